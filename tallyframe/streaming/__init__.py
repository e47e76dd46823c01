"""Arriving files, each handled once."""
