"""Connected components, as the rest of the library finds them."""

from tallyframe.operators.components import components

__all__ = ["components"]
