"""The queries over the standard tables, each with the SQL that it must agree with where SQL can say it."""
