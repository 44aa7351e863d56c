"""Queries over the driver tables, each with its SQL statement where SQL can say it."""
