"""Queries over the project's tables, each with the SQL it is checked against."""
