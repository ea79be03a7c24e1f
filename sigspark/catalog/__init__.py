"""Queries over the star tables, by family, each with the SQL that gives the same rows."""
