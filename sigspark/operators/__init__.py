"""Relational operators beyond the built-in ones: guards, grids, routing, as-of joins, rolling frames, moments."""
