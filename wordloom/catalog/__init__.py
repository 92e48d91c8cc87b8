"""Queries over the star-schema and text tables, and the SQL that must give the same rows."""
