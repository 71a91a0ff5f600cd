"""Registered queries and, next to each, the SQL that gives the same rows."""
