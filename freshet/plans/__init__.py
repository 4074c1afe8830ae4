"""Queries that bind operators to tables, with SQL that states the same."""
