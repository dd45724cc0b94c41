"""Relational operators of the four pipelines, as views and named queries."""
