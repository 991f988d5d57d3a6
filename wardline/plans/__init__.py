"""Queries over the project tables and their SQL counterparts."""
