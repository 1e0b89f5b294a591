"""Queries over the given tables, their SQL counterparts and the comparison of both."""
