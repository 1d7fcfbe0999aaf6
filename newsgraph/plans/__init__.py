"""Views over the given tables, named queries and their SQL counterparts."""
