"""Registered queries: each runs an operator over the given tables, most beside equivalent SQL."""
