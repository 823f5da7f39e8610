"""Registered queries: each binds operators to tables and carries the equivalent SQL."""
