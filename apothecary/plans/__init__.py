"""Registered queries: each composes the library's operators over the given tables."""
