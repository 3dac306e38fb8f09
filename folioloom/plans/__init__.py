"""Adapters, registered queries and their SQL counterparts."""
