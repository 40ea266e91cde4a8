"""Registered queries with their SQL checks, and the stand-in tables both read."""
