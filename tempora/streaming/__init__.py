"""Operators on streams, each with a form for stored tables."""
