"""Readers, table-derived fixtures and the report sink."""
