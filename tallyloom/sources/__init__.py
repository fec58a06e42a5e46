"""Readers, writers and input parsers."""
