"""Readers and writers with fixed schemas."""
