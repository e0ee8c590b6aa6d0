"""Incremental jobs: process only what is not stored yet."""
