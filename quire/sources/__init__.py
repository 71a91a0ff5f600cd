"""Readers and the chunk store."""
