"""Readers, writers and the fetch boundary."""
