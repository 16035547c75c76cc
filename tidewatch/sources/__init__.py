"""Readers, writers and journals."""
