"""Readers, writers and the test views."""
