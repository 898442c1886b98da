"""Readers, writers, catalog helpers and role views."""
