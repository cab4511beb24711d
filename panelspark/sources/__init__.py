"""Readers, writers and artifact contracts."""
