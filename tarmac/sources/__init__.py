"""Readers, writers and format guards."""
