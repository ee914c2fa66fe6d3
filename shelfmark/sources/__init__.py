"""Readers, keyed tables and test-data views."""
