"""Stored intermediate tables and the two end-to-end measures."""
