"""Canonical tables and point-in-time reads."""
