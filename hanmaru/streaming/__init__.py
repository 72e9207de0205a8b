"""Keyed sessions and time limits over event streams."""
