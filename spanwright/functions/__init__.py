"""Subpackage of spanwright."""
