"""Linkage of streams."""
