"""Readers and writers for track files and stage outputs."""
