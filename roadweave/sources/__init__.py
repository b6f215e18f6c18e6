"""Readers and writers of road maps."""
