"""Operators over the tables of a road map."""
