"""Synthetic maps and the registered queries over them."""
