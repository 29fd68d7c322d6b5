"""Logical relations that stand for the catalogue over the driver tables."""
