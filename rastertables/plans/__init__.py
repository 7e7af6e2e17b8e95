"""Catalog queries and the whole-scene run."""
