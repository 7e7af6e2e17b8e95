"""Raster, mask and geometry operators."""
