"""Satellite scene analytics as Spark plans.

Scenes, tiles, mask runs, polygons and processing events are DataFrames; every
operator takes DataFrames (or Columns) and returns DataFrames (or Columns).
"""
