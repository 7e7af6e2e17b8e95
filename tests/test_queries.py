"""Registered queries beside their SQL. Long runs are left to tools/check_queries.py."""

import pytest

import oracles
from rastertables.queries import REGISTRY
from tools.check_queries import compare, database

LONG = {
    "ingest_stream", "ingested_exports", "ingested_masks", "rebuild_exports", "scene_status", "processed_polygons", "processed_masks", "process_scenes",
    "segment_with_model", "upsert_tiles", "task_state_stream", "log_stream", "notification_stream", "dedup_keys",
    "overlay_colours", "standardise_rgb", "stretch", "tile_names", "number_tiles", "drop_black_tiles", "centre_land",
    "clip_polygons_to_water", "clip_mask_to_water", "union_land", "merge_masks", "scan_events", "tile_corners",
    "scene_outlines", "progress_events", "rasterize_land", "retry_failed", "scene_status_with_failures", "merge_masks_closing_gaps",
}


@pytest.fixture(scope="module")
def connection(sf_dir):
    return database(sf_dir)


def test_every_check_has_a_query():
    assert set(oracles.CHECKS) <= set(REGISTRY)
    assert LONG <= set(oracles.CHECKS)


@pytest.mark.parametrize("name", [n for n in oracles.CHECKS if n not in LONG])
def test_query_equals_sql(spark, connection, sf_dir, name):
    assert compare(REGISTRY[name](spark, sf_dir), connection, oracles.statements()[name]) == ""


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
