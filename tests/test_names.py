from datetime import datetime

import pytest
from pyspark.sql import functions as F

from rastertables.functions import names, overlay


def one(spark, column, **values):
    literals = [F.lit(v).alias(k) for k, v in values.items()] or [F.lit(0).alias("_")]
    return spark.range(1).select(*literals).select(column.alias("out")).first()["out"]


@pytest.mark.parametrize("key,safe,stem", [
    ("raw/a b.tif", "a_b", "a b"),
    ("raw/.tif", "tif", ".tif"),
    ("raw/a..tif", "a", "a."),
    ("raw/x.y.TIFF", "x_y", "x.y"),
    ("noext", "noext", "noext"),
    ("raw/___.tif", "source", "___"),
    ("", "source", ""),
    ("raw/dir/", "source", ""),
    ("raw/снимок-1.tif", "-1", "снимок-1"),
])
def test_source_names(spark, key, safe, stem):
    assert one(spark, names.safe_source_name(F.col("k")), k=key) == safe
    assert one(spark, names.stem(F.col("k")), k=key) == stem


@pytest.mark.parametrize("key,date", [
    ("raw/S1_20240131.tif", "2024-01-31"), ("x/2024-01_31z", "2024-01-31"),
    ("2099-9999", "2099-99-99"), ("raw/19990101.tif", None), ("1920240131", "2024-01-31"), ("", None),
])
def test_extract_date(spark, key, date):
    assert one(spark, names.extract_date(F.col("k")), k=key) == date


@pytest.mark.parametrize("raw,color", [
    ("#ABC", "aabbcc"), (" ##12aB9f ", "12ab9f"), ("12345", "2d6a4f"), ("xyzxyz", "2d6a4f"), (None, "2d6a4f"), ("", "2d6a4f"),
])
def test_colours(spark, raw, color):
    assert one(spark, names.sanitize_hex_color(F.lit(raw).cast("string"))) == color


def test_tile_names_keep_large_numbers(spark):
    name = names.tile_filename(F.lit("raw/s.tif"), F.lit(12345), F.lit(True))
    assert one(spark, name) == "tile_s_12345.png"
    assert one(spark, names.mask_filename(F.lit("raw/s.tif"), F.lit(7))) == "mask_s_0007.png"


def test_percent_encoding(spark):
    assert one(spark, names.percent_encode(F.lit("a b/é*~+&.-_"))) == "a%20b%2F%C3%A9%2A~%2B%26.-_"


@pytest.mark.parametrize("moment", [datetime(2024, 1, 2, 3, 4, 5), datetime(2024, 1, 2, 3, 4, 5, 60)])
def test_iso_timestamp(spark, moment):
    assert one(spark, names.iso_timestamp(F.lit(moment))) == moment.isoformat()


@pytest.mark.parametrize("status,stage,current,total,text", [
    ("processing", "slice", 3, 10, "processing / slice (3/10)"), ("failed", None, 3, 0, "failed"),
    (None, None, None, None, "unknown"), ("processed", "", None, 4, "processed (0/4)"),
])
def test_status_label(spark, status, stage, current, total, text):
    column = names.status_label(
        F.lit(status).cast("string"), F.lit(stage).cast("string"), F.lit(current).cast("int"), F.lit(total).cast("int"))
    assert one(spark, column) == text


@pytest.mark.parametrize("alpha,expected", [(0, 0), (7, 0), (8, 5), (255, 183), (100, 72)])
def test_overlay_alpha(spark, alpha, expected):
    assert one(spark, overlay.overlay_alpha(F.lit(alpha))) == expected
