"""Corners, boxes and box predicates. Every function yields Columns only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F


@dataclass(frozen=True)
class Box:
    """Four Columns of a box in degrees."""

    west: Column
    south: Column
    east: Column
    north: Column

    @classmethod
    def of(cls, prefix: str = "") -> "Box":
        return cls(*(F.col(prefix + side) for side in ("west", "south", "east", "north")))

    def columns(self, prefix: str = "") -> list[Column]:
        return [self.west.alias(prefix + "west"), self.south.alias(prefix + "south"),
                self.east.alias(prefix + "east"), self.north.alias(prefix + "north")]


CORNERS = ("top_left", "top_right", "bottom_right", "bottom_left")


def filled_corners() -> dict[str, Column]:
    """Corner columns with the missing ones of old rows taken from the other diagonal."""
    c = F.col
    return {
        "top_left_lon": c("top_left_lon"),
        "top_left_lat": c("top_left_lat"),
        "top_right_lon": F.coalesce(c("top_right_lon"), c("bottom_right_lon")),
        "top_right_lat": F.coalesce(c("top_right_lat"), c("top_left_lat")),
        "bottom_right_lon": c("bottom_right_lon"),
        "bottom_right_lat": c("bottom_right_lat"),
        "bottom_left_lon": F.coalesce(c("bottom_left_lon"), c("top_left_lon")),
        "bottom_left_lat": F.coalesce(c("bottom_left_lat"), c("bottom_right_lat")),
    }


def tile_bbox(corners: dict[str, Column] | None = None) -> Box:
    """Box over the four corners; works on old rows too."""
    corners = corners or filled_corners()
    lon = [corners[f"{name}_lon"] for name in CORNERS]
    lat = [corners[f"{name}_lat"] for name in CORNERS]
    return Box(F.least(*lon), F.least(*lat), F.greatest(*lon), F.greatest(*lat))


def bounds_intersect(a: Box, b: Box) -> Column:
    """Closed-interval overlap on both axes."""
    return (a.east >= b.west) & (a.west <= b.east) & (a.north >= b.south) & (a.south <= b.north)


def padded_bounds(box: Box, ratio: float) -> Box:
    """Box grown on each side by ratio times its size."""
    dx, dy = (box.east - box.west) * ratio, (box.north - box.south) * ratio
    return Box(box.west - dx, box.south - dy, box.east + dx, box.north + dy)


def normalize_bbox(value: Column) -> Column:
    """Four decimals; NULL stays NULL."""
    return F.round(value, 4)


def corner_delta(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Largest coordinate difference of two points, in degrees."""
    return F.greatest(F.abs(lon1 - lon2), F.abs(lat1 - lat2))


def point(lon: Column, lat: Column) -> Column:
    return F.struct(lon.alias("lon"), lat.alias("lat"))


def bounds_polygon(box: Box) -> Column:
    """Closed rectangle ring, counter-clockwise from the south-west corner."""
    return F.array(
        point(box.west, box.south), point(box.east, box.south), point(box.east, box.north),
        point(box.west, box.north), point(box.west, box.south),
    )
