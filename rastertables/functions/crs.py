"""Pixel corner to WGS84 for geographic, Web Mercator, UTM and polar stereographic scenes."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

# WGS84 ellipsoid and UTM constants.
SEMI_MAJOR = 6378137.0
FLATTENING = 1 / 298.257223563
UTM_SCALE = 0.9996
UTM_FALSE_EASTING = 500000.0
UTM_FALSE_NORTHING_SOUTH = 10000000.0
# EPSG code, latitude of true scale and central meridian of the polar grids.
POLAR_GRIDS = {3413: (70.0, -45.0), 3995: (71.0, 0.0), 3976: (-70.0, 0.0), 3031: (-71.0, 0.0)}

_N = FLATTENING / (2 - FLATTENING)
_RECTIFYING = SEMI_MAJOR / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64 + _N**6 / 256)
_BETA = (
    _N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360,
    _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440,
    17 * _N**3 / 480 - 37 * _N**4 / 840,
    4397 * _N**4 / 161280,
)
_DELTA = (
    2 * _N - 2 * _N**2 / 3 - 2 * _N**3 + 116 * _N**4 / 45,
    7 * _N**2 / 3 - 8 * _N**3 / 5 - 227 * _N**4 / 45,
    56 * _N**3 / 15 - 136 * _N**4 / 35,
    4279 * _N**4 / 630,
)


def mercator_to_wgs84(x: Column, y: Column) -> tuple[Column, Column]:
    lon = x / F.lit(SEMI_MAJOR) * F.lit(180.0 / math.pi)
    lat = (F.lit(2.0) * F.atan(F.exp(y / F.lit(SEMI_MAJOR))) - F.lit(math.pi / 2)) * F.lit(180.0 / math.pi)
    return lon, lat


def _bind(value: Column, body) -> Column:
    """Evaluate `value` once and hand it to `body`; keeps the generated code small."""
    return F.transform(F.array(value), body)[0]


def _pair(first: Column, second: Column) -> Column:
    return F.struct(first.alias("u"), second.alias("v"))


def utm_to_wgs84(x: Column, y: Column, epsg: Column) -> Column:
    """Struct(lon, lat) by the Krueger series of the inverse transverse Mercator."""
    central = F.pmod(epsg, F.lit(100)) * 6.0 - 183.0
    northing = F.when(epsg >= 32700, y - UTM_FALSE_NORTHING_SOUTH).otherwise(y)
    scale = F.lit(UTM_SCALE * _RECTIFYING)

    def conformal_sphere(p: Column) -> Column:
        xi, eta = p["u"], p["v"]
        for j, beta in enumerate(_BETA, start=1):
            xi = xi - F.lit(beta) * F.sin(p["u"] * (2.0 * j)) * F.cosh(p["v"] * (2.0 * j))
            eta = eta - F.lit(beta) * F.cos(p["u"] * (2.0 * j)) * F.sinh(p["v"] * (2.0 * j))
        return _pair(xi, eta)

    def angles(p: Column) -> Column:
        lon = central + F.degrees(F.atan2(F.sinh(p["v"]), F.cos(p["u"])))
        return _pair(lon, F.asin(F.sin(p["u"]) / F.cosh(p["v"])))

    def geodetic(p: Column) -> Column:
        lat = p["v"]
        for j, delta in enumerate(_DELTA, start=1):
            lat = lat + F.lit(delta) * F.sin(p["v"] * (2.0 * j))
        return F.struct(p["u"].alias("lon"), F.degrees(lat).alias("lat"))

    start = _pair(northing / scale, (x - F.lit(UTM_FALSE_EASTING)) / scale)
    return _bind(_bind(_bind(start, conformal_sphere), angles), geodetic)


def polar_scale(true_latitude: float) -> float:
    """Distance from the pole per unit of the conformal radius, for a latitude of true scale."""
    phi = math.radians(abs(true_latitude))
    e = math.sqrt(FLATTENING * (2 - FLATTENING))
    bent = e * math.sin(phi)
    t = math.tan(math.pi / 4 - phi / 2) / ((1 - bent) / (1 + bent)) ** (e / 2)
    return SEMI_MAJOR * math.cos(phi) / math.sqrt(1 - bent * bent) / t


def polar_to_wgs84(x: Column, y: Column, epsg: Column) -> Column:
    """Struct(lon, lat) of a polar stereographic point; the pole has the longitude of its meridian."""
    def of(value) -> Column:
        cases = F.lit(None).cast("double")
        for code, settings in POLAR_GRIDS.items():
            cases = F.when(epsg == code, F.lit(float(value(*settings)))).otherwise(cases)
        return cases

    side = of(lambda lat, lon: math.copysign(1, lat))
    sphere = F.lit(math.pi / 2) - F.lit(2.0) * F.atan(F.hypot(x, y) / of(lambda lat, lon: polar_scale(lat)))
    turned = of(lambda lat, lon: lon) + F.degrees(F.atan2(x, -side * y))
    lon = F.when(turned < -180, turned + 360).when(turned > 180, turned - 360).otherwise(turned)

    def geodetic(p: Column) -> Column:
        lat = p["v"]
        for j, delta in enumerate(_DELTA, start=1):
            lat = lat + F.lit(delta) * F.sin(p["v"] * (2.0 * j))
        return F.struct(p["u"].alias("lon"), (side * F.degrees(lat)).alias("lat"))

    return _bind(_pair(lon, sphere), geodetic)


def is_utm(epsg: Column) -> Column:
    return epsg.between(32601, 32660) | epsg.between(32701, 32760)


def is_supported(epsg: Column) -> Column:
    """False for an unknown reference system and for none."""
    return F.coalesce(epsg.isin(4326, 3857, *POLAR_GRIDS) | is_utm(epsg), F.lit(False))


def pixel_to_wgs84(px: Column, py: Column) -> Column:
    """Struct(lon, lat) of a pixel corner, from the scene columns epsg and a..f.

    A scene without a reference system, or with an unknown one, gives NULL. It is a pure function
    of the integer grid node, so neighbouring tiles get identical shared corners.
    """
    epsg = F.col("epsg")
    x = F.col("a") * px + F.col("b") * py + F.col("c")
    y = F.col("d") * px + F.col("e") * py + F.col("f")
    point = lambda pair: F.struct(pair[0].alias("lon"), pair[1].alias("lat"))
    return (
        F.when(epsg == 4326, point((x, y)))
        .when(epsg == 3857, point(mercator_to_wgs84(x, y)))
        .when(is_utm(epsg), utm_to_wgs84(x, y, epsg))
        .when(epsg.isin(*POLAR_GRIDS), polar_to_wgs84(x, y, epsg))
    )
