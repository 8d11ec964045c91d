import math

import pytest
from pyspark.sql import functions as F

from waymark.functions import geo


def value(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


@pytest.mark.parametrize(
    "a, b, most, same", [(-1.0, 350.0, 90, True), (90.0, -1.0, 90, True), (0.0, 91.0, 90, False), (0.0, 89.0, 90, True), (365.0, 5.0, 0, True), (350.0, 10.0, 20, True), (float("nan"), 5.0, 1, True)]
)
def test_heading_matches(spark, a, b, most, same):
    assert value(spark, geo.heading_matches(F.lit(a), F.lit(b), most)) is same


def test_null_heading_is_unknown(spark):
    assert value(spark, geo.normalize_heading(F.lit(None).cast("double"))) is None
    assert value(spark, geo.normalize_heading(F.lit(719.0))) == 359.0


def test_raw_turn_takes_unknown_as_359(spark):
    assert value(spark, geo.raw_turn(F.lit(-1.0), F.lit(10.0))) == pytest.approx(11.0)
    assert value(spark, geo.raw_turn(F.lit(355.0), F.lit(10.0))) == pytest.approx(15.0)


def test_haversine_crosses_the_180th_meridian(spark):
    d = value(spark, geo.haversine(10.0, 179.9999, 10.0, -179.9999))
    assert d == pytest.approx(math.radians(0.0002) * geo.EARTH_RADIUS_M * math.cos(math.radians(10)), rel=1e-6)
    assert value(spark, geo.haversine(90.0, 0.0, -90.0, 0.0)) == pytest.approx(math.pi * geo.EARTH_RADIUS_M)


@pytest.mark.parametrize("lat, lon, ok", [(0.0, 0.0, False), (0.0, 1.0, True), (90.0, 180.0, True), (90.1, 0.0, False), (1.0, -180.1, False), (None, 1.0, False)])
def test_usable_position(spark, lat, lon, ok):
    row = spark.createDataFrame([(lat, lon)], "lat double, lon double")
    assert row.select(geo.usable_position().alias("x")).first().x is ok


def test_utm(spark):
    def xy(lat, lon):
        zone = int(math.floor((lon + 180) / 6)) + 1
        return spark.range(1).select(*[c.alias(n) for c, n in zip(geo.utm_xy(F.lit(lat), F.lit(lon), zone), "xy")]).first()

    # On the central meridian the northing is the scaled meridian arc, the easting 500 km.
    p = xy(52.0, 9.0)
    assert p.x == pytest.approx(500_000, abs=1e-6)
    # The arc by numerical integration.
    e2 = geo.WGS84_F * (2 - geo.WGS84_F)
    n = 200_000
    arc = sum(geo.WGS84_A * (1 - e2) / (1 - e2 * math.sin(math.radians(52) * (i + 0.5) / n) ** 2) ** 1.5 for i in range(n)) * math.radians(52) / n
    assert p.y == pytest.approx(0.9996 * arc, abs=1e-3)
    q = xy(52.0001, 9.0)
    assert q.y - p.y == pytest.approx(11.12, abs=0.02)
    assert value(spark, geo.utm_epsg(F.lit(-33.9), F.lit(18.4))) == 32734


def test_bearing(spark):
    assert value(spark, geo.bearing(F.lit(1.0), F.lit(0.0))) == pytest.approx(90)
    assert value(spark, geo.bearing(F.lit(-1.0), F.lit(0.0))) == pytest.approx(270)


def test_tiles_go_round(spark):
    x, y = value(spark, geo.tile_x(8.05, 14)), value(spark, geo.tile_y(52.28, 14))
    lon0, lon1 = (value(spark, geo.tile_pixel_to_lon(F.lit(x), F.lit(p), 14)) for p in (0, 4096))
    lat0, lat1 = (value(spark, geo.tile_pixel_to_lat(F.lit(y), F.lit(p), 14)) for p in (0, 4096))
    assert lon0 <= 8.05 <= lon1 and lat0 <= 52.28 <= lat1
