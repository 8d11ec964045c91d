"""Geography and headings as column expressions (G1-G8, S16-S18 of the inventory)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: mean Earth radius in metres.
EARTH_RADIUS_M = 6_371_000.0
#: Fixed values of WGS 84: semi-major axis, flattening, UTM scale and false easting.
WGS84_A, WGS84_F, UTM_K0, UTM_E0 = 6_378_137.0, 1 / 298.257223563, 0.9996, 500_000.0


def _c(x: Column | str | float) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(float(x))


def haversine(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle distance in metres; null if any input is null."""
    lat1, lon1, lat2, lon2 = map(_c, (lat1, lon1, lat2, lon2))
    h = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * EARTH_RADIUS_M) * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def usable_position(lat="lat", lon="lon") -> Column:
    """True if both are known, not both zero, and within +-90 and +-180 degrees."""
    lat, lon = _c(lat), _c(lon)
    inside = lat.between(-90.0, 90.0) & lon.between(-180.0, 180.0)
    return F.coalesce(inside & ~((lat == 0) & (lon == 0)), F.lit(False))


def normalize_heading(angle) -> Column:
    """Heading in [0, 360); null for null, NaN and negative (unknown) angles."""
    angle = _c(angle)
    return F.when((angle >= 0) & ~F.isnan(angle), F.pmod(angle, F.lit(360.0)))


def heading_difference(a, b) -> Column:
    """Smaller angle between two headings; null if either is unknown."""
    d = F.abs(normalize_heading(a) - normalize_heading(b))
    return F.least(d, 360.0 - d)


def heading_matches(a, b, max_degrees: float) -> Column:
    """True within ``max_degrees`` (inclusive) or if either heading is unknown."""
    return F.coalesce(heading_difference(a, b) <= max_degrees, F.lit(True))


def raw_turn(a, b) -> Column:
    """Angle between two raw compass values on the circle, -1 taken as 359 degrees."""
    return F.abs(F.pmod(_c(a) - _c(b) + 180.0, F.lit(360.0)) - 180.0)


def local_xy(lat, lon, lat0, lon0) -> tuple[Column, Column]:
    """Metres east and north of (lat0, lon0) in a local equirectangular plane."""
    lat, lon, lat0, lon0 = map(_c, (lat, lon, lat0, lon0))
    return F.radians(lon - lon0) * F.cos(F.radians(lat0)) * EARTH_RADIUS_M, F.radians(lat - lat0) * EARTH_RADIUS_M


def bearing(dx, dy) -> Column:
    """Compass bearing of a metric offset, in [0, 360)."""
    return F.pmod(F.degrees(F.atan2(_c(dx), _c(dy))), F.lit(360.0))


def utm_zone(lon) -> Column:
    return F.least(F.floor((_c(lon) + 180.0) / 6.0) + 1, F.lit(60)).cast("int")


def utm_epsg(lat, lon) -> Column:
    """EPSG code 326xx (north) or 327xx (south) of a position, usually the mean of a city."""
    return F.when(_c(lat) >= 0, F.lit(32600)).otherwise(F.lit(32700)) + utm_zone(lon)


def utm_xy(lat, lon, zone) -> tuple[Column, Column]:
    """UTM easting and northing (m, north of the equator) by the third-order Krueger series."""
    lat, lon = _c(lat), _c(lon)
    zone = F.lit(zone) if isinstance(zone, int) else zone
    n = WGS84_F / (2 - WGS84_F)
    a = WGS84_A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    e = 2 * math.sqrt(n) / (1 + n)
    s = F.sin(F.radians(lat))
    t = F.sinh(F.atanh(s) - e * F.atanh(e * s))
    dl = F.radians(lon - (zone * 6 - 183))
    xi, eta = F.atan2(t, F.cos(dl)), F.atanh(F.sin(dl) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for j, c in enumerate(alpha, 1):
        x = x + c * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + c * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return UTM_E0 + UTM_K0 * a * x, UTM_K0 * a * y


def tile_x(lon, zoom: int) -> Column:
    return ((_c(lon) + 180.0) / 360.0 * float(1 << zoom)).cast("long")


def tile_y(lat, zoom: int) -> Column:
    return ((1.0 - F.asinh(F.tan(F.radians(_c(lat)))) / math.pi) / 2.0 * float(1 << zoom)).cast("long")


def tile_pixel_to_lon(x_tile, px, zoom: int, extent: int = 4096) -> Column:
    return (_c(x_tile) + _c(px) / float(extent)) / float(1 << zoom) * 360.0 - 180.0


def tile_pixel_to_lat(y_tile, py, zoom: int, extent: int = 4096) -> Column:
    """Latitude of a pixel whose y counts from the bottom of the tile."""
    y = (_c(y_tile) + (1.0 - _c(py) / float(extent))) / float(1 << zoom)
    return F.degrees(F.atan(F.sinh(math.pi * (1.0 - 2.0 * y))))
