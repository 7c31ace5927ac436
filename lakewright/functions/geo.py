"""Coordinates and grid cells as column arithmetic."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# The local metric frame and the ellipsoid.
REFERENCE_LATITUDE = 35.71
METRES_A_DEGREE = 111_320.0
GRS80_A, GRS80_F = 6378137.0, 1 / 298.257222101
US_FOOT = 1200 / 3937
FEET = {"ft": 0.3048, "ftUS": US_FOOT}
FOOT_NAMES = ("foot", "feet", "[ft_i]")


def local_xy(lat: Column, lon: Column) -> tuple[Column, Column]:
    """Equirectangular metres around the reference latitude."""
    return lon * (METRES_A_DEGREE * math.cos(math.radians(REFERENCE_LATITUDE))), lat * METRES_A_DEGREE


def metres(value: Column, uom: Column) -> Column:
    """A length in metres; an unknown or missing unit counts as metres."""
    unit = F.regexp_extract(F.coalesce(uom, F.lit("")), r"([^:#]*)$", 1)
    out = F.lit(1.0)
    for name, size in FEET.items():
        out = F.when(unit == name, F.lit(size)).otherwise(out)
    return value * F.when(F.lower(unit).isin(*FOOT_NAMES), F.lit(0.3048)).otherwise(out)


def utm_inverse(e: Column, n: Column, zone: Column) -> tuple[Column, Column]:
    """(lat, lon) in degrees of northern UTM coordinates, by the usual series."""
    a, f = GRS80_A, GRS80_F
    e2 = f * (2 - f)
    e1 = (1 - math.sqrt(1 - e2)) / (1 + math.sqrt(1 - e2))
    k0 = 0.9996
    mu = n / (k0 * a * (1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256))
    series = (3 * e1 / 2 - 27 * e1**3 / 32, 21 * e1**2 / 16 - 55 * e1**4 / 32, 151 * e1**3 / 96, 1097 * e1**4 / 512)
    phi = mu
    for i, c in enumerate(series):
        phi = phi + F.lit(c) * F.sin(mu * (2 * (i + 1)))
    ep2 = e2 / (1 - e2)
    sin, cos, tan = F.sin(phi), F.cos(phi), F.tan(phi)
    c1, t1 = cos * cos * ep2, tan * tan
    w = F.lit(1.0) - sin * sin * e2
    n1 = F.lit(a) / F.sqrt(w)
    r1 = F.lit(a * (1 - e2)) / (w * F.sqrt(w))
    d = (e - 500000.0) / (n1 * k0)
    p = [None, d] + [F.pow(d, F.lit(float(i))) for i in range(2, 7)]
    lat = phi - (n1 * tan / r1) * (
        p[2] / 2
        - (F.lit(5.0) + t1 * 3 + c1 * 10 - c1 * c1 * 4 - 9 * ep2) * p[4] / 24
        + (F.lit(61.0) + t1 * 90 + c1 * 298 + t1 * t1 * 45 - 252 * ep2 - c1 * c1 * 3) * p[6] / 720
    )
    lon = (p[1] - (F.lit(1.0) + t1 * 2 + c1) * p[3] / 6 + (F.lit(5.0) - c1 * 2 + t1 * 28 - c1 * c1 * 3 + 8 * ep2 + t1 * t1 * 24) * p[5] / 120) / cos
    return F.degrees(lat), F.degrees(lon) + (zone * 6 - 183)


def utm_forward(lat: Column, lon: Column, zone: Column) -> tuple[Column, Column]:
    """(easting, northing) in metres of degrees, northern hemisphere, by the usual series."""
    a, f = GRS80_A, GRS80_F
    e2 = f * (2 - f)
    ep2, k0 = e2 / (1 - e2), 0.9996
    phi = F.radians(lat)
    sin, cos, tan = F.sin(phi), F.cos(phi), F.tan(phi)
    n = F.lit(a) / F.sqrt(F.lit(1.0) - sin * sin * e2)
    t, c = tan * tan, cos * cos * ep2
    arc = F.radians(lon - (zone * 6 - 183)) * cos
    p = [None, arc] + [F.pow(arc, F.lit(float(i))) for i in range(2, 7)]
    m = (
        phi * (1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256)
        - F.sin(phi * 2) * (3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024)
        + F.sin(phi * 4) * (15 * e2**2 / 256 + 45 * e2**3 / 1024)
        - F.sin(phi * 6) * (35 * e2**3 / 3072)
    ) * a
    east = (p[1] + (F.lit(1.0) - t + c) * p[3] / 6 + (F.lit(5.0) - t * 18 + t * t + c * 72 - 58 * ep2) * p[5] / 120) * n * k0 + 500000.0
    north = (m + n * tan * (p[2] / 2 + (F.lit(5.0) - t + c * 9 + c * c * 4) * p[4] / 24 + (F.lit(61.0) - t * 58 + t * t + c * 600 - 330 * ep2) * p[6] / 720)) * k0
    return east, north


def lcc_inverse(e_ft: Column, n_ft: Column) -> tuple[Column, Column]:
    """(lat, lon) of the two-parallel conic of EPSG:2263, in US feet."""
    e = math.sqrt(GRS80_F * (2 - GRS80_F))
    lat1, lat2 = math.radians(41 + 2 / 60), math.radians(40 + 40 / 60)
    lat0, lon0 = math.radians(40 + 10 / 60), math.radians(-74.0)

    def m(phi: float) -> float:
        return math.cos(phi) / math.sqrt(1 - (e * math.sin(phi)) ** 2)

    def t(phi: float) -> float:
        return math.tan(math.pi / 4 - phi / 2) / ((1 - e * math.sin(phi)) / (1 + e * math.sin(phi))) ** (e / 2)

    n = math.log(m(lat1) / m(lat2)) / math.log(t(lat1) / t(lat2))
    big = m(lat1) / (n * t(lat1) ** n)
    rho0 = GRS80_A * big * t(lat0) ** n
    x = e_ft * US_FOOT - 984250.0 * US_FOOT
    y = F.lit(rho0) - n_ft * US_FOOT
    tp = F.pow(F.sqrt(x * x + y * y) / (GRS80_A * big), F.lit(1 / n))
    phi = F.lit(math.pi / 2) - F.atan(tp) * 2
    for _ in range(6):
        s = F.sin(phi) * e
        phi = F.lit(math.pi / 2) - F.atan(tp * F.pow((F.lit(1.0) - s) / (F.lit(1.0) + s), F.lit(e / 2))) * 2
    return F.degrees(phi), F.degrees(F.atan2(x, y) / n + lon0)


def mesh_bounds(code: Column) -> dict[str, Column]:
    """South-west corner and size, in degrees, of an 8-digit third mesh or 9-digit quarter."""
    d = lambda i, n=1: F.substring(code, i, n).cast("int")
    south = d(1, 2) * F.lit(1.0) / 1.5 + d(5) * F.lit(1.0) / 12 + d(7) * F.lit(1.0) / 120
    west = d(3, 2) + F.lit(100.0) + d(6) * F.lit(1.0) / 8 + d(8) * F.lit(1.0) / 80
    quarter = F.length(code) == 9
    q = F.when(quarter, d(9)).otherwise(0)
    high = F.when(quarter, F.lit(1 / 240)).otherwise(F.lit(1 / 120))
    wide = F.when(quarter, F.lit(1 / 160)).otherwise(F.lit(1 / 80))
    return {
        "south": south + F.when(q >= 3, F.lit(1 / 240)).otherwise(0.0),
        "west": west + F.when(q.isin(2, 4), F.lit(1 / 160)).otherwise(0.0),
        "height": high,
        "width": wide,
    }


def quadrant(lat: Column, lon: Column, mid_lat: Column, mid_lon: Column) -> Column:
    """1 south-west, 2 south-east, 3 north-west, 4 north-east; a point on a middle line goes north or east."""
    return F.lit(1) + F.when(lon >= mid_lon, 1).otherwise(0) + F.when(lat >= mid_lat, 2).otherwise(0)


def clamped_cell(v: Column, low: Column, size: Column, n: int) -> Column:
    """Index of the cell that holds ``v``, clamped to 0..n-1."""
    return F.greatest(F.least(F.floor((v - low) / size), F.lit(n - 1)), F.lit(0)).cast("int")


def shoelace(xs: Column, ys: Column) -> Column:
    """Unsigned area of a closed ring given as arrays of coordinates."""
    n = F.size(xs)
    cross = F.transform(F.sequence(F.lit(0), n - 2), lambda i: F.get(xs, i) * F.get(ys, i + 1) - F.get(xs, i + 1) * F.get(ys, i))
    return F.abs(F.aggregate(cross, F.lit(0.0), lambda acc, v: acc + v)) / 2


def pos_list(text: Column) -> Column:
    """array<struct<a, b, z>> from a list of coordinate triples, closed; null unless at least four triples fit."""
    v = F.transform(F.filter(F.split(F.trim(text), r"\s+"), lambda x: x != ""), lambda x: x.try_cast("double"))
    n = F.size(v)
    pts = F.transform(
        F.sequence(F.lit(0), F.greatest(F.floor(n / 3).cast("int") - 1, F.lit(0))),
        lambda i: F.struct(F.get(v, i * 3).alias("a"), F.get(v, i * 3 + 1).alias("b"), F.get(v, i * 3 + 2).alias("z")),
    )
    closed = F.when(F.element_at(pts, 1) == F.element_at(pts, -1), pts).otherwise(F.concat(pts, F.slice(pts, 1, 1)))
    return F.when((n >= 9) & (n % 3 == 0) & ~F.exists(v, lambda x: x.isNull()), closed)
