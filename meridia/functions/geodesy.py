"""Distances, directions and projections of longitudes and latitudes in degrees."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import geometry as G

#: Mean radius of the ellipsoid, and the WGS 84 ellipsoid itself.
RADIUS, A, FLAT = 6371008.771415, 6378137.0, 1 / 298.257223563


def _rad(*values) -> list[Column]:
    return [F.radians(G.number(v)) for v in values]


def central_angle(lon1, lat1, lon2, lat2) -> Column:
    a, b, c, d = _rad(lon1, lat1, lon2, lat2)
    h = F.pow(F.sin((d - b) / 2), 2) + F.cos(b) * F.cos(d) * F.pow(F.sin((c - a) / 2), 2)
    return 2 * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def haversine(lon1, lat1, lon2, lat2, radius: float = RADIUS) -> Column:
    return central_angle(lon1, lat1, lon2, lat2) * radius


def bearing(lon1, lat1, lon2, lat2) -> Column:
    """Initial course in degrees, 0 to 360, clockwise from north."""
    _, b, _, d = _rad(lon1, lat1, lon2, lat2)
    over = F.radians(G.number(lon2) - G.number(lon1))  # degrees taken off each other lose less than radians
    t = F.degrees(F.atan2(F.sin(over) * F.cos(d), F.cos(b) * F.sin(d) - F.sin(b) * F.cos(d) * F.cos(over)))
    # added only where it has to be: what is added and taken off again costs digits
    return F.when(t < 0, t + 360.0).otherwise(t)


def wrap(lon: Column) -> Column:
    return F.pmod(lon + 180.0, F.lit(360.0)) - 180.0


def destination(lon, lat, degrees, distance, radius: float = RADIUS) -> Column:
    """Struct lon, lat reached on a great circle."""
    a, b, t = _rad(lon, lat, degrees)
    s = G.number(distance) / radius
    y = F.asin(F.sin(b) * F.cos(s) + F.cos(b) * F.sin(s) * F.cos(t))
    x = a + F.atan2(F.sin(t) * F.sin(s) * F.cos(b), F.cos(s) - F.sin(b) * F.sin(y))
    return F.struct(wrap(F.degrees(x)).alias("lon"), F.degrees(y).alias("lat"))


def cross_track(lon, lat, lon1, lat1, lon2, lat2, radius: float = RADIUS) -> Column:
    """Signed distance of a point from a great circle, positive on its left."""
    s = central_angle(lon1, lat1, lon, lat)
    turn = F.radians(bearing(lon1, lat1, lon2, lat2) - bearing(lon1, lat1, lon, lat))
    return F.asin(F.sin(s) * F.sin(turn)) * radius


def midpoint(lon1, lat1, lon2, lat2) -> Column:
    a, b, c, d = _rad(lon1, lat1, lon2, lat2)
    bx, by = F.cos(d) * F.cos(c - a), F.cos(d) * F.sin(c - a)
    lat = F.atan2(F.sin(b) + F.sin(d), F.sqrt((F.cos(b) + bx) * (F.cos(b) + bx) + by * by))
    return F.struct(wrap(F.degrees(a + F.atan2(by, F.cos(b) + bx))).alias("lon"), F.degrees(lat).alias("lat"))


def _isometric(lat: Column) -> Column:
    return F.log(F.tan(math.pi / 4 + lat / 2))


def rhumb_distance(lon1, lat1, lon2, lat2, radius: float = RADIUS) -> Column:
    """Length of the line of constant course on a sphere."""
    a, b, c, d = _rad(lon1, lat1, lon2, lat2)
    dp, dl = _isometric(d) - _isometric(b), F.abs(c - a)
    dl = F.when(dl > math.pi, 2 * math.pi - dl).otherwise(dl)
    q = F.when(F.abs(dp) > 1e-12, (d - b) / dp).otherwise(F.cos(b))
    return F.hypot(d - b, q * dl) * radius


def rhumb_bearing(lon1, lat1, lon2, lat2) -> Column:
    a, b, c, d = _rad(lon1, lat1, lon2, lat2)
    dl = c - a
    dl = F.when(dl > math.pi, dl - 2 * math.pi).when(dl < -math.pi, dl + 2 * math.pi).otherwise(dl)
    return F.pmod(F.degrees(F.atan2(dl, _isometric(d) - _isometric(b))) + 360.0, F.lit(360.0))


def inverse(lon1, lat1, lon2, lat2, a: float = A, f: float = FLAT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(metres, azimuth at the start, azimuth at the end) of geodesics on an ellipsoid, in arrays of degrees.

    Vincenty's steps where they settle. Elsewhere, near antipodes, the azimuth at the start by
    bisection: it decides where the geodesic comes to the other latitude, by integrals over the
    auxiliary sphere.
    """
    lon1, lat1, lon2, lat2 = np.broadcast_arrays(*(np.asarray(x, float) for x in (lon1, lat1, lon2, lat2)))
    with np.errstate(all="ignore"):
        u1, u2 = np.arctan((1 - f) * np.tan(np.radians(lat1))), np.arctan((1 - f) * np.tan(np.radians(lat2)))
        dl = np.radians(lon2 - lon1 - 360 * np.round((lon2 - lon1) / 360))
        s1, c1, s2, c2 = np.sin(u1), np.cos(u1), np.sin(u2), np.cos(u2)
        lam, move = dl.copy(), np.full(dl.shape, np.inf)
        for _ in range(40):
            x, y = c2 * np.sin(lam), c1 * s2 - s1 * c2 * np.cos(lam)
            ss, cs = np.hypot(x, y), s1 * s2 + c1 * c2 * np.cos(lam)
            sigma = np.arctan2(ss, cs)
            sa = np.where(ss > 0, c1 * c2 * np.sin(lam) / np.where(ss > 0, ss, 1), 0)
            ca2 = 1 - sa * sa
            cm = np.where(ca2 > 1e-15, cs - 2 * s1 * s2 / np.where(ca2 > 1e-15, ca2, 1), 0)
            cc = f / 16 * ca2 * (4 + f * (4 - 3 * ca2))
            new = dl + (1 - cc) * f * sa * (sigma + cc * ss * (cm + cc * cs * (-1 + 2 * cm * cm)))
            move, lam = np.abs(new - lam), new
            if not (move > 1e-13).any():
                break
        u = ca2 * f * (2 - f) / (1 - f) ** 2
        aa = 1 + u / 16384 * (4096 + u * (-768 + u * (320 - 175 * u)))
        bb = u / 1024 * (256 + u * (-128 + u * (74 - 47 * u)))
        ds = bb * ss * (cm + bb / 4 * (cs * (-1 + 2 * cm * cm) - bb / 6 * cm * (-3 + 4 * ss * ss) * (-3 + 4 * cm * cm)))
        metres = a * (1 - f) * aa * (sigma - ds)
        first, last = np.arctan2(c2 * np.sin(lam), c1 * s2 - s1 * c2 * np.cos(lam)), np.arctan2(c1 * np.sin(lam), -s1 * c2 + c1 * s2 * np.cos(lam))
    out = np.array(metres), np.degrees(first) % 360, np.degrees(last) % 360
    odd = np.flatnonzero(((move > 1e-12) | (np.abs(lam) > np.pi)).ravel() & np.isfinite(dl + u1 + u2).ravel())
    if len(odd):
        got = _antipodal(*(x.ravel()[odd] for x in (dl, u1, u2)), a, f)
        for k in range(3):
            out[k].ravel()[odd] = got[k]
    return out


def _antipodal(dl, u1, u2, a, f):
    """As inverse, from differences of longitude and reduced latitudes in radians, by bisection."""
    nodes, weights = np.polynomial.legendre.leggauss(24)
    east, dl = np.where(dl < 0, -1.0, 1.0), np.abs(dl)
    swap = np.abs(u1) < np.abs(u2)
    b1, b2 = np.where(swap, u2, u1), np.where(swap, u1, u2)
    north = np.where(b1 > 0, -1.0, 1.0)
    b1, b2 = np.minimum(b1 * north, -1e-15), b2 * north  # the start is south of the equator, and the farther from it

    def walk(alpha):
        s0 = np.sin(alpha) * np.cos(b1)
        c0 = np.sqrt(np.maximum(0, 1 - s0 * s0))
        ca2 = np.sqrt(np.maximum(0, np.cos(alpha) ** 2 * np.cos(b1) ** 2 + np.cos(b2) ** 2 - np.cos(b1) ** 2))
        g1, g2 = np.arctan2(np.sin(b1), np.cos(alpha) * np.cos(b1)), np.arctan2(np.sin(b2), ca2)
        w = np.arctan2(s0 * np.sin(g2), np.cos(g2)) - np.arctan2(s0 * np.sin(g1), np.cos(g1))
        w = np.where(w < 0, w + 2 * np.pi, w)
        k2 = f * (2 - f) / (1 - f) ** 2 * c0 * c0
        at = (g2 + g1)[:, None] / 2 + (g2 - g1)[:, None] / 2 * nodes
        root = np.sqrt(1 + k2[:, None] * np.sin(at) ** 2)
        half = (g2 - g1) / 2
        lam = w - f * s0 * half * (((2 - f) / (1 + (1 - f) * root)) @ weights)
        return lam, a * (1 - f) * half * (root @ weights), np.arctan2(np.sin(alpha) * np.cos(b1) / np.maximum(np.cos(b2), 1e-300), ca2 / np.maximum(np.cos(b2), 1e-300))

    low, high = np.zeros(len(dl)), np.full(len(dl), np.pi)
    for _ in range(60):
        mid = (low + high) / 2
        less = walk(mid)[0] < dl
        low, high = np.where(less, mid, low), np.where(less, high, mid)
    first = (low + high) / 2
    _, metres, last = walk(first)
    # back: mirrored, and from the other end
    sa, ca, sb, cb = np.sin(first), np.cos(first), np.sin(last), np.cos(last)
    sa, ca, sb, cb = np.where(swap, sb, sa), np.where(swap, -cb, ca) * np.where(swap, 1, 1), np.where(swap, sa, sb), np.where(swap, -ca, cb)
    return metres, np.degrees(np.arctan2(sa * east, ca * north)) % 360, np.degrees(np.arctan2(sb * east, cb * north)) % 360


def direct(lon, lat, azimuth, metres, a: float = A, f: float = FLAT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lon, lat, azimuth) at the end of geodesics of a length, in arrays of degrees."""
    lon, lat, azimuth, metres = np.broadcast_arrays(*(np.asarray(x, float) for x in (lon, lat, azimuth, metres)))
    alpha, tu = np.radians(azimuth), (1 - f) * np.tan(np.radians(lat))
    u1 = np.arctan(tu)
    su, cu, sa, ca = np.sin(u1), np.cos(u1), np.sin(alpha), np.cos(alpha)
    s1 = np.arctan2(tu, ca)
    s0 = cu * sa
    c2 = 1 - s0 * s0
    u = c2 * f * (2 - f) / (1 - f) ** 2
    aa = 1 + u / 16384 * (4096 + u * (-768 + u * (320 - 175 * u)))
    bb = u / 1024 * (256 + u * (-128 + u * (74 - 47 * u)))
    sigma = metres / (a * (1 - f) * aa)
    for _ in range(30):
        cm, ss, cs = np.cos(2 * s1 + sigma), np.sin(sigma), np.cos(sigma)
        ds = bb * ss * (cm + bb / 4 * (cs * (-1 + 2 * cm * cm) - bb / 6 * cm * (-3 + 4 * ss * ss) * (-3 + 4 * cm * cm)))
        sigma = metres / (a * (1 - f) * aa) + ds
    cm, ss, cs = np.cos(2 * s1 + sigma), np.sin(sigma), np.cos(sigma)
    y = su * cs + cu * ss * ca
    phi = np.arctan2(y, (1 - f) * np.hypot(s0, su * ss - cu * cs * ca))
    lam = np.arctan2(ss * sa, cu * cs - su * ss * ca)
    cc = f / 16 * c2 * (4 + f * (4 - 3 * c2))
    dl = lam - (1 - cc) * f * s0 * (sigma + cc * ss * (cm + cc * cs * (-1 + 2 * cm * cm)))
    out = lon + np.degrees(dl)
    return out - 360 * np.floor((out + 180) / 360), np.degrees(phi), np.degrees(np.arctan2(s0, cu * cs * ca - su * ss)) % 360


def geodesic_inverse(lon1, lat1, lon2, lat2) -> Column:
    """Struct distance, azimuth1, azimuth2 on WGS 84; all null if a coordinate is."""

    @F.pandas_udf("distance double, azimuth1 double, azimuth2 double")
    def run(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(dict(zip(("distance", "azimuth1", "azimuth2"), inverse(a, b, c, d))))

    return run(*map(G.number, (lon1, lat1, lon2, lat2)))


def geodesic_direct(lon, lat, azimuth, metres) -> Column:
    """Struct lon, lat, azimuth at the end of a geodesic on WGS 84."""

    @F.pandas_udf("lon double, lat double, azimuth double")
    def run(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(dict(zip(("lon", "lat", "azimuth"), direct(a, b, c, d))))

    return run(*map(G.number, (lon, lat, azimuth, metres)))


def geodesic_interpolate(lon1, lat1, lon2, lat2, fraction) -> Column:
    """Struct lon, lat of the place that part of the way along the geodesic on WGS 84."""

    @F.pandas_udf("lon double, lat double")
    def run(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series, t: pd.Series) -> pd.DataFrame:
        metres, azimuth, _ = inverse(a, b, c, d)
        lon, lat, _ = direct(a, b, azimuth, metres * t.to_numpy())
        return pd.DataFrame({"lon": lon, "lat": lat})

    return run(*map(G.number, (lon1, lat1, lon2, lat2, fraction)))


def vincenty(lon1, lat1, lon2, lat2) -> Column:
    """Geodesic distance in metres on WGS 84."""
    return geodesic_inverse(lon1, lat1, lon2, lat2)["distance"]


def to_web_mercator(lon, lat) -> Column:
    """Struct x, y in metres (EPSG:3857)."""
    a, b = _rad(lon, lat)
    return F.struct((a * A).alias("x"), (_isometric(b) * A).alias("y"))


def from_web_mercator(x, y) -> Column:
    return F.struct(F.degrees(G.number(x) / A).alias("lon"), F.degrees(2 * F.atan(F.exp(G.number(y) / A)) - math.pi / 2).alias("lat"))


def utm_zone(lon, lat) -> Column:
    """EPSG code of the point's UTM zone, without the exceptions of Norway and Svalbard."""
    zone = F.least(F.lit(60), F.floor((wrap(G.number(lon)) + 180) / 6) + 1)
    return (F.when(G.number(lat) >= 0, 32600).otherwise(32700) + zone).cast("int")


def to_utm(lon, lat, epsg) -> Column:
    """Struct x, y by the transverse Mercator series of sixth order in the third flattening."""
    n = FLAT / (2 - FLAT)
    #: The series' coefficients.
    alpha = (
        n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180,
        13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440,
        61 * n**3 / 240 - 103 * n**4 / 140,
        49561 * n**4 / 161280,
    )
    k = 0.9996 * A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    e = 2 * math.sqrt(n) / (1 + n)
    epsg = G.col(epsg)
    (b,) = _rad(lat)
    dl = F.radians(wrap(G.number(lon) - ((epsg % 100) * 6 - 183)))
    t = F.sinh(F.atanh(F.sin(b)) - e * F.atanh(e * F.sin(b)))
    xi, eta = F.atan2(t, F.cos(dl)), F.atanh(F.sin(dl) / F.sqrt(1 + t * t))
    x = eta + sum((c * F.cos(2 * j * xi) * F.sinh(2 * j * eta) for j, c in enumerate(alpha, 1)), F.lit(0.0))
    y = xi + sum((c * F.sin(2 * j * xi) * F.cosh(2 * j * eta) for j, c in enumerate(alpha, 1)), F.lit(0.0))
    return F.struct((500_000 + k * x).alias("x"), (k * y + F.when(epsg >= 32700, 10_000_000.0).otherwise(0.0)).alias("y"))


def spherical_area(g, radius: float = RADIUS) -> Column:
    """Area of polygons on the sphere, edges as lines of equal projection (Chamberlain and Duquette)."""
    ring = lambda r: F.abs(G.total(G.pairs(r, lambda a, b: F.radians(b["x"] - a["x"]) * (2 + F.sin(F.radians(a["y"])) + F.sin(F.radians(b["y"])))))) * radius * radius / 2
    part = lambda p: 2 * ring(F.element_at(p, 1)) - G.total(F.transform(p, ring))
    return F.when(G.dimension(g) == 2, G.total(F.transform(G.parts(g), part))).otherwise(0.0)


def great_circle_length(g, radius: float = RADIUS) -> Column:
    return G.total(F.transform(G.rings(g), lambda r: G.total(G.pairs(r, lambda a, b: haversine(a["x"], a["y"], b["x"], b["y"], radius)))))


# --- lengths and areas on the ellipsoid ----------------------------------------------------------


def _vincenty_column(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Metres of a geodesic in columns; null where the steps don't settle, near antipodes."""
    u = lambda lat: F.atan((1 - FLAT) * F.tan(F.radians(lat)))
    dl = F.radians(lon2 - lon1 - 360 * F.round((lon2 - lon1) / 360))
    ends = F.struct(F.sin(u(lat1)).alias("s1"), F.cos(u(lat1)).alias("c1"), F.sin(u(lat2)).alias("s2"), F.cos(u(lat2)).alias("c2"), dl.alias("l"))

    def at(p, lam):
        """Struct of the angle between the ends and what the next step needs of it."""

        def go(t):
            x, y = p["c2"] * t["s"], p["c1"] * p["s2"] - p["s1"] * p["c2"] * t["c"]
            base = F.struct(F.sqrt(x * x + y * y).alias("ss"), (p["s1"] * p["s2"] + p["c1"] * p["c2"] * t["c"]).alias("cs"), (p["c1"] * p["c2"] * t["s"]).alias("q"))

            def rest(b):
                sa = F.when(b["ss"] > 0, b["q"] / b["ss"]).otherwise(0.0)
                return G.let(F.struct(b["ss"].alias("ss"), b["cs"].alias("cs"), sa.alias("sa"), (1 - sa * sa).alias("ca2")), lambda k: F.struct(k["ss"].alias("ss"), k["cs"].alias("cs"), F.atan2(k["ss"], k["cs"]).alias("sigma"), k["sa"].alias("sa"), k["ca2"].alias("ca2"), F.when(k["ca2"] > 1e-15, k["cs"] - 2 * p["s1"] * p["s2"] / k["ca2"]).otherwise(0.0).alias("cm")))

            return G.let(base, rest)

        return G.let(F.struct(F.sin(lam).alias("s"), F.cos(lam).alias("c")), go)

    def step(p):
        def go(a, _):
            def moved(k):
                c = FLAT / 16 * k["ca2"] * (4 + FLAT * (4 - 3 * k["ca2"]))
                return p["l"] + (1 - c) * FLAT * k["sa"] * (k["sigma"] + c * k["ss"] * (k["cm"] + c * k["cs"] * (-1 + 2 * k["cm"] * k["cm"])))

            return F.when(a["move"] < 1e-14, a).otherwise(G.let(G.let(at(p, a["lam"]), moved), lambda new: F.struct(new.alias("lam"), F.abs(new - a["lam"]).alias("move"))))

        return go

    def metres(k):
        u2 = k["ca2"] * (1 / (1 - FLAT) ** 2 - 1)
        big = 1 + u2 / 16384 * (4096 + u2 * (-768 + u2 * (320 - 175 * u2)))
        small = u2 / 1024 * (256 + u2 * (-128 + u2 * (74 - 47 * u2)))
        change = small * k["ss"] * (k["cm"] + small / 4 * (k["cs"] * (-1 + 2 * k["cm"] * k["cm"]) - small / 6 * k["cm"] * (-3 + 4 * k["ss"] * k["ss"]) * (-3 + 4 * k["cm"] * k["cm"])))
        return A * (1 - FLAT) * big * (k["sigma"] - change)

    def whole(p):
        found = F.aggregate(F.sequence(F.lit(1), F.lit(30)), F.struct(p["l"].alias("lam"), F.lit(1.0).alias("move")), step(p))
        return G.let(found, lambda a: F.when((a["move"] < 1e-12) & (F.abs(a["lam"]) <= math.pi), G.let(at(p, a["lam"]), metres)))

    return G.let(ends, whole)


def geodesic_length(g, unit: float = 1.0) -> Column:
    """Length of lines on the WGS 84 ellipsoid, vertex to vertex, in metres or units of so many metres; 0 for other geometries.

    In columns; null for a line with two neighbouring vertices nearly opposite each other.
    """
    step = lambda a, b: _vincenty_column(a["x"], a["y"], b["x"], b["y"])
    return F.when(G.dimension(g) == 1, G.total(F.transform(G.rings(g), lambda r: G.total(G.pairs(r, step)))) / unit).otherwise(F.when(G.col(g).isNotNull(), 0.0))


def geodesic_perimeter(g, unit: float = 1.0) -> Column:
    """Length of all rings of polygons on the ellipsoid; 0 for other geometries."""
    step = lambda a, b: _vincenty_column(a["x"], a["y"], b["x"], b["y"])
    return F.when(G.dimension(g) == 2, G.total(F.transform(G.rings(g), lambda r: G.total(G.pairs(r, step)))) / unit).otherwise(F.when(G.col(g).isNotNull(), 0.0))


def _authalic_series() -> tuple[float, list[float]]:
    """Square of the radius of the sphere of equal area, and the sine series that turns a latitude into the one of equal area there; by integration."""
    e2 = FLAT * (2 - FLAT)
    e = math.sqrt(e2)
    q = lambda s: (1 - e2) * (s / (1 - e2 * s * s) + math.atanh(e * s) / e)
    top = q(1.0)
    phi = (np.arange(4096) + 0.5) / 4096 * math.pi / 2
    off = np.array([math.asin(min(1.0, q(math.sin(x)) / top)) for x in phi]) - phi
    return A * A * top / 2, [float(4 / math.pi * np.sum(off * np.sin(2 * n * phi)) * (math.pi / 2 / 4096)) for n in range(1, 6)]


AUTHALIC2, _AUTHALIC = _authalic_series()


def authalic(lat: Column) -> Column:
    """The latitude, in radians, on the sphere of equal area, of one in degrees."""
    x = F.radians(lat)
    return x + sum((c * F.sin(2 * n * x) for n, c in enumerate(_AUTHALIC, 1)), F.lit(0.0))


#: Steps of a side whose areas are taken, at least, and the degrees that one has at most.
LEAST_STEPS, LONGEST = 64, 0.25
#: Places on sides that are held at once.
MOST_PLACES = 1 << 18


def strips(lon1, lat1, lon2, lat2) -> tuple[np.ndarray, np.ndarray]:
    """(signed square metres between the equator and each side on WGS 84, radians it turns in longitude), in arrays of degrees.

    A side is the great circle of reduced latitudes in even steps. A step has the integral of the area
    up to a latitude by Simpson's rule, and one that ends at a pole or turns by more than a right angle
    that of a great circle on the sphere of equal area.
    """
    l1, l2 = np.radians(lon1), np.radians(lon2)
    b1, b2 = (np.arctan((1 - FLAT) * np.tan(np.radians(x))) for x in (lat1, lat2))
    e2 = FLAT * (2 - FLAT)
    short_way = lambda dl: dl - 2 * math.pi * np.round(dl / (2 * math.pi))

    def below(z, flat):
        """Square metres a radian wide below a place, by its height and its distance from the axis on the sphere of reduced latitudes."""
        s = z / np.hypot(z, (1 - FLAT) * flat)
        return A * A * (1 - e2) / 2 * (s / (1 - e2 * s * s) + np.arctanh(math.sqrt(e2) * s) / math.sqrt(e2))

    d = 2 * np.arcsin(np.minimum(1, np.sqrt(np.sin((b2 - b1) / 2) ** 2 + np.cos(b1) * np.cos(b2) * np.sin((l2 - l1) / 2) ** 2)))
    turn = short_way(l2 - l1)
    area = turn * (below(np.sin(b1), np.cos(b1)) + below(np.sin(b2), np.cos(b2))) / 2  # stays for ends that agree
    n = LEAST_STEPS * np.ceil(np.maximum(d / math.radians(LONGEST * LEAST_STEPS), 1))
    n[~(d >= 1e-12)] = 0
    for k in np.unique(n[n > 0]).astype(int):
        these, t = np.flatnonzero(n == k), np.arange(2 * k + 1)[:, None] / (2 * k)
        for at in range(0, len(these), max(1, MOST_PLACES // (2 * k + 1))):
            i = these[at : at + max(1, MOST_PLACES // (2 * k + 1))]
            u, w = np.sin((1 - t) * d[i]) / np.sin(d[i]), np.sin(t * d[i]) / np.sin(d[i])
            x = u * (np.cos(b1[i]) * np.cos(l1[i])) + w * (np.cos(b2[i]) * np.cos(l2[i]))
            y = u * (np.cos(b1[i]) * np.sin(l1[i])) + w * (np.cos(b2[i]) * np.sin(l2[i]))
            z = u * np.sin(b1[i]) + w * np.sin(b2[i])
            flat = np.hypot(x, y)
            q, dl, over = below(z, flat), short_way(np.diff(np.arctan2(y, x)[::2], axis=0)), flat[::2] < 1e-9
            step = dl * (q[:-2:2] + 4 * q[1::2] + q[2::2]) / 6
            if (wide := (np.abs(dl) > math.pi / 2) | over[1:] | over[:-1]).any():
                low, high = (np.tan(np.arcsin(np.clip(v[wide] / AUTHALIC2, -1, 1)) / 2) for v in (q[:-2:2], q[2::2]))
                step[wide] = AUTHALIC2 * 2 * np.arctan(np.tan(dl[wide] / 2) * (low + high) / (1 + low * high))
            area[i], turn[i] = step.sum(0), dl.sum(0)
    return area, turn


def polygon_areas(parts: pa.Array) -> pa.Array:
    """Square metres on WGS 84 of arrays of polygons, which are arrays of closed rings, the shell first; null for null."""
    sizes = lambda a: a.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    owner = lambda a: np.repeat(np.arange(len(a)), sizes(a))
    polygons = parts.flatten()
    rings = polygons.flatten()
    vertices = rings.flatten()
    x, y = (vertices.field(k).to_numpy(zero_copy_only=False).astype(float) for k in "xy")
    n, ring, i = sizes(rings), owner(rings), np.arange(len(x))
    start = (np.cumsum(n) - n)[ring]
    # a pole lies on the meridian of the side that comes as well as of that which goes
    pole, comes, last = np.abs(y) >= 90, np.maximum(i - 1, 0), i == start + n[ring] - 1
    goes = np.minimum(np.where(last, start + 1, i + 1), max(len(x) - 1, 0))
    at = np.repeat(i, 1 + (pole & (i > start)))
    twin = np.concatenate([at[1:] == at[:-1], [False]]) if len(at) else np.zeros(0, bool)
    lon, lat, ring = np.where(pole[at], np.where(twin, x[comes[at]], x[goes[at]]), x[at]), y[at], ring[at]
    side = np.flatnonzero(ring[1:] == ring[:-1])
    area, turn = strips(lon[side], lat[side], lon[side + 1], lat[side + 1])
    area, turn = (np.bincount(ring[side], v, len(rings)) for v in (area, turn))
    # around a pole the strips reach from the equator to the ring, and the rest of the half is inside
    area = np.where(np.round(turn / (2 * math.pi)) != 0, 2 * math.pi * AUTHALIC2 - np.abs(area), np.abs(area))
    polygon = owner(polygons)
    hole = np.concatenate([[False], polygon[1:] == polygon[:-1]]) if len(polygon) else np.zeros(0, bool)
    out = np.bincount(owner(parts)[polygon], np.where(hole, -area, area), len(parts))
    return pa.array(out, pa.float64(), mask=parts.is_null().to_numpy(zero_copy_only=False))


def geodesic_area(g, unit: float = 1.0) -> Column:
    """Area of polygons in square metres, or units of so many, on the WGS 84 ellipsoid; sides are short ways, so rings may cross the seam and go around a pole.

    Sides are great circles of reduced latitudes, which are nearest to geodesics, in steps of at most
    LONGEST degrees and at least LEAST_STEPS a side. Holes count against their shell whichever way
    they turn.
    """

    @F.arrow_udf("double")
    def run(parts: pa.Array) -> pa.Array:
        return polygon_areas(parts)

    two = G.dimension(g) == 2
    return F.when(two, run(F.when(two, G.parts(g))) / (unit * unit)).otherwise(F.when(G.col(g).isNotNull(), 0.0))
