"""Coordinate reference systems: a registry made by rule, their projections, and geometry columns that carry them.

Formulas are written once, over a namespace of functions that is numpy's on the driver and Spark's in
columns. Coordinates are x, y (longitude first) whatever order an authority lists its axes in.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import geometry as G

#: Ellipsoids (name, semi-major axis, inverse flattening), prime meridians, units.
ELLIPSOIDS = {"EPSG:7030": ("WGS 84", 6378137.0, 298.257223563), "EPSG:7019": ("GRS 1980", 6378137.0, 298.257222101), "EPSG:7048": ("GRS 1980 Authalic Sphere", 6371007.0, 0.0)}
PRIME_MERIDIANS = {"EPSG:8901": ("Greenwich", 0.0), "EPSG:8903": ("Paris", 2.33722917), "EPSG:8909": ("Ferro", -17.6666666666667)}
UNITS = {"EPSG:9001": ("metre", "linear", 1.0), "EPSG:9002": ("foot", "linear", 0.3048), "EPSG:9003": ("US survey foot", "linear", 1200 / 3937), "EPSG:9036": ("kilometre", "linear", 1000.0), "EPSG:9101": ("radian", "angular", 1.0), "EPSG:9102": ("degree", "angular", math.pi / 180), "EPSG:9201": ("unity", "scale", 1.0)}
DATUMS = {"wgs84": ("World Geodetic System 1984", "EPSG:6326", "EPSG:7030"), "etrs89": ("European Terrestrial Reference System 1989", "EPSG:6258", "EPSG:7019"), "nad83": ("North American Datum 1983", "EPSG:6269", "EPSG:7019"), "gda94": ("Geocentric Datum of Australia 1994", "EPSG:6283", "EPSG:7019")}
GEOGRAPHIC = {"wgs84": 4326, "etrs89": 4258, "nad83": 4269, "gda94": 4283}
NAMES = {4326: "WGS 84", 4979: "WGS 84", 4978: "WGS 84", 4258: "ETRS89", 4269: "NAD83", 4283: "GDA94"}
WORLD = (-180.0, -90.0, 180.0, 90.0)
#: Projected systems (name, datum, method, parameters, area of use).
PROJECTED = {
    3857: ("WGS 84 / Pseudo-Mercator", "wgs84", "webmerc", {}, (-180.0, -85.06, 180.0, 85.06)),
    3395: ("WGS 84 / World Mercator", "wgs84", "merc", {}, (-180.0, -80.0, 180.0, 84.0)),
    3035: ("ETRS89-extended / LAEA Europe", "etrs89", "laea", {"lat0": 52.0, "lon0": 10.0, "x0": 4321000.0, "y0": 3210000.0}, (-35.58, 24.6, 44.83, 84.73)),
    3034: ("ETRS89-extended / LCC Europe", "etrs89", "lcc", {"lat0": 52.0, "lon0": 10.0, "lat1": 35.0, "lat2": 65.0, "x0": 4000000.0, "y0": 2800000.0}, (-35.58, 24.6, 44.83, 84.73)),
    5070: ("NAD83 / Conus Albers", "nad83", "aea", {"lat0": 23.0, "lon0": -96.0, "lat1": 29.5, "lat2": 45.5, "x0": 0.0, "y0": 0.0}, (-124.79, 24.41, -66.91, 49.38)),
    3577: ("GDA94 / Australian Albers", "gda94", "aea", {"lat0": 0.0, "lon0": 132.0, "lat1": -18.0, "lat2": -36.0, "x0": 0.0, "y0": 0.0}, (112.85, -43.7, 153.69, -9.86)),
}
METHODS = {"webmerc": "Popular Visualisation Pseudo Mercator", "merc": "Mercator (variant A)", "utm": "Transverse Mercator", "laea": "Lambert Azimuthal Equal Area", "lcc": "Lambert Conic Conformal (2SP)", "aea": "Albers Equal Area"}


class _Numpy:
    """Functions on arrays."""

    sin, cos, tan, atan, atan2, asin, sinh, cosh, asinh, atanh, log, exp, sqrt = np.sin, np.cos, np.tan, np.arctan, np.arctan2, np.arcsin, np.sinh, np.cosh, np.arcsinh, np.arctanh, np.log, np.exp, np.sqrt
    power, where, degrees, radians, sign = np.power, staticmethod(lambda c, a, b: np.where(c, a, b)), np.degrees, np.radians, np.sign
    wrap = staticmethod(lambda d: d - 360.0 * np.floor((d + 180.0) / 360.0))
    let = staticmethod(lambda v, f: f(v))


class _Spark:
    """The same on columns."""

    sin, cos, tan, atan, atan2, asin, sinh, cosh, asinh, atanh, log, exp, sqrt = map(staticmethod, (F.sin, F.cos, F.tan, F.atan, F.atan2, F.asin, F.sinh, F.cosh, F.asinh, F.atanh, F.log, F.exp, F.sqrt))
    power, degrees, radians, sign = map(staticmethod, (F.pow, F.degrees, F.radians, F.signum))
    where = staticmethod(lambda c, a, b: F.when(c, a).otherwise(b))
    wrap = staticmethod(lambda d: d - 360.0 * F.floor((d + 180.0) / 360.0))
    let = staticmethod(G.let)


@dataclass(frozen=True)
class Crs:
    """One reference system. Two are equal if their authority and code are."""

    authority: str
    code: str
    name: str
    kind: str
    datum_key: str
    method: str | None = None
    parameters: tuple[tuple[str, float], ...] = ()
    area: tuple[float, float, float, float] = WORLD

    # --- what it is ---------------------------------------------------------------------------

    @property
    def canonical(self) -> str:
        return f"{self.authority}:{self.code}"

    @property
    def is_geographic(self) -> bool:
        return self.kind in ("geographic_2d", "geographic_3d")

    @property
    def is_projected(self) -> bool:
        return self.kind == "projected"

    @property
    def is_geocentric(self) -> bool:
        return self.kind == "geocentric"

    @property
    def is_derived(self) -> bool:
        return self.is_projected

    #: The registry holds none of these.
    is_vertical = is_compound = is_engineering = is_bound = is_deprecated = False
    celestial_body = "Earth"

    @property
    def geoid_models(self) -> list[str]:
        return []

    @property
    def non_deprecated(self) -> list[Crs]:
        return [self]

    @property
    def axis_order(self) -> list[str]:
        if self.is_geocentric:
            return ["x", "y", "z"]
        if self.is_projected:
            return ["y", "x"] if self.code in ("3035", "3034") else ["x", "y"]
        plain = ["lon", "lat"] if self.authority == "OGC" else ["lat", "lon"]
        return plain + ["height"] * (self.kind == "geographic_3d")

    @property
    def axes(self) -> list[dict]:
        unit = "degree" if self.is_geographic else "metre"
        way = {"lat": "north", "lon": "east", "x": "east", "y": "north", "z": "up", "height": "up"}
        return [{"name": a, "direction": way[a], "unit": "metre" if a == "height" else unit} for a in self.axis_order]

    @property
    def area_of_use(self) -> dict:
        return dict(zip(("west", "south", "east", "north"), self.area)) | {"name": "World" if self.area == WORLD else self.name}

    @property
    def ellipsoid(self) -> dict:
        key = DATUMS[self.datum_key][2]
        name, a, f = ELLIPSOIDS[key]
        return {"name": name, "id": key, "semi_major_axis": a, "semi_minor_axis": a * (1 - 1 / f) if f else a, "inverse_flattening": f}

    @property
    def datum(self) -> dict:
        return {"name": DATUMS[self.datum_key][0], "id": DATUMS[self.datum_key][1]}

    @property
    def prime_meridian(self) -> dict:
        return {"name": "Greenwich", "id": "EPSG:8901", "longitude": 0.0}

    @property
    def geodetic_crs(self) -> dict:
        code = GEOGRAPHIC[self.datum_key]
        return {"authority": "EPSG", "code": str(code), "name": NAMES[code]}

    @property
    def info(self) -> dict:
        return {"canonical": self.canonical, "name": self.name, "kind": self.kind, "axes": self.axes, "area_of_use": self.area_of_use, "ellipsoid": self.ellipsoid, "datum": self.datum, "prime_meridian": self.prime_meridian, "celestial_body": self.celestial_body, "method": METHODS.get(self.method), "parameters": dict(self.parameters)}

    # --- other forms --------------------------------------------------------------------------

    def to_epsg(self) -> int | None:
        return int(self.code) if self.authority == "EPSG" else 4326 if self.code == "CRS84" else None

    def to_authority(self, *, authority: str | None = None) -> tuple[str, str] | None:
        return (self.authority, self.code) if authority in (None, self.authority) else None

    def to_2d(self) -> Crs:
        return crs(4326) if self.kind == "geographic_3d" else self

    def to_3d(self) -> Crs:
        return crs(4979) if self.canonical in ("EPSG:4326", "OGC:CRS84") else self

    def identify(self, *, authority: str | None = None) -> list[Crs]:
        return [c for c in [self, *catalog(kind=self.kind)] if (c is self or c == self) and authority in (None, c.authority)][:1]

    def same_as(self, other, *, mode: str = "equivalent") -> bool:
        """Whether two systems are the same: `strict` by authority and code, `equivalent` up to the order of axes."""
        o = crs(other)
        return self == o if mode == "strict" else (self.kind, self.datum_key, self.method, self.parameters) == (o.kind, o.datum_key, o.method, o.parameters)

    def to_proj(self) -> str:
        p, ell = dict(self.parameters), "+ellps=GRS80" if self.datum_key != "wgs84" else "+datum=WGS84"
        if self.kind == "geocentric":
            return f"+proj=geocent {ell} +units=m +no_defs"
        if self.is_geographic:
            return f"+proj=longlat {ell} +no_defs"
        if self.method == "utm":
            return f"+proj=utm +zone={int(p['zone'])}{' +south' if p['y0'] else ''} {ell} +units=m +no_defs"
        if self.method == "webmerc":
            return "+proj=merc +a=6378137 +b=6378137 +lat_ts=0 +lon_0=0 +x_0=0 +y_0=0 +k=1 +units=m +nadgrids=@null +wktext +no_defs"
        named = {"lat0": "lat_0", "lon0": "lon_0", "lat1": "lat_1", "lat2": "lat_2", "x0": "x_0", "y0": "y_0"}
        return f"+proj={self.method} " + "".join(f"+{named[k]}={v:g} " for k, v in p.items()) + f"{ell} +units=m +no_defs"

    def to_projjson_dict(self) -> dict:
        kinds = {"geographic_2d": "GeographicCRS", "geographic_3d": "GeographicCRS", "projected": "ProjectedCRS", "geocentric": "GeodeticCRS"}
        e = self.ellipsoid
        frame = {"type": "GeodeticReferenceFrame", "name": self.datum["name"], "ellipsoid": {"name": e["name"], "semi_major_axis": e["semi_major_axis"], "inverse_flattening": e["inverse_flattening"]}}
        out = {"$schema": "https://proj.org/schemas/v0.7/projjson.schema.json", "type": kinds[self.kind], "name": self.name}
        axes = {"subtype": "ellipsoidal" if self.is_geographic else "Cartesian", "axis": [{"name": a["name"], "abbreviation": a["name"], "direction": a["direction"], "unit": a["unit"]} for a in self.axes]}
        if self.is_projected:
            out |= {"base_crs": {"type": "GeographicCRS", "name": self.geodetic_crs["name"], "datum": frame}, "conversion": {"name": self.name, "method": {"name": METHODS[self.method]}, "parameters": [{"name": k, "value": v} for k, v in self.parameters]}}
        else:
            out["datum"] = frame
        return out | {"coordinate_system": axes, "id": {"authority": self.authority, "code": self.to_epsg() if self.authority == "EPSG" else self.code}}

    def to_projjson(self, *, pretty: bool = False, indentation_width: int = 2) -> str:
        return json.dumps(self.to_projjson_dict(), indent=indentation_width if pretty else None)

    def to_wkt(self, *, version: str = "wkt2_2019", pretty: bool = False) -> str:
        """Well-known text of the second version, or `wkt1_gdal`."""
        e, old = self.ellipsoid, version.startswith("wkt1")
        ell = f'{"SPHEROID" if old else "ELLIPSOID"}["{e["name"]}",{e["semi_major_axis"]:.10g},{e["inverse_flattening"]:.12g}' + ("]" if old else ',LENGTHUNIT["metre",1]]')
        datum = f'DATUM["{self.datum["name"]}",{ell}]'
        prime = 'PRIMEM["Greenwich",0]' if old else 'PRIMEM["Greenwich",0,ANGLEUNIT["degree",0.0174532925199433]]'
        ident = f'{"AUTHORITY" if old else "ID"}["{self.authority}",{chr(34) + self.code + chr(34) if old or not self.code.isdigit() else self.code}]'
        degree = 'UNIT["degree",0.0174532925199433]' if old else 'ANGLEUNIT["degree",0.0174532925199433]'
        metre = 'UNIT["metre",1]' if old else 'LENGTHUNIT["metre",1]'
        if self.is_projected:
            base = f'{"GEOGCS" if old else "BASEGEOGCRS"}["{self.geodetic_crs["name"]}",{datum},{prime}{"," + degree if old else ""}]'
            how = "".join(f',PARAMETER["{k}",{v:.12g}]' for k, v in self.parameters)
            middle = f'PROJECTION["{METHODS[self.method]}"]{how}' if old else f'CONVERSION["{self.name}",METHOD["{METHODS[self.method]}"]{how}]'
            axes = "" if old else ",CS[Cartesian,2]" + "".join(f',AXIS["{a["name"]}",{a["direction"]}]' for a in self.axes)
            out = f'{"PROJCS" if old else "PROJCRS"}["{self.name}",{base},{middle}{axes},{metre},{ident}]'
        else:
            n = len(self.axes)
            cs = "" if old else f',CS[{"Cartesian" if self.is_geocentric else "ellipsoidal"},{n}]' + "".join(f',AXIS["{a["name"]}",{a["direction"]}]' for a in self.axes)
            word = ("GEOCCS" if self.is_geocentric else "GEOGCS") if old else ("GEODCRS" if self.is_geocentric else "GEOGCRS")
            out = f'{word}["{self.name}",{datum},{prime}{cs},{metre if self.is_geocentric else degree},{ident}]'
        return out.replace(",", ",\n  ") if pretty else out

    def to_cf(self) -> dict:
        names = {"webmerc": "mercator", "merc": "mercator", "utm": "transverse_mercator", "laea": "lambert_azimuthal_equal_area", "lcc": "lambert_conformal_conic", "aea": "albers_conical_equal_area", None: "latitude_longitude"}
        return {"grid_mapping_name": names[self.method], "semi_major_axis": self.ellipsoid["semi_major_axis"], "inverse_flattening": self.ellipsoid["inverse_flattening"], "longitude_of_prime_meridian": 0.0, "crs_wkt": self.to_wkt()}

    def operations(self, target) -> list[dict]:
        """How coordinates get to `target`; one way, as the registry has one projection each and no grids."""
        t = crs(target)
        steps = [*(["inverse of " + self.name] if self.is_projected or self.is_geocentric else []), *([f"{DATUMS[self.datum_key][0]} to {DATUMS[t.datum_key][0]}: no shift"] if self.datum_key != t.datum_key else []), *([t.name] if t.is_projected or t.is_geocentric else [])]
        return [{"source": self.canonical, "target": t.canonical, "steps": steps or ["no change"], "accuracy": 0.0 if self.datum_key == t.datum_key else 2.0, "ballpark": self.datum_key != t.datum_key}]

    def operation(self, target) -> dict:
        return self.operations(target)[0]

    def factors(self, lon, lat) -> dict[str, np.ndarray]:
        """Scales along the meridian and the parallel, areal scale, convergence (degrees) and angular distortion of a projection."""
        if not self.is_projected:
            raise ValueError("only projected systems have factors")
        lon, lat = np.asarray(lon, float), np.asarray(lat, float)
        e, d = self.ellipsoid, 1e-6
        f = 1 / e["inverse_flattening"] if e["inverse_flattening"] else 0.0
        e2 = f * (2 - f)
        at = lambda x, y: np.stack(project(_Numpy, self, x, y))
        dx, dy = (at(lon + d, lat) - at(lon - d, lat)) / (2 * math.radians(d)), (at(lon, lat + d) - at(lon, lat - d)) / (2 * math.radians(d))
        s = np.sin(np.radians(lat))
        w = 1 - e2 * s * s
        k = np.hypot(*dx) / (e["semi_major_axis"] * np.cos(np.radians(lat)) / np.sqrt(w))
        h = np.hypot(*dy) / (e["semi_major_axis"] * (1 - e2) / w**1.5)
        sine = np.abs(dx[0] * dy[1] - dx[1] * dy[0]) / (np.hypot(*dx) * np.hypot(*dy))
        big, small = np.sqrt(np.maximum(0, h * h + k * k + 2 * h * k * sine)), np.sqrt(np.maximum(0, h * h + k * k - 2 * h * k * sine))
        return {"meridional_scale": h, "parallel_scale": k, "areal_scale": h * k * sine, "meridian_convergence": np.degrees(np.arctan2(dx[1], dx[0])), "angular_distortion": np.degrees(2 * np.arcsin(np.clip(small / big, 0, 1)))}


# --- the registry ------------------------------------------------------------------------------


def _utm(code: int) -> Crs | None:
    for base, datum, zones, south, name in ((32600, "wgs84", range(1, 61), False, "WGS 84"), (32700, "wgs84", range(1, 61), True, "WGS 84"), (25800, "etrs89", range(28, 39), False, "ETRS89"), (26900, "nad83", range(1, 24), False, "NAD83")):
        if code - base in zones:
            z = code - base
            low = z * 6 - 186.0
            return Crs("EPSG", str(code), f"{name} / UTM zone {z}{'S' if south else 'N'}", "projected", datum, "utm", (("zone", float(z)), ("lat0", 0.0), ("lon0", low + 3.0), ("k", 0.9996), ("x0", 500000.0), ("y0", 10000000.0 if south else 0.0)), (low, -80.0 if south else 0.0, low + 6.0, 0.0 if south else 84.0))
    return None


@cache
def _known(authority: str, code: str) -> Crs | None:
    if (authority, code) == ("OGC", "CRS84"):
        return Crs("OGC", "CRS84", "WGS 84 (CRS84)", "geographic_2d", "wgs84")
    if authority != "EPSG" or not code.isdigit():
        return None
    n = int(code)
    if n in (4978, 4979):
        return Crs("EPSG", code, NAMES[n], "geocentric" if n == 4978 else "geographic_3d", "wgs84")
    for datum, geographic in GEOGRAPHIC.items():
        if n == geographic:
            return Crs("EPSG", code, NAMES[n], "geographic_2d", datum)
    if n in PROJECTED:
        name, datum, method, parameters, area = PROJECTED[n]
        return Crs("EPSG", code, name, "projected", datum, method, tuple(parameters.items()), area)
    return _utm(n)


def crs(value) -> Crs:
    """A system from a Crs, an EPSG number, `EPSG:4326`, `OGC:CRS84`, an urn, a name, PROJJSON, or text that a Crs has written."""
    if isinstance(value, Crs):
        return value
    if isinstance(value, dict):
        value = f"{value['id']['authority']}:{value['id']['code']}"
    text = str(value).strip()
    if text.startswith("{"):
        return crs(json.loads(text))
    if text.lower().startswith("urn:ogc:def:crs:"):
        parts = text.split(":")
        text = f"{parts[4]}:{parts[-1]}"
    if text.isdigit():
        text = f"EPSG:{text}"
    authority, _, code = text.partition(":")
    found = _known(authority.upper(), code.upper())
    if found is None:
        found = next((c for c in catalog() if text.lower() == c.name.lower() or text in (c.to_proj(), c.to_wkt(), c.to_wkt(version="wkt1_gdal"))), None)
    if found is None:
        raise ValueError(f"unknown reference system {value!r}")
    return found


def catalog(*, authority: str | None = None, kind: str | None = None, area: tuple[float, float, float, float] | None = None, contains: bool = False) -> list[Crs]:
    """All systems known, or those of an authority, a kind, or an area that they meet or contain."""
    numbers = [*GEOGRAPHIC.values(), 4978, 4979, *PROJECTED, *range(32601, 32661), *range(32701, 32761), *range(25828, 25839), *range(26901, 26924)]
    every = [_known("OGC", "CRS84"), *(_known("EPSG", str(n)) for n in sorted(numbers))]
    out = [c for c in every if authority in (None, c.authority) and kind in (None, c.kind)]
    if area:
        w, s, e, n = area
        fits = (lambda a: a[0] <= w and a[1] <= s and a[2] >= e and a[3] >= n) if contains else (lambda a: a[0] <= e and a[2] >= w and a[1] <= n and a[3] >= s)
        out = [c for c in out if fits(c.area)]
    return out


def search(name: str, *, authority: str | None = None, kind: str | None = None, limit: int = 20) -> list[Crs]:
    words = name.lower().split()
    return [c for c in catalog(authority=authority, kind=kind) if all(w in c.name.lower() for w in words)][:limit]


def codes(authority: str, *, kind: str | None = None) -> list[str]:
    return [c.code for c in catalog(authority=authority, kind=kind)]


def authorities() -> list[str]:
    return sorted({c.authority for c in catalog()})


def utm_zones(*, datum_name: str | None = None, area: tuple[float, float, float, float] | None = None, contains: bool = False) -> list[Crs]:
    return [c for c in catalog(kind="projected", area=area, contains=contains) if c.method == "utm" and (datum_name is None or datum_name.lower() in (c.datum["name"].lower(), c.geodetic_crs["name"].lower()))]


def units(authority: str = "EPSG", *, category: str | None = None) -> list[dict]:
    return [{"authority": a, "code": c, "name": n, "category": k, "factor": f} for key, (n, k, f) in UNITS.items() for a, c in [key.split(":")] if a == authority and category in (None, k)]


def unit(authority: str, code) -> dict:
    found = [u for u in units(authority) if u["code"] == str(code)]
    if not found:
        raise ValueError(f"unknown unit {authority}:{code}")
    return found[0]


def ellipsoids() -> list[dict]:
    return [{"id": k, "name": n, "semi_major_axis": a, "inverse_flattening": f} for k, (n, a, f) in ELLIPSOIDS.items()]


def prime_meridians() -> list[dict]:
    return [{"id": k, "name": n, "longitude": x} for k, (n, x) in PRIME_MERIDIANS.items()]


def celestial_bodies() -> list[str]:
    return ["Earth"]


def projections() -> list[str]:
    return sorted(METHODS)


def cache_info() -> dict:
    return _known.cache_info()._asdict()


def clear_cache() -> None:
    _known.cache_clear()


# --- formulas ----------------------------------------------------------------------------------


def _shape(c: Crs) -> tuple[float, float, float]:
    """Semi-major axis, eccentricity, third flattening."""
    e = c.ellipsoid
    f = 1 / e["inverse_flattening"] if e["inverse_flattening"] else 0.0
    return e["semi_major_axis"], math.sqrt(f * (2 - f)), f / (2 - f)


#: Coefficients, by powers of the third flattening from the first, of the transverse Mercator series both ways and of latitude by conformal latitude.
ALONG = ((1 / 2, -2 / 3, 5 / 16, 41 / 180), (0, 13 / 48, -3 / 5, 557 / 1440), (0, 0, 61 / 240, -103 / 140), (0, 0, 0, 49561 / 161280))
BACK = ((1 / 2, -2 / 3, 37 / 96, -1 / 360), (0, 1 / 48, 1 / 15, -437 / 1440), (0, 0, 17 / 480, -37 / 840), (0, 0, 0, 4397 / 161280))
LATITUDE = ((2, -2 / 3, -2, 116 / 45), (0, 7 / 3, -8 / 5, -227 / 45), (0, 0, 56 / 15, -136 / 35), (0, 0, 0, 4279 / 630))


def _series(table, n: float) -> list[float]:
    return [sum(c * n ** (i + 1) for i, c in enumerate(row)) for row in table]


def _isometric(m, phi, e: float):
    return m.asinh(m.tan(phi)) - e * m.atanh(e * m.sin(phi))


def _from_isometric(m, psi, n: float):
    """Geodetic latitude in radians."""
    return m.let(m.atan(m.sinh(psi)), lambda chi: chi + sum(c * m.sin(2 * (j + 1) * chi) for j, c in enumerate(_series(LATITUDE, n))))


def _q(m, phi, e: float):
    """Twice the area of a strip from the equator, in units of the axis squared and radians of longitude."""
    s = m.sin(phi)
    return (1 - e * e) * (s / (1 - e * e * s * s) + m.atanh(e * s) / e)


def _from_q(m, q, e: float):
    step = lambda phi: phi + (1 - e * e * m.sin(phi) * m.sin(phi)) * (1 - e * e * m.sin(phi) * m.sin(phi)) / (2 * m.cos(phi)) * (q / (1 - e * e) - m.sin(phi) / (1 - e * e * m.sin(phi) * m.sin(phi)) - m.atanh(e * m.sin(phi)) / e)
    top = float(_q(_Numpy, math.pi / 2, e))
    out = m.asin(m.where(q > top, top, m.where(q < -top, -top, q)) / top)  # authalic latitude, then Newton's steps
    for _ in range(4):
        out = m.let(out, lambda p: m.where((p > 1.5707) | (p < -1.5707), p, step(p)))
    return out


def _cone(c: Crs):
    """Constants of a conic projection: of the scalars only, so numpy's."""
    a, e, _ = _shape(c)
    p = {k: math.radians(v) for k, v in c.parameters if k.startswith("l")}
    w = lambda t: math.cos(t) / math.sqrt(1 - e * e * math.sin(t) ** 2)
    m1, m2 = w(p["lat1"]), w(p["lat2"])
    if c.method == "lcc":
        t = lambda phi: math.exp(-float(_isometric(_Numpy, phi, e)))
        n = (math.log(m1) - math.log(m2)) / (math.log(t(p["lat1"])) - math.log(t(p["lat2"]))) if p["lat1"] != p["lat2"] else math.sin(p["lat1"])
        f = m1 / (n * t(p["lat1"]) ** n)
        return n, f, a * f * t(p["lat0"]) ** n
    q = lambda phi: float(_q(_Numpy, phi, e))
    n = (m1 * m1 - m2 * m2) / (q(p["lat2"]) - q(p["lat1"])) if p["lat1"] != p["lat2"] else math.sin(p["lat1"])
    big = m1 * m1 + n * q(p["lat1"])
    return n, big, a * math.sqrt(big - n * q(p["lat0"])) / n


def project(m, c: Crs, lon, lat):
    """(x, y) of a projected system from degrees."""
    a, e, n = _shape(c)
    p, phi = dict(c.parameters), m.radians(lat)
    lam = m.radians(m.wrap(lon - p["lon0"])) if "lon0" in p else m.radians(lon)
    if c.method == "webmerc":
        return a * lam, a * m.asinh(m.tan(phi))
    if c.method == "merc":
        return a * lam, a * _isometric(m, phi, e)
    if c.method == "utm":
        t = m.sinh(_isometric(m, phi, e))
        xi, eta = m.atan2(t, m.cos(lam)), m.atanh(m.sin(lam) / m.sqrt(1 + t * t))
        k = p["k"] * a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
        alpha = _series(ALONG, n)
        x = eta + sum(w * m.cos(2 * (j + 1) * xi) * m.sinh(2 * (j + 1) * eta) for j, w in enumerate(alpha))
        y = xi + sum(w * m.sin(2 * (j + 1) * xi) * m.cosh(2 * (j + 1) * eta) for j, w in enumerate(alpha))
        return p["x0"] + k * x, p["y0"] + k * y
    if c.method == "laea":
        top = float(_q(_Numpy, math.pi / 2, e))
        r, lat0 = a * math.sqrt(top / 2), math.radians(p["lat0"])
        b0 = math.asin(float(_q(_Numpy, lat0, e)) / top)
        d = a * math.cos(lat0) / math.sqrt(1 - e * e * math.sin(lat0) ** 2) / (r * math.cos(b0))
        b = m.asin(_q(m, phi, e) / top)
        k = r * m.sqrt(2 / (1 + math.sin(b0) * m.sin(b) + math.cos(b0) * m.cos(b) * m.cos(lam)))
        return p["x0"] + k * d * m.cos(b) * m.sin(lam), p["y0"] + k / d * (math.cos(b0) * m.sin(b) - math.sin(b0) * m.cos(b) * m.cos(lam))
    s, f, rho0 = _cone(c)
    rho = a * f * m.exp(-s * _isometric(m, phi, e)) if c.method == "lcc" else a * m.sqrt(f - s * _q(m, phi, e)) / s
    return p["x0"] + rho * m.sin(s * lam), p["y0"] + rho0 - rho * m.cos(s * lam)


def unproject(m, c: Crs, x, y):
    """(lon, lat) in degrees from a projected system."""
    a, e, n = _shape(c)
    p = dict(c.parameters)
    if c.method == "webmerc":
        return m.degrees(x / a), m.degrees(m.atan(m.sinh(y / a)))
    if c.method == "merc":
        return m.degrees(x / a), m.degrees(_from_isometric(m, y / a, n))
    x, y = x - p["x0"], y - p["y0"]
    if c.method == "utm":
        k = p["k"] * a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
        beta = _series(BACK, n)
        eta, xi = x / k, y / k
        u = eta - sum(w * m.cos(2 * (j + 1) * xi) * m.sinh(2 * (j + 1) * eta) for j, w in enumerate(beta))
        v = xi - sum(w * m.sin(2 * (j + 1) * xi) * m.cosh(2 * (j + 1) * eta) for j, w in enumerate(beta))
        chi = m.asin(m.sin(v) / m.cosh(u))
        lam = m.atan2(m.sinh(u), m.cos(v))
        return p["lon0"] + m.degrees(lam), m.degrees(_from_isometric(m, m.asinh(m.tan(chi)), n))
    if c.method == "laea":
        top = float(_q(_Numpy, math.pi / 2, e))
        r, lat0 = a * math.sqrt(top / 2), math.radians(p["lat0"])
        b0 = math.asin(float(_q(_Numpy, lat0, e)) / top)
        d = a * math.cos(lat0) / math.sqrt(1 - e * e * math.sin(lat0) ** 2) / (r * math.cos(b0))
        u, v = x / d, y * d
        rho = m.sqrt(u * u + v * v)
        ce = 2 * m.asin(rho / (2 * r))
        some = m.where(rho == 0, 1.0, rho)
        q = top * (m.cos(ce) * math.sin(b0) + v * m.sin(ce) * math.cos(b0) / some)
        lam = m.atan2(u * m.sin(ce), rho * math.cos(b0) * m.cos(ce) - v * math.sin(b0) * m.sin(ce))
        return p["lon0"] + m.degrees(m.where(rho == 0, 0.0, lam)), m.degrees(_from_q(m, q, e))
    s, f, rho0 = _cone(c)
    sign = math.copysign(1.0, s)
    rho, theta = sign * m.sqrt(x * x + (rho0 - y) * (rho0 - y)), m.atan2(sign * x, sign * (rho0 - y))
    lon = p["lon0"] + m.degrees(theta / s)
    if c.method == "lcc":
        return lon, m.degrees(_from_isometric(m, -m.log(rho / (a * f)) / s, n))
    return lon, m.degrees(_from_q(m, (f - rho * rho * s * s / (a * a)) / s, e))


def _moved(m, source: Crs, target: Crs, x, y, z):
    """Coordinates in the target; z stays but to and from geocentric systems."""
    if source.same_as(target):
        return x, y, z
    if source.is_projected:
        x, y = unproject(m, source, x, y)
    elif source.is_geocentric:
        x, y, z = _from_geocentric(m, source, x, y, z)
    if target.is_projected:
        x, y = project(m, target, x, y)
    elif target.is_geocentric:
        a, e, _ = _shape(target)
        phi, lam = m.radians(y), m.radians(x)
        w = a / m.sqrt(1 - e * e * m.sin(phi) * m.sin(phi))
        x, y, z = (w + z) * m.cos(phi) * m.cos(lam), (w + z) * m.cos(phi) * m.sin(lam), (w * (1 - e * e) + z) * m.sin(phi)
    return x, y, z


def _from_geocentric(m, c: Crs, x, y, z):
    a, e, _ = _shape(c)
    r = m.sqrt(x * x + y * y)
    phi = m.atan2(z, r * (1 - e * e))
    for _ in range(5):
        phi = m.let(phi, lambda p: m.atan2(z + e * e * a * m.sin(p) / m.sqrt(1 - e * e * m.sin(p) * m.sin(p)), r))
    w = a / m.sqrt(1 - e * e * m.sin(phi) * m.sin(phi))
    height = r * m.cos(phi) + z * m.sin(phi) - a * a / w
    return m.degrees(m.atan2(y, x)), m.degrees(phi), height


def transform(source, target, x, y, z=None) -> tuple[np.ndarray, ...]:
    """Arrays of coordinates in another system: (x, y), or (x, y, z) if z is given."""
    s, t = crs(source), crs(target)
    out = _moved(_Numpy, s, t, np.asarray(x, float), np.asarray(y, float), np.asarray(0.0 if z is None else z, float))
    return out if z is not None or t.is_geocentric else out[:2]


def transform_columns(source, target, x, y, z=None) -> Column:
    """Struct x, y, z of coordinates in another system."""
    z = F.lit(0.0) if z is None else G.number(z)
    out = _moved(_Spark, crs(source), crs(target), G.number(x), G.number(y), z)
    return F.struct(*[c.alias(k) for k, c in zip("xyz", out)])


def transform_bounds(source, target, bounds: tuple[float, float, float, float], *, densify: int = 21) -> tuple[float, float, float, float]:
    """The box in another system that holds a box, whose edges are looked at in `densify` points each beside the corners."""
    a, b, c, d = bounds
    t = np.linspace(0.0, 1.0, densify + 2)
    xs, ys = a + (c - a) * t, b + (d - b) * t
    x = np.concatenate([xs, xs, np.full(len(t), a), np.full(len(t), c)])
    y = np.concatenate([np.full(len(t), b), np.full(len(t), d), ys, ys])
    u, v = transform(source, target, x, y)[:2]
    good = np.isfinite(u) & np.isfinite(v)
    return float(u[good].min()), float(v[good].min()), float(u[good].max()), float(v[good].max())


def roundtrip(source, target, x, y, *, iterations: int = 1) -> np.ndarray:
    """How far points end from where they were after going there and back, in units of the source."""
    u, v = np.asarray(x, float), np.asarray(y, float)
    for _ in range(iterations):
        u, v = transform(target, source, *transform(source, target, u, v)[:2])[:2]
    return np.hypot(u - x, v - y)


# --- geometry columns --------------------------------------------------------------------------


def _meta(df: DataFrame, geometry: str) -> dict:
    return dict(df.schema[geometry].metadata or {})


def crs_of(df: DataFrame, geometry: str = "geometry") -> Crs | None:
    found = _meta(df, geometry).get("crs")
    return crs(found) if found else None


def epoch_of(df: DataFrame, geometry: str = "geometry") -> float | None:
    return _meta(df, geometry).get("epoch")


def set_crs(df: DataFrame, geometry: str, value, *, overwrite: bool = False) -> DataFrame:
    """df whose geometry column says what its coordinates mean; they don't move. None takes the system away."""
    meta, new = _meta(df, geometry), None if value is None else crs(value).canonical
    if meta.get("crs") not in (None, new) and not overwrite:
        raise ValueError(f"{geometry} has {meta['crs']} already; overwrite=True relabels it, to_crs moves its coordinates")
    meta.pop("crs", None)
    if new is None:
        meta.pop("epoch", None)
    return df.withMetadata(geometry, meta | ({"crs": new} if new else {}))


def set_epoch(df: DataFrame, geometry: str, epoch: float | None, *, overwrite: bool = False) -> DataFrame:
    """df whose geometry column says in which decimal year its coordinates were observed."""
    meta = _meta(df, geometry)
    if "crs" not in meta and epoch is not None:
        raise ValueError("an epoch needs a reference system")
    if meta.get("epoch") not in (None, epoch) and not overwrite:
        raise ValueError(f"{geometry} has the epoch {meta['epoch']} already")
    meta.pop("epoch", None)
    return df.withMetadata(geometry, meta | ({"epoch": float(epoch)} if epoch is not None else {}))


def to_crs(df: DataFrame, geometry: str, target, *, source=None) -> DataFrame:
    """df with the geometry column's coordinates in another system, from the one it carries or `source`. M stays as it is."""
    found = source if source is not None else crs_of(df, geometry)
    if found is None:
        raise ValueError(f"{geometry} carries no reference system; set_crs it, or give a source")
    s, t = crs(found), crs(target)

    def move(v: Column) -> Column:
        return G.let(transform_columns(s, t, v["x"], v["y"], F.coalesce(v["z"], F.lit(0.0))), lambda k: F.struct(k["x"].alias("x"), k["y"].alias("y"), F.when(v["z"].isNotNull() | F.lit(t.is_geocentric), k["z"]).alias("z"), v["m"].alias("m")))

    meta = _meta(df, geometry) | {"crs": t.canonical}
    return df.withColumn(geometry, G.map_vertices(F.col(geometry), move)).withMetadata(geometry, meta)


def local_utm(lon, lat) -> Column:
    """EPSG number of a point's UTM zone, with the wider ones of Norway and Svalbard."""
    lon = G.number(lon)
    x, y = lon - 360.0 * F.floor((lon + 180.0) / 360.0), G.number(lat)
    zone = F.least(F.lit(60), F.floor((x + 180) / 6) + 1)
    zone = F.when((y >= 56) & (y < 64) & (x >= 3) & (x < 12), 32).otherwise(zone)
    far = F.when(x < 9, 31).when(x < 21, 33).when(x < 33, 35).otherwise(37)
    zone = F.when((y >= 72) & (y <= 84) & (x >= 0) & (x < 42), far).otherwise(zone)
    return (F.when(y >= 0, 32600).otherwise(32700) + zone).cast("int")

