"""Text and binary forms: WKT, WKB, GeoJSON, encoded polylines.

Writers are column expressions; readers of nested text and binary are Arrow functions.
"""

from __future__ import annotations

import json
import re
import struct

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import geometry as G

#: Names in well-known text, in the order of the kinds.
NAMES = ("POINT", "LINESTRING", "POLYGON", "MULTIPOINT", "MULTILINESTRING", "MULTIPOLYGON", "GEOMETRYCOLLECTION")


def _number(c: Column, precision: int | None) -> Column:
    c = c if precision is None else F.round(c, precision)
    text = F.when((c == F.floor(c)) & (F.abs(c) < 1e15), c.cast("decimal(20,0)").cast("string")).otherwise(F.regexp_replace(c.cast("string"), r"\.0$", ""))
    return text


def to_wkt(g, precision: int | None = None) -> Column:
    """Well-known text, with Z and M where the first vertex has them; whole numbers have no point."""
    v = lambda p: F.concat_ws(" ", *[F.when(p[k].isNotNull(), _number(p[k], precision)) for k in "xyzm"])
    seq = lambda r: F.concat(F.lit("("), F.array_join(F.transform(r, v), ", "), F.lit(")"))
    nest = lambda a: F.concat(F.lit("("), F.array_join(a, ", "), F.lit(")"))
    kind, parts = G.kind(g), G.parts(g)
    body = (
        F.when(kind.isin(G.POINT, G.LINE), seq(F.flatten(F.flatten(parts)))).when(kind == G.POLYGON, nest(F.transform(F.flatten(parts), seq)))
        .when(kind.isin(G.MULTIPOINT, G.MULTILINE), nest(F.transform(F.flatten(parts), seq))).otherwise(nest(F.transform(parts, lambda p: nest(F.transform(p, seq)))))
    )
    name = F.element_at(F.array(*map(F.lit, NAMES)), kind)
    tag = F.concat(F.when(G.has_z(g), "Z").otherwise(""), F.when(G.has_m(g), "M").otherwise(""))
    head = F.concat(name, F.when(tag != "", F.concat(F.lit(" "), tag)).otherwise(""))
    return F.when(G.is_empty(g), F.concat(head, F.lit(" EMPTY"))).otherwise(F.concat(head, F.lit(" "), body))


def to_geojson(g, *, include_z: bool = True) -> Column:
    at = lambda p: F.concat(F.lit("["), F.concat_ws(",", *[F.when(p[k].isNotNull(), p[k].cast("string")) for k in ("xyz" if include_z else "xy")]), F.lit("]"))
    nest = lambda a: F.concat(F.lit("["), F.array_join(a, ","), F.lit("]"))
    seq = lambda r: nest(F.transform(r, at))
    kind, parts = G.kind(g), G.parts(g)
    flat = F.flatten(F.flatten(parts))
    body = (
        F.when(G.is_empty(g), "[]").when(kind == G.POINT, at(F.get(flat, F.lit(0)))).when(kind.isin(G.LINE, G.MULTIPOINT), seq(flat))
        .when(kind.isin(G.POLYGON, G.MULTILINE), nest(F.transform(F.flatten(parts), seq))).otherwise(nest(F.transform(parts, lambda p: nest(F.transform(p, seq)))))
    )
    return F.concat(F.lit('{"type":"'), G.geometry_type(g), F.lit('","coordinates":'), body, F.lit("}"))


def to_feature(g, properties: Column | None = None, id: Column | None = None) -> Column:
    """A GeoJSON feature as text; properties is a struct or map."""
    props = F.lit("null") if properties is None else F.coalesce(F.to_json(properties), F.lit("null"))
    head = F.lit('{"type":"Feature"') if id is None else F.concat(F.lit('{"type":"Feature","id":'), F.to_json(F.struct(id.alias("v"))).substr(F.lit(6), F.length(F.to_json(F.struct(id.alias("v")))) - 6))
    return F.concat(head, F.lit(',"geometry":'), F.coalesce(to_geojson(g), F.lit("null")), F.lit(',"properties":'), props, F.lit("}"))


def _vertex(values, z: bool, m: bool) -> dict:
    values = list(map(float, values))
    return {"x": values[0], "y": values[1], "z": values[2] if z else None, "m": values[2 + z] if m else None}


def parse_wkt(text: str | None) -> dict | None:
    if text is None:
        return None
    found = re.fullmatch(r"\s*(?:SRID=\d+;)?\s*([A-Za-z]+)\s*(ZM|Z|M)?\s*(EMPTY|\(.*\))\s*", text, re.S | re.I)
    if not found or found[1].upper() not in NAMES[:6]:
        raise ValueError(f"not well-known text: {text[:60]!r}")
    kind, tag = NAMES.index(found[1].upper()) + 1, (found[2] or "").upper()
    if found[3].upper() == "EMPTY":
        return {"kind": kind, "parts": []}
    rows = json.loads(re.sub(r"[^(),\s][^(),]*", lambda m: json.dumps(m[0].strip()), found[3]).replace("(", "[").replace(")", "]"))
    some = rows
    while isinstance(some, list):
        some = some[0]
    n = len(some.split())
    z, m = "Z" in tag or (not tag and n >= 3), "M" in tag or (not tag and n == 4)
    one = lambda s: _vertex((s[0] if isinstance(s, list) else s).split(), z, m)
    if kind in (1, 4):
        parts = [[[one(v)]] for v in rows]
    elif kind == 2:
        parts = [[[one(v) for v in rows]]]
    elif kind == 5:
        parts = [[[one(v) for v in line]] for line in rows]
    else:
        parts = [[[one(v) for v in r] for r in p] for p in ([rows] if kind == 3 else rows)]
    return _checked(kind, parts)


def _checked(kind: int, parts: list) -> dict:
    for p in parts:
        for r in p:
            if kind in (2, 5) and len(r) < 2 or kind in (3, 6) and (len(r) < 4 or (r[0]["x"], r[0]["y"]) != (r[-1]["x"], r[-1]["y"])):
                raise ValueError("a line needs two vertices, a ring four and the first again at its end")
    return {"kind": kind, "parts": parts}


def parse_geojson(text: str | None) -> dict | None:
    if text is None:
        return None
    data = json.loads(text)
    data = data.get("geometry", data) if data.get("type") == "Feature" else data
    if data is None:
        return None
    kinds = {v: k for k, v in G.KINDS.items()}
    kind, c = kinds[data["type"]], data["coordinates"]
    v = lambda p: _vertex(p, len(p) > 2, False)
    if not c:
        return {"kind": kind, "parts": []}
    parts = {1: lambda: [[[v(c)]]], 2: lambda: [[[v(p) for p in c]]], 3: lambda: [[[v(p) for p in r] for r in c]], 4: lambda: [[[v(p)]] for p in c], 5: lambda: [[[v(p) for p in r]] for r in c], 6: lambda: [[[v(p) for p in r] for r in q] for q in c]}[kind]()
    return _checked(kind, parts)


def parse_wkb(data: bytes | None) -> dict | None:
    if data is None:
        return None
    data, at = bytes(data), 0

    def read(order: str, form: str):
        nonlocal at
        out = struct.unpack_from(order + form, data, at)
        at += struct.calcsize(order + form)
        return out

    def one():
        order = "<" if read("<", "B")[0] else ">"
        (code,) = read(order, "I")
        z, m = bool(code & 0x80000000) or (code & 0xFFFF) // 1000 in (1, 3), bool(code & 0x40000000) or (code & 0xFFFF) // 1000 in (2, 3)
        if code & 0x20000000:
            read(order, "I")
        kind, width = (code & 0xFFFF) % 1000, 2 + z + m
        seq = lambda: [_vertex(read(order, f"{width}d"), z, m) for _ in range(read(order, "I")[0])]
        if kind == 1:
            v = _vertex(read(order, f"{width}d"), z, m)
            return kind, [] if v["x"] != v["x"] else [[[v]]]
        if kind == 2:
            line = seq()
            return kind, [[line]] if line else []
        if kind == 3:
            rings = [seq() for _ in range(read(order, "I")[0])]
            return kind, [rings] if rings else []
        if kind in (4, 5, 6):
            return kind, [p for _ in range(read(order, "I")[0]) for p in one()[1]]
        raise ValueError(f"kind {kind} is not supported")

    return _checked(*one())


def write_wkb(g) -> bytes | None:
    if g is None:
        return None
    kind, parts = g["kind"], g["parts"]
    some = next((r[0] for p in parts for r in p if r), None)
    axes = [k for k in "xyzm" if k in "xy" or (some is not None and some[k] is not None)]
    code = lambda k: struct.pack("<BI", 1, k + 1000 * (("z" in axes) + 2 * ("m" in axes)))
    seq = lambda r: struct.pack("<I", len(r)) + b"".join(struct.pack(f"<{len(axes)}d", *[v[k] for k in axes]) for v in r)

    def one(k, p):
        if k == 1:
            return code(1) + struct.pack(f"<{len(axes)}d", *[p[0][0][a] for a in axes])
        return code(2) + seq(p[0]) if k == 2 else code(3) + struct.pack("<I", len(p)) + b"".join(map(seq, p))

    if kind <= 3:
        nothing = {1: code(1) + struct.pack("<2d", float("nan"), float("nan")), 2: code(2) + struct.pack("<I", 0), 3: code(3) + struct.pack("<I", 0)}
        return one(kind, parts[0]) if parts else nothing[kind]
    return code(kind) + struct.pack("<I", len(parts)) + b"".join(one(kind - 3, p) for p in parts)


def from_wkt(c) -> Column:
    return F.udf(parse_wkt, G.GEOMETRY, useArrow=True)(G.col(c))


def from_wkb(c) -> Column:
    return F.udf(parse_wkb, G.GEOMETRY, useArrow=True)(G.col(c))


def from_geojson(c) -> Column:
    return F.udf(parse_geojson, G.GEOMETRY, useArrow=True)(G.col(c))


def to_wkb(g) -> Column:
    return F.udf(write_wkb, "binary", useArrow=True)(G.col(g))


def to_polyline(g, precision: int = 5) -> Column:
    """Encoded polyline of a line or point, latitude first."""
    whole = lambda c: F.floor(c * float(10**precision) + 0.5).cast("long")
    r = G.vertices(g)
    flat = F.flatten(F.transform(r, lambda v, i: F.array(*[whole(v[k]) - F.when(i == 0, F.lit(0).cast("long")).otherwise(whole(F.get(r, i - 1)[k])) for k in "yx"])))

    def code(d):
        n = F.when(d < 0, -2 * d - 1).otherwise(2 * d)
        size = F.when(n == 0, 1).otherwise(F.ceil(F.length(F.bin(n)) / 5)).cast("int")
        return F.array_join(F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.char(F.floor(n / F.pow(F.lit(32.0), i)).cast("long").bitwiseAND(F.lit(31)) + F.when(i < size - 1, 32).otherwise(0) + 63)), "")

    return F.array_join(F.transform(flat, code), "")


def from_polyline(c, precision: int = 5) -> Column:
    """The point or line of an encoded polyline; an empty text is an empty line, a text that ends early an error."""
    text = G.col(c)
    long = F.lit(0).cast("long")
    chunks = F.regexp_extract_all(text, F.lit("[_-~]*[?-^]"), F.lit(0))
    part = lambda ch: (F.ascii(ch) - 63).cast("long").bitwiseAND(F.lit(31))
    whole = lambda s: F.aggregate(F.reverse(F.filter(F.split(s, ""), lambda x: x != "")), long, lambda n, ch: n * 32 + part(ch))
    steps = F.transform(chunks, lambda s: G.let(whole(s), lambda n: F.when(n % 2 == 1, -F.shiftright(n, 1) - 1).otherwise(F.shiftright(n, 1))))
    cell = lambda y, x: F.struct((x / float(10**precision)).alias("x"), (y / float(10**precision)).alias("y"), F.lit(None).cast("double").alias("z"), F.lit(None).cast("double").alias("m"))
    start = F.struct(long.alias("y"), long.alias("x"), F.array().cast("array<struct<x:double,y:double,z:double,m:double>>").alias("out"))

    def line(d):
        add = lambda a, i: G.let(F.struct((a["y"] + F.get(d, 2 * i)).alias("y"), (a["x"] + F.get(d, 2 * i + 1)).alias("x")), lambda s: F.struct(s["y"].alias("y"), s["x"].alias("x"), F.concat(a["out"], F.array(cell(s["y"], s["x"]))).alias("out")))
        pairs = F.filter(F.sequence(F.lit(0), F.greatest(F.size(d) / 2 - 1, F.lit(0)).cast("int")), lambda i: 2 * i < F.size(d))
        out = F.aggregate(pairs, start, add, lambda a: a["out"])
        return G.let(out, lambda v: F.struct(F.when(F.size(v) == 1, 1).otherwise(2).alias("kind"), F.when(F.size(v) > 0, F.array(F.array(v))).otherwise(F.array().cast("array<array<array<struct<x:double,y:double,z:double,m:double>>>>")).alias("parts")))

    early = (F.length(F.array_join(chunks, "")) < F.length(text)) | (F.size(chunks) % 2 == 1)
    return F.when(text.isNull(), None).when(early, F.raise_error(F.lit("the polyline ends early")).cast(G.GEOMETRY)).otherwise(G.let(steps, line).cast(G.GEOMETRY))
