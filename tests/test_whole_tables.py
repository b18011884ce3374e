"""Queries answer for every row of their tables, against plain Python."""

from __future__ import annotations

import math

import pyarrow.parquet as pq

from meridia.plans import catalog

SF = "/root/testdata/sf0.001"


def test_a_pole_for_every_ring(spark):
    keys = pq.read_table(f"{SF}/customer.parquet")["c_custkey"].to_pylist()
    got = {r["c_custkey"]: r["distance"] for r in catalog.QUERIES["ring_poles"](spark, SF).collect()}
    assert sorted(got) == sorted(keys) and any(k % 20 for k in keys)
    assert all(abs(got[k] - (1 + k % 7) * math.cos(math.pi / (4 + k % 9))) < 0.051 for k in keys)


def test_a_part_of_every_track(spark):
    users = {}
    for e in pq.read_table(f"{SF}/events.parquet").to_pylist():
        users.setdefault(e["user_id"], []).append((e["ts"], e["event_id"], e["event_id"] % 360 - 180, e["value"]))
    want = {}
    for u, rows in users.items():
        at = [x[2:] for x in sorted(rows)]
        if len(at) > 1:
            want[u] = sum(map(math.dist, at, at[1:])) / 4
    got = {r["user_id"]: r["length"] for r in catalog.QUERIES["line_substring"](spark, SF).collect()}
    assert got.keys() == want.keys() and any(u % 10 for u in want)
    assert all(abs(got[u] - want[u]) < 0.002 for u in want)


def within(ring, x0, y0, x1, y1):
    """Area of a convex ring within a box: vertical chords between all places where their length bends."""
    edges = list(zip(ring, ring[1:] + ring[:1]))
    bends = {x0, x1} | {p[0] for p in ring}
    for (ax, ay), (bx, by) in edges:
        bends |= {ax + (bx - ax) * (y - ay) / (by - ay) for y in (y0, y1) if min(ay, by) < y < max(ay, by)}
    bends = sorted(x for x in bends if x0 <= x <= x1)

    def chord(x):
        ys = [ay + (by - ay) * (x - ax) / (bx - ax) for (ax, ay), (bx, by) in edges if min(ax, bx) < x < max(ax, bx)]
        return max(0.0, min(max(ys), y1) - max(min(ys), y0)) if ys else 0.0

    return sum((b - a) * chord((a + b) / 2) for a, b in zip(bends, bends[1:]) if b - a > 1e-12)


def test_every_ring_clipped(spark):
    keys = pq.read_table(f"{SF}/customer.parquet")["c_custkey"].to_pylist()
    want, cut = {}, 0
    for k in keys:
        lon, lat, n, size = (k * 7919) % 36000 / 100 - 180, (k * 6971) % 17000 / 100 - 85, 4 + k % 9, 1 + k % 7
        ring = [(lon + size * math.cos(2 * math.pi * i / n), lat + size * math.sin(2 * math.pi * i / n)) for i in range(n)]
        x0, y0 = -180 + 72 * ((lon + 180) // 72), -85 + 34 * ((lat + 85) // 34)
        want[k] = within(ring, x0, y0, x0 + 72, y0 + 34)
        cut += want[k] < within(ring, -999, -999, 999, 999) - 0.001
    got = {r["c_custkey"]: r["area"] for r in catalog.QUERIES["clip_rings"](spark, SF).collect()}
    assert got.keys() == want.keys() and 20 < cut < len(keys)
    assert all(abs(got[k] - want[k]) < 1e-5 for k in keys)
