"""Unions of coverages as polygons, assembled by joins: no group of polygons is ever gathered."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meridia.functions import constructive as P
from meridia.functions import geometry as G
from meridia.functions import measures as M
from meridia.operators.saved import saved


def _sides(df: DataFrame, geometry: str, by: list[str]) -> DataFrame:
    """by, ax, ay, bx, by_: the directed sides of polygons, the inside on their left."""
    rings = F.flatten(F.transform(G.parts(P.orient(F.col(geometry), ccw=True)), lambda p: p))
    pairs = F.flatten(F.transform(rings, lambda r: G.pairs(r, lambda a, b: F.struct(a["x"].alias("ax"), a["y"].alias("ay"), b["x"].alias("bx"), b["y"].alias("by_")))))
    return df.where(G.dimension(F.col(geometry)) == 2).select(*by, F.explode(pairs).alias("s_")).select(*by, "s_.*").where("ax <> bx or ay <> by_")


def _outer(sides: DataFrame, by: list[str]) -> DataFrame:
    """Sides that no other polygon of the group has the other way."""
    forth = (F.col("ax") < F.col("bx")) | ((F.col("ax") == F.col("bx")) & (F.col("ay") < F.col("by_")))
    low = [F.when(forth, F.col(p)).otherwise(F.col(q)).alias(n) for p, q, n in (("ax", "bx", "x1"), ("ay", "by_", "y1"), ("bx", "ax", "x2"), ("by_", "ay", "y2"))]
    counts = sides.select(*by, *low, forth.alias("forth")).groupBy(*by, "x1", "y1", "x2", "y2").agg(F.sum(F.when(F.col("forth"), 1).otherwise(-1)).alias("n"))
    once = counts.where("n <> 0")
    pick = lambda a, b: F.when(F.col("n") > 0, F.col(a)).otherwise(F.col(b))
    return once.select(*by, pick("x1", "x2").alias("ax"), pick("y1", "y2").alias("ay"), pick("x2", "x1").alias("bx"), pick("y2", "y1").alias("by_"))


def _linked(numbered: DataFrame, by: list[str], left: bool) -> DataFrame:
    """Numbered sides with the number of the one that follows: of several at a vertex the one furthest to the left, or to the right."""
    after = numbered.select(*by, F.col("ax").alias("bx"), F.col("ay").alias("by_"), F.col("side").alias("next"), F.col("bx").alias("cx"), F.col("by_").alias("cy"))
    turn = F.atan2(
        (F.col("ax") - F.col("bx")) * (F.col("cy") - F.col("by_")) - (F.col("ay") - F.col("by_")) * (F.col("cx") - F.col("bx")),
        (F.col("ax") - F.col("bx")) * (F.col("cx") - F.col("bx")) + (F.col("ay") - F.col("by_")) * (F.col("cy") - F.col("by_")),
    )
    around = F.when(turn <= 1e-12, turn + 2 * math.pi).otherwise(turn)  # from the way back, against the clock
    best = (F.max_by if left else F.min_by)(F.struct(*by, "ax", "ay", "bx", "by_", "next"), F.struct(around.alias("t"), "next"))
    return numbered.join(after, [*by, "bx", "by_"]).groupBy("side").agg(best.alias("k")).select("side", "k.*")


def _lowest(links: DataFrame) -> DataFrame:
    """(side, low): the smallest number in each side's ring. Pointers double in each round."""
    here = links.select("side", F.col("next").alias("to"), F.least("side", "next").alias("low"))
    while True:
        there = here.select(F.col("side").alias("to"), F.col("to").alias("to2"), F.col("low").alias("low2"))
        new = saved(here.join(there, "to").select("side", F.col("to2").alias("to"), F.least("low", "low2").alias("low"), (F.col("low2") < F.col("low")).alias("moved")))
        here = new.drop("moved")
        if new.where("moved").isEmpty():
            return here.select("side", "low")


def rings_of_sides(sides: DataFrame, by: list[str]) -> DataFrame:
    """by, ring (array of vertices x, y, closed): closed ways of directed sides, the inside on their left.

    At a vertex where several ways pass, each first keeps to the left, which parts polygons that touch;
    ways that pass a vertex twice then keep to the right there, which parts them from their holes. A
    ring of n sides takes about log2(n) joins for its number and as many for its order, and only its
    own vertices come together in a row.
    """
    numbered = saved(sides.withColumn("side", F.monotonically_increasing_id()))
    first = saved(_linked(numbered, by, True))
    links = saved(_linked(numbered.join(_lowest(first).withColumnRenamed("low", "way_"), "side"), [*by, "way_"], False).drop("way_"))
    low = _lowest(links)
    # the way ends where it comes back to the smallest
    far = links.select("side", "next").join(low, "side").select("side", "low", F.when(F.col("next") != F.col("low"), F.col("next")).alias("to"), F.when(F.col("next") != F.col("low"), 1).otherwise(0).cast("long").alias("left"))
    far = saved(far)
    while not far.where("to is not null").isEmpty():
        there = far.select(F.col("side").alias("to"), F.col("to").alias("to2"), F.col("left").alias("left2"))
        far = saved(far.join(there, "to", "left").select("side", "low", F.col("to2").alias("to"), (F.col("left") + F.coalesce("left2", F.lit(0))).alias("left")))
    placed = links.join(far.select("side", "low", "left"), "side")
    order = F.sort_array(F.collect_list(F.struct("left", F.col("ax").alias("x"), F.col("ay").alias("y"))), asc=False)
    made = placed.groupBy(*by, "low").agg(order.alias("v")).select(*by, F.transform("v", lambda v: F.struct(v["x"].alias("x"), v["y"].alias("y"))).alias("v"))
    return made.select(*by, F.concat("v", F.slice("v", 1, 1)).alias("ring"))


def _area(ring: Column) -> Column:
    return G.total(G.pairs(ring, lambda a, b: (a["x"] * b["y"] - b["x"] * a["y"]) / 2))


def coverage_union(df: DataFrame, geometry: str, by: list[str] | None = None) -> DataFrame:
    """`by` and `geometry`: a row for each polygon of the union of a coverage, by groups.

    The polygons of a group must be a coverage: they meet only in whole sides. Sides that two of them
    have fall away, and the rest closes to rings; a hole goes to the smallest shell around it. Missing
    geometries and such as are no polygons count for nothing.
    """
    by = by or []
    rings = rings_of_sides(_outer(_sides(df, geometry, by), by), by).withColumn("a_", _area(F.col("ring")))
    rings = saved(rings.withColumn("r_", F.monotonically_increasing_id()).withColumn("ring", F.transform("ring", lambda v: G.vertex(v["x"], v["y"]))))
    shells, holes = rings.where("a_ > 0"), rings.where("a_ < 0")
    if holes.isEmpty():
        return shells.select(*by, G.polygon(F.col("ring")).alias(geometry))
    from meridia.operators.joins import candidates

    outer = shells.select("r_", "a_", *[F.col(c).alias(f"o_{i}") for i, c in enumerate(by)], G.polygon(F.col("ring")).alias("o_g"))
    # a place just inside a side of the hole's ring decides, as its vertices may lie on the shell
    a, b = F.col("ring")[0], F.col("ring")[1]
    off = lambda k, o, s: (a[k] + b[k]) / 2 + s * (b[o] - a[o]) * 1e-7  # noqa: E731 - a hole's ring has the polygon on its left
    inner = holes.select(F.col("r_").alias("h_"), F.col("ring").alias("h_ring"), *[F.col(c).alias(f"i_{i}") for i, c in enumerate(by)], G.point(off("x", "y", -1), off("y", "x", 1)).alias("h_p"))
    same = F.lit(True)
    for i in range(len(by)):
        same = same & F.col(f"o_{i}").eqNullSafe(F.col(f"i_{i}"))
    found = candidates(outer, inner, "o_g", "h_p").where(same & M.contains_xy(F.col("o_g"), G.x("h_p"), G.y("h_p")))
    of = found.groupBy("h_").agg(F.min_by("r_", F.struct("a_", "r_")).alias("r_"), F.first("h_ring").alias("h_ring"))
    of = of.groupBy("r_").agg(F.collect_list("h_ring").alias("holes_"))
    return shells.join(of, "r_", "left").select(*by, F.when(F.col("holes_").isNull(), G.polygon(F.col("ring"))).otherwise(G.polygon(F.col("ring"), F.col("holes_"))).alias(geometry))
