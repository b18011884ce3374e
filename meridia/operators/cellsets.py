"""Sets of cells as rows: compaction and set algebra by joins on the cells above, so no set has to fit a row.

A table has columns by which its rows belong together and a column of cells; cells of several levels
mix, and a cell stands for all below it. Results are compact: no cell within another, complete
families as their parent.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meridia.functions import cells as C
from meridia.functions import grids, h3
from meridia.operators.saved import saved, spread


class Levels:
    """What sets need of a grid, as columns: a cell's level, its parent at a level, its children, and how many there are."""

    def __init__(self, finest: int, level: Callable, parent: Callable, children: Callable, family: Callable):
        self.finest, self.level, self.parent, self.children, self.family = finest, level, parent, children, family

    def above(self, cell: str, own: bool = True) -> Column:
        """Array of a cell's ancestors, itself too with `own`."""
        c = F.col(cell)
        up = F.filter(F.sequence(F.lit(0), F.lit(self.finest)), lambda n: n <= self.level(c) if own else n < self.level(c))
        return F.transform(up, lambda n: self.parent(c, n))


def _tile_at(c: Column, n: Column) -> Column:
    z = F.shiftrightunsigned(c, 58)
    low = c.bitwiseAND(F.lit((1 << 58) - 1))
    return F.shiftleft(n.cast("long"), 58).bitwiseOR(F.call_function("shiftright", low, ((z - n) * 2).cast("int")))


def _s2_at(c: Column, n: Column) -> Column:
    low = F.call_function("shiftleft", F.lit(1).cast("long"), (30 - n).cast("int") * 2)
    return c.bitwiseAND(-low).bitwiseOR(low)


TILES = Levels(29, lambda c: F.shiftrightunsigned(c, 58).cast("int"), _tile_at, C.tile_children, lambda c: F.lit(4))
S2 = Levels(30, grids.s2_level, _s2_at, grids.s2_children, lambda c: F.lit(4))
H3 = Levels(h3.FINEST, h3.h3_resolution, h3.h3_parent, h3.h3_children, lambda c: F.when(h3.h3_is_pentagon(c), 6).otherwise(7))
GEOHASH = Levels(12, lambda c: F.length(c), lambda c, n: F.substring(c, F.lit(1), n), lambda c: F.transform(F.array(*[F.lit(k) for k in C.GEOHASH]), lambda k: F.concat(c, k)), lambda c: F.lit(32))


def _clean(df: DataFrame, by: list[str], cell: str) -> DataFrame:
    return df.where(F.col(cell).isNotNull()).select(*by, cell).distinct()


def _up(df: DataFrame, by: list[str], cell: str, grid: Levels, own: bool = True) -> DataFrame:
    """Each cell with each of its ancestors as above_."""
    return df.select(*by, cell, F.explode(grid.above(cell, own)).alias("above_")).where("above_ is not null")


def outermost(df: DataFrame, by: list[str], cell: str, grid: Levels) -> DataFrame:
    """The cells that are within no other of their rows, each once. Only ancestors of levels that the table has are looked up."""
    one = saved(_clean(df, by, cell))
    levels = sorted(r[0] for r in one.select(grid.level(F.col(cell))).distinct().collect())  # at most as many as the grid has
    if len(levels) < 2:
        return one
    up = F.transform(F.filter(F.array(*map(F.lit, levels)), lambda n: n < grid.level(F.col(cell))), lambda n: grid.parent(F.col(cell), n))
    inner = one.select(*by, cell, F.explode(up).alias("above_")).join(one.withColumnRenamed(cell, "above_"), [*by, "above_"], "left_semi").select(*by, cell).distinct()
    return one.join(inner, [*by, cell], "left_anti")


def compact(df: DataFrame, by: list[str], cell: str, grid: Levels) -> DataFrame:
    """The same area by the fewest cells. Families are gathered level by level, finest first, each level written before the next."""
    done, rest = None, saved(outermost(df, by, cell, grid).withColumn("level_", grid.level(F.col(cell))))
    levels = [r[0] for r in rest.select("level_").distinct().collect()]  # at most as many as the grid has
    for n in range(max(levels, default=0), 0, -1):
        here, coarser = rest.where(F.col("level_") == n), rest.where(F.col("level_") < n)
        if here.isEmpty():
            continue
        # a family is a few cells, so one shuffle both counts and keeps them
        family = here.groupBy(*by, grid.parent(F.col(cell), F.lit(n - 1)).alias("up_")).agg(F.collect_list(cell).alias("cells_"))
        family = saved(family.withColumn("full_", F.size("cells_") == grid.family(F.col("up_"))))
        left = family.where(~F.col("full_")).select(*by, F.explode("cells_").alias(cell))
        full = family.where("full_").select(*by, F.col("up_").alias(cell), F.lit(n - 1).alias("level_"))
        done = left if done is None else done.union(left)
        rest = saved(coarser.union(full)) if not full.isEmpty() else coarser
    rest = rest.select(*by, cell)
    return rest if done is None else done.union(rest)


def uncompact(df: DataFrame, by: list[str], cell: str, grid: Levels, level: int) -> DataFrame:
    """Cells of one level in place of coarser ones; finer ones stay."""
    rest = saved(_clean(df, by, cell))
    first = rest.agg(F.min(grid.level(F.col(cell)))).first()[0]
    for n in range(level if first is None else first, level):
        # cells are few bytes and their children many: more tasks than the table has
        here = F.when(grid.level(F.col(cell)) == n, grid.children(F.col(cell))).otherwise(F.array(cell))
        rest = saved(spread(rest, cell).select(*by, F.explode(here).alias(cell)))
    return rest.distinct()


def union(a: DataFrame, b: DataFrame, by: list[str], cell: str, grid: Levels) -> DataFrame:
    return compact(a.select(*by, cell).union(b.select(*by, cell)), by, cell, grid)


def intersection(a: DataFrame, b: DataFrame, by: list[str], cell: str, grid: Levels) -> DataFrame:
    """Cells of either side that are within one of the other."""
    a, b = outermost(a, by, cell, grid), outermost(b, by, cell, grid)
    within = lambda x, y: _up(x, by, cell, grid).join(y.withColumnRenamed(cell, "above_"), [*by, "above_"], "left_semi").select(*by, cell)
    return compact(within(a, b).union(within(b, a)), by, cell, grid)


def difference(a: DataFrame, b: DataFrame, by: list[str], cell: str, grid: Levels) -> DataFrame:
    """What of a is in no cell of b. Cells of a that hold smaller ones of b are opened level by level, and only those."""
    a, b = outermost(a, by, cell, grid), saved(outermost(b, by, cell, grid))
    holders = saved(_up(b, by, cell, grid, own=False).select(*by, F.col("above_").alias(cell)).distinct())
    covered = _up(a, by, cell, grid).join(b.withColumnRenamed(cell, "above_"), [*by, "above_"], "left_semi").select(*by, cell).distinct()
    rest, out = saved(a.join(covered, [*by, cell], "left_anti")), None
    while not rest.isEmpty():
        keep = rest.join(holders, [*by, cell], "left_anti")
        out = keep if out is None else out.union(keep)
        opened = rest.join(holders, [*by, cell], "left_semi").select(*by, F.explode(grid.children(F.col(cell))).alias(cell))
        rest = saved(opened.join(b, [*by, cell], "left_anti"))
    return compact(out if out is not None else a.limit(0), by, cell, grid)
