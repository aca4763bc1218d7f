"""Exact order statistics of groups of any size: medians and running sums over counts of distinct values.

No task or buffer holds a group's values. A group with many distinct values is narrowed down in rounds: a mergeable quantile sketch gives
pivots, all tasks count exactly between them, and the cell that holds the middle is split again, until few values are left.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.sources.durable import durable, small

#: Distinct values that a group's last step, or its only one, may hold.
CELLS = 10_000  # 2 at least, for two middle values
#: Cells that a round splits an interval into, and the accuracy of the sketch that finds their bounds.
PIVOTS, ACCURACY = 64, 2_000


def _pivots(values: DataFrame, keys: list[str], n: int = PIVOTS) -> DataFrame:
    return values.groupBy(*keys).agg(F.array_distinct(F.percentile_approx("value", F.array(*[F.lit(i / n) for i in range(1, n)]), F.lit(ACCURACY))).alias("_pivots"))


def _part() -> Column:
    """How many pivots lie below the value: rises with the value."""
    return F.size(F.filter("_pivots", lambda p: p < F.col("value")))


def _same(keys: Iterable[str], other: str = "_k") -> Column:
    on = F.lit(True)
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"{other}{i}"))
    return on


def _renamed(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.withColumnsRenamed({k: f"_k{i}" for i, k in enumerate(keys)})


def most_cells(counts: DataFrame, keys: list[str]) -> int:
    """Rows of the largest group of counts."""
    return counts.groupBy(*keys).agg(F.count("value").alias("_cells")).agg(F.max("_cells")).first()[0] or 0


def medians(counts: DataFrame, keys: list[str], out: str = "median", most: int | None = None) -> DataFrame:
    """The exact median of each group, the mean of the two middle ones for an even number: keys, `out`. counts: keys, value, _n (how often; a value
    may stand in several rows), kept durably. Nulls don't count; a group of nulls has a null median. most: most_cells or a bound on it, if known."""
    if (most_cells(counts, keys) if most is None else most) <= CELLS:
        return counts.groupBy(*keys).agg(F.percentile("value", F.lit(0.5), F.col("_n")).alias(out))
    sizes = durable(counts.groupBy(*keys).agg(F.count("value").alias("_cells"), F.sum(F.when(F.col("value").isNotNull(), F.col("_n"))).alias("_total")))
    large = sizes.filter(F.col("_cells") > CELLS)
    few = _renamed(sizes.filter(F.col("_cells") <= CELLS), keys).select(*[f"_k{i}" for i in range(len(keys))])
    done = [counts.join(small(durable(few)), _same(keys), "left_semi").groupBy(*keys).agg(F.percentile("value", F.lit(0.5), F.col("_n")).alias(out))]
    # an open group: its interval of values, and how many values lie below it
    open_groups = durable(large.select(*keys, "_total", F.lit(float("-inf")).alias("_lo"), F.lit(float("inf")).alias("_hi"), F.lit(0).cast("long").alias("_before")))
    first, second = F.floor((F.col("_total") - 1) / 2), F.floor(F.col("_total") / 2)
    while not open_groups.isEmpty():
        bounds = small(_renamed(open_groups, keys))
        inside = counts.filter(F.col("value").isNotNull()).join(bounds, _same(keys) & (F.col("value") >= F.col("_lo")) & (F.col("value") <= F.col("_hi"))).select(*keys, "value", "_n", "_total", "_before")
        split = inside.join(small(_renamed(durable(_pivots(inside, keys)), keys)), _same(keys)).withColumn("_part", _part())
        cells = split.groupBy(*keys, "_part").agg(F.sum("_n").alias("_in"), F.count("*").alias("_cells"), F.min("value").alias("_lo"), F.max("value").alias("_hi"), F.first("_total").alias("_total"), F.first("_before").alias("_start"))
        upto = F.col("_start") + F.sum("_in").over(Window.partitionBy(*keys).orderBy("_part"))  # PIVOTS rows a group at most
        held = cells.withColumn("_upto", upto).withColumn("_before", F.col("_upto") - F.col("_in")).filter((F.col("_before") <= second) & (F.col("_upto") > first))
        held = durable(held.groupBy(*keys).agg(F.first("_total").alias("_total"), F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"), F.min("_before").alias("_before"), F.sum("_cells").alias("_cells")))
        settled = durable(held.filter(F.col("_cells") <= CELLS))
        if not settled.isEmpty():
            last = counts.join(small(_renamed(settled, keys)), _same(keys) & (F.col("value") >= F.col("_lo")) & (F.col("value") <= F.col("_hi"))).select(*keys, "value", "_n", "_total", "_before")
            upto = F.col("_before") + F.sum("_n").over(Window.partitionBy(*keys).orderBy("value").rowsBetween(Window.unboundedPreceding, 0))  # CELLS rows a group at most
            at = lambda k: F.min(F.when(F.col("_upto") > k, F.col("value")))
            done.append(last.withColumn("_upto", upto).groupBy(*keys).agg(((at(first) + at(second)) / 2).alias(out)))
        open_groups = durable(held.filter(F.col("_cells") > CELLS).drop("_cells"))
    whole = done[0]
    for d in done[1:]:
        whole = whole.unionByName(d)
    return durable(whole)


def running_sums(counts: DataFrame, columns: list[str]) -> DataFrame:
    """Adds <column>_below, the sum over rows of smaller value, to counts: value (distinct, not null, kept durably) and the columns. Parts between
    pivots are summed first, so no task holds all values."""
    pivots = _pivots(counts, [], 256)
    parts = counts.join(F.broadcast(pivots)).withColumn("_part", _part()).drop("_pivots")  # pivots are one row
    sums = parts.groupBy("_part").agg(*[F.sum(c).alias(f"_{c}") for c in columns])
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # 256 rows at most
    starts = sums.select("_part", *[F.coalesce(F.sum(f"_{c}").over(earlier), F.lit(0)).alias(f"_{c}_start") for c in columns])
    own = Window.partitionBy("_part").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    below = {f"{c}_below": F.col(f"_{c}_start") + F.coalesce(F.sum(c).over(own), F.lit(0)) for c in columns}
    return parts.join(F.broadcast(starts), "_part").withColumns(below).select(*counts.columns, *below)
