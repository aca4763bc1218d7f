"""Self and peer baselines over long rows (user, period, feature, value): robust centre, spread and z."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, MapType, StringType, StructField, StructType

from plumbline.operators.selection import CELLS, medians, most_cells
from plumbline.sources.durable import BROADCAST_ROWS, durable, durable_columns, small

MAD_TO_SD = 1.4826
#: Fields of a stat, in order, and what is known of a group of peers.
STAT = {"value": pa.float64(), "self_center": pa.float64(), "self_z": pa.float64(), "self_first": pa.bool_(), "self_hist_max": pa.float64(), "peer_center": pa.float64(), "peer_z": pa.float64(), "peer_n": pa.int32()}
PEERS = ("peer_center", "peer_n", "_spread", "_from")
NOT_COUNTS = ("earliest_hour", "latest_hour", "attachment_bytes")


@dataclass(frozen=True)
class BaselineConfig:
    window: int = 12
    min_history: int = 6
    robust: bool = True
    z_self: float = 3.0
    z_peer: float = 4.0
    max_facts: int = 40
    floor_fraction: float = 0.05
    z_cap: float = 50.0
    min_peers: int = 5
    tiny: float = 1e-9


def array_median(values: Column) -> Column:
    """Median of an array; null if it is empty."""
    s = F.array_sort(values)
    n = F.size(values)
    return (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2


def array_mad(values: Column, centre: Column) -> Column:
    return array_median(F.transform(values, lambda v: F.abs(v - centre)))


def value_counts(rows: DataFrame, keys: list[str]) -> DataFrame:
    """How often each value stands in each group: what medians are taken of, so that a large group is counted by all tasks first."""
    return rows.groupBy(*keys, "value").agg(F.count("*").alias("_n"))


def middle_and_deviation(rows: DataFrame, keys: list[str], counts: DataFrame | None = None) -> DataFrame:
    """Median of each group's values, and of their distances from it: keys, _m, _mad, _n; exact at any size (see selection). counts: the rows'
    value_counts, kept durably, if at hand."""
    counts = durable(value_counts(rows, keys)) if counts is None else counts
    most = most_cells(counts, keys)
    kept = durable if most > CELLS else (lambda df: df)  # selection in rounds reads its input several times
    centres = durable(medians(counts, keys, "_m", most))
    apart = kept(counts.join(small(centres), keys).groupBy(*keys, F.abs(F.col("value") - F.col("_m")).alias("value")).agg(F.sum("_n").alias("_n")))
    sizes = counts.groupBy(*keys).agg(F.sum("_n").alias("_n"))
    return centres.join(medians(apart, keys, "_mad", most), keys).join(sizes, keys)


def global_scales(rows: DataFrame) -> DataFrame:
    """Spread of each feature over everything: scaled MAD, or where that is 0 the standard deviation, 1 at least."""
    return _scales(middle_and_deviation(rows, ["feature"]), rows.groupBy("feature").agg(F.stddev_pop("value").alias("_sd")))


def _scales(middles: DataFrame, deviations: DataFrame) -> DataFrame:
    scale = middles.join(deviations, "feature")
    mad = F.lit(MAD_TO_SD) * F.col("_mad")
    return scale.select("feature", F.when(mad > 0, mad).otherwise(F.greatest(F.coalesce("_sd", F.lit(1.0)), F.lit(1.0))).alias("scale"))


def spread_floor(feature: Column, centre: Column, scale: Column, config: BaselineConfig) -> Column:
    counts = F.sqrt(F.greatest(centre, F.lit(1.0)))
    return F.when(feature.isin(*NOT_COUNTS), F.greatest(F.lit(config.floor_fraction) * scale, F.lit(config.tiny))).otherwise(counts)


def clipped_z(value: Column, centre: Column, spread: Column, cap: float) -> Column:
    z = F.try_divide(value - centre, spread)
    return F.when(z.isNotNull(), F.greatest(F.lit(-cap), F.least(F.lit(cap), z)))


def _figures(values: np.ndarray, known: np.ndarray, row: np.ndarray, window: int, new: slice) -> tuple[np.ndarray, ...]:
    """_size, _middle, _apart and _top of the `window` rows before each of the `new` rows. row: its place in its group, from 0; values are NaN where not known."""
    past, size = np.full((len(values), window), np.nan), np.zeros(len(values), dtype=np.int32)
    for k in range(1, min(window, len(values) - 1) + 1):
        same = row[k:] >= k
        past[k:, k - 1] = np.where(same, values[:-k], np.nan)
        size[k:] += same & known[:-k]
    past, size = past[new], size[new]
    centre, apart, top = (np.where(size > 0, 0.0, np.nan) for _ in range(3))
    busy = np.flatnonzero((past == 0).sum(axis=1) < size)  # a history of zeros, as most are, needs no sorting
    past, some = past[busy], size[busy]
    at = lambda x, i: np.take_along_axis(x, i[:, None], 1)[:, 0]
    middle = lambda x: (at(x, (some - 1) // 2) + at(x, some // 2)) / 2
    if len(busy):
        with np.errstate(invalid="ignore", over="ignore"):
            past.sort(axis=1)  # what is missing comes last
            centre[busy], top[busy] = middle(past), at(past, some - 1)
            apart[busy] = middle(np.sort(np.abs(past - centre[busy, None]), axis=1))
    return size, centre, apart, top


def _places(rows: pa.Table, keys: tuple[str, ...]) -> np.ndarray:
    """Each row's place, from 0, among the neighbours that share its keys."""
    begins = np.ones(len(rows), dtype=bool)
    begins[1:] = False
    for k in keys:
        codes = rows[k].combine_chunks().dictionary_encode(null_encoding="encode")
        codes = (codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes).indices.to_numpy(zero_copy_only=False)
        begins[1:] |= codes[1:] != codes[:-1]
    places = np.arange(len(rows))
    return places - np.maximum.accumulate(np.where(begins, places, 0))


def _with_past(batches: Iterable[pa.RecordBatch], window: int, keys: tuple[str, ...], read: tuple[str, ...]) -> Iterator[tuple[pa.RecordBatch, pa.Table, np.ndarray, slice]]:
    """Each batch with the rows that histories need: its own after the last of the batches before, their places, and where its own are."""
    carried = None
    for batch in batches:
        own = pa.table([batch.column(c) for c in (*keys, *read)], [*keys, *read])
        rows = (own if carried is None else pa.concat_tables([carried, own])).combine_chunks()
        yield batch, rows, _places(rows, keys), slice(len(rows) - len(own), None)
        carried = rows.slice(max(0, len(rows) - window))


def _values(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Values, NaN where not known, and which are known."""
    known = column.is_valid().to_numpy()
    return np.where(known, column.cast(pa.float64()).fill_null(0.0).to_numpy(), np.nan), known


def past_figures(batches: Iterable[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Adds to rows in the order of user, feature and period: _size, _middle, _apart (median distance from it) and _top of the values in the `window`
    rows before each of its user and feature. Only the last rows of a batch are carried on to the next."""
    for batch, rows, places, new in _with_past(batches, window, ("user", "feature"), ("value",)):
        size, *found = _figures(*_values(rows["value"]), places, window, new)
        made = [pa.array(size), *[pa.array(x, mask=size == 0) for x in found]]
        yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*batch.schema.names, "_size", "_middle", "_apart", "_top"])


def _lines(column: pa.ChunkedArray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Values and which are known of lists of n, a line for each list that is not null."""
    values, known = _values(pa.chunked_array([column.combine_chunks().flatten()]))
    return values.reshape(-1, n), known.reshape(-1, n)


def wide_figures(batches: Iterable[pa.RecordBatch], names: tuple[str, ...], scales: tuple[float, ...], config: BaselineConfig) -> Iterator[pa.RecordBatch]:
    """Rows in the order of user and period, with rising numbers _row and lists of PEERS (one entry for each named column), become the other columns
    and stats, as `wide_stats` has them. scales: one for each named column. Rows without peers are left out, but stand in histories."""
    n, last = len(names), -1
    for batch, rows, places, new in _with_past(batches, config.window, ("user",), names):
        found, numbers = [], batch["_row"].to_numpy()
        if len(batch) and (numbers[0] <= last or (np.diff(numbers) <= 0).any()):
            raise ValueError("rows came out of order")
        last = numbers[-1] if len(batch) else last
        for name, scale in zip(names, scales):
            values, known = _values(rows[name])
            size, centre, apart, top = _figures(values, known, places, config.window, new)
            values, known, ready = values[new], known[new], size >= max(config.min_history, 1)
            floor = np.full(len(size), max(config.floor_fraction * scale, config.tiny)) if name in NOT_COUNTS else np.sqrt(np.maximum(centre, 1.0))
            with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
                spread = np.maximum(MAD_TO_SD * apart, floor)
                z = np.maximum(-config.z_cap, np.fmin(config.z_cap, (values - centre) / spread))
                first = (top == 0) & ((values > 0) | np.isnan(values))
            found.append([(values, known), (centre, ready), (z, ready & known & (spread != 0)), (first, ready & (known | (top != 0))), (top, ready)])
        table = pa.Table.from_batches([batch])
        kept = np.flatnonzero(table["_from"].is_valid().to_numpy())
        own = [tuple(np.stack([p[i] for p in parts], axis=1)[kept] for i in (0, 1)) for parts in zip(*found)]
        centre, count, spread, start = (_lines(table[c], n) for c in PEERS)
        with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
            z = np.maximum(-config.z_cap, np.fmin(config.z_cap, (own[0][0] - start[0]) / spread[0]))
        made = [*own, centre, (z, own[0][1] & start[1]), count]
        made[-1] = (np.where(count[1], count[0], 0).astype(np.int32), count[1])
        fields = [pa.array(v.ravel(), t, mask=~k.ravel()) for (v, k), t in zip(made, STAT.values())]
        called = pa.array(names).take(pa.array(np.tile(np.arange(n), len(kept))))
        stats = pa.MapArray.from_arrays(pa.array(np.arange(len(kept) + 1, dtype=np.int32) * n), called, pa.StructArray.from_arrays(fields, list(STAT)))
        others = [c for c in batch.schema.names if c not in (*names, *PEERS, "_row")]
        left = table.select(others).take(pa.array(kept)).combine_chunks()
        yield pa.RecordBatch.from_arrays([*[c.combine_chunks() for c in left.columns], stats], [*others, "stats"])


def self_baselines(rows: DataFrame, config: BaselineConfig = BaselineConfig(), scales: DataFrame | None = None) -> DataFrame:
    """Adds self_center, self_spread, self_z, self_first, self_hist_max from the user's earlier rows: the last `window` present
    ones, at least `min_history`, the row itself left out. Arrays hold `window` values at most. scales: global_scales, if at hand."""
    if config.robust:  # medians of all rows of a batch at once
        window = config.window
        ordered = rows.repartition("user", "feature").sortWithinPartitions("user", "feature", "period")
        schema = StructType([*rows.schema.fields, StructField("_size", IntegerType()), *[StructField(c, DoubleType()) for c in ("_middle", "_apart", "_top")]])
        h = ordered.mapInArrow(lambda batches: past_figures(batches, window), schema)
        ready, top = F.col("_size") >= config.min_history, F.col("_top")
        h = h.withColumn("self_center", F.when(ready, F.col("_middle"))).withColumn("_raw", F.lit(MAD_TO_SD) * F.when(ready, F.col("_apart")))
    else:
        earlier = Window.partitionBy("user", "feature").orderBy("period").rowsBetween(-config.window, -1)
        h = rows.withColumn("_h", F.collect_list("value").over(earlier))
        ready, top = F.size("_h") >= config.min_history, F.array_max("_h")
        h = h.withColumn("self_center", F.when(ready, F.aggregate("_h", F.lit(0.0), lambda s, v: s + v) / F.size("_h")))
        h = h.withColumn("_raw", F.when(ready, F.sqrt(F.aggregate("_h", F.lit(0.0), lambda s, v: s + (v - F.col("self_center")) ** 2) / F.size("_h"))))
    h = h.join(F.broadcast(global_scales(rows) if scales is None else scales), "feature")  # one row for each feature
    h = h.withColumn("self_spread", F.when(ready, F.greatest("_raw", spread_floor(F.col("feature"), F.col("self_center"), F.col("scale"), config))))
    return h.select(
        *rows.columns,
        "self_center",
        "self_spread",
        clipped_z(F.col("value"), F.col("self_center"), F.col("self_spread"), config.z_cap).alias("self_z"),
        F.when(ready, (top == 0) & (F.col("value") > 0)).alias("self_first"),
        F.when(ready, top).alias("self_hist_max"),
    )


def _spreads(middles: DataFrame, keys: list[str]) -> DataFrame:
    return middles.select(*keys, F.col("_m").alias("_c"), F.col("_n").alias("peer_n"), (F.lit(MAD_TO_SD) * F.col("_mad")).alias("_raw"))


def peer_spreads(rows: DataFrame, config: BaselineConfig = BaselineConfig(), role: str = "role", scales: DataFrame | None = None) -> DataFrame:
    """A row per role, period and feature: centre, size and raw spread of its values, and the feature's scale."""
    keys = ["feature", role, "period"]
    if config.robust:
        spreads = _spreads(middle_and_deviation(rows, keys), keys)
    else:
        spreads = rows.groupBy(*keys).agg(F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("_raw"), F.avg("value").alias("_c"), F.count("*").alias("peer_n"))
    return spreads.join(F.broadcast(global_scales(rows) if scales is None else scales), "feature")  # one row for each feature


def with_peers(rows: DataFrame, spreads: DataFrame, config: BaselineConfig = BaselineConfig(), role: str = "role") -> DataFrame:
    """Adds peer_center, peer_spread, peer_z, peer_n to rows from peer_spreads. The z is withheld at centre 0, centre and z in groups
    below min_peers; spread and size stay."""
    both = rows.join(small(durable(spreads)), ["feature", role, "period"])
    both = both.withColumn("peer_spread", F.greatest("_raw", spread_floor(F.col("feature"), F.col("_c"), F.col("scale"), config)))
    enough = F.col("peer_n") >= config.min_peers
    z = F.when(enough & (F.col("_c") != 0), clipped_z(F.col("value"), F.col("_c"), F.col("peer_spread"), config.z_cap))
    return both.select(*rows.columns, F.when(enough, F.col("_c")).alias("peer_center"), "peer_spread", z.alias("peer_z"), F.col("peer_n").cast("int").alias("peer_n"))


def peer_baselines(rows: DataFrame, config: BaselineConfig = BaselineConfig(), role: str = "role") -> DataFrame:
    """rows with the baselines of all rows of the same role, period and feature."""
    return with_peers(rows, peer_spreads(rows, config, role), config, role)


def baselines(rows: DataFrame, config: BaselineConfig = BaselineConfig(), role: str = "role") -> DataFrame:
    """Self and peer baselines of rows that are cheap to read again: the scales are found once, and rows are shuffled for the
    users' histories only."""
    scales = durable(global_scales(rows))
    # kept: what follows would else be merged with the nested medians of histories into expressions too large to plan
    return with_peers(durable(self_baselines(rows, config, scales)), peer_spreads(rows, config, role, scales), config, role)


def _sparse_counts(rows: DataFrame, names: tuple[str, ...], groups: list[str]) -> DataFrame:
    """value_counts of each group's named columns (feature: a column's place), kept durably. Most counts of a period are 0: rows are counted once, and
    zeros are those that have no other value."""
    n, keys = len(names), ["feature", *groups]
    each = rows.select(*groups, F.posexplode(F.array(*names, F.lit(0.0))).alias("feature", "value"))  # the last entry counts the rows
    counts = durable_columns(value_counts(each.filter(F.col("value").isNull() | (F.col("value") != 0) | (F.col("feature") == n)), keys))
    some, sizes = counts.filter(F.col("feature") < n), counts.filter(F.col("feature") == n)
    every = sizes.select(F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("feature"), *groups, "_n")
    zeros = every.unionByName(some.select(*keys, (-F.col("_n")).alias("_n"))).groupBy(*keys).agg(F.sum("_n").alias("_n")).filter(F.col("_n") > 0)
    return durable_columns(some.unionByName(zeros.select(*keys, F.lit(0.0).alias("value"), "_n")))


def wide_stats(wide: DataFrame, names: tuple[str, ...], config: BaselineConfig = BaselineConfig(), role: str = "role") -> DataFrame:
    """wide, kept durably: a row per (user, period) with its role and a column per feature. Columns of wide that are no features, and stats: feature -> struct
    of its value and robust baselines, as `baselines` finds them for long rows. A history is one sort of a user's rows for all features, and groups of
    peers are counted values, so no row is ever shuffled once a feature; maps are made for whole batches."""
    others = [c for c in wide.columns if c not in names]
    rows = wide.select(*others, *[F.col(c).cast("double").alias(c) for c in names])
    keys = ["feature", role, "period"]
    counts = _sparse_counts(rows, names, [role, "period"])
    deviations = rows.agg(F.array(*[F.stddev_pop(c) for c in names]).alias("_d")).select(F.posexplode("_d").alias("feature", "_sd"))
    # sums of the groups' counts are those of all rows
    every = durable_columns(counts.groupBy("feature", "value").agg(F.sum("_n").alias("_n")))
    scales = durable(_scales(middle_and_deviation(rows, ["feature"], every), deviations))
    spreads = _spreads(middle_and_deviation(rows, keys, counts), keys).join(F.broadcast(scales), "feature")  # one row for each feature
    called = F.array(*[F.lit(c) for c in names])
    spread = F.greatest("_raw", spread_floor(F.get(called, F.col("feature")), F.col("_c"), F.col("scale"), config))
    centre = F.when(F.col("peer_n") >= config.min_peers, F.col("_c")).alias("peer_center")
    measured = F.when((F.col("_c") != 0) & (F.col("_spread") != 0), F.col("peer_center")).alias("_from")
    spreads = spreads.select(*keys, "_c", centre, F.col("peer_n").cast("int").alias("peer_n"), spread.alias("_spread")).select(*keys, "peer_center", "peer_n", "_spread", measured)
    # a group has a row for each feature, so places in the sorted array are the features' own
    peers = spreads.groupBy(role, "period").agg(F.sort_array(F.collect_list(F.struct("feature", *PEERS))).alias("_peers"))
    peers = durable(peers.select(role, "period", *[F.col("_peers")[c].alias(c) for c in PEERS]))

    most = BROADCAST_ROWS // len(names)
    few = peers.limit(most + 1).count() <= most  # then rows meet their groups in place, after the sort
    ordered = (rows if few else rows.join(peers, [role, "period"], "left")).repartition("user").sortWithinPartitions("user", "period")
    # numbered, as the optimizer drops a sort that a join follows, and as the order is checked by the numbers
    ordered = ordered.withColumn("_row", F.monotonically_increasing_id())
    ordered = ordered.join(F.broadcast(peers), [role, "period"], "left") if few else ordered
    found = {r.feature: r.scale for r in scales.collect()}  # one for each feature
    each = tuple(found.get(i, 1.0) for i in range(len(names)))
    kinds = {pa.float64(): DoubleType(), pa.bool_(): BooleanType(), pa.int32(): IntegerType()}
    stats = MapType(StringType(), StructType([StructField(c, kinds[t]) for c, t in STAT.items()]))
    ordered = ordered.select(*others, *names, *PEERS, "_row")
    return ordered.mapInArrow(lambda batches: wide_figures(batches, names, each, config), StructType([*[rows.schema[c] for c in others], StructField("stats", stats)]))
