"""Hard negatives of embeddings by pruning on coordinates (operator 12).

Every component x counts as the integer floor(256 * x), and a row's score is its integer inner product with an anchor. An
anchor's positives are its best rows of the same label; for each positive, its negatives are the best rows of other labels
whose scores lie between LEAST hundredths of the positive's and the positive's own. Steps:

1. Buckets. Rows of like length are dealt into buckets of about BUCKET rows (a bucket's rows are of one group of labels). A bucket holds
   its directions (rows of length 1) and, for each coordinate, the order of its rows by that coordinate.
2. Parts. Anchors are dealt into parts of about PART. A part meets the buckets it may need, longest first, in SLOTS lines of buckets,
   one after another, and keeps its best partners so far; so a pair of blocks is a row of a join, and no task holds more than
   a bucket and a part.
3. Pruning. A score of at least s needs a cosine of at least t = s / (anchor's length * longest row's length), s being what a row must
   reach to be among an anchor's best so far. A bucket with t > 1 is left out. Otherwise the direction's value at each of the FOCUS coordinates
   where the anchor is largest lies in a range that t and the anchor give; the ranges are found in the sorted lists by
   binary search, and the candidates are the rows in all of them (all rows, where t is not positive).
4. Exact integer scores of the candidates; the best of all lines are merged.

Defined results: rows with a null label, a null vector, or a null or non-finite component take no part; shorter vectors end in zeros; components
whose integer is beyond 2^26 in size are held there, so scores of up to 2,047 dimensions fit a long; an anchor's partners never have its own
vec_id, so its repeats are none; repeated rows count each, and a repeated anchor gives its rows once each; a null vec_id is no anchor, comes last in ties
and is given back as null (2^63 - 1 is taken for null); anchors without positives or negatives give no rows; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import durable, finite, matrix, small, table

SCALE, LARGEST = 256, 1 << 26
POSITIVES, NEGATIVES = 5, 5
#: Least share of the positive's score, in hundredths.
LEAST = 80
#: Rows of a bucket, anchors of a part, lines of buckets that a part meets, groups of labels.
BUCKET, PART, SLOTS, GROUPS = 8192, 2048, 32, 16
#: Rows whose length has the same whole logarithm to this base may share a bucket.
LENGTHS = 1.05
FOCUS = 3
#: Above this share of a bucket, candidates are scored by one matrix product instead of one anchor at a time.
DENSE = 0.25
NULL_ID, NONE = np.iinfo(np.int64).max, np.iinfo(np.int64).min
_SLACK = 1e-9


def integer_rows(vectors: DataFrame, anchors: Column) -> DataFrame:
    """row, vec_id, label, is_anchor, grp, x (array of int), sq (squared length) of the rows that take part, kept durably."""
    held = lambda c: F.floor(F.least(F.greatest(c.cast("double") * SCALE, F.lit(-float(LARGEST))), F.lit(float(LARGEST)))).cast("int")
    rows = vectors.filter(F.col("label").isNotNull() & finite(F.col("embedding")))
    rows = rows.select("vec_id", F.col("label").cast("long").alias("label"), F.coalesce(anchors, F.lit(False)).alias("is_anchor"), F.transform("embedding", held).alias("x"))
    rows = rows.withColumn("sq", F.aggregate("x", F.lit(0).cast("double"), lambda s, v: s + v.cast("double") * v)).withColumn("grp", F.pmod(F.hash("label"), F.lit(GROUPS)))
    return durable(rows).withColumn("row", F.monotonically_increasing_id())


def bucket_plan(counts: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int]]:
    """counts: (grp, length class, rows). (grp, class, first bucket, buckets): classes of a group are joined, longest first, until they fill a
    bucket; larger ones are dealt into several. Buckets are numbered with the longest rows of each group first."""
    plan, at = [], 0
    for grp in sorted({g for g, _, _ in counts}):
        run, n = [], 0
        own = sorted(((c, k) for g, c, k in counts if g == grp), reverse=True)
        for i, (c, k) in enumerate(own):
            run, n = [*run, c], n + k
            if n >= BUCKET or i == len(own) - 1:
                many = -(-n // BUCKET)
                plan += [(grp, x, at, many) for x in run]
                run, n, at = [], 0, at + many
    return plan


BLOCK = "block int, grp int, n int, rows binary, ids binary, labels binary, x binary, orders binary"


def packed(rows: DataFrame, dims: int, ordered: bool) -> DataFrame:
    """A row per block: row, vec_id, label and x of all its rows as arrays of bytes; with `ordered`, also the sorted list of each coordinate."""

    def run(key: tuple, t: pa.Table) -> pa.Table:
        t = t.combine_chunks().sort_by("row")
        x = matrix(t.column("x").combine_chunks(), dims).astype(np.int32)
        ids = t.column("vec_id").fill_null(int(NULL_ID)).to_numpy()
        orders = np.argsort(directions(x), axis=0, kind="stable").T.astype(np.int32).tobytes() if ordered else b""
        blobs = [t.column("row").to_numpy().tobytes(), ids.tobytes(), t.column("label").to_numpy().tobytes(), x.tobytes(), orders]
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "grp": pa.array([t.column("grp")[0].as_py()], pa.int32()), "n": pa.array([t.num_rows], pa.int32()), **{k: pa.array([b], pa.binary()) for k, b in zip(("rows", "ids", "labels", "x", "orders"), blobs)}})

    return durable(rows.select("block", "grp", "row", "vec_id", "label", "x").groupBy("block").applyInArrow(run, BLOCK))


def directions(x: np.ndarray) -> np.ndarray:
    length = np.sqrt((x.astype(float) ** 2).sum(axis=1))
    return x / np.where(length > 0, length, 1)[:, None]


class Rows:
    """A packed block."""

    def __init__(self, row: dict, dims: int):
        n = row["n"]
        self.rows, self.ids, self.labels = (np.frombuffer(row[k], np.int64) for k in ("rows", "ids", "labels"))
        self.x = np.frombuffer(row["x"], np.int32).reshape(n, dims).astype(float)
        self.length = np.sqrt((self.x**2).sum(axis=1))
        self.unit = directions(self.x)


class Bucket(Rows):
    def __init__(self, row: dict, dims: int):
        super().__init__(row, dims)
        self.orders = np.frombuffer(row["orders"], np.int32).reshape(dims, row["n"])
        self.longest = float(self.length.max(initial=0))


def feasible(t: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Range of a direction's value at a coordinate where the anchor's direction has q, given a cosine of t or more (0 < t <= 1)."""
    t = np.clip(t, 0, 1)
    wide = np.sqrt((1 - t * t) * np.maximum(1 - q * q, 0))
    return np.where(-q >= t, -np.inf, q * t - wide - _SLACK), np.where(q >= t, np.inf, q * t + wide + _SLACK)


def candidates(anchors: Rows, bucket: Bucket, need: np.ndarray) -> Iterator[tuple[int, np.ndarray | None]]:
    """For each anchor that may find a score of need or more in the bucket: its number, and the rows in all ranges of its
    focus coordinates, or None where these are most of the rows."""
    n, focus = len(bucket.x), min(FOCUS, anchors.x.shape[1])
    reach = anchors.length * bucket.longest
    t = np.where(reach > 0, need / np.where(reach > 0, reach, 1), np.where(need > 0, 2.0, -1.0)) * (1 - _SLACK)
    first, last = np.zeros((len(t), focus), int), np.full((len(t), focus), n)
    on = np.argsort(-np.abs(anchors.unit), axis=1, kind="stable")[:, :focus]
    pruned = (t > 0) & (t <= 1)
    low, high = feasible(t[:, None], np.take_along_axis(anchors.unit, on, axis=1))
    for f in np.unique(on[pruned]) if focus else ():
        who, k = np.nonzero((on == f) & pruned[:, None])
        values = bucket.unit[bucket.orders[f], f]
        first[who, k], last[who, k] = np.searchsorted(values, low[who, k]), np.searchsorted(values, high[who, k], "right")
    for i in np.nonzero(t <= 1)[0]:
        if not pruned[i] or not focus:
            yield i, None
            continue
        narrow = int((last[i] - first[i]).argmin())
        if last[i, narrow] - first[i, narrow] > DENSE * n:
            yield i, None
            continue
        found = bucket.orders[on[i, narrow], first[i, narrow] : last[i, narrow]]
        for k in range(focus):
            if k != narrow:
                value = bucket.unit[found, on[i, k]]
                found = found[(value >= low[i, k]) & (value <= high[i, k])]
        if len(found):
            yield i, found


def scored(anchors: Rows, bucket: Bucket, need: np.ndarray) -> Iterator[tuple[int, np.ndarray | slice, np.ndarray]]:
    """Anchor, rows (or all), exact scores of the candidates."""
    exact = float(anchors.length.max(initial=0)) * bucket.longest < 2.0**52  # else doubles don't hold the sums
    kind = float if exact else np.int64
    x, many = bucket.x.astype(kind, copy=False), []

    def dense() -> Iterator[tuple]:
        for i, s in zip(many, (anchors.x[many].astype(kind) @ x.T).astype(np.int64)):
            yield i, slice(None), s

    for i, found in candidates(anchors, bucket, need):
        if found is None:
            many.append(i)
            if len(many) * len(x) >= 1 << 21:
                yield from dense()
                many.clear()
        else:
            yield i, found, (x[found] @ anchors.x[i].astype(kind)).astype(np.int64)
    if many:
        yield from dense()


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest scores, ties by smaller id."""
    if len(scores) > k:
        on = scores >= np.partition(scores, -k)[-k]
        scores, ids = scores[on], ids[on]
    order = np.lexsort((ids, -scores))[:k]
    return scores[order], ids[order]


_EMPTY = np.zeros(0, np.int64)


class BestPositives:
    """The best rows of the same label so far, of each anchor of a part."""

    def __init__(self, anchors: Rows, _row: dict, k: int):
        self.k, self.anchors, self.found = k, anchors, [(_EMPTY, _EMPTY)] * len(anchors.x)
        self.need = np.full(len(anchors.x), -np.inf)

    def meet(self, bucket: Bucket) -> None:
        for i, rows, scores in scored(self.anchors, bucket, self.need):
            on = (bucket.labels[rows] == self.anchors.labels[i]) & (bucket.ids[rows] != self.anchors.ids[i]) & (scores >= self.need[i])
            if on.any():
                a, b = self.found[i]
                self.found[i] = best(np.concatenate([a, scores[on]]), np.concatenate([b, bucket.ids[rows][on]]), self.k)
                if len(self.found[i][0]) == self.k:
                    self.need[i] = self.found[i][0][-1]

    def rows(self) -> Iterator[tuple]:
        for row, (scores, ids) in zip(self.anchors.rows.tolist(), self.found):
            if len(scores):
                yield row, None, scores.tolist(), ids.tolist()


class BestNegatives:
    """The best rows of other labels so far, for each anchor of a part and each of its positives' scores."""

    def __init__(self, anchors: Rows, row: dict, k: int):
        self.k, self.anchors = k, anchors
        tops = [sorted(set(t)) for t in row["tops"]]
        #: score of the positive, least score, what is found
        self.bands = [[[t, -(-LEAST * t // 100), (_EMPTY, _EMPTY)] for t in own if t >= 0] for own in tops]
        self.need = np.array([min((b[1] for b in own), default=np.inf) for own in self.bands], float)

    def meet(self, bucket: Bucket) -> None:
        for i, rows, scores in scored(self.anchors, bucket, self.need):
            ids = bucket.ids[rows]
            on = (bucket.labels[rows] != self.anchors.labels[i]) & (ids != self.anchors.ids[i]) & (scores >= self.need[i])
            if not on.any():
                continue
            scores, ids, need = scores[on], ids[on], []
            for band in self.bands[i]:
                top, least, (a, b) = band
                in_band = (scores <= top) & (scores >= least)
                if in_band.any():
                    band[2] = best(np.concatenate([a, scores[in_band]]), np.concatenate([b, ids[in_band]]), self.k)
                need.append(band[2][0][-1] if len(band[2][0]) == self.k else least)
            self.need[i] = min(need)

    def rows(self) -> Iterator[tuple]:
        for row, own in zip(self.anchors.rows.tolist(), self.bands):
            for top, _, (scores, ids) in own:
                if len(scores):
                    yield row, top, scores.tolist(), ids.tolist()


FOUND = "row long, top long, scores array<long>, ids array<long>"
FOUND_ARROW = pa.schema([("row", pa.int64()), ("top", pa.int64()), ("scores", pa.list_(pa.int64())), ("ids", pa.list_(pa.int64()))])


def search(parts: DataFrame, buckets: DataFrame, pairs: DataFrame, dims: int, kind: type, k: int) -> DataFrame:
    """The best k of each anchor (and band). pairs: part, block, slot, which buckets a part meets."""
    left = parts.withColumnRenamed("block", "part").select("part", F.struct(*[c for c in parts.columns if c not in ("block", "grp", "orders")]).alias("anchors"))
    right = buckets.select("block", F.struct(*[c for c in buckets.columns if c not in ("block", "grp")]).alias("bucket"))
    cells = pairs.join(right, "block").join(left, "part").repartition(F.col("part"), F.col("slot")).sortWithinPartitions("part", "slot", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, None

        def out() -> Iterator[pa.RecordBatch]:
            if state and (found := list(state.rows())):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), FOUND_ARROW)], schema=FOUND_ARROW)

        for b in batches:
            for j in range(b.num_rows):
                row = {name: b.column(name)[j] for name in b.schema.names}
                if at != (key := (row["part"].as_py(), row["slot"].as_py())):
                    yield from out()
                    anchors = row["anchors"].as_py()
                    at, state = key, kind(Rows(anchors, dims), anchors, k)
                state.meet(Bucket(row["bucket"].as_py(), dims))
        yield from out()

    found = cells.mapInArrow(run, FOUND)
    merged = found.groupBy("row", "top").agg(F.flatten(F.collect_list(F.arrays_zip("scores", "ids"))).alias("all"))  # SLOTS lists at most
    first = F.slice(F.array_sort("all", lambda a, b: F.when(a["scores"] > b["scores"], -1).when(a["scores"] < b["scores"], 1).when(a["ids"] < b["ids"], -1).when(a["ids"] > b["ids"], 1).otherwise(0)), 1, k)
    return merged.select("row", "top", first.alias("best"))


def hard_negatives(vectors: DataFrame, anchors: Column, positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """vectors: vec_id, label, embedding; anchors: which rows are anchors. anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    rows = integer_rows(vectors, anchors)
    dims = rows.agg(F.max(F.size("x"))).first()[0] or 0
    length = F.when(F.col("sq") > 0, F.floor(F.log("sq") / (2 * np.log(LENGTHS)))).otherwise(-1).cast("int")
    counts = [(r.grp, r.length, r.n) for r in rows.groupBy("grp", length.alias("length")).agg(F.count("*").alias("n")).collect()]  # at most GROUPS times the length classes
    plan = bucket_plan(counts)
    spark = vectors.sparkSession
    classes = F.broadcast(spark.createDataFrame(plan, "grp int, length int, first int, many int"))
    dealt = rows.withColumn("length", length).join(classes, ["grp", "length"]).withColumn("block", (F.col("first") + F.pmod(F.xxhash64("row"), "many")).cast("int"))
    buckets = packed(dealt, dims, True)

    own = [(r.grp, r.n) for r in rows.filter("is_anchor").groupBy("grp").agg(F.count("*").alias("n")).orderBy("grp").collect()]
    starts, at = [], 0
    for grp, n in own:
        starts.append((grp, at, -(-n // PART)))
        at += -(-n // PART)
    groups = F.broadcast(spark.createDataFrame(starts, "grp int, first int, many int"))
    chosen = rows.filter("is_anchor").join(groups, "grp").withColumn("block", (F.col("first") + F.pmod(F.xxhash64("row"), "many")).cast("int"))
    parts = packed(chosen, dims, False)
    slot = F.pmod("block", F.lit(SLOTS))
    numbers = buckets.select("block", "grp", slot.alias("slot"))

    # positives: a part meets the buckets of its own group of labels
    in_group = numbers.join(groups, "grp").select(F.explode(F.sequence(F.col("first"), F.col("first") + F.col("many") - 1)).alias("part"), "block", "slot")
    top = durable(search(parts, buckets, in_group, dims, BestPositives, positives))

    # negatives: it meets all buckets, with the scores of its anchors' positives
    tops = chosen.select("block", "row").join(top, "row", "left").groupBy("block").agg(F.sort_array(F.collect_list(F.struct("row", F.coalesce(F.transform("best", lambda b: b["scores"]), F.array().cast("array<bigint>")).alias("t")))).alias("o"))
    parts = parts.join(tops.select("block", F.transform("o", lambda s: s["t"]).alias("tops")), "block")
    anywhere = numbers.select(F.explode(F.sequence(F.lit(0), F.lit(at - 1))).alias("part"), "block", "slot") if at else in_group
    low = durable(search(parts, buckets, anywhere, dims, BestNegatives, negatives))

    known = lambda c: F.when(F.col(c) != int(NULL_ID), F.col(c))
    pairs = top.select("row", F.explode("best").alias("p")).select("row", F.col("p.scores").alias("top"), F.col("p.ids").alias("positive"))
    pairs = pairs.join(low, ["row", "top"]).select("row", "positive", F.col("top").alias("positive_score"), F.posexplode("best").alias("rank", "b"))
    pairs = pairs.join(small(durable(rows.filter("is_anchor").select("row", F.col("vec_id").alias("anchor_id")))), "row").withColumn("negative", F.col("b.ids"))
    return pairs.select("anchor_id", known("positive").alias("positive_id"), (F.col("rank") + 1).alias("rank"), known("negative").alias("negative_id"), "positive_score", F.col("b.scores").alias("negative_score"))


def op12(spark, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    return hard_negatives(vectors.withColumn("label", label), F.col("vec_id") % 100 == 0)


OP12_SQL = """
WITH taken AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(c::DOUBLE * 256) FOR c IN embedding] AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([c FOR c IN embedding IF c IS NULL OR NOT isfinite(c)]) = 0),
scores AS (SELECT a.r, a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id AS id, list_inner_product(a.x, b.x)::BIGINT AS score FROM taken a JOIN taken b ON a.vec_id % 100 = 0 AND b.vec_id IS DISTINCT FROM a.vec_id),
positives AS (SELECT r, anchor_id, id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY r ORDER BY score DESC, id NULLS LAST) AS p FROM scores WHERE same QUALIFY p <= 5),
negatives AS (SELECT p.anchor_id, p.positive_id, row_number() OVER (PARTITION BY p.r, p.p ORDER BY n.score DESC, n.id NULLS LAST) AS k, n.id AS negative_id, positive_score, n.score AS negative_score
  FROM positives p JOIN scores n ON p.r = n.r AND NOT n.same AND 80 * positive_score <= 100 * n.score AND n.score <= positive_score)
SELECT anchor_id, positive_id, k::INT AS rank, negative_id, positive_score, negative_score FROM negatives WHERE k <= 5
"""
