"""Pooling of sentences from several drafts of one signal into claims.

Drafts come as rows (signal_id, sample_index, text). Exact pooling groups by identity key; semantic pooling joins a
sentence to the nearest cluster by the vectors given; judged pooling takes groups made elsewhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import scalars as S
from plumbline.sources.durable import durable


def check_settings(method: str, threshold: float | None, temperature: float, k: int) -> None:
    """Semantic pooling needs a threshold, exact has none; drafts are drawn at a positive temperature, one at least."""
    if method not in ("exact", "semantic"):
        raise ValueError(f"no pooling method {method!r}")
    if (method == "semantic") != (threshold is not None):
        raise ValueError("a threshold belongs to semantic pooling, and to nothing else")
    if temperature <= 0 or k < 1:
        raise ValueError("temperature must be above 0 and k at least 1")


def first_drafts(drafts: DataFrame, k: int) -> DataFrame:
    """Drafts beyond the k-th are left out."""
    return drafts.filter(F.col("sample_index") < k)


def sentence_rows(drafts: DataFrame, sentences: Column | None = None) -> DataFrame:
    """signal_id, sample_index, pos, text, key of every sentence."""
    split = S.sentences_in(F.col("text")) if sentences is None else sentences
    rows = drafts.select("signal_id", "sample_index", F.posexplode(split).alias("pos", "text"))
    return rows.withColumn("key", S.identity_key(F.col("text")))


def numbered(claims: DataFrame, order: str = "first") -> DataFrame:
    """Adds sentence_id s001 on, by first appearance within the signal."""
    n = F.row_number().over(Window.partitionBy("signal_id").orderBy(order))
    return claims.withColumn("sentence_id", F.format_string("s%03d", n))


def pool_exact(rows: DataFrame) -> DataFrame:
    """One claim for each (signal, key): the first surface form, the distinct samples it appears in."""
    first = F.min(F.struct("sample_index", "pos", "text"))
    claims = rows.groupBy("signal_id", "key").agg(first.alias("first"), F.array_sort(F.collect_set("sample_index")).alias("appears_in"))
    return numbered(claims).select("signal_id", "sentence_id", F.col("first.text").alias("text"), "key", "appears_in", F.size("appears_in").alias("n_samples"))


def sentence_ids(rows: DataFrame, claims: DataFrame) -> DataFrame:
    """signal_id, sample_index and the distinct claim ids of a draft, in order of appearance."""
    seen = rows.join(claims.select("signal_id", "key", "sentence_id"), ["signal_id", "key"]).groupBy("signal_id", "sample_index", "sentence_id").agg(F.min("pos").alias("pos"))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "sentence_id")))
    return seen.groupBy("signal_id", "sample_index").agg(F.transform(ordered, lambda x: x["sentence_id"]).alias("sentence_ids"))


#: Vectors of one signal that one task settles in their order, clusters that one task compares with, and vectors compared together.
BLOCK, CHUNK, PART = 20_000, 8_192, 2_048
PIVOTS, BATCH = 8, 256
_SLACK = 1e-9


def _units(vectors) -> np.ndarray:
    """Vectors of length 1; zero vectors stay."""
    v = np.array([np.asarray(x, float) for x in vectors]).reshape(len(vectors), -1)
    norm = np.sqrt((v * v).sum(axis=1))
    return v / np.where(norm > 0, norm, 1)[:, None]


def _most_similar(units: np.ndarray, v: np.ndarray, about: np.ndarray, threshold: float) -> tuple[int, float]:
    """Place and cosine of the most similar unit vector, the last of equal ones; place -1 below the threshold. `about` are cosines that may be
    off by rounding; those that matter are worked out again, each in the same way wherever it is compared."""
    top = about.max(initial=-2)
    if top < threshold - _SLACK:
        return -1, -2.0
    near = np.flatnonzero(about >= max(top, threshold) - _SLACK)
    exact = (units[near] * v).sum(axis=1) if len(near) else np.empty(0)
    best = len(exact) - 1 - int(np.argmax(exact[::-1])) if len(exact) else -1
    return (int(near[best]), float(exact[best])) if best >= 0 and exact[best] >= threshold else (-1, -2.0)


class PivotIndex:
    """Angles of unit vectors to a few of them. By the triangle inequality, two vectors whose angles to a pivot differ by more than the angle
    of the threshold aren't similar enough, so whole ranges are left out before cosines are taken."""

    def __init__(self, units: np.ndarray, threshold: float):
        self.units, self.pivots = units, units[:: max(1, len(units) // PIVOTS)][:PIVOTS]
        self.reach = np.arccos(np.clip(threshold, -1, 1)) + 1e-6
        self.angles = self.to_pivots(units)

    def to_pivots(self, units: np.ndarray) -> np.ndarray:
        zero = (units * units).sum(axis=1) == 0  # a zero vector has cosine 0 with everything, and no place among angles
        angles = np.arccos(np.clip(units @ self.pivots.T, -1, 1))
        angles[zero] = np.nan
        return angles

    def near(self, units: np.ndarray) -> np.ndarray:
        """Places that some of these vectors may be similar enough to."""
        angles = self.to_pivots(units)
        if np.isnan(angles).any():
            return np.arange(len(self.units))
        low, high = angles.min(axis=0) - self.reach, angles.max(axis=0) + self.reach
        return np.flatnonzero(~((self.angles < low) | (self.angles > high)).any(axis=1))

    def best(self, units: np.ndarray, threshold: float, allowed=None) -> list[tuple[int, float]]:
        """The most similar one for each vector; `allowed(i, places)` says which may count."""
        out: list[tuple[int, float]] = [(-1, -2.0)] * len(units)
        by_angle = np.argsort(self.to_pivots(units)[:, 0]) if len(self.units) else []
        for k in range(0, len(by_angle), BATCH):
            batch = by_angle[k : k + BATCH]
            places = self.near(units[batch])
            if not len(places):
                continue
            about = units[batch] @ self.units[places].T
            for i, row in zip(batch, about):
                if allowed is not None:
                    row = np.where(allowed(i, places), row, -2.0)
                at, cosine = _most_similar(self.units[places], units[i], row, threshold)
                out[i] = (int(places[at]) if at >= 0 else -1, cosine)
        return out


class Heads:
    """First vectors of clusters. A vector joins the cluster whose first one is most similar, at `threshold` or more (ties: the later
    cluster), else opens one."""

    def __init__(self, threshold: float):
        self.threshold, self.n, self.units = threshold, 0, np.empty((0, 0))

    def join(self, vector: np.ndarray) -> int:
        v = _units([vector])[0]
        if self.n:
            known = self.units[: self.n]
            best, _ = _most_similar(known, v, known @ v, self.threshold)
            if best >= 0:
                return best
        if self.n == len(self.units):
            grown = np.empty((max(16, 2 * self.n), len(v)))
            if self.n:
                grown[: self.n] = self.units
            self.units = grown
        self.units[self.n] = v
        self.n += 1
        return self.n - 1


def greedy_clusters(vectors: np.ndarray, threshold: float) -> np.ndarray:
    """Clusters of vectors in their order."""
    heads = Heads(threshold)
    return np.array([heads.join(v) for v in np.asarray(vectors, float)], np.int64)


def pool_semantic(units: DataFrame, threshold: float) -> DataFrame:
    """units: signal_id, ord, vector (distinct sentences in order). Adds cluster."""
    return threshold_sweep(units, [threshold]).drop("threshold")


def pool_clusters(rows: DataFrame, clusters: DataFrame) -> DataFrame:
    """Claims of semantic or judged pooling. rows: sentence_rows; clusters: signal_id, key, cluster. Text is the first surface
    form; variants are the others' too."""
    joined = rows.join(clusters, ["signal_id", "key"])
    first = F.min(F.struct("sample_index", "pos", "text"))
    claims = joined.groupBy("signal_id", "cluster").agg(
        first.alias("first"), F.array_sort(F.collect_set("sample_index")).alias("appears_in"), F.array_sort(F.collect_set("text")).alias("variants"), F.count_distinct("key").cast("int").alias("n_variants")
    )
    return numbered(claims).select("signal_id", "sentence_id", F.col("first.text").alias("text"), "appears_in", F.size("appears_in").alias("n_samples"), "variants", "n_variants")


def judged_clusters(units: DataFrame, groups: DataFrame) -> DataFrame:
    """units: signal_id, key, index; groups: signal_id, members (arrays of indexes). First group wins; places out of range don't
    count; what no group has is a cluster of its own."""
    members = groups.select("signal_id", F.posexplode("members").alias("cluster", "of")).select("signal_id", "cluster", F.explode("of").alias("index"))
    first = members.groupBy("signal_id", "index").agg(F.min("cluster").alias("cluster"))
    return units.join(first, ["signal_id", "index"], "left").select("signal_id", "key", F.coalesce(F.concat(F.lit("g"), F.col("cluster")), F.concat(F.lit("s"), F.col("index"))).alias("cluster"))


def _settled(rows: DataFrame, kind: dict) -> DataFrame:
    """Clusters of signals whose vectors one task can take in their order."""

    def cluster(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, heads = None, None
        for pdf in batches:
            of = []
            for threshold, signal, vector in zip(pdf["threshold"], pdf["signal_id"], pdf["vector"]):
                if (threshold, signal) != now:
                    now, heads = (threshold, signal), Heads(threshold)
                of.append(heads.join(np.asarray(vector, float)))
            yield pd.DataFrame({"threshold": pdf["threshold"], "signal_id": pdf["signal_id"], "ord": pdf["ord"], "cluster": np.array(of, np.int64)})

    ordered = rows.repartition("threshold", "signal_id").sortWithinPartitions("threshold", "signal_id", "ord")
    return ordered.select("threshold", "signal_id", "ord", "vector").mapInPandas(cluster, f"threshold double, signal_id {kind['signal_id']}, ord {kind['ord']}, cluster long")


def _best_of(rows: DataFrame, heads: DataFrame, kind: dict) -> DataFrame:
    """The most similar head before each vector, at the threshold or more: threshold, signal_id, ord, best (cosine, cluster). Parts of vectors meet
    chunks of heads, so the work is spread over pairs of both."""
    keys = ["threshold", "signal_id"]
    heads = heads.select(*[F.col(c).alias(c) for c in heads.columns])  # columns of their own: heads may come from the same rows
    sizes = heads.groupBy(*keys).agg((F.floor(F.max("cluster") / CHUNK) + 1).cast("int").alias("_chunks"))
    parts = rows.groupBy(*keys).agg(F.ceil(F.count("*") / PART).cast("int").alias("_parts"))
    left = rows.join(F.broadcast(sizes), keys).join(F.broadcast(parts), keys)  # a row for each signal with many vectors
    left = left.select(*keys, "ord", "vector", F.pmod(F.hash("ord"), "_parts").alias("part"), F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1)).alias("chunk"))
    right = heads.join(F.broadcast(parts), keys).select(*keys, F.col("ord").alias("head_ord"), "cluster", "vector", F.floor(F.col("cluster") / CHUNK).cast("int").alias("chunk"), F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("part"))

    def compare(v: pd.DataFrame, h: pd.DataFrame) -> pd.DataFrame:
        if not len(v) or not len(h):
            return pd.DataFrame(columns=["threshold", "signal_id", "ord", "cosine", "cluster"], dtype=object)
        h = h.sort_values("cluster")
        threshold, head_ord, ords = float(v["threshold"].iloc[0]), h["head_ord"].to_numpy(), v["ord"].to_numpy()
        found = PivotIndex(_units(h["vector"].tolist()), threshold).best(_units(v["vector"].tolist()), threshold, lambda i, places: head_ord[places] < ords[i])
        signal, cluster = v["signal_id"].iloc[0], h["cluster"].to_numpy()
        out = [(threshold, signal, o, c, cluster[p]) for o, (p, c) in zip(ords, found) if p >= 0]
        return pd.DataFrame(out, columns=["threshold", "signal_id", "ord", "cosine", "cluster"], dtype=object)

    on = [*keys, "part", "chunk"]
    met = left.groupBy(*on).cogroup(right.groupBy(*on)).applyInPandas(compare, f"threshold double, signal_id {kind['signal_id']}, ord {kind['ord']}, cosine double, cluster long")
    return met.groupBy(*keys, "ord").agg(F.max(F.struct("cosine", "cluster")).alias("best"))


def threshold_sweep(units: DataFrame, thresholds: list[float]) -> DataFrame:
    """pool_semantic at several thresholds: threshold, signal_id, ord (a number, unique in a signal), cluster.

    The result depends on the order. A signal of up to BLOCK vectors is settled by one task. A larger one is cut into blocks of its order: a
    block's vectors are compared with the clusters so far in parallel, only those that none of them takes are settled by one task, and
    then all are compared with the clusters that these have opened before them."""
    tagged = units.select("signal_id", "ord", "vector", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("threshold"))
    kind, keys = dict(units.dtypes), ["threshold", "signal_id"]
    sizes = durable(units.groupBy("signal_id").agg(F.count("*").alias("_n")).filter(F.col("_n") > BLOCK))
    large = {r.signal_id: r["_n"] for r in sizes.collect()}  # signals of more than BLOCK vectors only
    if not large:
        return _settled(tagged, kind)
    small_ones = tagged.join(F.broadcast(sizes), tagged.signal_id.eqNullSafe(sizes.signal_id), "left_anti")
    done = [_settled(small_ones, kind)]
    n_blocks = -(-max(large.values()) // BLOCK)
    own = tagged.join(F.broadcast(sizes.select("signal_id")), "signal_id")
    cuts = own.groupBy("signal_id").agg(F.percentile_approx("ord", F.array(*[F.lit(i / n_blocks) for i in range(1, n_blocks)]), F.lit(100 * n_blocks)).alias("_cuts"))
    own = durable(own.join(F.broadcast(cuts), "signal_id").withColumn("block", F.size(F.filter("_cuts", lambda c: c < F.col("ord")))).drop("_cuts"))
    heads = None
    for k in range(n_blocks):
        rows = own.filter(F.col("block") == k).drop("block")
        old = durable(_best_of(rows, heads, kind)) if heads is not None else None
        open_rows = rows if old is None else rows.join(old, [*keys, "ord"], "left_anti")
        local = durable(_settled(open_rows, kind))  # at most a block
        first = local.groupBy(*keys, "cluster").agg(F.min("ord").alias("ord"))
        if heads is not None:
            first = first.join(F.broadcast(heads.groupBy(*keys).agg((F.max("cluster") + 1).alias("_from"))), keys, "left").withColumn("cluster", F.col("cluster") + F.coalesce("_from", F.lit(0))).drop("_from")
        opened = durable(rows.join(first, [*keys, "ord"]).select(*keys, "ord", "vector", "cluster"))
        best = _best_of(rows, opened, kind)
        best = best if old is None else best.unionByName(old)
        joined = best.groupBy(*keys, "ord").agg(F.max("best").alias("best")).select(*keys, "ord", F.col("best.cluster").alias("cluster"))
        joined = joined.join(opened.select(*keys, "ord"), [*keys, "ord"], "left_anti")
        done.append(durable(joined.unionByName(opened.select(*keys, "ord", "cluster"))))
        heads = opened if heads is None else durable(heads.unionByName(opened))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def distribution(claims: DataFrame, k: Column, by: list[str] | None = None) -> DataFrame:
    """Shares of claims in one draft, in two or more, and in most of k drafts."""
    n = F.count("*")
    once, again, most = F.count_if(F.col("n_samples") == 1), F.count_if(F.col("n_samples") >= 2), F.count_if(F.col("n_samples") >= F.floor(k / 2) + 1)
    return claims.groupBy(*(by or [])).agg(
        n.alias("claims"), once.alias("singletons"), again.alias("recurring"), most.alias("majority"), (once / n).alias("singleton_share"), (again / n).alias("recurring_share"), (most / n).alias("majority_share")
    )


def histogram(claims: DataFrame) -> DataFrame:
    return claims.groupBy("n_samples").agg(F.count("*").alias("claims"))


def generator_stats(drafts: DataFrame) -> DataFrame:
    return drafts.agg(F.count_distinct("signal_id").alias("signals"), F.count("*").alias("drafts"), F.count_distinct(F.lower(F.trim("text"))).alias("distinct_drafts"))


def generation_summary(requested: DataFrame, drafts: DataFrame, claims: DataFrame) -> DataFrame:
    """One row about a run. requested: signal_id, is_malicious; drafts and claims of the signals that succeeded."""
    done = drafts.select("signal_id").distinct().withColumn("_done", F.lit(True))
    counts = requested.join(done, "signal_id", "left").agg(F.count("*").alias("signals_requested"), F.count("_done").alias("signals_succeeded"), F.count_if(F.col("_done") & F.col("is_malicious")).alias("malicious_signals"))
    return counts.join(F.broadcast(claims.agg(F.count("*").alias("unique_sentences"))))  # one row each


def pooling_stats(claims: DataFrame) -> DataFrame:
    return claims.agg(F.sum("n_samples").alias("mentions"), F.count("*").alias("claims"), (F.sum("n_samples") / F.count("*")).alias("compression"), F.count_if(F.col("n_samples") == 1).alias("singletons"))


def length_comparison(drafts: DataFrame, user: Column, by: list[str]) -> DataFrame:
    """Mean characters, tokens, id mentions and pronouns of drafts."""
    text = F.col("text")
    return drafts.groupBy(*by).agg(F.avg(F.length(text)).alias("chars"), F.avg(S.approximate_tokens(text)).alias("tokens"), F.avg(S.id_mentions(text, user)).alias("id_mentions"), F.avg(S.pronoun_mentions(text)).alias("pronouns"))


