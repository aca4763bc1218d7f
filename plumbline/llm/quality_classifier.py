"""Quality classifier: random Fourier features, ridge scores from partition-summed normal equations, isotonic calibration
(operator 4).

Each text gives a fixed list of statistics. They are standardised, mapped to random Fourier features (which approximate
a Gaussian kernel), and a ridge model is solved from sums that every partition forms alone, so that only matrices of the
feature count meet. Raw scores are calibrated by isotonic regression on a fixed grid.

Defined results: null or empty text is scored like any other (all statistics are 0); null or missing labels are not
learned from; repeated label rows count as often as they occur, repeated documents are scored each; with no learnable
label every score is 0.5; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.linalg import VectorUDT  # noqa: F401  registers the type that the calibration reads
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import crc_mod, durable, table

STATISTICS = (
    "log_words", "word_length", "log_longest_word", "upper", "digits", "symbols", "bars", "marks", "stops", "commas", "non_ascii", "blanks", "newlines",
    "byte_entropy", "distinct_words", "distinct_pairs", "distinct_lines", "log_line_length", "top_byte",
)
N_FEATURES = 256
#: Width of the Gaussian kernel, in units of sqrt(number of statistics).
BANDWIDTH = 1.0
RIDGE = 1e-4
SEED = 20240229
CLIP = 4.0
GRID = 500
THRESHOLD = 0.3


def _sum_of(counts: np.ndarray, chars: str) -> float:
    return float(counts[[ord(c) for c in chars]].sum())


def statistics(text: str | None) -> list[float]:
    """The statistics of one text, in the order of STATISTICS."""
    if not text:
        return [0.0] * len(STATISTICS)
    raw = text.encode("utf-8", "surrogatepass")
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n = len(raw)
    words, lines = text.split(), text.split("\n")
    n_words = max(len(words), 1)
    shares = counts[counts > 0] / n
    return [
        math.log1p(len(words)),
        sum(map(len, words)) / n_words,
        math.log1p(max(map(len, words), default=0)),
        float(counts[65:91].sum()) / n,
        float(counts[48:58].sum()) / n,
        _sum_of(counts, "#*$%&<>") / n,
        _sum_of(counts, "|") / n,
        _sum_of(counts, "!?") / n,
        _sum_of(counts, ".") / n,
        _sum_of(counts, ",;:") / n,
        float(counts[128:].sum()) / n,
        float(counts[32]) / n,
        float(counts[10]) / n,
        float(-(shares * np.log2(shares)).sum()),
        len(set(words)) / n_words,
        len(set(zip(words, words[1:]))) / max(len(words) - 1, 1),
        len(set(lines)) / len(lines),
        math.log1p(n / len(lines)),
        float(counts.max()) / n,
    ]


def document_statistics(documents: DataFrame) -> DataFrame:
    """doc_id and x, the statistics of the whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [statistics(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.list_(pa.float64()))], names=["doc_id", "x"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, x array<double>")


class FourierMap:
    """z(x) = [1, sqrt(2/D) cos(W s(x) + b)] with s the standardisation; W and b follow from the seed."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray, n_features: int = N_FEATURES, seed: int = SEED):
        r = np.random.RandomState(seed)
        d = len(mean)
        self.mean, self.spread = mean, np.where(spread > 1e-9, spread, 1.0)
        self.w = r.normal(size=(d, n_features)) / (BANDWIDTH * math.sqrt(d))
        self.b = r.uniform(0, 2 * math.pi, size=n_features)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        s = np.clip((x - self.mean) / self.spread, -CLIP, CLIP)
        z = np.sqrt(2.0 / len(self.b)) * np.cos(s @ self.w + self.b)
        return np.concatenate([np.ones((len(x), 1)), z], axis=1)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _moments(training: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    k = len(STATISTICS)
    sums = [F.sum(F.get("x", F.lit(i))).alias(f"a{i}") for i in range(k)] + [F.sum(F.pow(F.get("x", F.lit(i)), 2)).alias(f"b{i}") for i in range(k)]
    row = training.agg(F.count("*").alias("n"), F.count_distinct("y").alias("kinds"), *sums).first()
    if not row.n or row.kinds < 2:
        return 0, np.zeros(k), np.ones(k)
    mean = np.array([row[f"a{i}"] for i in range(k)]) / row.n
    return row.n, mean, np.sqrt(np.maximum(np.array([row[f"b{i}"] for i in range(k)]) / row.n - mean**2, 0))


def normal_equations(training: DataFrame, to_features: FourierMap) -> np.ndarray:
    """Sum of z'[z, y] over all rows: each partition sends one row per feature, and Spark adds them by row."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                z = to_features(_matrix(b.column(0)))
                own = z.T @ np.concatenate([z, b.column(1).to_numpy()[:, None]], axis=1)
                total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "row"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for i, row in zip(b.column(0).to_pylist(), _matrix(b.column(1)) if b.num_rows else ()):
                sums[i] = sums[i] + row if i in sums else row
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(list(sums.values()), pa.list_(pa.float64()))], names=["i", "row"])

    schema = "i int, row array<double>"
    parts = training.select("x", F.col("y").cast("double")).mapInArrow(part, schema)
    rows = parts.repartition(16, "i").mapInArrow(add, schema).collect()  # one row for each feature
    return np.array([r.row for r in sorted(rows, key=lambda r: r.i)])


def fit(features: DataFrame, labels: DataFrame):
    """A function from statistics to scores, fitted on all labelled rows; labels: doc_id, y (0 or 1)."""
    training = durable(features.join(labels.filter(F.col("y").isNotNull()), "doc_id").select("x", F.col("y").cast("double").alias("y")))
    n, mean, spread = _moments(training)
    if not n:
        return lambda x: np.full(len(x), 0.5)
    to_features = FourierMap(mean, spread)
    sums = normal_equations(training, to_features)
    a, b = sums[:, :-1], sums[:, -1]
    weights = np.linalg.solve(a + RIDGE * n * np.eye(len(a)), b)

    def raw(x: np.ndarray) -> np.ndarray:
        return to_features(x) @ weights

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                cell = np.round(np.clip(raw(_matrix(b.column(0))), -0.5, 1.5) * GRID).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(cell), b.column(1)], names=["cell", "y"])

    grid = training.mapInArrow(cells, "cell int, y double").groupBy("cell").agg(F.avg("y").alias("label"), F.count("*").cast("double").alias("weight"))
    model = IsotonicRegression(isotonic=True, weightCol="weight", featuresCol="feature").fit(grid.withColumn("feature", F.col("cell") / GRID))
    at, values = model.boundaries.toArray(), model.predictions.toArray()
    # A slight slope keeps the order of raw scores inside a flat step.
    return lambda x: np.clip(0.999 * np.interp(raw(x), at, values) + 0.001 * np.clip(raw(x), 0, 1), 0.0, 1.0)


def score(features: DataFrame, model) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model(_matrix(b.column(1))))], names=["doc_id", "score"])

    return features.select("doc_id", "x").mapInArrow(run, "doc_id long, score double")


def op4(spark, sf_dir: str) -> DataFrame:
    """Scores of all documents; rows whose crc32(doc_id) mod 5 is 0 are held out of learning (a null doc_id is not, but has no label to learn from)."""
    features = durable(document_statistics(table(spark, sf_dir, "documents")))
    labels = table(spark, sf_dir, "labels").filter(crc_mod(F.col("doc_id")) != 0).select("doc_id", F.col("quality").alias("y"))
    scored = score(features, fit(features, labels))
    return scored.select("doc_id", F.coalesce(crc_mod(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
