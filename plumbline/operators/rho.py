"""The trained combination of claim scores: balanced logistic regression, its cross-validation and its figures."""

from __future__ import annotations

import math
from dataclasses import asdict, dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.operators.sampling import ranked, shuffle_key
from plumbline.operators.selection import running_sums
from plumbline.sources import sinks
from plumbline.sources.durable import durable

FEATURES = ("self_consistency", "fact_match", "misweighted", "hallucinated_context")


@dataclass(frozen=True)
class RhoModel:
    """A fitted combination as plain numbers: weights in the order of its features, what it was trained for, and the fingerprint of its
    training rows."""

    features: tuple[str, ...]
    weights: tuple[float, ...]
    intercept: float
    policy: str = "primary"
    n_rows: int = 0
    fingerprint: str = ""


MODEL = "features array<string>, weights array<double>, intercept double, policy string, n_rows long, fingerprint string"


def _value(feature: str) -> Column:
    """A feature as a number. A missing fact match stands for the agreement; what is missing else is 0."""
    value = F.col(feature).cast("double")
    if feature == "fact_match":
        value = F.coalesce(value, F.col("self_consistency").cast("double"))
    return F.coalesce(value, F.lit(0.0))


def train(gold: DataFrame, features: tuple[str, ...] = FEATURES, target: str = "target", policy: str = "primary") -> RhoModel:
    """Classes weigh the same: a row weighs n / (2 * rows of its class). regParam 1 / n is the usual C = 1."""
    rows = gold.select(F.col(target).cast("double").alias("target"), *[_value(f).alias(f) for f in features])
    marks = F.sum(F.xxhash64("target", *features).cast("decimal(38,0)"))  # does not depend on the rows' order
    sizes = {r.target: r for r in rows.groupBy("target").agg(F.count("*").alias("n"), marks.alias("marks")).collect()}  # a row for each class
    n = sum(r.n for r in sizes.values())
    weight = F.lit(None).cast("double")
    for y, r in sizes.items():
        weight = F.when(F.col("target") == y, n / 2 / r.n).otherwise(weight)
    vectors = VectorAssembler(inputCols=list(features), outputCol="features").transform(rows.withColumn("_w", weight))
    fitted = LogisticRegression(labelCol="target", weightCol="_w", regParam=1 / n, standardization=False, tol=1e-12, maxIter=500).fit(vectors)
    mark = sum(int(r.marks) for r in sizes.values()) % (1 << 64)
    return RhoModel(tuple(features), tuple(float(w) for w in fitted.coefficients), float(fitted.intercept), policy, n, f"{mark:016x}")


def predict(model: RhoModel, rows: DataFrame, features: tuple[str, ...] | None = None, out: str = "rho") -> DataFrame:
    """Adds the probability: plain expressions, no objects of the training run. `features`, if given, must be the model's, in its order."""
    if features is not None and tuple(features) != model.features:
        raise ValueError(f"the model has the features {model.features}, not {tuple(features)}")
    margin = F.lit(model.intercept)
    for f, w in zip(model.features, model.weights):
        margin = margin + F.lit(w) * _value(f)
    return rows.select("*", (1 / (1 + F.exp(-margin))).alias(out))


def save_model(spark: SparkSession, model: RhoModel, path: str) -> None:
    """As a JSON record, under the rules of sinks."""
    sinks.write_records(spark.createDataFrame([tuple(asdict(model).values())], MODEL), path)


def load_model(spark: SparkSession, path: str, policy: str | None = None) -> RhoModel:
    """The saved model; an error if it is not whole, or was trained for another policy than the one given."""
    r = spark.read.schema(MODEL).json(sinks.current(spark, path)).first()
    if r.features is None or r.weights is None or len(r.features) != len(r.weights) or r.intercept is None or not all(map(math.isfinite, [*r.weights, r.intercept])):
        raise ValueError(f"{path} holds no whole model")
    if policy is not None and policy != r.policy:
        raise ValueError(f"{path} was trained for the policy {r.policy}, not {policy}")
    return RhoModel(tuple(r.features), tuple(r.weights), r.intercept, r.policy, r.n_rows, r.fingerprint)


def with_folds(gold: DataFrame, k: int = 5, target: str = "target", ident: str = "cluster_id", seed: int = 42) -> DataFrame:
    """Stratified folds: rows of a class are shuffled by hash and dealt out in turn."""
    keyed = gold.withColumn("_k", shuffle_key(F.col(ident), seed))
    return ranked(keyed, target, "_k", ident, "fold").withColumn("fold", F.pmod("fold", F.lit(k)).cast("int")).drop("_k")


def cross_validated(gold: DataFrame, k: int = 5, features: tuple[str, ...] = FEATURES, target: str = "target", ident: str = "cluster_id") -> DataFrame:
    """Every row with the probability of a model that did not see its fold."""
    folded = durable(with_folds(gold, k, target, ident))
    parts = [predict(train(folded.filter(F.col("fold") != i), features, target), folded.filter(F.col("fold") == i), features) for i in range(k)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _errors(target: str, score: str, cut: float) -> list[Column]:
    y, p = F.col(target).cast("double"), F.col(score)
    return [F.avg(F.pow(p - y, 2)).alias("brier"), F.avg(F.abs((p >= cut).cast("int") - y)).alias("mae")]


def _auc(positive: str, negative: str, below: str) -> Column:
    """From counts by score: the share of pairs of a positive and a negative row that are in order, ties half."""
    in_order = F.sum(F.col(positive) * (F.col(below) + F.col(negative) / 2))
    return F.try_divide(in_order, F.sum(positive).cast("double") * F.sum(negative)).alias("auc")


def _by_score(scored: DataFrame, target: str, score: str, *keys: str) -> DataFrame:
    own = scored.filter(F.col(score).isNotNull())
    return own.groupBy(*keys, F.col(score).alias("value")).agg(F.count_if(F.col(target) == 1).alias("positive"), F.count_if(F.col(target) == 0).alias("negative"))


def probability_figures(scored: DataFrame, target: str = "target", score: str = "rho", cut: float = 0.5) -> DataFrame:
    """One row: auc (exact; null if a class is missing), brier, and mae, the mean error of the predicted class (1 from `cut` on)."""
    counts = durable(_by_score(scored, target, score))
    auc = running_sums(counts, ["negative"]).agg(_auc("positive", "negative", "negative_below"))
    return auc.join(F.broadcast(scored.agg(*_errors(target, score, cut))))  # a row each


def fold_figures(scored: DataFrame, target: str = "target", score: str = "rho", fold: str = "fold", cut: float = 0.5) -> DataFrame:
    """One row: mean and standard deviation (of the whole, not of a sample) of the folds' auc, brier and mae."""
    folds = [r[0] for r in scored.select(fold).distinct().orderBy(fold).collect()]
    each = [probability_figures(scored.filter(F.col(fold) == i), target, score, cut) for i in folds]
    rows = each[0]
    for e in each[1:]:
        rows = rows.unionByName(e)
    return rows.agg(*[f(c).alias(f"{c}_{name}") for c in ("auc", "brier", "mae") for f, name in ((F.avg, "mean"), (F.stddev_pop, "std"))])


def confusion(scored: DataFrame, target: str = "target", score: str = "rho", cut: float = 0.5) -> DataFrame:
    """Per class: tp, fp, fn, precision, recall, f1."""
    pred = (F.col(score) >= cut).cast("int")
    counts = scored.groupBy(F.col(target).cast("int").alias("y"), pred.alias("p")).agg(F.count("*").alias("n"))
    classes = F.explode(F.array(F.lit(0), F.lit(1))).alias("class")
    c = counts.select("y", "p", "n", classes)
    tp, fp, fn = (F.sum(F.when(x, F.col("n")).otherwise(0)) for x in ((F.col("y") == F.col("class")) & (F.col("p") == F.col("class")), (F.col("y") != F.col("class")) & (F.col("p") == F.col("class")), (F.col("y") == F.col("class")) & (F.col("p") != F.col("class"))))
    t = c.groupBy("class").agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"))
    return t.select("*", F.try_divide("tp", F.col("tp") + F.col("fp")).alias("precision"), F.try_divide("tp", F.col("tp") + F.col("fn")).alias("recall"), F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"))


def recall_at(scored: DataFrame, ks: tuple[int, ...] = (10, 50, 100, 200, 300, 500), target: str = "target", score: str = "rho", ident: str = "cluster_id") -> DataFrame:
    """Of the rows that are not grounded, the share among the k with the lowest score. Each k is a top-k, so no row is ranked
    against all."""
    total = scored.filter(F.col(target) == 0).count()
    lowest = scored.select(target, score, ident).orderBy(score, ident).limit(max(ks))
    ranked = lowest.withColumn("_r", F.row_number().over(Window.orderBy(score, ident)))
    grid = F.explode(F.array(*[F.lit(k) for k in ks])).alias("k")
    found = ranked.select(target, "_r", grid).groupBy("k").agg(F.count_if((F.col("_r") <= F.col("k")) & (F.col(target) == 0)).alias("found"))
    return found.select("k", "found", F.try_divide("found", F.lit(total)).alias("recall"))
