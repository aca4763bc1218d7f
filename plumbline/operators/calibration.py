"""Choosing the acceptance threshold: split by user, risk curves, certified thresholds, and their adaptive form.

A claim is accepted when its score is at least lambda. Rows: user, group, score, label.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.sampling import ranked, shuffle_key
from plumbline.sources.durable import durable

# What counts as wrong under each policy, and the grids.
POLICIES = {"primary": ("hallucinated", "misweighted", "false precision"), "secondary": ("hallucinated",)}
LAMBDAS = tuple(round(1 - 0.05 * i, 2) for i in range(21))
ALPHAS = tuple(round(0.05 * i, 2) for i in range(1, 7))


def split_by_user(rows: DataFrame, fraction: float = 0.5, group: str | None = None, seed: int = 42) -> DataFrame:
    """Adds in_calibration: the first ceil(fraction * n) users of each group, in the order of an MD5 of user and seed. A user's
    rows are on one side; a user in several groups belongs to the least."""
    g = F.col(group) if group else F.lit("")
    users = rows.groupBy("user").agg(F.min(g).alias("_g"))
    sizes = users.groupBy(F.col("_g").alias("_group")).agg(F.count("*").alias("_n"))
    placed = ranked(users.withColumn("_k", shuffle_key(F.col("user"), seed)), "_g", "_k", "user", "_r").join(sizes, F.col("_g").eqNullSafe(F.col("_group")))
    return rows.join(placed.select("user", (F.col("_r") <= F.ceil(F.col("_n") * F.lit(fraction))).alias("in_calibration")), "user")


def risk_curve(rows: DataFrame, policy: str = "primary", lambdas: tuple[float, ...] = LAMBDAS) -> DataFrame:
    """lambda, n_selected, n_wrong, risk on a grid. One pass: each row counts at the largest lambda that accepts it, and the
    grid's few sums are added up."""
    levels = sorted(set(lambdas))
    level = F.array_max(F.filter(F.array(*[F.lit(x) for x in levels]), lambda x: x <= F.col("score")))
    wrong = F.count_if(F.col("label").isin(*POLICIES[policy]))
    cells = rows.filter("score IS NOT NULL").groupBy(level.alias("level")).agg(F.count("*").alias("n"), wrong.alias("w"))
    grid = rows.sparkSession.createDataFrame([(x,) for x in levels], "lambda double")
    sums = grid.join(F.broadcast(cells), F.col("level") >= F.col("lambda"), "left").groupBy("lambda").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_selected"), F.coalesce(F.sum("w"), F.lit(0)).alias("n_wrong"))
    return sums.withColumn("risk", F.col("n_wrong") / F.greatest("n_selected", F.lit(1)))


def binomial_tail(wrong: int, n: int, alpha: float) -> float:
    """P(Bin(n, alpha) <= wrong): the p-value of `the risk is above alpha`. Terms are summed away from the mode until they no
    longer count, so the work grows with the root of n."""
    if n == 0:
        return 1.0
    log_term = lambda k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(alpha) + (n - k) * math.log1p(-alpha)
    below = wrong <= n * alpha
    ks = range(wrong, -1, -1) if below else range(wrong + 1, n + 1)
    total = 0.0
    for k in ks:
        term = math.exp(log_term(k))
        total += term
        if term <= total * 1e-18:
            break
    return min(1.0, total) if below else max(0.0, 1.0 - total)


def learn_then_test(rows: DataFrame, policy: str = "primary", alphas: tuple[float, ...] = ALPHAS, delta: float = 0.10, lambdas: tuple[float, ...] = LAMBDAS) -> DataFrame:
    """For each alpha the least lambda of an unbroken run of certified ones from the top: alpha, lambda_hat (null if nothing is
    certified), achieved_risk, n_selected, n_wrong, p_value, status. Only the risk curve reaches the driver."""
    curve = sorted(risk_curve(rows, policy, lambdas).collect(), key=lambda r: -r["lambda"])
    out = []
    for alpha in alphas:
        best = None
        for r in curve:
            p = binomial_tail(r.n_wrong, r.n_selected, alpha)
            if p > delta:
                break
            best = (alpha, r["lambda"], r.risk, r.n_selected, r.n_wrong, p, "pass")
        out.append(best or (alpha, None, None, None, None, None, "fail"))
    return rows.sparkSession.createDataFrame(out, "alpha double, lambda_hat double, achieved_risk double, n_selected long, n_wrong long, p_value double, status string")


def conformal_risk(rows: DataFrame, policy: str = "primary", alphas: tuple[float, ...] = ALPHAS, fraction: float = 0.5, lambdas: tuple[float, ...] = LAMBDAS, n: int | None = None) -> DataFrame:
    """The same for a bound on how many wrong claims get through: max(1, round(alpha * n * fraction)), one more than seen. n: number of
    rows before a split, where `rows` are one side of it; else all of `rows`."""
    n = rows.count() if n is None else n
    curve = risk_curve(rows, policy, lambdas).collect()
    out = []
    for alpha in alphas:
        bound = max(1, round(alpha * n * fraction))
        fine = [r for r in curve if r.n_wrong + 1 <= bound]
        best = min(fine, key=lambda r: r["lambda"], default=None)
        out.append((alpha, bound, best["lambda"] if best else None, best.n_selected if best else None, best.n_wrong if best else None, "pass" if best else "fail"))
    return rows.sparkSession.createDataFrame(out, "alpha double, bound long, lambda_hat double, n_selected long, n_wrong long, status string")


def manifest(rows: DataFrame, settings: dict, policy: str = "primary", delta: float = 0.10, seed: int = 42, alphas: tuple[float, ...] = ALPHAS, lambdas: tuple[float, ...] = LAMBDAS) -> DataFrame:
    """What a calibration did, as one record: policy, grids, provenance, and its results; write with sinks.write_records."""
    results = learn_then_test(rows, policy, alphas, delta, lambdas)
    packed = results.agg(F.array_sort(F.collect_list(F.struct("alpha", "lambda_hat", "achieved_risk", "n_selected", "n_wrong", "p_value", "status"))).alias("results"))
    return packed.select(
        F.lit(policy).alias("policy"), F.lit(delta).alias("delta"), F.lit(seed).alias("seed"), F.array(*[F.lit(x) for x in lambdas]).alias("lambdas"), F.array(*[F.lit(x) for x in alphas]).alias("alphas"),
        F.create_map(*[F.lit(str(x)) for kv in settings.items() for x in kv]).alias("provenance"), "results",
    )


#: Cells that a round splits an undecided range of scores into.
SPLIT = 64
UNKNOWN = "Unknown"


def _chain(periods: list, cells: dict, alpha: float, gamma: float, start: float) -> tuple[list[tuple], list[tuple]]:
    """Rows (period, lambda, err) as far as counts decide, and the ranges of scores (period, least, most) to be split next. A cell whose
    scores lie on both sides of lambda is undecided: half of it is taken, to guess where later periods will need more."""
    lam, rows, asked = start, [], []
    for period in periods:
        n = w = 0.0
        for least, most, k, wrong in cells[period]:
            share = 1.0 if least >= lam else 0.0
            if least < lam <= most:
                asked.append((period, least, most))
                share = 0.5
            n, w = n + share * k, w + share * wrong
        err = w / max(n, 1.0)
        if not asked:
            rows.append((period, lam, err))
        lam = max(0.0, min(1.0, lam + gamma * (err - alpha)))
    return rows, asked


def adaptive_thresholds(rows: DataFrame, policy: str = "primary", alpha: float = 0.10, gamma: float = 0.05, start: float = 0.90) -> DataFrame:
    """Lambda period by period: after a period with error e it moves by gamma * (e - alpha), within 0 and 1. rows: period, score,
    label; rows without a period or of period `Unknown` don't count.

    Exact, and counted in parallel: all tasks count scores in cells, and the chain of periods sees counts only. Where lambda falls
    between the scores of a cell, that cell is split into SPLIT ones by another count, until every period is decided; a round
    extends the decided periods, mostly by all, as it splits what later periods are likely to need. The driver holds some
    SPLIT counts a period and round, whatever the number of scores."""
    wrong = F.col("label").isin(*POLICIES[policy]).cast("int")
    kept = rows.filter(F.col("score").isNotNull() & F.col("period").isNotNull() & (F.col("period").cast("string") != UNKNOWN))
    counts = durable(kept.groupBy("period", "score").agg(F.count("*").alias("n"), F.sum(F.coalesce(wrong, F.lit(0))).alias("w")))
    cell = lambda: [F.min("score").alias("least"), F.max("score").alias("most"), F.sum("n").alias("n"), F.sum("w").alias("w")]
    cells: dict = {}
    # lambda stays within 0 and 1: scores beyond are on one side of it always
    for r in counts.groupBy("period", F.floor(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("score"))) * SPLIT).alias("part")).agg(*cell()).collect():
        cells.setdefault(r.period, []).append((r.least, r.most, float(r.n), float(r.w)))
    kind = dict(rows.dtypes)["period"]
    while True:
        done, asked = _chain(sorted(cells), cells, alpha, gamma, start)
        if not asked:
            return rows.sparkSession.createDataFrame(done, f"period {kind}, lambda double, err double")
        ranges = rows.sparkSession.createDataFrame(asked, f"_period {kind}, _least double, _most double")
        inside = counts.join(F.broadcast(ranges), (F.col("period") == F.col("_period")) & F.col("score").between(F.col("_least"), F.col("_most")))  # one row a period
        share = (F.col("score") - F.col("_least")) / (F.col("_most") - F.col("_least"))
        split = inside.groupBy("period", "_least", F.least(F.floor(share * SPLIT), F.lit(SPLIT - 1)).alias("part")).agg(*cell()).collect()
        for period, least, most in asked:
            cells[period] = [c for c in cells[period] if c[:2] != (least, most)]
        for r in split:
            cells[r.period].append((r.least, r.most, float(r.n), float(r.w)))
