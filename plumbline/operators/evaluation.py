"""Error and recall of accepted claims, comparisons of scores, and reports on wording."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import scalars as S
from plumbline.operators.calibration import POLICIES

GROUNDED = "grounded"


def _figures(accepted: Column, policy: str) -> list[Column]:
    """A null score is accepted at no threshold; with nothing accepted the error is 0."""
    ok = F.coalesce(accepted, F.lit(False))
    n, wrong = F.count_if(ok), F.count_if(ok & F.col("label").isin(*POLICIES[policy]))
    grounded = F.count_if(F.col("label") == GROUNDED)
    return [n.alias("accepted"), wrong.alias("wrong"), (wrong / F.greatest(n, F.lit(1))).alias("error"), F.coalesce(F.try_divide(F.count_if(ok & (F.col("label") == GROUNDED)), grounded), F.lit(0.0)).alias("recall")]


def at_threshold(rows: DataFrame, threshold: float, policy: str = "primary", by: list[str] | None = None) -> DataFrame:
    """Error and grounded recall at a threshold, over all or by columns (malicious flag, rule combination)."""
    return rows.groupBy(*(by or [])).agg(*_figures(F.col("score") >= threshold, policy))


def _thresholds(rows: DataFrame, cuts: tuple[float, ...]) -> DataFrame:
    return rows.withColumn("threshold", F.explode(F.array(*[F.lit(c) for c in cuts])))


def threshold_sweep(rows: DataFrame, cuts: tuple[float, ...] = (0.3, 0.5, 0.7), by: list[str] | None = None) -> DataFrame:
    """tp, fp, fn, tn, precision, recall and null scores at each threshold; truth is `grounded`."""
    yes, truth = F.coalesce(F.col("score") >= F.col("threshold"), F.lit(False)), F.col("label") == GROUNDED
    t = _thresholds(rows, cuts).groupBy(*(by or []), "threshold").agg(
        F.count_if(yes & truth).alias("tp"), F.count_if(yes & ~truth).alias("fp"), F.count_if(~yes & truth).alias("fn"), F.count_if(~yes & ~truth).alias("tn"), F.count_if(F.col("score").isNull()).alias("null_scores")
    )
    return t.withColumns({"precision": F.try_divide("tp", F.col("tp") + F.col("fp")), "recall": F.try_divide("tp", F.col("tp") + F.col("fn"))})


def long_scores(rows: DataFrame, scores: tuple[str, ...]) -> DataFrame:
    """Rows by score name: everything else, score_name, score."""
    keep = [c for c in rows.columns if c not in scores]
    return rows.select(*keep, *[F.col(s).cast("double").alias(s) for s in scores]).unpivot(keep, list(scores), "score_name", "score")


def ablation(rows: DataFrame, scores: tuple[str, ...], cuts: tuple[float, ...] = (0.3, 0.5, 0.7)) -> DataFrame:
    return threshold_sweep(long_scores(rows, scores), cuts, ["score_name"])


def baseline_table(rows: DataFrame, scores: tuple[str, ...], cuts: dict[str, float], null_as_zero: bool = False) -> DataFrame:
    """Error and recall of each score at each named cut, under each policy."""
    x = long_scores(rows, scores)
    if null_as_zero:
        x = x.withColumn("score", F.coalesce("score", F.lit(0.0)))
    x = x.withColumn("cut", F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(v).alias("at")) for n, v in cuts.items()])))
    parts = [x.groupBy("score_name", F.col("cut.name").alias("cut")).agg(*_figures(F.col("score") >= F.col("cut.at"), p)).withColumn("policy", F.lit(p)) for p in POLICIES]
    return parts[0].unionByName(parts[1])


def score_histogram(rows: DataFrame, bins: int = 20) -> DataFrame:
    """Rows of each label in equal bins over 0 to 1, the last one closed."""
    cell = F.least(F.floor(F.col("score") * bins), F.lit(bins - 1)).cast("int")
    return rows.filter("score IS NOT NULL").groupBy("label", cell.alias("bin")).agg(F.count("*").alias("n"))


def ranks_of_wrong(rows: DataFrame, wrong_ids: list[str], ident: str = "cluster_id") -> DataFrame:
    """For each given claim, how many grounded rows score at least as high, and their share."""
    cases = rows.filter(F.col(ident).isin(wrong_ids)).select(F.col(ident).alias("case"), F.col("score").alias("case_score"))
    good = rows.filter(F.col("label") == GROUNDED).select("score")
    total = good.count()
    # the stated cases against all rows
    above = good.join(F.broadcast(cases), F.col("score") >= F.col("case_score"), "right").groupBy("case", "case_score").agg(F.count("score").alias("above"))
    return above.withColumn("share", F.try_divide("above", F.lit(total)))


def case_report(rows: DataFrame, cases: DataFrame, ident: str = "cluster_id") -> DataFrame:
    """Score rows of named cases; a case that is not there has null scores."""
    return cases.join(rows, ident, "left")


def with_context(rows: DataFrame, clusters: DataFrame, signals: DataFrame) -> DataFrame:
    """rows: cluster_id; clusters: cluster_id, user, malicious, rules; signals: signal_id, period, group. Unknown ones are `Unknown`."""
    out = rows.withColumn("signal_id", S.signal_of(F.col("cluster_id"))).join(clusters, "cluster_id", "left").join(signals, "signal_id", "left")
    return out.withColumns({c: F.coalesce(c, F.lit("Unknown")) for c in ("rules", "group")})


def updated_gold(gold: DataFrame, scores: DataFrame, columns: tuple[str, ...] = ("self_consistency", "fact_match", "misweighted", "hallucinated_context")) -> DataFrame:
    """Gold rows with fresh features by cluster id, 0.0 where there are none."""
    fresh = scores.select("cluster_id", *[F.col(c).cast("double").alias(f"_{c}") for c in columns])
    return gold.drop(*columns).join(fresh, "cluster_id", "left").select("*", *[F.coalesce(f"_{c}", F.lit(0.0)).alias(c) for c in columns]).drop(*[f"_{c}" for c in columns])


def errors(gold: DataFrame, scored: DataFrame) -> DataFrame:
    return gold.filter("target = 0").join(scored, "cluster_id")


def text_drift(claims: DataFrame, labelled: DataFrame) -> DataFrame:
    """Claims whose text differs from the labelled one."""
    return claims.join(labelled.select("cluster_id", F.col("representative_text").alias("labelled_text")), "cluster_id").filter(~F.col("text").eqNullSafe(F.col("labelled_text")))


def disagreements(a: DataFrame, b: DataFrame, n: int, high: float = 0.5, low: float = 0.3) -> DataFrame:
    """The first n grounded rows that one score table rates at least `high` and the other below `low`."""
    both = a.filter(F.col("label") == GROUNDED).select("cluster_id", F.col("score").alias("score_a")).join(b.select("cluster_id", F.col("score").alias("score_b")), "cluster_id")
    return both.filter((F.col("score_a") >= high) & (F.col("score_b") < low)).orderBy("cluster_id").limit(n)


def in_both(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return a.select(*keys).intersect(b.select(*keys))


def identity_numbers(identity: Column, fields: tuple[str, ...]) -> Column:
    """The numbers that stand in the shown identity fields."""
    texts = F.concat_ws(" ", *[identity[f] for f in fields]) if fields else F.lit("")
    return F.transform(F.regexp_extract_all(F.coalesce(texts, F.lit("")), F.lit(r"\d+"), F.lit(0)), lambda x: x.cast("double"))


def hidden_maxima(facts: Column, others: Column | None = None) -> Column:
    """Recent maxima of what happened before, that no other rendered number of the signal shows; others: further shown numbers."""
    maxima = F.array_compact(F.transform(facts, lambda f: F.when(~F.coalesce(f["never_before"], F.lit(False)), f["self_recent_max"])))
    shown = F.flatten(F.transform(facts, lambda f: F.array_compact(F.array(f["value"], f["self_center"], f["peer_center"], f["peer_group_size"].cast("double")))))
    return F.array_except(maxima, shown if others is None else F.concat(shown, others))


def signal_profile(signals: DataFrame) -> DataFrame:
    """Peer sizes, whether a value truly exceeds its recent maximum, and hidden maxima of each signal. Digits of role, team and unit are
    shown, too, where the identity has these fields."""
    has = {f.name: f.dataType for f in signals.schema.fields}["identity"].names if "identity" in signals.columns else []
    digits = identity_numbers(F.col("identity"), tuple(f for f in ("role", "team", "functional_unit") if f in has))
    exceeds = F.exists("facts", lambda f: F.coalesce((f["value"] > f["self_recent_max"]) & ~F.coalesce(f["never_before"], F.lit(False)), F.lit(False)))
    sizes = F.array_distinct(F.array_compact(F.transform("facts", lambda f: f["peer_group_size"])))
    return signals.select("signal_id", F.array_sort(sizes).alias("peer_sizes"), exceeds.alias("true_exceedance"), F.array_sort(hidden_maxima(F.col("facts"), digits)).alias("hidden_maxima"))


# Wordings that count.
WORDINGS = {
    "exceeds_max": r"(?i)\b(?:exceed(?:s|ed|ing)?|surpass(?:es|ed|ing)?|above|over|beyond|higher than)\b[^.]{0,60}?\b(?:maximum|max|peak|highest|previous high|prior high|limit|threshold)\b",
    "sigma": r"(?i)z[- ]?score[^.]{0,20}?\d|\d+(?:\.\d+)?\s*(?:standard deviations?|sigma|σ)|\d+(?:\.\d+)?\s*(?:sd|s\.d\.)\b",
}


def wording_hits(drafts: DataFrame, profiles: DataFrame) -> DataFrame:
    """drafts: signal_id, sample_index, text. Hits of each wording, of a peer group's size used as a denominator, and of hidden
    maxima as figures; the last two patterns follow from each signal's numbers."""
    rows = drafts.join(profiles, "signal_id")
    # as the renderer shows them: no decimals where there are none; digits of rule ids, weeks and window lengths don't count
    number = lambda x: F.when(x == F.floor(x), x.cast("long").cast("string")).otherwise(F.regexp_replace(x.cast("decimal(18,3)").cast("string"), r"0+$", ""))
    sizes = F.array_join(F.transform("peer_sizes", lambda n: n.cast("string")), "|")
    maxima = F.array_join(F.transform("hidden_maxima", lambda n: F.replace(number(n), F.lit("."), F.lit(r"\."))), "|")
    hits = lambda pattern, text=F.col("text"): F.size(F.regexp_extract_all(text, pattern, F.lit(0)))
    within = lambda inner, form, text=F.col("text"): F.when(inner != "", hits(F.concat(F.lit(form[0]), inner, F.lit(form[1])), text)).otherwise(0)
    named = [hits(F.lit(p)).alias(n) for n, p in WORDINGS.items()]
    return rows.select("signal_id", "sample_index", "true_exceedance", *named, within(sizes, (r"\b(?:out of|of|among|amongst|across)\s+(?:the\s+)?(?:", r")\b(?!\s+(?:peers|same-role|colleagues|others))")).alias("peer_denominator"), within(maxima, (r"(?<![\d.])(?:", r")(?![\d.])"), S.scrub_boilerplate(F.col("text"))).alias("max_figure"))


def wording_comparison(before: DataFrame, after: DataFrame) -> DataFrame:
    """Hits and drafts affected of two versions, on the signals that both have, split by true exceedance."""
    kinds = (*WORDINGS, "peer_denominator", "max_figure")
    a = before.join(after.select("signal_id").distinct(), "signal_id", "left_semi").withColumn("version", F.lit("before"))
    b = after.join(before.select("signal_id").distinct(), "signal_id", "left_semi").withColumn("version", F.lit("after"))
    long = a.unionByName(b).unpivot(["version", "true_exceedance", "signal_id", "sample_index"], list(kinds), "wording", "hits")
    return long.groupBy("true_exceedance", "wording").pivot("version", ["before", "after"]).agg(F.sum("hits").alias("hits"), F.count_if(F.col("hits") > 0).alias("drafts"))
