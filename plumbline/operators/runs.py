"""Whole runs in one call: from logs to labelled signal records, from drafts to scored claims, from judged claims to thresholds.

Each step is the library's own; what later steps read more than once is kept in the shared folder, so logs are read and aggregated once.
Defined results: periods in `leave_out`, and events from `until` on, count for nothing, baselines included; a user without a snapshot is of the role UNKNOWN
and has blank identity fields; a user without a window has no malicious period; empty logs give empty results and a summary of zeros.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import scalars as S
from plumbline.operators import calibration, features, grounding, identity, pooling, signals
from plumbline.operators.baselines import BaselineConfig
from plumbline.sources import logs as L
from plumbline.sources.durable import durable


@dataclass(frozen=True)
class SignalRun:
    """features: a wide row per (user, period); labels: user, period, is_malicious, scenario; signals: records; summary: one row."""

    features: DataFrame
    labels: DataFrame
    signals: DataFrame
    summary: DataFrame


def period_edges(period: Column, grain: str) -> tuple[Column, Column]:
    """First and last second of a period."""
    if grain == "week":
        return S.week_start(period), S.week_end(period)
    first = F.to_timestamp(period)
    return first, F.timestamp_add("SECOND", F.lit(86399), first)


def signals_from_logs(
    logs: dict[str, DataFrame], snapshots: DataFrame, windows: DataFrame, config: BaselineConfig = BaselineConfig(), rules: tuple[signals.Rule, ...] = signals.RULES,
    until: str | None = None, leave_out: tuple[str, ...] = (), grain: str = "week",
) -> SignalRun:
    """logs: the five logs by name, as read_log or scan_log has them; snapshots: user, snapshot_month and the identity columns; windows: user,
    start, end, scenario. Peers share the role of the last snapshot; a record shows the identity of its own month."""
    missing = set(features.LOGS) - set(logs)
    if missing:
        raise ValueError(f"no log named {', '.join(sorted(missing))}")
    bounded = [logs[k] if until is None else L.before(logs[k], until) for k in features.LOGS]
    wide = features.raw_features(*[features.prepare(x.filter(F.col("ts").isNotNull()), grain) for x in bounded])
    wide = durable(L.without_periods(wide, list(leave_out)) if leave_out else wide)

    start, end = period_edges(F.col("period"), grain)
    spans = wide.select("user", "period", start.alias("period_start"), end.alias("period_end"))
    labels = durable(identity.label_periods(spans, windows).select("user", "period", "is_malicious", "scenario"))

    grouped = durable(identity.with_roles(wide, identity.latest_roles(snapshots)))
    flagged = durable(signals.apply_rules(signals.baselined_maps(grouped, features.BASELINED, config), rules, config))
    known = identity.identity_as_of(flagged.select("user", "period", F.date_format(start, "yyyy-MM").alias("month")), snapshots)
    known = known.select("user", "period", F.struct(*identity.IDENTITY).alias("identity"))
    # joins come first, and records are kept: facts are expressions too large for what the optimizer does around joins
    whole = durable(flagged.join(known, ["user", "period"]).join(labels, ["user", "period"]))
    records = durable(signals.records(signals.facts(whole, rules, config), rules, grain))

    marks = labels.join(flagged.select("user", "period", F.lit(True).alias("_f")), ["user", "period"], "left")
    summary = signals.run_summary(marks.select(F.coalesce("_f", F.lit(False)).alias("is_flagged"), "is_malicious"))
    return SignalRun(wide, labels, records, summary)


def claims_from_drafts(drafts: DataFrame, records: DataFrame, k: int, judgements: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """drafts: signal_id, sample_index, text; records: signals. Claims of the first k drafts, pooled by their words, and a score row for each.
    A claim is held against the drafts that don't say it."""
    rows = pooling.sentence_rows(pooling.first_drafts(drafts, k))
    claims = durable(pooling.pool_exact(rows))
    named = claims.select("signal_id", "sentence_id", "text", "appears_in")
    pairs = grounding.claim_pairs(named, rows.select("signal_id", "sample_index", "text"), tokens=True)
    others = pairs.join(named.select("signal_id", "sentence_id", "appears_in"), ["signal_id", "sentence_id"]).filter(~F.array_contains("appears_in", F.col("sample_index"))).drop("appears_in")
    agreement = grounding.self_consistency(grounding.judged(others, judgements)).select("signal_id", "sentence_id", "self_consistency")
    return claims, grounding.score_claims(named.drop("appears_in"), records, agreement)


@dataclass(frozen=True)
class CalibrationRun:
    """rows: cluster_id, user, group, score, label, in_calibration; thresholds: a row per policy, method and alpha, with the figures of the other
    side of the split at its threshold; manifests: a record per policy."""

    rows: DataFrame
    thresholds: DataFrame
    manifests: DataFrame


def thresholds_from_judgements(
    scores: DataFrame, judged: DataFrame, settings: dict, groups: DataFrame | None = None, policies: tuple[str, ...] = tuple(calibration.POLICIES),
    fraction: float = 0.5, alphas: tuple[float, ...] = calibration.ALPHAS, delta: float = 0.10, lambdas: tuple[float, ...] = calibration.LAMBDAS, seed: int = 42,
) -> CalibrationRun:
    """scores: cluster_id, rho; judged: cluster_id, user, label; settings: what made the claims, for the manifests; groups: user, group, which the
    split keeps in proportion.

    Defined results: claims without a judgement, and judgements without a scored claim, take no part; of several judgements of a claim, or
    groups of a user, the least counts; a user without a group is of the group Unknown; a claim without a user takes no part, as it belongs to neither side. Without rows no
    threshold is certified."""
    unknown = set(policies) - set(calibration.POLICIES)
    if unknown:
        raise ValueError(f"no policy named {', '.join(sorted(unknown))}")
    if list(lambdas) != sorted(lambdas, reverse=True):
        raise ValueError("lambdas must fall, the strictest first")
    one = judged.filter(F.col("user").isNotNull() & F.col("label").isNotNull()).groupBy("cluster_id").agg(F.min(F.struct("user", "label")).alias("j"))
    rows = scores.filter(F.col("rho").isNotNull()).groupBy("cluster_id").agg(F.min("rho").alias("score")).join(one, "cluster_id").select("cluster_id", "j.user", "score", "j.label")
    if groups is not None:
        rows = rows.join(groups.groupBy("user").agg(F.min("group").alias("group")), "user", "left")
    else:
        rows = rows.withColumn("group", F.lit(None).cast("string"))
    rows = durable(calibration.split_by_user(rows.withColumn("group", F.coalesce("group", F.lit("Unknown"))), fraction, "group", seed))
    inside, outside = rows.filter("in_calibration"), rows.filter(~F.col("in_calibration"))
    n, users = rows.agg(F.count("*"), F.count_distinct("user")).first()

    found, records = None, None
    for policy in policies:
        certified = calibration.learn_then_test(inside, policy, alphas, delta, lambdas).withColumns({"method": F.lit("learn then test"), "bound": F.lit(None).cast("long")})
        counted = calibration.conformal_risk(inside, policy, alphas, fraction, lambdas, n)
        counted = counted.withColumns({"method": F.lit("conformal risk"), "p_value": F.lit(None).cast("double"), "achieved_risk": F.col("n_wrong") / F.greatest("n_selected", F.lit(1))})
        other = calibration.risk_curve(outside, policy, lambdas).select(F.col("lambda").alias("lambda_hat"), F.col("n_selected").alias("other_selected"), F.col("n_wrong").alias("other_wrong"), F.col("risk").alias("other_risk"))
        both = certified.unionByName(counted).join(F.broadcast(other), "lambda_hat", "left")  # a row per lambda of the grid
        both = both.select(
            F.lit(policy).alias("policy"), "method", "alpha", "bound", "lambda_hat", "achieved_risk", "n_selected", "n_wrong", "p_value", "status", "other_selected", "other_wrong", "other_risk"
        )
        record = calibration.manifest(inside, {**settings, "fraction": fraction, "rows": n, "users": users}, policy, delta, seed, alphas, lambdas)
        found, records = (both, record) if found is None else (found.unionByName(both), records.unionByName(record))
    return CalibrationRun(rows, found, records)
