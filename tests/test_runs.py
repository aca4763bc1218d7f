"""Whole runs on small logs: what they return, what bounds and left-out periods change, and empty logs."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from plumbline.operators import calibration, features, identity, runs
from plumbline.operators.baselines import BaselineConfig
from plumbline.sources import logs as L

MONDAY = datetime(2010, 1, 4, 10)


@pytest.fixture(scope="module")
def given(spark):
    """Six users of one role who log on once a week; in week 9 one of them copies 40 files at night."""
    on = [(MONDAY + timedelta(weeks=w), f"U{u}", "PC1", "Logon") for u in range(6) for w in range(10)]
    copies = [(MONDAY + timedelta(weeks=w, minutes=m), f"U{u}", f"f{m}.doc", "Copy", "True") for u in range(6) for w in range(10) for m in range(40 if (u, w) == (2, 8) else 1)]
    made = {
        "logon": spark.createDataFrame(on, "ts timestamp, user string, pc string, activity string"),
        "file": spark.createDataFrame(copies, "ts timestamp, user string, filename string, activity string, to_removable_media string"),
    }
    for log in ("device", "email", "http"):
        made[log] = spark.createDataFrame([], ", ".join([*(f"{c} string" for c in L.LOGS[log][1] if c != "date"), "ts timestamp"]))
    made["logon"] = made["logon"].unionByName(spark.createDataFrame([(None, "U9", "PC1", "Logon")], made["logon"].schema))
    people = [(f"U{u}", m, f"Name {u}", role, "B", "F", "D", "T", "S") for u in range(6) for m, role in (("2010-01", "Clerk"), ("2010-12", "Boss"))]
    snapshots = spark.createDataFrame(people, "user string, snapshot_month string, " + ", ".join(f"{c} string" for c in identity.IDENTITY))
    at = MONDAY + timedelta(weeks=8)
    windows = spark.createDataFrame([("U2", at, at + timedelta(days=1), "1")], "user string, start timestamp, end timestamp, scenario string")
    return made, snapshots, windows


def test_from_logs_to_signals(spark, given):
    run = runs.signals_from_logs(*given)
    assert run.features.count() == run.labels.count() == 60  # the event without a time counts for nothing
    (s,) = run.signals.collect()
    assert (s.user, s.period, s.period_type) == ("U2", "2010-W09", "week") and s.label.is_malicious and s.label.scenario == "1"
    assert s.identity.role == "Clerk" and s.identity.employee_name == "Name 2" and "R2" in [r.rule_id for r in s.triggered_rules]
    assert [f.value for f in s.facts if f.field == "removable_media_copies"] == [40]
    t = run.summary.first()
    assert (t.periods, t.flagged, t.malicious, t.malicious_flagged, t.recall) == (60, 1, 1, 1, 1.0)


def test_bounds_and_left_out_periods(spark, given):
    short = runs.signals_from_logs(*given, until="2010-02-22", config=BaselineConfig(min_history=3))
    assert short.features.agg(F.max("period")).first()[0] == "2010-W07" and short.signals.isEmpty()
    without = runs.signals_from_logs(*given, leave_out=("2010-W09",))
    assert without.features.count() == 54 and without.signals.isEmpty() and without.summary.first().malicious == 0


def test_nothing_and_what_is_missing(spark, given):
    logs, snapshots, windows = given
    run = runs.signals_from_logs({k: v.limit(0) for k, v in logs.items()}, snapshots, windows)
    assert run.signals.isEmpty() and run.summary.first().periods == 0
    with pytest.raises(ValueError, match="http"):
        runs.signals_from_logs({k: v for k, v in logs.items() if k != "http"}, snapshots, windows)
    assert features.LOGS == tuple(L.LOGS)


def test_from_drafts_to_scored_claims(spark, given):
    records = runs.signals_from_logs(*given).signals
    one = records.first().signal_id
    said = ["The user copied 40 files. Nothing else was seen.", "The user copied 40 files. The count was 777.", "The user copied 40 files.", "Ignored as the fourth draft of three."]
    drafts = spark.createDataFrame([(one, k, t) for k, t in enumerate(said)], "signal_id string, sample_index int, text string")
    claims, scores = runs.claims_from_drafts(drafts, records, 3)
    text = {r.sentence_id: r.text for r in claims.collect()}
    found = {text[r.sentence_id]: r for r in scores.collect()}
    assert set(found) == {"The user copied 40 files.", "Nothing else was seen.", "The count was 777."}
    assert found["The user copied 40 files."].fact_match_score == 1 and found["The count was 777."].fact_match_score == 0
    assert found["Nothing else was seen."].self_consistency == 0 == found["Nothing else was seen."].rho


def test_from_judgements_to_thresholds(spark):
    scored = [(f"c{i:03d}", i / 400) for i in range(400)] + [("lone", 0.9), ("blank", None)]
    told = [(f"c{i:03d}", f"U{i % 40}", "hallucinated" if i < 100 else "misweighted" if i < 200 else "grounded") for i in range(400)]
    told += [("c399", "U39", "misweighted"), ("unscored", "U1", "grounded"), ("c000", None, "grounded"), ("blank", "U1", "grounded")]
    scores, judged = spark.createDataFrame(scored, "cluster_id string, rho double"), spark.createDataFrame(told, "cluster_id string, user string, label string")
    groups = spark.createDataFrame([(f"U{u}", f"g{u % 2}") for u in range(36)], "user string, group string")
    run = runs.thresholds_from_judgements(scores, judged, {"k": 4}, groups, lambdas=(0.9, 0.6, 0.5, 0.25, 0.0))
    rows = run.rows.collect()
    assert len(rows) == 400 and {r.group for r in rows} == {"g0", "g1", "Unknown"}
    side = {}
    for r in rows:
        assert side.setdefault(r.user, r.in_calibration) == r.in_calibration
    assert sorted((g, sum(side[u] for u in {r.user for r in rows if r.group == g})) for g in ("g0", "g1", "Unknown")) == [("Unknown", 2), ("g0", 9), ("g1", 9)]
    found = {(r.policy, r.method, r.alpha): r for r in run.thresholds.collect()}
    assert len(found) == 2 * 2 * len(calibration.ALPHAS)
    for (policy, method, alpha), r in found.items():
        if r.lambda_hat is not None:
            for inside, n, wrong in ((True, r.n_selected, r.n_wrong), (False, r.other_selected, r.other_wrong)):
                taken = [x for x in rows if x.in_calibration == inside and x.score >= r.lambda_hat]
                assert (len(taken), sum(x.label in calibration.POLICIES[policy] for x in taken)) == (n, wrong)
    # no claim from 0.5 on is wrong by the primary policy, none from 0.25 on by the secondary one; the few above 0.9 can certify 0.2, not 0.1
    assert found["secondary", "learn then test", 0.1].lambda_hat is None
    assert found["primary", "learn then test", 0.3].lambda_hat == 0.5 and found["secondary", "learn then test", 0.2].lambda_hat == 0.25
    assert found["primary", "conformal risk", 0.3].bound == 60
    manifests = {m.policy: m for m in run.manifests.collect()}
    assert manifests["primary"].provenance == {"k": "4", "fraction": "0.5", "rows": "400", "users": "40"} and manifests["secondary"].lambdas == [0.9, 0.6, 0.5, 0.25, 0.0]


def test_thresholds_of_nothing(spark):
    scores, judged = spark.createDataFrame([], "cluster_id string, rho double"), spark.createDataFrame([], "cluster_id string, user string, label string")
    run = runs.thresholds_from_judgements(scores, judged, {})
    assert run.rows.isEmpty() and {r.lambda_hat for r in run.thresholds.filter("method = 'learn then test'").collect()} == {None}
    for bad in ({"policies": ("third",)}, {"lambdas": (0.1, 0.9)}):
        with pytest.raises(ValueError):
            runs.thresholds_from_judgements(scores, judged, {}, **bad)
