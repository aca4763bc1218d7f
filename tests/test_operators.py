"""Operators on small hand-made frames."""

import math

import pytest
from pyspark.sql import functions as F

from plumbline.operators import baselines, calibration, evaluation, features, grounding, identity, judgements, pooling, rho, sampling, signals
from plumbline.sources import logs, sinks


def test_log_lines(spark):
    lines = ['{1},01/02/2010 07:00:00,U1,PC,http://a.com/x,GET,say "hi, there', "{2},bad,U2,PC,,GET,"]
    rows = logs.parse_lines(spark.createDataFrame([(x,) for x in lines], "value string"), "http")
    got = rows.collect()
    assert got[0].url == "http://a.com/x" and str(got[0].ts) == "2010-01-02 07:00:00" and got[1].url is None and got[1].ts is None
    assert logs.rejected_rows(rows).first().rejected == 1


def test_log_files_snapshots_and_fixes(spark, tmp_path):
    (tmp_path / "logon.csv").write_text("id,date,user,pc,activity\n{1},01/02/2010 07:00:00,U1,PC1,Logon\n")
    assert logs.read_log(spark, str(tmp_path / "logon.csv"), "logon").first().pc == "PC1"
    (tmp_path / "ldap").mkdir()
    for month, role in (("2010-01", "a"), ("2010-02", "b")):
        (tmp_path / "ldap" / f"{month}.csv").write_text(f"user_id,role\nU1,{role}\n")
    assert {(r.snapshot_month, r.role) for r in logs.read_snapshots(spark, str(tmp_path / "ldap")).collect()} == {("2010-01", "a"), ("2010-02", "b")}
    (tmp_path / "fixes.json").write_text('{"U1": {"x": "01/02/2010 00:00:00"}, "U2": {}}')
    fixes = logs.read_date_fixes(spark, str(tmp_path / "fixes.json"))
    assert [tuple(r) for r in fixes.collect()] == [("U1", "x", "01/02/2010 00:00:00")]
    answers = spark.createDataFrame([("r", "U1", "1", "x", "01/05/2010 00:00:00"), ("other", "U9", "1", "y", "y")], "dataset string, user string, scenario string, start string, end string")
    assert str(logs.truth_windows(answers, "r", fixes).first().start) == "2010-01-02 00:00:00"
    with pytest.raises(Exception, match="no readable date"):
        logs.truth_windows(answers, "other", fixes).collect()
    wide = spark.createDataFrame([("r", "U1", "1", "x", "05/05/2010 00:00:00")], answers.schema)
    with pytest.raises(Exception, match="too wide"):
        logs.truth_windows(wide, "r", fixes).collect()


def test_sinks(spark, tmp_path):
    assert (sinks.pooling_slug("exact"), sinks.output_path("a/", "semantic", 0.85)) == ("exact", "a/t085")
    rows, path = spark.range(5), str(tmp_path / "out")
    sinks.write_records(rows, path)
    with pytest.raises(ValueError, match="stays"):
        sinks.write_records(rows.limit(0), path)
    assert spark.read.json(sinks.current(spark, path)).count() == 5
    made = []
    build = lambda: (made.append(1), rows)[1]
    for _ in range(2):
        assert sinks.resumed(spark, str(tmp_path / "kept"), build).count() == 5
    assert made == [1]


def test_raw_features(spark):
    def log(rows, schema):
        return features.prepare(spark.createDataFrame(rows, schema).withColumn("ts", F.to_timestamp("ts")))

    logon = log([("U", "2010-01-04 06:00:00", "Logon", "A"), ("U", "2010-01-09 20:00:00", "Logoff", "B")], "user string, ts string, activity string, pc string")
    device = log([("U", "2010-01-04 06:00:00", "Connect"), ("V", "2010-01-04 09:00:00", "Disconnect")], "user string, ts string, activity string")
    file = log([("U", "2010-01-04 06:00:00", "a.txt", "True"), ("U", "2010-01-04 09:00:00", None, None)], "user string, ts string, filename string, to_removable_media string")
    email = log([("U", "2010-01-04 09:00:00", "Send", "a@x.org;b@dtaa.com", None, None, "d(5);e(6)"), ("U", "2010-01-04 09:00:00", "View", "a@x.org", None, None, "d(5)")], "user string, ts string, activity string, to string, cc string, bcc string, attachments string")
    http = log([("U", "2010-01-04 09:00:00", "http://wikileaks.org/x"), ("U", "2010-01-04 09:00:00", None)], "user string, ts string, url string")
    got = {r.user: r.asDict() for r in features.raw_features(logon, device, file, email, http).collect()}
    u = got["U"]
    assert (u["total_logons"], u["after_hours_logons"], u["weekend_logons"], u["distinct_pcs"], u["n_active_days"], u["n_weekend_days"], u["earliest_hour"], u["latest_hour"]) == (1, 1, 0, 2, 2, 1, 6, 6)
    assert (u["total_file_events"], u["removable_media_copies"], u["distinct_files"], u["total_emails_sent"], u["external_recipients"], u["attachment_bytes"]) == (2, 1, 1, 1, 1, 11)
    assert (u["total_http_requests"], u["leak_site_visits"], u["distinct_domains"]) == (2, 1, 1)
    assert got["V"]["earliest_hour"] is None and got["V"]["total_logons"] == 0


def series(spark, values, feature="total_logons"):
    return spark.createDataFrame([("U", f"p{i:02d}", feature, float(v)) for i, v in enumerate(values)], "user string, period string, feature string, value double")


def test_self_baselines(spark):
    got = {r.period: r for r in baselines.self_baselines(series(spark, [0, 0, 0, 0, 0, 0, 4, 0])).collect()}
    assert got["p05"].self_z is None and got["p05"].self_first is None
    p = got["p06"]
    assert (p.self_center, p.self_spread, p.self_z, p.self_first, p.self_hist_max) == (0, 1, 4, True, 0)
    far = baselines.self_baselines(series(spark, [1] * 13 + [1e6], "attachment_bytes")).filter("period = 'p13'").first()
    assert far.self_z == 50


def test_peer_baselines(spark):
    rows = [(f"U{i}", "p", "total_logons", float(v), role) for i, (v, role) in enumerate([(0, "a")] * 5 + [(9, "b")] * 4 + [(4, "c")] * 5)]
    got = {r.role: r for r in baselines.peer_baselines(spark.createDataFrame(rows, "user string, period string, feature string, value double, role string")).collect()}
    assert (got["a"].peer_center, got["a"].peer_z, got["a"].peer_n) == (0, None, 5)
    assert (got["b"].peer_center, got["b"].peer_z, got["b"].peer_spread, got["b"].peer_n) == (None, None, 3, 4)
    assert (got["c"].peer_center, got["c"].peer_z) == (4, 0)


STATS = "map<string,struct<value:double,self_center:double,self_z:double,self_first:boolean,self_hist_max:double,peer_center:double,peer_z:double,peer_n:int>>"


def flagged(spark, stats):
    full = {k: tuple({**dict.fromkeys(signals.MEASURES), **v}[m] for m in signals.MEASURES) for k, v in stats.items()}
    return signals.apply_rules(spark.createDataFrame([("U", "2010-W33", full)], f"user string, period string, stats {STATS}"))


def test_rules(spark):
    assert flagged(spark, {"leak_site_visits": {"value": 1.0}}).first().evidence[0].fields == ["leak_site_visits"]
    assert flagged(spark, {"after_hours_logons": {"value": 3.0, "self_z": 3.0}}).first().triggered == ["R1"]
    assert flagged(spark, {"after_hours_logons": {"value": 2.0, "self_z": 9.0}}).count() == 0
    assert flagged(spark, {"removable_media_copies": {"value": 10.0, "peer_z": 4.0}}).first().triggered == ["R2"]
    assert flagged(spark, {"external_recipients": {"value": 1.0}, "attachment_bytes": {"value": 5e7, "self_z": 3.0}}).first().triggered == ["R3"]
    both = flagged(spark, {"total_logons": {"value": 9.0, "self_z": 3.0, "peer_z": 4.0}, "total_file_events": {"value": 9.0, "self_z": 3.0, "peer_z": 3.0}}).first()
    assert both.triggered == ["R5"] and both.evidence[0].fields == ["total_logons"]


def record(spark):
    stats = {
        "leak_site_visits": {"value": 2.0, "self_center": 0.0, "self_z": 2.0, "self_first": True, "self_hist_max": 0.0},
        "job_search_visits": {"value": 7.0, "self_center": 1.0, "self_z": 50.0, "self_first": False, "self_hist_max": 3.0, "peer_center": 2.0, "peer_z": 4.5, "peer_n": 8},
        "distinct_pcs": {"value": 1.0},
    }
    return signals.records(signals.facts(flagged(spark, stats)))


def test_records(spark):
    r = record(spark).first()
    assert r.signal_id and [t.rule_id for t in r.triggered_rules] == ["R4"]
    assert [(f.fact_id, f.field, f.triggering_rule_ids) for f in r.facts] == [("F001", "leak_site_visits", ["R4"]), ("F002", "job_search_visits", ["R4"]), ("F003", "distinct_pcs", [])]
    assert r.facts[1].self_z_capped and r.facts[1].peer_group_size == 8 and r.facts[2].self_z_capped is None
    text = signals.context_text(record(spark)).first().context
    assert "never before" in text and "own typical 0.00" not in text and "among 8" in text and "50" not in text
    assert record(spark).select(signals.evidence_ids(F.col("facts")).alias("x")).first().x == ["F001", "F002"]


def test_summary(spark):
    s = signals.run_summary(spark.createDataFrame([(True, True), (False, True), (False, False)], "is_flagged boolean, is_malicious boolean")).first()
    assert (s.periods, s.flagged, s.malicious, s.malicious_flagged, s.recall, s.alarm) == (3, 1, 2, 1, 0.5, True)


def test_identity_and_labels(spark):
    snaps = spark.createDataFrame([("U", "2010-03", "c"), ("U", "2010-01", "a"), ("V", "2010-05", "z")], "user string, snapshot_month string, role string")
    rows = spark.createDataFrame([("U", "2010-02"), ("V", "2010-02"), ("W", "2010-02"), ("U", "2010-03")], "user string, month string")
    got = {(r.user, r.month): (r.snapshot_month, r.role) for r in identity.identity_as_of(rows, snaps, ("role",)).collect()}
    assert got == {("U", "2010-02"): ("2010-01", "a"), ("V", "2010-02"): ("2010-05", "z"), ("W", "2010-02"): (None, ""), ("U", "2010-03"): ("2010-03", "c")}
    assert {(r.user, r.role) for r in identity.with_roles(rows.select("user").distinct(), identity.latest_roles(snaps)).collect()} == {("U", "UNKNOWN"), ("V", "z"), ("W", "UNKNOWN")}
    periods = spark.createDataFrame([("U", "p1", "2010-01-04", "2010-01-10"), ("U", "p2", "2010-01-11", "2010-01-17")], "user string, period string, period_start string, period_end string")
    windows = spark.createDataFrame([("U", "2010-01-10", "2010-01-10", "s")], "user string, start string, end string, scenario string")
    assert [(r.period, r.is_malicious) for r in identity.label_periods(periods, windows).orderBy("period").collect()] == [("p1", True), ("p2", False)]


def test_samples(spark):
    rows = spark.createDataFrame([(f"s{i}", "a" if i % 3 else "b", i < 2) for i in range(30)], "signal_id string, bucket string, bad boolean")
    got = sampling.stratified_sample(rows, 8, "bucket", "bad").collect()
    assert [r.signal_id for r in got[:2]] == ["s0", "s1"] and [r.bucket for r in got[2:]] == ["a", "b"] * 3
    assert sampling.uniform_sample(rows, 99).count() == 30 and sampling.uniform_sample(rows, 5).collect() == sampling.uniform_sample(rows.repartition(3), 5).collect()


def drafts(spark):
    return spark.createDataFrame([("g", 0, "One rose.\nTwo fell."), ("g", 1, "two  FELL.\ntwo fell."), ("g", 2, "Three.")], "signal_id string, sample_index int, text string")


def test_exact_pooling(spark):
    rows = pooling.sentence_rows(drafts(spark))
    claims = pooling.pool_exact(rows)
    assert [(r.sentence_id, r.text, r.n_samples) for r in claims.orderBy("sentence_id").collect()] == [("s001", "One rose.", 1), ("s002", "Two fell.", 2), ("s003", "Three.", 1)]
    assert {r.sample_index: r.sentence_ids for r in pooling.sentence_ids(rows, claims).collect()} == {0: ["s001", "s002"], 1: ["s002"], 2: ["s003"]}
    d = pooling.distribution(claims, F.lit(3)).first()
    assert (d.claims, d.singletons, d.recurring, d.majority) == (3, 2, 1, 1)
    assert pooling.first_drafts(drafts(spark), 2).count() == 2
    assert pooling.generator_stats(drafts(spark)).first().drafts == 3 and pooling.pooling_stats(claims).first().mentions == 4


def test_semantic_pooling(spark):
    import numpy as np

    assert pooling.greedy_clusters(np.array([[1, 0], [0.6, 0.8], [0.6, 0.8], [0, 0]]), 0.6).tolist() == [0, 0, 0, 1]
    assert pooling.greedy_clusters(np.array([[1, 0], [0, 1], [1, 1]]), 0.7).tolist() == [0, 1, 1]
    for bad in (("semantic", None, 1.0, 1), ("exact", 0.8, 1.0, 1), ("exact", None, 0.0, 1), ("exact", None, 1.0, 0), ("other", None, 1.0, 1)):
        with pytest.raises(ValueError):
            pooling.check_settings(*bad)
    rows = pooling.sentence_rows(drafts(spark))
    keys = rows.select("signal_id", "key").distinct().withColumn("cluster", F.when(F.col("key") == "three.", 0).otherwise(1))
    got = pooling.pool_clusters(rows, keys).orderBy("sentence_id").collect()
    assert [(r.text, r.n_samples, r.n_variants) for r in got] == [("One rose.", 2, 2), ("Three.", 1, 1)]




def test_numbers_against_facts(spark):
    kinds = "fact_id:string,display:string,self_center:double,never_before:boolean,peer_center:double,peer_group_size:int"
    df = spark.createDataFrame([("20 2 200 20000 7 20.1", [("F001", "20", 10.0, False, None, None)]), ("none", [])], f"text string, facts array<struct<{kinds}>>")
    a, b = grounding.match_numbers(df).withColumn("share", grounding.share_grounded(F.col("matches"))).collect()
    assert [(m.kind, m.detail) for m in a.matches] == [("matched", "value"), ("derived", "ratio"), ("derived", "percent"), ("derived", "unit"), ("unmatched", None), ("matched", "value")]
    assert a.share == pytest.approx(5 / 6) and b.share is None


def test_weighting_entities_and_agreement(spark):
    kinds = "fact_id:string,gloss:string,triggering_rule_ids:array<string>"
    facts = [("F001", "removable media copies", ["R2"]), ("F002", "active days worked", [])]
    df = spark.createDataFrame([(t, facts) for t in ("The reason is active days", "The reason is removable copies and active days", "It rose in active days", "While due to active days, media grew")], f"text string, facts array<struct<{kinds}>>")
    assert [r.x for r in df.select(grounding.misweighted_fact(F.col("text"), F.col("facts")).alias("x")).collect()] == ["F002", None, None, None]
    e = spark.range(1).select(grounding.entity_matches(F.array(F.lit("Ann Lee"), F.lit("Bob Ray")), F.array(F.lit("ann lee"), F.lit("clerk"))).alias("x")).first().x
    assert e == [True, False]
    claims = spark.createDataFrame([("g", "s001", "a b c")], "signal_id string, sentence_id string, text string")
    said = spark.createDataFrame([("g", 0, "a b c d"), ("g", 1, "x y"), ("g", 2, "z")], "signal_id string, sample_index int, text string")
    pairs = grounding.claim_pairs(claims, said)
    assert grounding.self_consistency(grounding.judged(pairs)).first().self_consistency == pytest.approx(1 / 3)
    told = spark.createDataFrame([("z", "a b c", "entailment"), ("a b c d", "a b c", "neutral")], "premise string, hypothesis string, label string")
    assert grounding.self_consistency(grounding.judged(pairs, told), F.col("sample_index") == 1).first().self_consistency == 0.5
    rows = spark.createDataFrame([(True, 0.9, 0.5), (False, 0.9, 0.5), (False, None, 0.5)], "m boolean, f double, c double")
    assert [r.x for r in rows.select(grounding.rho(F.col("m"), F.col("f"), F.col("c")).alias("x")).collect()] == [0, 0.9, 0.5]


def claims(spark):
    rows = [(f"U{i % 10}", "g", i / 100, "grounded" if i >= 30 else "hallucinated") for i in range(100)] + [("U0", "g", None, "grounded")]
    return spark.createDataFrame(rows, "user string, group string, score double, label string")


def test_calibration(spark):
    rows = claims(spark)
    curve = {r["lambda"]: (r.n_selected, r.n_wrong) for r in calibration.risk_curve(rows).collect()}
    assert curve[0.0] == (100, 30) and curve[0.5] == (50, 0) and curve[1.0] == (0, 0)
    assert calibration.binomial_tail(1, 3, 0.5) == pytest.approx(0.5) and calibration.binomial_tail(0, 0, 0.1) == 1
    assert calibration.binomial_tail(40, 1000, 0.05) == pytest.approx(sum(math.comb(1000, k) * 0.05**k * 0.95 ** (1000 - k) for k in range(41)))
    got = {r.alpha: r for r in calibration.learn_then_test(rows, lambdas=tuple(x / 20 for x in range(15, -1, -1))).collect()}
    assert got[0.3].status == "pass" and 0 < got[0.3].lambda_hat <= 0.3 and got[0.3].p_value <= 0.1
    assert calibration.learn_then_test(rows).first().status == "fail"
    side = {r.user: r.in_calibration for r in calibration.split_by_user(rows, 0.45).select("user", "in_calibration").distinct().collect()}
    assert len(side) == 10 and sum(side.values()) == 5
    crc = calibration.conformal_risk(rows, alphas=(0.1,)).first()
    assert (crc.bound, crc.lambda_hat) == (5, 0.3)
    steps = calibration.adaptive_thresholds(spark.createDataFrame([("a", 0.95, "hallucinated"), ("a", 0.91, "grounded"), ("b", 0.91, "hallucinated"), ("b", 0.93, "grounded")], "period string, score double, label string")).collect()
    assert [(r.period, r["lambda"], r.err) for r in steps] == [("a", 0.9, 0.5), ("b", pytest.approx(0.92), 0.0)]
    assert calibration.manifest(rows, {"k": 1}).count() == 1


def test_evaluation(spark):
    rows = claims(spark)
    top = evaluation.at_threshold(rows, 2.0).first()
    assert (top.accepted, top.error) == (0, 0)
    sweep = {r.threshold: r for r in evaluation.threshold_sweep(rows).collect()}
    assert (sweep[0.3].tp, sweep[0.3].fp, sweep[0.3].fn, sweep[0.3].tn, sweep[0.3].null_scores) == (70, 0, 1, 30, 1)
    assert {(r.label, r.bin): r.n for r in evaluation.score_histogram(rows).collect()}[("grounded", 19)] == 5
    ranks = evaluation.ranks_of_wrong(rows.withColumn("cluster_id", F.concat(F.lit("c"), (F.col("score") * 100).cast("int"))), ["c10"]).first()
    assert ranks.above == 70


def test_wordings(spark):
    profile = evaluation.signal_profile(record(spark))
    p = profile.first()
    assert p.peer_sizes == [8] and p.true_exceedance and p.hidden_maxima == [3.0]
    said = spark.createDataFrame([(p.signal_id, 0, "It exceeds the recent maximum of 3, two standard deviations, 5 of 8 peers")], "signal_id string, sample_index int, text string")
    h = evaluation.wording_hits(said, profile).first()
    # a deviation counts with a digit only, and `of 8 peers` is the right way to put it
    assert (h.exceeds_max, h.sigma, h.peer_denominator, h.max_figure) == (1, 0, 0, 1)
    said = said.withColumn("text", F.lit("Above its usual peak of 3, by 2.5 standard deviations, z-score near 4, out of the 8, in the past 3 weeks, [R3] 2010-W03, not 13 or 3.5"))
    h = evaluation.wording_hits(said, profile).first()
    assert (h.exceeds_max, h.sigma, h.peer_denominator, h.max_figure) == (1, 2, 1, 1)
    named = record(spark).withColumn("identity", F.struct(F.lit("Clerk 3").alias("role"), F.lit("12 - X").alias("team")))
    assert evaluation.signal_profile(named).first().hidden_maxima == []


def test_rho_model(spark):
    rows = [(f"c{i}", i / 200, None if i % 5 == 0 else i / 200, i % 2 == 0, 0.0, int(i > 120)) for i in range(200)]
    gold = spark.createDataFrame(rows, "cluster_id string, self_consistency double, fact_match double, misweighted boolean, hallucinated_context double, target int")
    scored = rho.cross_validated(gold)
    assert scored.count() == 200 and rho.probability_figures(scored).first().auc > 0.95
    assert rho.recall_at(scored, (10, 500)).orderBy("k").first().found == 10
    assert {r["class"] for r in rho.confusion(scored).collect()} == {0, 1}


def test_judgement_tables(spark):
    keys = spark.createDataFrame([("k1", "entailment"), ("k2", "weighting")], "key_sha1 string, kind string")
    line = lambda k, t: '{"request_id":"%s","response":{"candidates":[{"content":{"parts":[{"text":%s}]}}]}}' % (k, t)  # noqa: E731, UP031
    lines = spark.createDataFrame([(line("k1", '"{\\"label\\":\\"odd\\"}"'),), (line("k2", '"{\\"misweighted\\":true}"'),), ("broken",), (line("k3", '"{}"'),)], "value string")
    got = {r.key_sha1: (r.label, r.misweighted) for r in judgements.read_responses(lines, keys).collect()}
    assert got == {"k1": ("neutral", None), "k2": (None, True)}
    stored = judgements.upsert(keys, spark.createDataFrame([("k1", "entailment")], keys.schema))
    assert stored.count() == 2
    assert judgements.chunk_of(spark.createDataFrame([(str(i),) for i in range(10)], "key_sha1 string"), 4).select("chunk").distinct().count() <= 3


def test_ranks_in_parts_are_those_of_the_whole(spark):
    rows = spark.range(3000).select(F.col("id"), (F.col("id") % 3 == 0).alias("g")).withColumn("k", sampling.shuffle_key(F.col("id"), 42))
    got = {(r.g, r["rank"]): r.id for r in sampling.ranked(rows, "g", "k", "id").collect()}
    for g in (True, False):
        want = [r.id for r in sorted((r for r in rows.filter(F.col("g") == g).collect()), key=lambda r: (r.k, r.id))]
        assert [got[(g, i + 1)] for i in range(len(want))] == want


def test_generation_summary(spark):
    asked = spark.createDataFrame([("a", True), ("b", True), ("c", False)], "signal_id string, is_malicious boolean")
    drafts = spark.createDataFrame([("a", 0), ("a", 1), ("c", 0)], "signal_id string, sample_index int")
    r = pooling.generation_summary(asked, drafts, spark.range(7)).first()
    assert tuple(r) == (3, 2, 1, 7)


def test_late_events_are_left_out_and_leave_no_state(spark, tmp_path):
    import os

    from plumbline.streaming import events as stream

    schema = "user_id long, ts timestamp, event_type string, value double"
    batches = (["2024-02-26 10:00:00", "2024-03-20 10:00:00"], ["2024-03-21 23:00:00"], ["2024-01-02 10:00:00", "2024-05-01 10:00:00"])  # a batch drops what the watermark before the last batch has passed
    for i, times in enumerate(batches):
        path = tmp_path / "in" / f"{i}.json"
        path.parent.mkdir(exist_ok=True)
        path.write_text("".join(f'{{"user_id": 1, "ts": "{t}", "event_type": "a", "value": 1.0}}\n' for t in times))
        os.utime(path, (1_700_000_000 + 100 * i,) * 2)
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    stream.run_to_end(stream.weekly_counts(source), str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    got = {str(r.week_start)[:10]: (r.events, r.after_hours_events) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {"2024-02-26": (1, 0), "2024-03-18": (2, 1)}  # the event of January came when its week was over; May's is still open


def test_number_index_equals_a_scan(spark):
    """Numbers near, between and beyond targets, against a plain scan of the ordered candidates."""
    import random

    rng = random.Random(5)
    some = lambda: rng.choice([None, 0.0, rng.uniform(-50, 50), float(rng.randint(-9, 9)), rng.uniform(0, 1e7)])
    kinds = "fact_id:string,display:string,self_center:double,never_before:boolean,peer_center:double,peer_group_size:int"
    rows = []
    for i in range(120):
        facts = [(f"F{j}", rng.choice([None, "x", "0", "1,200 MB", f"{rng.uniform(-20, 90):.2f} a"]), some(), rng.choice([None, True, False]), some(), rng.choice([None, 0, 7, 40])) for j in range(rng.randint(0, 6))]
        shown = [x for f in facts for x in (f[2], f[4], f[5]) if x is not None] or [1.0]
        near = [float(rng.choice(shown)) * rng.choice([1, 0.01, 100, 1e3, 1e-6]) * rng.choice([1, 1.01, 0.99, 1.0100001, 1.05, 0.95, 0.9499999, 1.2, -1]) for _ in range(12)]
        rows.append((i, None if i == 0 else facts, [*near, 0.0, 5e-10, -5e-10, 2e-9, 1e300]))
    df = spark.createDataFrame(rows, f"id int, facts array<struct<{kinds}>>, given array<double>").withColumn("text", F.lit(""))
    got = grounding.match_numbers(df, F.col("given")).select("id", "facts", "given", "matches", grounding.candidates(F.col("facts")).alias("c")).collect()
    seen = set()
    for r in got:
        for n, m in zip(r.given, r.matches):
            want = next((c for c in r.c or [] if (abs(n) < 1e-9 if c.target == 0 else abs(n - c.target) <= grounding.TARGETS[grounding.DETAILS[c.what]] * abs(c.target))), None)
            detail = want and grounding.DETAILS[want.what]
            assert (m.number, m.detail, m.fact_id) == (n, detail, want and r.facts[want.fact].fact_id)
            assert m.kind == {None: "unmatched", "value": "matched"}.get(detail, "derived")
            seen.add(detail)
    assert seen == {None, *grounding.DETAILS}
