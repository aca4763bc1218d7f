"""What the third review found: ties, odd texts, and steps that grew faster than their input."""

import statistics

import pyarrow as pa

from plumbline.functions import scalars as S
from plumbline.llm import near_dedup
from plumbline.operators import baselines, features, grounding, signals, similarity
from plumbline.plans import queries as q
from plumbline.sources import durable
from pyspark.sql import functions as F


def test_first_of_equal_maxima_makes_the_window(spark, tmp_path):
    rows = "(7L, timestamp '2024-01-05 10:00:00', 1L, 'view', 9.0D), (3L, timestamp '2024-01-02 10:00:00', 1L, 'purchase', 9.0D), (9L, timestamp '2024-01-09 10:00:00', 1L, 'purchase', 9.0D), (1L, timestamp '2024-01-01 10:00:00', 1L, 'view', 8.0D), (2L, timestamp '2024-01-01 10:00:00', 2L, 'purchase', NULL)"
    spark.sql(f"SELECT *, '' AS props FROM VALUES {rows} AS t(event_id, ts, user_id, event_type, value)").repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    found = q.QUERIES["a4_truth_windows"](spark, str(tmp_path)).collect()
    assert [tuple(r) for r in found] == [("U1", "2024-01-02 10:00:00", "2024-01-05 10:00:00", "s1")]


def test_abbreviation_right_after_another(spark):
    cut = lambda t: spark.range(1).select(S.sentences_in(F.lit(t))).first()[0]
    assert cut("de no. No. Ya. No. No. No. Ya") == ["de no. No.", "Ya.", "No. No.", "No. Ya"]
    assert cut("see no.  No. 7") == ["see no.  No. 7"]


def test_histories_do_not_end_at_batches():
    rows = [("a", f, p, None if p % 5 == 0 else float(p * (7 if f == "x" else 3) % 11)) for f in ("x", "y") for p in range(30)] + [(None, "x", p, 1.0) for p in range(3)]
    columns = [pa.array([r[i] for r in rows]) for i in range(4)]
    batch = pa.RecordBatch.from_arrays(columns, ["user", "feature", "period", "value"])
    for size in (1, 7, 63):
        out = pa.Table.from_batches(baselines.past_figures([batch.slice(i, size) for i in range(0, len(batch), size)], 12)).to_pylist()
        for i, (r, o) in enumerate(zip(rows, out)):
            past = [v for u, f, _, v in rows[max(0, i - 12) : i] if (u, f) == r[:2] and v is not None]
            middle = statistics.median(past) if past else None
            want = (len(past), middle, statistics.median(abs(v - middle) for v in past) if past else None, max(past, default=None))
            assert (o["_size"], o["_middle"], o["_apart"], o["_top"]) == want


def test_logs_meet_in_one_shuffle(spark, data):
    wide = q.QUERIES["c_raw_features"](spark, data)
    assert "SortMergeJoin" not in wide._jdf.queryExecution().toString() and " Join FullOuter" not in wide._jdf.queryExecution().toString()


def test_rows_without_user_meet_no_others(spark):
    parts = [spark.sql(f"SELECT cast(null AS string) AS user, '1' AS period, * FROM (SELECT {cols})") for cols in (", ".join(f"1L AS {c}" for c in some) for some in (features.FEATURES[:8], features.FEATURES[8:]))]
    assert features.joined(parts).count() == 2


def test_main_clause_makes_no_array_of_characters(spark):
    plan = spark.range(1).select(S.main_clause(F.concat(F.lit("While a (x, y), "), F.col("id").cast("string"))))._jdf.queryExecution().toString()
    assert ", , -1)" not in plan  # split at every character
    cut = lambda t: spark.range(1).select(S.main_clause(F.lit(t)), S.sub_clause(F.lit(t))).first()
    assert tuple(cut("While a (x, y), it\nfell, twice")) == ("it\nfell, twice", "While a (x, y)")
    assert tuple(cut("While 😀 (x, y), it fell")) == ("it fell", "While 😀 (x, y)")
    for t in ("While a (x, y, it fell", "While it fell,", "It fell, twice"):
        assert tuple(cut(t)) == (t, "")


def test_tiny_partitions_are_read_together(spark):
    """The pipeline on check_h: a few rows in 211 partitions made 211 tasks and their files in every shuffle that followed."""
    few = durable.gathered(spark.range(500).repartition(211, "id"))
    assert few.rdd.getNumPartitions() == 1 and sorted(r.id for r in few.collect()) == list(range(500))
    assert durable.gathered(spark.range(9000, numPartitions=4)).rdd.getNumPartitions() == 4
    assert durable.gathered(spark.range(0).repartition(211, "id")).count() == 0


def test_components_of_many_partitions(spark):
    """Rounds of components hold as many partitions as their edges need, and find the same groups."""
    links = spark.range(1, 400, numPartitions=211).selectExpr("id AS a", "CASE WHEN id % 10 = 0 THEN id ELSE id - 1 END AS b")
    found = near_dedup.components(links)
    assert found.rdd.getNumPartitions() <= 4
    assert {(r.id, r.root) for r in found.collect()} == {(i, i - i % 10) for i in range(400)}


def test_cosines_in_blocks(spark, monkeypatch):
    """b14_cosine: blocks of vectors give what the expression gives pair by pair, bit by bit, odd vectors included."""
    monkeypatch.setattr(similarity, "BLOCK", (3, 7))
    monkeypatch.setattr(similarity, "TILE", (2, 3))
    vector = "transform(sequence(1, 5), k -> cast(sin(id * 7 + k) as float))"
    odd = f"CASE WHEN id = 4 THEN NULL WHEN id = 8 THEN array(cast(0 as float), 0, 0, 0, 0) WHEN id = 12 THEN array(cast(1 as float), NULL, 1, 1, 1) WHEN id = 16 THEN array(cast(1 as float), 2) WHEN id = 20 THEN array(cast(1 as float), 2, 2) WHEN id = 21 THEN array(cast(3 as float), 4, 1) WHEN id = 24 THEN array(cast('NaN' as float), 1, 1, 1, 1) WHEN id = 28 THEN array() ELSE {vector} END"
    rows = spark.range(60).selectExpr("id", "CASE WHEN id = 11 THEN NULL WHEN id % 20 = 19 THEN 9 ELSE id % 2 END AS group", f"{odd} AS vector")
    found = similarity.cosines(rows.filter("id % 4 = 0"), rows)
    left, right = rows.filter("id % 4 = 0").toDF("a", "group", "x"), rows.toDF("b", "group", "y")
    plain = left.join(right, "group").filter("a <> b").select("a", "b", S.cosine(F.col("x"), F.col("y")).alias("cosine"))
    as_set = lambda df: sorted((r.a, r.b, repr(r.cosine)) for r in df.collect())
    assert as_set(found) == as_set(plain)
    assert found.rdd.getNumPartitions() > 1
    assert similarity.cosines(rows.filter("id < 0"), rows).count() == 0


def test_wide_stats_are_those_of_long_rows(spark, monkeypatch):
    """g1_facts and all on the rule step: a row a period finds what a row a feature finds, null values, empty groups and small batches included."""
    monkeypatch.setattr(baselines, "BROADCAST_ROWS", 4)
    names = ("total_logons", "attachment_bytes", "distinct_pcs")
    made = ("CASE WHEN id % 11 = 0 THEN NULL ELSE id * 37 % 5 END AS total_logons", "CASE WHEN id % 3 = 0 THEN id * 7919 % 1000 ELSE 0 END AS attachment_bytes", "0L AS distinct_pcs")
    wide = durable.durable(spark.range(400).selectExpr("concat('U', id % 9) AS user", "format_string('%03d', id DIV 9) AS period", "CASE WHEN id % 9 = 8 THEN NULL ELSE id % 9 % 2 END AS role", *made))
    config = baselines.BaselineConfig(min_peers=4)
    found = signals.baselined_maps(wide, names, config)
    assert "collect_list" not in found._jdf.queryExecution().toString()  # a row is not taken apart and put together again
    long = wide.select("user", "period", "role", *[F.col(c).cast("double").alias(c) for c in names]).unpivot(["user", "period", "role"], list(names), "feature", "value")
    want = signals.stat_maps(baselines.baselines(long, config))
    flat = lambda maps: sorted((r.user, r.period, f, tuple(s)) for r in maps.collect() for f, s in r.stats.items())
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = flat(found)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert repr(got) == repr(flat(want)) and len(got) > 1000
    assert signals.baselined_maps(wide.limit(0), names, config).count() == 0


def test_facts_are_worked_out_once(spark, data):
    """g1_facts: the optimizer asks whether there are facts before it takes them apart, which made them twice."""
    assert q.QUERIES["g1_facts"](spark, data)._jdf.queryExecution().optimizedPlan().toString().count("F%03d") == 1


def test_pairs_are_shuffled_without_their_texts(spark):
    """j2_stored_judgements: pairs meet judgements by a key of 16 bytes; a judgement counts before the overlap, pairs with a null text not at all."""
    said = spark.createDataFrame([("x", 0, "a b"), ("x", 1, "a b"), ("x", 2, "c"), ("x", 3, None)], "signal_id string, sample_index int, text string")
    claims = said.select("signal_id", F.format_string("s%d", "sample_index").alias("sentence_id"), "text")
    told = spark.createDataFrame([("c", "a b", "entailment"), ("a b", "a b", "neutral")], "premise string, hypothesis string, label string")
    for judgements in (told, told.select(grounding.pair_key().alias("pair_key"), "label"), None):
        for tokens in (True, False):
            found = grounding.judged(grounding.claim_pairs(claims, said, tokens=tokens), judgements)
            assert not {"premise", "hypothesis"} & set(found.columns)
            same = judgements is None
            want = {(f"s{i}", j): same if i < 2 and j < 2 else i == 2 and j == 2 or i < 2 and j == 2 and not same for i in range(3) for j in range(3)}
            assert {(r.sentence_id, r.sample_index): r.entailed for r in found.collect()} == want


def test_clauses_and_numbers_are_found_once(spark):
    """j13_score_claims: a claim's clause was cut out for each word of each fact, a fact's numbers read for each of its pairs."""
    fact = "named_struct('fact_id', 'F001', 'gloss', 'total logons', 'display', '12', 'triggering_rule_ids', array('R1'), 'never_before', false, 'self_center', 2.0D, 'peer_center', 3.0D, 'peer_group_size', 5)"
    rows = spark.range(1).selectExpr("'x' AS t", f"array({fact}) AS facts")
    plan = lambda c: rows.select(c)._jdf.queryExecution().analyzed().toString()
    assert plan(grounding.misweighted_fact(F.upper("t"), F.col("facts"))).count("upper(") == plan(S.main_clause(F.upper("t"))).count("upper(")
    assert plan(grounding.number_index(F.col("facts"))).count("regexp_extract(") == plan(grounding.leading_number(F.col("t"))).count("regexp_extract(")


def test_wide_stats_where_groups_are_broadcast(spark):
    """m8_signal_profile, n1_generation_requests and all on the rule step: a join after the sort must not undo it; rows come in no order, some without a group."""
    names = ("total_logons", "attachment_bytes", "distinct_pcs")
    made = ("CASE WHEN id % 11 = 0 THEN NULL WHEN id % 4 > 0 THEN 0 ELSE id * 37 % 5 END AS total_logons", "CASE WHEN id % 3 = 0 THEN id * 7919 % 1000 ELSE 0 END AS attachment_bytes", "0L AS distinct_pcs")
    wide = spark.range(600).orderBy(F.xxhash64("id")).selectExpr("concat('U', id % 9) AS user", "format_string('%03d', id DIV 9) AS period", "CASE WHEN id % 9 = 8 OR id % 50 = 0 THEN NULL ELSE id % 9 % 2 END AS role", *made)
    wide, config = durable.durable_columns(wide), baselines.BaselineConfig(min_peers=4)
    found = signals.baselined_maps(wide, names, config)
    assert not {"map_from_arrays", "explode", "namedlambdavariable"} & set(found._jdf.queryExecution().optimizedPlan().toString().replace("(", " ").split())
    long = wide.select("user", "period", "role", *[F.col(c).cast("double").alias(c) for c in names]).unpivot(["user", "period", "role"], list(names), "feature", "value")
    flat = lambda maps: sorted((r.user, r.period, f, tuple(s)) for r in maps.collect() for f, s in r.stats.items())
    got = flat(found)
    assert repr(got) == repr(flat(signals.stat_maps(baselines.baselines(long, config)))) and len(got) > 1000


def test_zeros_are_counted_from_the_rest(spark):
    """m8_signal_profile, n1_generation_requests: zeros were counted one by one; they are what the other values leave, null groups and null values included."""
    rows = spark.range(300).selectExpr("CASE WHEN id % 5 = 0 THEN NULL ELSE id % 5 END AS role", "CASE WHEN id % 7 = 0 THEN NULL ELSE id % 3 END AS period", "CASE WHEN id % 4 = 0 THEN NULL WHEN id % 4 = 1 THEN 2.0D ELSE 0.0D END AS a", "0.0D AS b", "1.0D + id % 2 AS c", "CASE WHEN id % 2 = 0 THEN double('NaN') ELSE -0.0D END AS d")
    keys = ["feature", "role", "period"]
    plain = baselines.value_counts(rows.select("role", "period", F.posexplode(F.array("a", "b", "c", "d")).alias("feature", "value")), keys)
    as_rows = lambda df: sorted(repr(tuple(r)) for r in df.select(*keys, "value", "_n").collect())
    assert as_rows(baselines._sparse_counts(rows, ("a", "b", "c", "d"), ["role", "period"])) == as_rows(plain)
    assert baselines._sparse_counts(rows.limit(0), ("a", "b", "c", "d"), ["role", "period"]).count() == 0


def test_a_field_is_looked_up_once_a_fact(spark):
    """m8_signal_profile, n1_generation_requests: each part of a fact looked its field up in the map again."""
    stats = f"map('total_logons', named_struct({', '.join(repr(m) + ', ' + ('false' if m == 'self_first' else '5' if m == 'peer_n' else '2.0D') for m in signals.MEASURES)}))"
    flagged = spark.range(1).selectExpr("'U1' AS user", "'p' AS period", f"{stats} AS stats", "array(named_struct('rule_id', 'R5', 'fields', array('total_logons'))) AS evidence", "array('R5') AS triggered")
    made = signals.facts(flagged)
    assert made._jdf.queryExecution().optimizedPlan().toString().count("element_at(stats") <= 1
    assert [(f.fact_id, f.field, f.value, f.display) for f in made.first().facts] == [("F001", "total_logons", 2.0, "2")]
