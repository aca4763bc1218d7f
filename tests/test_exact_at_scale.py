"""Operators that work in rounds or over several triggers: the same as plain code, however rows are dealt."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from plumbline.operators import baselines, calibration, selection
from plumbline.streaming import events as stream


def test_medians_of_a_million_distinct_values(spark, monkeypatch):
    million = spark.range(1_000_001).select(F.lit("all").alias("feature"), (F.pow(F.col("id"), 3) * F.when(F.col("id") % 2 == 0, 1.0).otherwise(-1.0)).alias("value"))
    got = baselines.middle_and_deviation(million, ["feature"]).first()
    values = [float(i) ** 3 * (1 if i % 2 == 0 else -1) for i in range(1_000_001)]
    m = statistics.median(values)
    assert (got["_m"], got["_n"]) == (m, 1_000_001) and got["_mad"] == statistics.median([abs(v - m) for v in values])


@pytest.mark.parametrize("cells", [10_000, 7, 2])
def test_medians_in_rounds(spark, monkeypatch, cells):
    monkeypatch.setattr(selection, "CELLS", cells)
    monkeypatch.setattr(selection, "PIVOTS", 4)
    rng = random.Random(cells)
    rows = [("hot", "a", rng.choice([0.0, 1.0, rng.gauss(0, 1e6), 2.0**rng.randint(-300, 300)])) for _ in range(900)]
    rows += [("even", "a", float(i)) for i in range(100)] + [("one", None, 3.5), ("ties", "b", 1.0)] + [("ties", "b", 2.0)] * 50 + [("nulls", "b", None)] * 3 + [("some", "b", None), ("some", "b", 4.0), ("some", "b", 5.0)]
    counts = selection.durable(baselines.value_counts(spark.createDataFrame(rows, "k string, j string, value double"), ["k", "j"]))
    want = {}
    for k, j, v in rows:
        want.setdefault((k, j), []).extend([v] if v is not None else [])
    assert {(r.k, r.j): r.median for r in selection.medians(counts, ["k", "j"]).collect()} == {k: statistics.median(v) if v else None for k, v in want.items()}


def test_running_sums(spark):
    rng = random.Random(2)
    rows = [(v, rng.randint(0, 3), rng.randint(0, 3)) for v in {rng.gauss(0, 1) for _ in range(3000)}]
    got = {r.value: (r.a_below, r.b_below) for r in selection.running_sums(selection.durable(spark.createDataFrame(rows, "value double, a long, b long")), ["a", "b"]).collect()}
    a = b = 0
    for v, x, y in sorted(rows):
        assert got[v] == (a, b)
        a, b = a + x, b + y


def plain_thresholds(rows, start=0.90):
    lam, out = start, []
    for period in sorted({p for p, s, _ in rows if s is not None and p not in (None, "Unknown")}):
        taken = [label for p, s, label in rows if p == period and s is not None and s >= lam]
        err = sum(x in calibration.POLICIES["primary"] for x in taken) / max(len(taken), 1)
        out.append((period, lam, err))
        lam = max(0.0, min(1.0, lam + 0.05 * (err - 0.10)))
    return out


def claims(n=4000, periods=25):
    rng = random.Random(9)
    score = lambda: rng.choice([rng.random(), 0.9, 0.895, 0.92, 1.0, 0.9 + rng.random() * 1e-9, 0.89 + rng.random() / 50, 1.5, -0.5])
    rows = [(f"2010-W{rng.randrange(periods):02d}", score(), rng.choice(["grounded", "grounded", "hallucinated", "misweighted", None])) for _ in range(n)]
    return rows + [("2010-W03", None, "hallucinated"), (None, 0.95, "hallucinated"), ("Unknown", 0.99, "hallucinated"), ("2010-W99", None, "grounded"), ("2010-W70", -2.0, "hallucinated")]


@pytest.mark.parametrize("split", [64, 2])
def test_thresholds_are_exact(spark, monkeypatch, split):
    monkeypatch.setattr(calibration, "SPLIT", split)
    rows = claims(4000 if split == 64 else 400)
    got = calibration.adaptive_thresholds(spark.createDataFrame(rows, "period string, score double, label string").repartition(5))
    assert [tuple(r) for r in got.orderBy("period").collect()] == plain_thresholds(rows)
    assert calibration.adaptive_thresholds(spark.createDataFrame([], "period string, score double, label string")).count() == 0


STREAM = "stream_id string, period string, closes timestamp, score double, label string"


def closes_of(period):
    return F.timestamp_add("WEEK", F.substring(period, -2, 2).cast("int"), F.lit("2010-01-04").cast("timestamp"))


@pytest.mark.parametrize("files, restart", [(1, False), (4, False), (4, True)])
def test_threshold_of_a_stream_over_several_triggers(spark, tmp_path, files, restart):
    rows = [("s", p, s, label) for p, s, label in claims(600) if p not in (None, "Unknown")] + [("t", f"2010-W{i:02d}", 0.95, "hallucinated") for i in range(4)]
    random.Random(1).shuffle(rows)
    made = spark.createDataFrame(rows, "stream_id string, period string, score double, label string").withColumn("closes", closes_of(F.col("period"))).select("stream_id", "period", "closes", "score", "label")
    end = spark.createDataFrame([("", "end", None, None)], "stream_id string, period string, score double, label string").withColumn("closes", F.lit("2040-01-01").cast("timestamp"))
    parts = [made.filter(F.pmod(F.hash("period", "score", "label"), F.lit(files)) == i) for i in range(files)]
    parts[-1] = parts[-1].unionByName(end.select(*made.columns))

    def run():
        source = spark.readStream.schema(STREAM).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        stream.run_to_end(stream.adaptive_threshold(source, late="5000 days"), str(tmp_path / "out"), str(tmp_path / "checkpoint"))

    for i, p in enumerate(parts):
        p.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        if restart and i == 1:
            run()  # stops with the first two files read; the next call goes on from the checkpoint
    run()
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    want = [(k, *r) for k in "st" for r in plain_thresholds([(p, s, label) for i, p, s, label in rows if i == k])]
    assert got == want


def test_late_rows_do_not_reopen_a_period(spark, tmp_path):
    def row(period, score, label):
        return ("s", period, score, label)

    first, second, third = [row("2010-W01", 0.95, "hallucinated")], [row("2010-W09", 0.95, "grounded")], [row("2010-W01", 0.99, "hallucinated"), row("2010-W40", None, None)]
    for i, rows in enumerate((first, second, third)):
        spark.createDataFrame(rows, "stream_id string, period string, score double, label string").withColumn("closes", closes_of(F.col("period"))).select("stream_id", "period", "closes", "score", "label").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        source = spark.readStream.schema(STREAM).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        stream.run_to_end(stream.adaptive_threshold(source, late="7 days"), str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    assert sorted((r.period, round(r["lambda"], 6), r.err) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [("2010-W01", 0.9, 1.0), ("2010-W09", 0.945, 0.0)]


# ---------------------------------------------------------------- models and figures


def gold_rows(n=300):
    rng = random.Random(4)
    rows = []
    for i in range(n):
        y = int(rng.random() < 0.3)
        rows.append((f"c{i}", min(1.0, max(0.0, rng.gauss(0.4 + 0.3 * y, 0.2))), None if i % 5 == 0 else round(rng.random() * (0.5 + y / 2), 2), rng.random() < 0.4 - 0.3 * y, float(rng.random() < 0.2), y))
    return rows


GOLD = "cluster_id string, self_consistency double, fact_match double, misweighted boolean, hallucinated_context double, target int"


def test_fit_equals_newton_and_outlives_its_session(spark, tmp_path):
    import numpy as np

    from plumbline.operators import rho

    rows = gold_rows()
    gold = spark.createDataFrame(rows, GOLD).repartition(3)
    x = np.array([[s, s if f is None else f, float(m), h, 1.0] for _, s, f, m, h, _ in rows])
    y = np.array([r[-1] for r in rows], float)
    weight = np.where(y == 1, len(y) / 2 / y.sum(), len(y) / 2 / (1 - y).sum())
    w, ridge = np.zeros(5), np.diag([1.0, 1.0, 1.0, 1.0, 0.0])  # C = 1: half of the squared weights, the intercept free
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ w))
        w -= np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (weight * (p - y)) + ridge @ w)
    model = rho.train(gold)
    assert np.abs(np.array([*model.weights, model.intercept]) - w).max() < 1e-6

    rho.save_model(spark, model, str(tmp_path / "model"))
    loaded = rho.load_model(spark.newSession(), str(tmp_path / "model"), policy="primary")
    assert loaded == model and loaded.n_rows == 300
    other = rho.train(gold.withColumn("target", F.col("target") + F.when(F.col("cluster_id") == "c7", 0).otherwise(0)))
    assert other.fingerprint == model.fingerprint != rho.train(gold.filter("cluster_id <> 'c7'")).fingerprint
    scored = {r.cluster_id: r.rho for r in rho.predict(loaded, gold).collect()}
    p = 1 / (1 + np.exp(-x @ w))
    assert all(abs(scored[r[0]] - q) < 1e-6 for r, q in zip(rows, p))
    with pytest.raises(ValueError):
        rho.load_model(spark, str(tmp_path / "model"), policy="secondary")
    with pytest.raises(ValueError):
        rho.predict(loaded, gold, ("fact_match", "self_consistency"))


def test_figures_are_exact(spark):
    from plumbline.operators import rho

    rng = random.Random(6)
    rows = [(rng.choice([rng.random(), 0.5, 0.25]), int(rng.random() < 0.4), i % 3) for i in range(600)]
    df = spark.createDataFrame(rows, "rho double, target int, fold int")

    def plain(rs):
        pos, neg = [s for s, y, _ in rs if y], [s for s, y, _ in rs if not y]
        auc = sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg))
        return auc, sum((s - y) ** 2 for s, y, _ in rs) / len(rs), sum(abs((s >= 0.5) - y) for s, y, _ in rs) / len(rs)

    assert tuple(rho.probability_figures(df).first()) == pytest.approx(plain(rows), abs=1e-12)
    folds = list(zip(*[plain([r for r in rows if r[2] == k]) for k in range(3)]))
    want = [f(v) for v in folds for f in (statistics.mean, statistics.pstdev)]
    assert tuple(rho.fold_figures(df).first()) == pytest.approx(want, abs=1e-12)
    assert rho.probability_figures(df.filter("target = 1")).first().auc is None


# ---------------------------------------------------------------- outputs


def test_a_failing_job_leaves_the_output_as_it_was(spark, tmp_path):
    from plumbline.sources import sinks

    at = str(tmp_path / "out")
    sinks.write_records(spark.range(5), at, "parquet")

    @F.udf("long")
    def failing(i):
        if i == 90:
            raise ValueError("half-way")
        return i

    with pytest.raises(Exception, match="half-way"):
        sinks.write_records(spark.range(100).repartition(4).select(failing("id").alias("id")), at, "parquet")
    assert spark.read.parquet(sinks.current(spark, at)).count() == 5
    with pytest.raises(ValueError):
        sinks.write_records(spark.range(0), at, "parquet")
    assert spark.read.parquet(sinks.current(spark, at)).count() == 5

    ran = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def counted(i):
        ran.add(1)
        return i

    sinks.write_records(spark.range(7).select(counted("id").alias("id")), at, "parquet")
    assert ran.value == 7 and spark.read.parquet(sinks.current(spark, at)).count() == 7  # the plan ran once
    assert sinks.drop_old_versions(spark, at) == 2 and spark.read.parquet(sinks.current(spark, at)).count() == 7


# ---------------------------------------------------------------- features in several runs


def log_rows(days):
    rng = random.Random(8)
    rows = []
    for d in days:
        for u in range(4):
            for k in range(30):
                rows.append((f"U{u}", f"2010-01-{d:02d} {rng.randrange(24):02d}:10:00", rng.choice(["Logon", "Logoff", "Connect", "Send", "View"]), f"PC{rng.randrange(400)}", f"f{rng.randrange(900)}.x{k % 3}", rng.choice(["a@dtaa.com", "b@x.org;c@y.org", None]), rng.choice(["True", "False", None]), rng.choice(["p(12);q.doc(30)", None, ""]), rng.choice(["http://www.indeed.com/a", f"http://h{rng.randrange(50)}.org", None])))
    return rows


LOG = "user string, at string, activity string, pc string, filename string, to string, to_removable_media string, attachments string, url string"


def test_features_of_six_days_in_two_runs(spark, tmp_path, monkeypatch):
    from plumbline.operators import features, incremental

    def logs_of(days, path):
        spark.createDataFrame(log_rows(days), LOG).write.parquet(path)
        events = features.prepare(spark.read.parquet(path).withColumn("ts", F.col("at").cast("timestamp")).withColumns({"cc": F.col("to"), "bcc": F.lit(None).cast("string")}))
        return {log: events for log in features.LOGS}

    store = str(tmp_path / "store")
    early, late = logs_of(range(3, 8), str(tmp_path / "early")), logs_of([8], str(tmp_path / "late"))
    whole = {log: early[log].unionByName(late[log]) for log in features.LOGS}
    want = sorted(map(tuple, features.raw_features(*whole.values()).collect()))
    incremental.add_chunk(early, store, "days-1-5")
    import shutil

    shutil.rmtree(tmp_path / "early")  # they are not read again
    for _ in range(2):  # a repeated run replaces its own rows
        incremental.add_chunk(late, store, "day-6")
    assert incremental.has_chunk(spark, store, "day-6") and not incremental.has_chunk(spark, store, "day-7")
    assert sorted(map(tuple, incremental.features_of(spark, store, ["days-1-5", "day-6"]).collect())) == want
    assert max(r[2 + features.FEATURES.index("distinct_files")] for r in want) > 100


def test_capped_sets_stay_exact(spark):
    from plumbline.operators import features, incremental

    parts = [[f"f{i}" for i in range(k * 4, k * 4 + 6)] for k in range(5)]  # 22 in all, 6 a chunk
    frames = [features.prepare(spark.createDataFrame([("U", "2010-01-04 10:00:00", f, None) for f in p], "user string, ts string, filename string, to_removable_media string").withColumn("ts", F.col("ts").cast("timestamp"))) for p in parts]
    for cap, want in ((500, 22), (22, 22), (21, 21), (7, 7), (3, 3)):
        rows = [incremental.partials(f, "file", cap) for f in frames]
        whole = rows[0]
        for r in rows[1:]:
            whole = whole.unionByName(r)
        assert all(len(r.distinct_files) <= cap for r in whole.collect())
        assert incremental.merged(whole, "file", cap).first().distinct_files == want


# ---------------------------------------------------------------- pooling of large signals


@pytest.mark.parametrize("threshold", [0.2, 0.6, 0.97])
def test_blocks_give_the_clusters_of_one_pass(spark, monkeypatch, threshold):
    import numpy as np

    from plumbline.operators import pooling

    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 6))
    vectors = centres[rng.integers(0, 12, 260)] + rng.normal(size=(260, 6)) * 0.25
    vectors[20] = vectors[250] = 0
    vectors[100:110] = vectors[3]
    rows = [("large", int(i * 3), v.tolist()) for i, v in enumerate(vectors)] + [("small", i, v.tolist()) for i, v in enumerate(vectors[:30])]
    units = spark.createDataFrame(rows, "signal_id string, ord long, vector array<double>").repartition(4)
    want = {("large", i * 3): int(c) for i, c in enumerate(pooling.greedy_clusters(vectors, threshold))} | {("small", i): int(c) for i, c in enumerate(pooling.greedy_clusters(vectors[:30], threshold))}
    for name, value in (("BLOCK", 60), ("CHUNK", 5), ("PART", 16), ("BATCH", 4)):
        monkeypatch.setattr(pooling, name, value)
    got = {(r.signal_id, r.ord): r.cluster for r in pooling.pool_semantic(units, threshold).collect()}
    assert got == want and 1 < len(set(want.values())) < 290


def test_a_pivot_index_loses_nothing():
    import numpy as np

    from plumbline.operators import pooling

    rng = np.random.default_rng(7)
    heads, rows = pooling._units(rng.normal(size=(900, 8)) ** 3), pooling._units(rng.normal(size=(300, 8)) ** 3)
    index, cosines = pooling.PivotIndex(heads, 0.95), rows @ heads.T
    for i, (at, _) in enumerate(index.best(rows, 0.95)):
        assert at == (int(cosines[i].argmax()) if cosines[i].max() >= 0.95 else -1)
    assert np.mean([len(index.near(rows[i : i + 1])) for i in range(300)]) < 0.3 * len(heads)  # most are left out without a cosine
