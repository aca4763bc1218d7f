"""The stages of the corpus pipeline, each against brute force on what the stage before it kept."""

import random

import corpus_pipeline
from plumbline.llm import queries
from tests.llm.test_operators import DOCUMENTS, brute_groups, brute_leaks, brute_repeats, near_copy, words


def test_stages(spark, tmp_path):
    rng = random.Random(8)
    passage = words(rng, 60)
    items = [(i, words(rng, 25)) for i in range(4)]
    texts = [words(rng, 100) for _ in range(60)]
    texts += [texts[0], near_copy(rng, texts[1], 0.01), "too short", None, words(rng, 80).upper().replace(" ", "###  ")]
    texts += [f"{words(rng, 60)} {passage}" for _ in range(4)] + [f"{words(rng, 60)} {items[k][1]} {words(rng, 10)}" for k in range(4)]
    rows = [(i, t, "en", "a", len(t or "")) for i, t in enumerate(texts)]
    sf = str(tmp_path / "sf")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    docs, kept = spark.read.parquet(f"{sf}/documents.parquet"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(f"{sf}/{k}")
        docs = spark.read.parquet(f"{sf}/{k}")
        kept[k] = docs
        if k < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    read = lambda k: [(r.doc_id, r.text) for r in kept[k].collect()]
    assert {d for d, _ in read(0)} == set(range(len(rows))) - {62, 63, 64}
    assert {d for d, _ in read(1)} == {d for d, (_, c) in brute_groups(read(0), 80).items() if d == c}
    removed = {d: n for (d, _, n, _, _), _ in brute_repeats(read(1)).items()}
    before = dict(read(1))
    assert all(len(before[d].encode()) - len(t.encode()) == removed[d] for d, t in read(2))
    assert sum(n > 0 for n in removed.values()) >= 3
    leaking = {d for d, _ in brute_leaks(read(2), items)}
    assert {d for d, _ in read(3)} == {d for d, _ in read(2)} - leaking and len(leaking) == 4
    assert {r.doc_id for r in kept[4].collect()} == {d for d, _ in read(3)}
    assert corpus_pipeline.run(spark, sf).count() == kept[4].count()
    assert DOCUMENTS.startswith("doc_id")


def test_near_duplicates_link_at_four_fifths(spark):
    rng = random.Random(12)
    rows, shares = [], []
    shingles = lambda t: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)}
    for k in range(40):
        first = words(rng, 200)
        own = rng.randint(12, 25)  # words at the end that differ
        second = " ".join(first.split()[: 200 - own]) + " " + words(rng, own)
        rows += [(2 * k, first), (2 * k + 1, second)]
        x, y = shingles(first), shingles(second)
        shares.append(100 * len(x & y) / len(x | y))
    want = {d for d, _ in rows} - {2 * k + 1 for k, s in enumerate(shares) if s >= 80}
    assert sum(81 <= s <= 84 for s in shares) >= 3 and min(shares) < 80
    df = spark.createDataFrame([(d, t, "en", "a", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, df, "").collect()} == want


EXTRA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, _id string, number int, key string"


def test_null_and_repeated_ids_and_clashing_columns(spark, tmp_path):
    rng = random.Random(13)
    fine = [words(rng, 80) for _ in range(6)]
    junk = [" ".join(["ka lo mi"] * 30) for _ in range(2)]  # as many words, rejected
    rows = [(None, fine[0]), (None, junk[0]), (None, None), (7, fine[1]), (7, fine[2]), (7, junk[1]), (7, fine[1]), (8, fine[2]), (9, fine[3]), (9, fine[4])]
    sf = str(tmp_path / "sf")
    spark.createDataFrame([(d, t, "en", None, 1, True, "x", 3, "k") for d, t in rows], EXTRA).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(1, fine[4])], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    docs, got = spark.read.parquet(f"{sf}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        stage(spark, docs, sf).write.parquet(f"{sf}/{k}")
        docs = spark.read.parquet(f"{sf}/{k}")
        assert docs.columns == [x.split()[0] for x in EXTRA.split(", ")]
        got.append(sorted(((r.doc_id, r.text) for r in docs.collect()), key=str))
    ordered = lambda x: sorted(x, key=str)
    assert got[0] == ordered([(None, fine[0]), (7, fine[1]), (7, fine[2]), (7, fine[1]), (8, fine[2]), (9, fine[3]), (9, fine[4])])
    assert got[1] == got[2] == ordered([(None, fine[0]), (7, fine[1]), (7, fine[2]), (9, fine[3]), (9, fine[4])])
    assert got[3] == ordered([(None, fine[0]), (7, fine[1]), (7, fine[2]), (9, fine[3])])
    assert corpus_pipeline.run(spark, sf).count() == 4


def test_empty_tables(spark, tmp_path):
    sf = str(tmp_path / "sf")
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    assert corpus_pipeline.run(spark, sf).count() == 0


def test_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
    assert set(queries.ORACLES) <= set(queries.QUERIES)
