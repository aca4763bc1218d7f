"""What a document and an item give depends on these two alone, and comes from fingerprints; urls against plain rules; null ids."""

import random
from collections import Counter

import duckdb
from pyspark.sql import functions as F

from plumbline.llm import decontaminate, quality_classifier, url_filter
from tests.llm.test_operators import words


def leaks(spark, docs, items):
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    return Counter((r.doc_id, r.item_id, r.start_word, r.n_words, round(r.similarity, 9)) for r in decontaminate.find_leaks(df, bench).collect())


def by_sql(docs, items):
    c = duckdb.connect()
    for name, key, rows in (("documents", "doc_id", docs), ("benchmark", "item_id", items)):
        c.execute(f"CREATE TABLE {name} ({key} BIGINT, text VARCHAR)")
        c.executemany(f"INSERT INTO {name} VALUES (?, ?)", rows)
    return Counter((d, i, s, n, round(x, 9)) for d, i, s, n, x in c.execute(decontaminate.OP6_SQL).fetchall())


def test_other_items_change_nothing(spark):
    rng = random.Random(12)
    tail = words(rng, 40)
    items = [(1, f"x {tail}"), (2, f"y {tail}"), (3, f"x {tail} z"), (4, tail)]
    docs = [(10, f"one two three four five six x {tail} seven"), (11, f"{tail}"), (12, f"y {tail} {words(rng, 9)} x {tail} z"), (13, f"{words(rng, 60)} {tail}")]
    got = leaks(spark, docs, items)
    assert got == by_sql(docs, items) and len(got) >= 12
    alone = sum((leaks(spark, docs, [i]) for i in items), Counter())
    assert got == alone and leaks(spark, docs, items[1:2])[10, 2, 7, 41, round(36 / 38, 9)] == 1


def near_threshold(rng, n):
    """Items and documents that hold a changed copy of similarity 0.80 to 0.85."""
    items, docs = [], []
    while len(items) < n:
        item = words(rng, rng.randint(25, 60)).split()
        copy = list(item)
        for p in rng.sample(range(1, len(item)), rng.randint(1, 2)):
            copy[p] = "own"
        a, b = (Counter(tuple(x[i : i + 5]) for i in range(len(x) - 4)) for x in (item, copy))
        shared = sum((a & b).values())
        if 0.80 <= shared / (2 * (len(item) - 4) - shared) <= 0.85:
            docs.append((len(items), f"{words(rng, 15)} {' '.join(copy)} {words(rng, 15)}"))
            items.append((len(items), " ".join(item)))
    return docs, items


def test_fingerprints_are_where_candidates_come_from(spark, monkeypatch):
    docs, items = near_threshold(random.Random(3), 120)
    docs += [(1000 + i, f"{words(random.Random(i), 8)} {items[i][1]} end") for i in range(40)]
    whole = leaks(spark, docs, items)
    assert whole == by_sql(docs, items) and len(whole) >= 160
    empty = spark.createDataFrame([], "window long, item long")
    with monkeypatch.context() as m:
        m.setattr(decontaminate, "near_pairs", lambda windows, prints: empty)
        left = leaks(spark, docs, items)
    assert len(left) < 0.05 * len(whole)  # what blocks miss is all that the rescue adds
    with monkeypatch.context() as m:
        m.setattr(decontaminate, "meets", lambda a, b: F.lit(True))  # no rescue
        found = leaks(spark, docs, items)
    assert len(found & whole) >= 0.98 * len(whole)


# ---------------------------------------------------------------- 3, 4


RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def plain(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    end = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host, rest = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end]), rest[end:]
    path = rest[: min((rest.find(c) for c in "?#" if c in rest), default=len(rest))]
    fitting = [(len(h + p), f"{h}{p}", v) for h, p, v in RULES if (host == h or host.endswith(f".{h}")) and path.startswith(p)]
    return (host, path, *(max(fitting)[1:] if fitting else (None, None)))


def test_urls_against_plain_rules(spark, data):
    pages = spark.read.parquet(f"{data}/pages.parquet")
    own = [r.url for r in pages.select("url").collect()]
    odd = [None, "", "x", "://", "http://", "HTTP://A.ORG", "http://a.org/", "http://EXAMPLE.org/es/x?y", "http://sub.Example.org/en/12#z", "http://notexample.org/es/", "http://example.org/es", "ftp://b.com/fr/a/de/", "http://b.com/de/?fr", "http://b.com?/de/", "a://b://c.org/", "http://org/", "http://xn--.com/fr/é", "http://b.com/" + "d" * 200_000, "http://İ.org/"]
    rows = [(i, u) for i, u in enumerate(own + odd + own[:5])]
    df = spark.createDataFrame([(*r, "a", "b", "c") for r in rows], "page_id long, url string, rule string, host string, label string")
    got = url_filter.judge(df).collect()
    assert sorted(r.page_id for r in got) == list(range(len(rows)))
    for r in got:
        host, path, rule, verdict = plain(rows[r.page_id][1])
        assert (r.host, r.path, r.rule) == (host, path, rule), rows[r.page_id][1][:80]
        assert r.verdict == verdict if verdict else r.verdict in ("allow", "block")


def test_a_null_id_is_not_held_out(spark, tmp_path):
    rows = [(i, "Good words here. " * (i % 7 + 1)) for i in range(60)] + [(None, "No id at all.")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2) for i in range(60)] + [(None, 1)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    got = quality_classifier.op4(spark, str(tmp_path)).collect()
    assert [r.held_out for r in got if r.doc_id is None] == [False] and len(got) == 61
