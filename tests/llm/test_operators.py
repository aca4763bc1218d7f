"""The ten operators against brute force, exact round trips and the hard cases that their docstrings state."""

import hashlib
import math
import random
import struct
import zlib
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.llm import chat_format, class_lm, decontaminate, near_dedup, packing, quality_classifier, quality_rules, suffix_dedup, token_counts, url_filter

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, score string, key string, block string, n_words string"
SYLLABLES = "ka lo mi ne ru ta vo su be di".split()


def words(rng, n):
    return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(n))


def near_copy(rng, text, share):
    return " ".join(words(rng, 1) if rng.random() < share else w for w in text.split(" "))


@pytest.fixture(scope="module")
def rows():
    """Documents with copies, near copies, shared passages, nulls, empty and long texts, ties and a repeated row."""
    rng = random.Random(5)
    texts = [words(rng, rng.randint(60, 160)) for _ in range(40)]
    passage = words(rng, 70)
    texts += [texts[0]] * 5 + [near_copy(rng, texts[1], 0.015) for _ in range(12)] + [near_copy(rng, texts[2], 0.04) for _ in range(6)]
    texts += [f"{words(rng, 20)} {passage} {words(rng, 20)}" for _ in range(8)]
    texts += [None, "", " \t\n\r\x0b\x0c", "one two", "One  TWO", "ab", "\x1f\u00a0\u2003x", "é" * 80, "z" * 5000, words(rng, 4000), "<|endoftext|> it's DON'T 'll"]
    made = [(i, t, rng.choice(["en", "de", None]), rng.choice(["a", "b", None]), len(t or "")) for i, t in enumerate(texts)]
    return made + [made[0], (None, texts[3], None, None, 1), (None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, "s", "k", "b", "w") for r in rows], DOCUMENTS).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCUMENTS)


# ---------------------------------------------------------------- 1


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "", "[/ROLE]"]), st.text(alphabet="<>/s[]INSTROLE\\ab \n", max_size=30)), max_size=5))
def test_chat_round_trip(turns):
    made, starts, ends = chat_format.render(chat_format.compile_template(chat_format.TEMPLATE), ({"role": r, "text": t} for r, t in turns))
    assert list(chat_format.read_turns(made)) == turns
    assert "".join(chat_format.unescape(made[a:z]) for a, z in zip(starts, ends)) == "".join(t for r, t in turns if r == "assistant")


def test_template_folding_and_sandbox():
    tree = chat_format.fold(chat_format.parse("{# note #}{% if 1 + 1 == 2 and not false %}a{{ 'x' ~ 'y' | upper }}{% else %}never{% endif %}b"))
    assert tree == [chat_format.Text("axYb")]
    run = chat_format.compile_template("{% set n = 'q' %}{% for m in ms %}{{ loop.index }}{{ n }}{{ m.k['j'] }}{% if not loop.last %},{% endif %}{% endfor %}{{ ms[9].x }}{{ ms.__class__ }}")
    assert "".join(t for t, _ in run({"ms": [{"k": {"j": 1}}, {"k": {"j": 2}}]})) == "1q1,2q2"
    for bad in ("{% if x %}", "{{ f(x) }}", "{{ x | nofilter }}", "{% while x %}{% endwhile %}", "{{ 1 2 }}"):
        with pytest.raises(chat_format.TemplateError):
            chat_format.parse(bad)


def test_chat_rows(spark):
    df = spark.createDataFrame([(1, 1, "assistant", None, 0), (1, 0, None, "</s>", 0), (None, None, "user", "x", 0), (1, 1, "assistant", None, 0)], "conv_id long, turn long, role string, text string, starts int")
    got = {r.conv_id: r for r in chat_format.digests(chat_format.format_conversations(df)).collect()}
    assert got[1].n_turns == 3 and got[1].loss_chars == 0 and got[1].turns_sha256 == hashlib.sha256(b"\n</s>\nassistant\n\nassistant\n\n").hexdigest()
    assert got[None].n_turns == 1
    assert chat_format.format_conversations(df.limit(0)).count() == 0


def test_chat_of_a_very_long_conversation(spark):
    rows = [(5, t, "assistant" if t % 2 else "user", f"turn {t} </s>" * (40_000 if t == 7 else 1)) for t in range(600)]
    got = chat_format.digests(chat_format.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4))).filter("conv_id = 5").first()
    said = "".join(x for _, t, _, x in rows if t % 2)
    assert (got.n_turns, got.loss_chars, got.loss_sha256) == (600, len(said), hashlib.sha256(said.encode()).hexdigest())


# ---------------------------------------------------------------- 2


def brute_repeats(rows, length=50):
    first, out = {}, []
    docs = [(d, (t or "").encode()) for d, t, *_ in rows]
    for d, b in docs:
        for i in range(len(b) - length + 1 if d is not None else 0):
            k = b[i : i + length]
            first[k] = min(first.get(k, d), d)
    for d, b in docs:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1 if d is not None else 0):
            if first[b[i : i + length]] < d:
                gone[i : i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((d, len(b), sum(gone), sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1])), hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def found_repeats(df):
    return Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect())


def test_repeats(docs, rows, nothing):
    got = suffix_dedup.remove_repeats(docs).cache()
    assert found_repeats(got) == brute_repeats(rows)
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in got.collect())
    assert suffix_dedup.remove_repeats(nothing).count() == 0


def test_repeats_with_small_blocks_panels_and_hot_values(spark, rows, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT_BLOCKS", 2)
    monkeypatch.setattr(suffix_dedup, "HOT_RUNS", 1)
    few = rows[40:75]
    df = spark.createDataFrame([(d, t) for d, t, *_ in few], "doc_id long, text string").repartition(8)
    assert found_repeats(suffix_dedup.remove_repeats(df, with_bytes=False)) == brute_repeats(few)


def test_repeats_of_short_and_long_runs_of_one_value(spark):
    rng = random.Random(6)
    made = [f"{words(rng, 8)}\n{rule}\n{words(rng, 8)}" for unit in ("-", "=-", "| a ") for rule in ((unit * 5000)[:n] for n in (60, 80, 5000, 55, 70))]
    for texts in (made, made[::-1]):
        few = list(enumerate(texts))
        df = spark.createDataFrame(few, "doc_id long, text string").repartition(4)
        assert found_repeats(suffix_dedup.remove_repeats(df, with_bytes=False)) == brute_repeats(few)


@settings(max_examples=60, deadline=None)
@given(st.binary(min_size=1, max_size=300).map(lambda b: bytes(x % 3 for x in b)), st.integers(9, 14))
def test_equal_strings(raw, length):
    import numpy as np

    order, kind = suffix_dedup.equal_strings(np.frombuffer(raw, np.uint8), length)
    twice = raw * (length // len(raw) + 2)
    by_kind = defaultdict(set)
    for i, k in zip(order.tolist(), kind.tolist()):
        by_kind[k].add(twice[i : i + length])
    assert all(len(v) == 1 for v in by_kind.values()) and len({next(iter(v)) for v in by_kind.values()}) == len(by_kind)


def test_panels_of_a_long_text(monkeypatch):
    import numpy as np

    text = bytes(random.Random(1).randint(97, 100) for _ in range(3000))
    whole = {}
    for size in (1_000_000, 700):
        monkeypatch.setattr(suffix_dedup, "PANEL_BYTES", size)
        suffix_dedup._powers.clear()
        found = set()
        for p in suffix_dedup.panels(text, np.array([len(text)])):
            for a, n, v in zip(p.at.tolist(), (p.end - p.start + 1).tolist(), p.value.tolist()):
                found |= {(a + k, v) for k in range(n)}
        whole[size] = found
    suffix_dedup._powers.clear()
    assert whole[700] == whole[1_000_000] and len(whole[700]) == len(text) - 49


# ---------------------------------------------------------------- 3


def test_url_rules_and_trees(spark):
    rng = random.Random(2)
    urls = [f"http://{rng.choice(['a', 'b.c'])}.example.{rng.choice(['com', 'org', 'net'])}/{rng.choice(['fr', 'de', 'es', 'en'])}/{rng.randint(1, 999)}" for _ in range(400)]
    urls += [None, "", "no scheme/x", "http://", "HTTP://EXAMPLE.ORG/es/1", "x://example.org/es", "x://notexample.org/es/", "x://example.org/en/17?a=1#b", "x://a.com/de/?://b.org/", "x://com/fr/"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").selectExpr("page_id", "url", "'h' AS host", "1 AS label")
    got = {r.page_id: r for r in url_filter.judge(df).collect()}
    n = 400
    assert [(got[n + i].host, got[n + i].path, got[n + i].rule) for i in range(10)] == [
        ("", "", None), ("", "", None), ("", "", None), ("", "", None), ("example.org", "/es/1", "example.org/es/"), ("example.org", "/es", "org/"), ("notexample.org", "/es/", "org/"),
        ("example.org", "/en/17", "example.org/en/1"), ("a.com", "/de/", "com/de/"), ("com", "/fr/", "com/fr/"),
    ]
    assert got[n + 5].verdict == "allow" and got[n + 4].verdict == "block" and got[n + 6].verdict == "allow"
    assert {r.verdict for r in got.values()} == {"allow", "block"} and len(got) == len(urls)
    assert url_filter.judge(df.limit(0)).count() == 0
    assert {r.verdict for r in url_filter.judge(df.filter("page_id = 400 OR page_id = 409")).collect()} == {"allow"}


def test_url_trees_learn_what_rules_say(spark, data):
    """Held-out accuracy: half of the rules' labels are hidden, from statistics too. Allowing all gives 0.758, and 0 on the blocked ones."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector
    from pyspark.sql import functions as F

    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("page_id", "url")
    df = url_filter.lexical(pages).filter("label IS NOT NULL").withColumn("truth", F.col("label")).withColumn("label", F.when(F.col("page_id") % 2 == 0, F.col("label")))
    df = url_filter.with_suffix_statistics(df.cache()).withColumn("features", array_to_vector(F.array(*url_filter.FEATURES))).cache()
    model = GBTClassifier(maxIter=url_filter.TREES, maxDepth=url_filter.DEPTH, seed=1).fit(df.filter("label IS NOT NULL"))
    test = model.transform(df.filter("label IS NULL")).cache()
    assert test.filter("prediction = truth").count() / test.count() > 0.92
    blocked = test.filter("truth = 0")
    assert blocked.filter("prediction = 0").count() / blocked.count() > 0.8


def test_url_statistics_leave_a_labelled_url_out(spark, monkeypatch):
    made = [(i, f"http://{'abc'[i % 3] if i % 5 else 'd%d' % i}.example.{'org' if i % 2 else 'com'}/{'de' if i % 4 < 2 else 'fr'}/{i}") for i in range(60)] + [(60, None), (61, "x" * 200_000), (61, "x" * 200_000)]
    df = url_filter.lexical(spark.createDataFrame(made, "page_id long, url string"))
    want = url_filter.with_suffix_statistics(df)
    rows = want.collect()
    for r in rows:
        same = [x for x in rows if x.site == r.site]
        use = [x.label for x in same if x.label is not None and (r.label is None or x.hash % url_filter.FOLDS != r.hash % url_filter.FOLDS)]
        assert r.site_share == pytest.approx(len(same) / len(rows)) and r.site_allowed == pytest.approx((sum(use) + 1) / (len(use) + 2))
    monkeypatch.setattr(url_filter, "BROADCAST_ROWS", 1)  # values beyond a broadcast: frequent ones are split off
    monkeypatch.setattr(url_filter, "FREQUENT", 8)
    assert Counter(map(tuple, url_filter.with_suffix_statistics(df).select(*want.columns).collect())) == Counter(map(tuple, rows))
    assert url_filter.judge(spark.createDataFrame(made, "page_id long, url string")).count() == len(made)


# ---------------------------------------------------------------- 4


def test_quality_classifier(spark, docs, rows, nothing):
    rng = random.Random(3)
    good = [(1000 + i, words(rng, 80), 1) for i in range(150)]
    bad = [(2000 + i, words(rng, 80).upper().replace(" ", "!! "), 0) for i in range(60)]
    texts = spark.createDataFrame([(d, t) for d, t, _ in good + bad], "doc_id long, text string").unionByName(docs.select("doc_id", "text"))
    labels = spark.createDataFrame([(d, y) for d, _, y in good[::2] + bad[::2]] + [(1, None), (77777, 1)], "doc_id long, y int")
    features = quality_classifier.document_statistics(texts)
    got = {r.doc_id: r.score for r in quality_classifier.score(features, quality_classifier.fit(features, labels)).collect()}
    assert len(got) == len({d for d, _, _ in good + bad} | {r[0] for r in rows}) and all(0 <= s <= 1 for s in got.values())
    right = [(got[d] >= quality_classifier.THRESHOLD) == bool(y) for d, _, y in good[1::2] + bad[1::2]]
    assert sum(right) / len(right) > 0.97
    none = quality_classifier.fit(features, labels.filter("y = 1"))
    assert {r.score for r in quality_classifier.score(features, none).collect()} == {0.5}
    assert quality_classifier.document_statistics(nothing).count() == 0


def test_quality_classifier_equals_plain_numpy(spark):
    """Partition sums, weights and the isotonic grid against one matrix and pooled violators."""
    import numpy as np

    q = quality_classifier
    rng = np.random.RandomState(7)
    x = rng.normal(size=(240, len(q.STATISTICS)))
    y = (x[:, 0] + 0.7 * rng.normal(size=240) > 0).astype(int)
    features = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "doc_id long, x array<double>").repartition(5)
    labels = spark.createDataFrame([(i, int(v)) for i, v in enumerate(y)], "doc_id long, y int")
    to_features = q.FourierMap(x.mean(axis=0), x.std(axis=0))
    z = to_features(x)
    sums = q.normal_equations(features.join(labels, "doc_id").select("x", "y"), to_features)
    assert np.allclose(sums, z.T @ np.column_stack([z, y]))
    raw = z @ np.linalg.solve(z.T @ z + q.RIDGE * len(y) * np.eye(z.shape[1]), z.T @ y)
    cells = np.round(np.clip(raw, -0.5, 1.5) * q.GRID).astype(int)
    blocks = []  # mean, weight, cells
    for c in np.unique(cells):
        blocks.append([y[cells == c].mean(), (cells == c).sum(), [c]])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            (m, w, cs), (n, v, ds) = blocks[-2:]
            blocks[-2:] = [[(m * w + n * v) / (w + v), w + v, cs + ds]]
    at, value = zip(*[(c / q.GRID, m) for m, _, cs in blocks for c in cs])
    want = np.clip(0.999 * np.interp(raw, at, value) + 0.001 * np.clip(raw, 0, 1), 0, 1)
    got = {r.doc_id: r.score for r in q.score(features, q.fit(features, labels)).collect()}
    assert np.allclose([got[i] for i in range(240)], want, atol=1e-6)


# ---------------------------------------------------------------- 5


def test_language_model(spark, docs, rows, nothing):
    from pyspark.sql import functions as F

    held = docs.select("doc_id", "text", (F.col("doc_id") % 4 == 1).alias("held_out"), "score")
    got = class_lm.score_texts(held).collect()
    assert len(got) == len(rows)
    split = lambda t: (t or "").encode().lower().split()
    train = Counter()
    for d, t, *_ in rows:
        if d is None or d % 4 != 1:
            train.update(split(t))
            train["end"] += 1
    n, v = sum(train.values()), len(train)
    want = Counter()
    for d, t, *_ in rows:
        seq = [*split(t), "end"]
        want[(d, len(seq), sum(train[w] > 0 for w in seq), n, round(sum(math.log10((train[w] + 0.5) / (n + 0.5 * (v + 1))) for w in seq), 6))] += 1
    assert Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert sum(r.score for r in got) > sum(r.base_score for r in got)
    assert class_lm.score_texts(nothing.selectExpr("doc_id", "text", "false AS held_out")).count() == 0


def test_language_model_scores_equal_a_plain_sum(spark, docs, rows, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(class_lm, "CHUNK_BYTES", 3000)
    held = docs.select("doc_id", "text", F.coalesce(F.col("doc_id") % 4 == 1, F.lit(False)).alias("held_out"))
    learned = class_lm.learn(held)
    of = {bytes(r.word): r["class"] for r in learned.words().collect()}
    got = Counter((r.doc_id, round(r.score, 6)) for r in class_lm.score_texts(held).collect())
    end, k = class_lm.CLASSES, class_lm.CLASSES + 1
    texts = [(d, d is not None and d % 4 == 1, [*(t or "").encode().lower().split(), "end"]) for d, t, *_ in rows]
    train, pairs = Counter(), Counter()
    for _, out, seq in texts:
        if not out:
            train.update(seq)
            classes = [end, *(of.get(w, end) for w in seq)]
            pairs.update(zip(classes, classes[1:]))
    follow, share, kinds = Counter(), Counter(), Counter()
    for (x, y), n in pairs.items():
        follow[x] += n
        share[y] += n
    for w, n in train.items():
        kinds[of.get(w, end)] += n > 0
    after = Counter(x for x, _ in pairs)
    want = Counter()
    for d, _, seq in texts:
        before, total = end, 0.0
        for w in seq:
            c = of.get(w, end)
            wide = (share[c] + 1) / (sum(share.values()) + k)
            step = (pairs[before, c] + after[before] * wide) / (follow[before] + after[before]) if follow[before] else wide
            total += math.log10(step) + math.log10((train[w] + 0.5) / (share[c] + 0.5 * (kinds[c] + 1)))
            before = c
        want[(d, round(total, 6))] += 1
    assert got == want
    assert learned.likelihoods == sorted(learned.likelihoods) and len(learned.likelihoods) > 1


def test_language_model_is_a_distribution():
    import numpy as np

    rng = np.random.RandomState(0)
    bigrams = rng.poisson(3, (9, 9)).astype(float)
    model = class_lm.Model(bigrams, np.full(9, 4.0))
    assert np.allclose((10.0**model.step).sum(axis=1), 1)
    for c, n in enumerate(bigrams.sum(axis=0)):
        counts = np.array([n - 3, 1, 1, 1, 0])  # four words and the unknown one
        assert np.isclose((10.0 ** (np.log10(counts + class_lm.ADDED) - model.total[c])).sum(), 1)


def test_moves_of_words_follow_the_exact_gain(monkeypatch):
    """A word moved alone raises the likelihood by what its gain says, and goes where it is greatest."""
    import numpy as np

    rng = np.random.RandomState(4)
    k, m = class_lm.CLASSES + 1, 30
    sides = []
    for _ in range(2):
        x = rng.randint(0, k, (m, 6))
        keys, n = np.unique(np.repeat(np.arange(m), 6) * k + x.ravel(), return_counts=True)
        sides += [class_lm._pack_keys(keys), class_lm._pack(n.astype(np.int64))]
    row = dict(zip(("before", "n_before", "after", "n_after"), sides)) | {"counts": class_lm._pack(np.full(m, 6)), "start": class_lm._pack(rng.randint(0, class_lm.CLASSES, m).astype(np.uint8))}
    for only in range(0, m, 5):
        words = class_lm.Words(row)
        totals = words.totals()
        words.counts[np.arange(m) != only] = 0  # the others stay
        words.move(totals, only)
        moved, values = class_lm.Words(row), []
        for c in range(class_lm.CLASSES):
            moved.of[only] = c
            values.append(class_lm.likelihood(moved.totals()))
        assert np.isclose(values[words.of[only]], max(values))


def test_exchange_never_lowers_the_likelihood():
    import numpy as np

    rng = np.random.RandomState(1)
    b = np.kron(np.array([[0, 9.0], [9.0, 0]]), rng.poisson(4, (6, 6)))
    b = np.pad(b, (0, 1))
    one = lambda of: np.eye(of.max() + 1)[of]

    def value(of):
        c = one(of).T @ b @ one(of)
        return class_lm._xlogx(c).sum() - class_lm._xlogx(c.sum(0)).sum() - class_lm._xlogx(c.sum(1)).sum()

    before = value(class_lm.exchange(b, classes=2, passes=0))
    of = class_lm.exchange(b, classes=2)
    assert value(of) >= before and len(set(of[:6])) == 1 and len(set(of[6:12])) == 1 and of[0] != of[6]


# ---------------------------------------------------------------- 6


def brute_leaks(docs, items):
    def split(t):
        return (t or "").encode().lower().split()

    def grams(w, k):
        return [tuple(w[i : i + k]) for i in range(len(w) - k + 1)]

    out = set()
    for d, t in docs:
        for item, u in items:
            w, x = split(t), split(u)
            if not w or not x:
                continue
            k = min(5, len(x))
            a, b = grams(w, k), grams(x, k)
            n, target = min(len(a), len(b)), Counter(b)
            best = max((sum((Counter(a[s : s + n]) & target).values()) for s in range(len(a) - n + 1)), default=0) if n else 0
            if n and 100 * best >= 80 * (n + len(b) - best):
                out.add((d, item))
    return out


def test_leaks(spark, docs, rows, nothing):
    rng = random.Random(4)
    items = [(i, words(rng, rng.randint(3, 40))) for i in range(12)] + [(100, None), (101, ""), (102, "one two"), (103, "ab"), (None, words(rng, 20))]
    leaky = [(500 + i, f"{words(rng, 30)} {near_copy(rng, items[i % 12][1], rng.choice([0, 0, 0.02, 0.2])).upper()} {words(rng, 30)}") for i in range(36)]
    leaky += [(600, items[5][1]), (601, " ".join(items[6][1].split()[:-1])), (602, None), (None, items[7][1]), (500, leaky[0][1])]
    everything = leaky + [(d, t) for d, t, *_ in rows]
    df = spark.createDataFrame(everything, "doc_id long, text string").selectExpr("*", "1 AS item", "2 AS item_id")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = [(r.doc_id, r.item_id) for r in decontaminate.find_leaks(df, bench).collect()]
    assert set(got) == brute_leaks(everything, items)
    assert len(set(got)) > 20
    assert decontaminate.find_leaks(nothing, bench).count() == 0 and decontaminate.find_leaks(df, bench.limit(0)).count() == 0


def test_fingerprints_alone_find_nearly_all_leaks(spark):
    """Blocks of fingerprints, without the rescue, on windows whose similarity to their item is just above the threshold."""
    from pyspark.sql import functions as F

    rng, made = random.Random(23), []
    while len(made) < 400:
        item = words(rng, rng.randint(25, 60)).split()
        window = list(item)
        for p in rng.sample(range(len(item)), rng.randint(1, 2)):
            window[p] = "own"
        a, b = (Counter(tuple(x[i : i + 5]) for i in range(len(x) - 4)) for x in (item, window))
        shared, n = sum((a & b).values()), len(item) - 4
        if 80 * (2 * n - shared) <= 100 * shared < 88 * (2 * n - shared):
            made.append((len(made), n, item, window))
    df = spark.createDataFrame(made, "number long, n_item int, item_words array<string>, own_words array<string>").withColumn("k", F.lit(5))
    side = lambda name, c: df.select(F.col("number").alias(name), "k", "n_item", decontaminate.simhash(decontaminate.occurrences(decontaminate.shingles(F.col(c), F.lit(5)))).alias("print"))
    got = [(r.window, r.item) for r in decontaminate.near_pairs(side("window", "own_words"), side("item", "item_words")).collect()]
    assert sum(a == b for a, b in got) >= 396 and sum(a != b for a, b in got) <= 40


def test_leaks_that_differ_in_a_repeated_phrase(spark):
    rng = random.Random(21)
    items, leaky = [], []
    for i in range(40):
        passage = words(rng, 118)
        items.append((i, f"{passage} {'. ' * 14}".strip()))  # the last ten shingles are one
        leaky.append((i, f"{words(rng, 20)} {passage} {'~ ' * 14}{words(rng, 20)}"))
    got = decontaminate.find_leaks(spark.createDataFrame(leaky, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = brute_leaks(leaky, items)
    assert {(r.doc_id, r.item_id) for r in got} == want and len(want) == 40


# ---------------------------------------------------------------- 7


def test_quality_rules(docs, rows, nothing):
    def brute(t):
        w = [x for x in "".join(" " if c in "\t\n\r\x0b\x0c" else c for c in t or "").split(" ") if x]
        tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        n = Counter(tri)
        covered = {i + k for i, g in enumerate(tri) if n[g] > 1 for k in range(3)}
        lines = [x for x in (t or "").split("\n") if x.strip(" \t\r\x0b\x0c")]
        return len(w), sum(map(len, w)), sum((t or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)

    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality_rules.apply_rules(docs).collect())
    assert got == Counter((d, *brute(t)) for d, t, *_ in rows)
    assert quality_rules.apply_rules(nothing).count() == 0


def test_repeated_words_beyond_the_packed_range(spark, monkeypatch):
    monkeypatch.setattr(quality_rules, "POSITION_BITS", 2)
    df = spark.createDataFrame([("a b c d a b c x a b c".split(),), (["q"] * 9,), ([],), (["a", "b"],)], "w array<string>")
    assert [r.n for r in quality_rules.repeat_words(df, "w", "n").collect()] == [9, 9, 0, 0]


def test_quality_cut_offs_keep_clean_texts(spark):
    rng = random.Random(9)
    clean = [(i, words(rng, 90), "en", "a") for i in range(300)]
    junk = [(1000 + i, " ".join(w + rng.choice(["###", "$$$"]) for w in words(rng, 90).split()), "en", "a") for i in range(40)]
    got = {r.doc_id: r.kept for r in quality_rules.apply_rules(spark.createDataFrame(clean + junk, "doc_id long, text string, lang string, source string")).collect()}
    assert all(got[d] for d, *_ in clean) and not any(got[d] for d, *_ in junk)


# ---------------------------------------------------------------- 8


def test_token_counts_equal_the_library(spark, docs, rows, nothing):
    from tokenizers import Tokenizer, models

    vocabulary = token_counts.read_vocabulary(token_counts.default_vocabulary())
    low = min(s for _, s in vocabulary)
    exact = Tokenizer(models.Unigram([("<unk>", low), *((f"<0x{i:02X}>", low) for i in range(256)), *vocabulary], 0, True))
    split = lambda t: [w for w in "".join(" " if c in "\t\n\r\x0b\x0c" else c for c in t or "").split(" ") if w]
    short = [r for r in rows if len(r[1] or "") < 3000]
    want = Counter((d, sum(len(exact.encode(token_counts.MARK + w).ids) for w in split(t))) for d, t, *_ in short)
    got = Counter((r.doc_id, r.n_tokens) for r in token_counts.count_tokens(docs.filter("text IS NULL OR length(text) < 3000")).collect())
    assert got == want
    assert token_counts.count_tokens(nothing).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="aabbcx", min_size=1, max_size=14))
def test_token_ties(word):
    from tokenizers import Tokenizer, models

    vocabulary = [("a", -1.0), ("b", -1.0), ("ab", -2.0), ("ba", -2.0), ("aab", -3.0), ("bb", -2.5), ("abba", -4.0), ("c", -3.0)]
    exact = Tokenizer(models.Unigram([("<unk>", -4.0), *((f"<0x{i:02X}>", -4.0) for i in range(256)), *vocabulary], 0, True))
    assert token_counts.Counter(vocabulary).word(word) == len(exact.encode(word).ids)


# ---------------------------------------------------------------- 9


def test_packing(docs, rows, nothing):
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(packing.default_tokenizer())
    got = packing.pack(docs).collect()
    want = Counter()
    for d, t, *_ in rows:
        ids = [*exact.encode(t or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), packing.CAPACITY):
            part = ids[k : k + packing.CAPACITY]
            want[(d, k // packing.CAPACITY, k, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part)))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    assert len(by) <= math.ceil(sum(r.length for r in got) / packing.CAPACITY) + 1
    assert packing.pack(nothing).count() == 0


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(1, packing.CAPACITY), max_size=200))
def test_best_fit(sizes):
    bins, offsets, fill = packing.best_fit(sizes)
    for b in range(len(fill)):
        at = 0
        for o, s in sorted((offsets[i], sizes[i]) for i in range(len(sizes)) if bins[i] == b):
            assert o == at
            at += s
        assert at == fill[b] <= packing.CAPACITY
    assert len(fill) <= 2 * -(-sum(sizes) // packing.CAPACITY) + 1


def test_merge_rounds(spark, monkeypatch):
    monkeypatch.setattr(packing, "FAN_IN", 2)
    df = spark.createDataFrame([(i, "ka " * (100 + i)) for i in range(90)], "doc_id long, text string").repartition(9)
    got = packing.pack(df).collect()
    used = defaultdict(int)
    for r in got:
        used[r.sequence_id] += r.length
    assert len(got) == 90 and max(used.values()) <= packing.CAPACITY and len(used) <= math.ceil(sum(used.values()) / packing.CAPACITY) + 2


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, packing.CAPACITY) | st.sampled_from([100, 900, 1100]), max_size=300))
def test_best_fit_of_counts(sizes):
    by_bin, seen = defaultdict(list), Counter()
    places, n_bins = packing.best_fit_counts(Counter(sizes))
    for size, rank, n, instance, each, at in places:
        assert rank == seen[size]
        seen[size] += n
        for k in range(n):
            by_bin[instance + k // each].append((at + k % each * size, size))
    assert seen == Counter(sizes) and set(by_bin) == set(range(n_bins)) and n_bins == len(packing.best_fit(sizes)[2])
    for items in by_bin.values():
        at = 0
        for offset, size in sorted(items):
            assert offset == at
            at += size
        assert at <= packing.CAPACITY


def test_bins_that_are_not_handed_on_are_matched(spark, monkeypatch):
    monkeypatch.setattr(packing, "CARRIED", 2)
    unit = len(packing.encoder_of(packing.default_tokenizer()).ids("ka ")) // 4
    texts = ["ka " * (n // unit) for n in [1100] * 60 + [900] * 60]  # sorted: no partition can match them alone
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartitionByRange(6, "doc_id")
    by = defaultdict(list)
    for r in packing.pack(df).collect():
        by[r.sequence_id].append((r.offset, r.length))
    assert sum(map(len, by.values())) == 120 and len(by) == 60
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY


# ---------------------------------------------------------------- 10


def brute_groups(rows, similarity=85):
    sets, root = {}, {}
    for d, t, *_ in rows:
        w = (t or "").encode().lower().split()
        if d is not None:
            sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set()
            root[d] = d

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            shared = len(sets[a] & sets[b])
            if a < b and sets[a] and sets[b] and 100 * shared >= similarity * (len(sets[a]) + len(sets[b]) - shared):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def test_near_duplicates(docs, rows, nothing):
    got = near_dedup.near_duplicates(docs).collect()
    want = brute_groups(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == want
    assert len(got) == len(rows) and all(r.kept == (r.doc_id == r.component_id) for r in got if r.doc_id is not None)
    assert all(r.kept and r.component_id is None for r in got if r.doc_id is None)
    assert sum(d != c for d, (_, c) in want.items()) > 10
    assert near_dedup.near_duplicates(nothing).count() == 0


def crowd(rng, pairs, n_words=300):
    """Texts that differ from a common one by four own words each, and for each of them a partner with four more: only partners are similar enough."""
    base = [f"w{rng.randrange(5000)}" for _ in range(n_words)]
    texts = []
    for k in range(pairs):
        one = list(base)
        places = rng.sample(range(n_words), 8)
        for p in places[:4]:
            one[p] = f"own{k}x{p}"
        two = list(one)
        for p in places[4:]:
            two[p] = f"more{k}x{p}"
        texts += [one, two]
    order = list(range(2 * pairs))
    rng.shuffle(order)
    return [(order[i], " ".join(t)) for i, t in enumerate(texts)]


@pytest.mark.parametrize("region, each", [(4096, 4), (60, 4), (4096, 0)])
def test_near_duplicates_in_a_crowd(spark, monkeypatch, region, each):
    monkeypatch.setattr(near_dedup, "REGION", region)  # 60: regions are walked again with deeper keys, then dealt in blocks
    monkeypatch.setattr(near_dedup, "EACH", each)  # 0: forests only
    few = crowd(random.Random(31), 150)
    want = {d: c for d, (_, c) in brute_groups(few).items()}
    assert len(set(want.values())) > 60
    df = spark.createDataFrame(few, "doc_id long, text string").repartition(3)
    assert {r.doc_id: r.component_id for r in near_dedup.near_duplicates(df).collect()} == want


def test_parities_never_rule_out_a_link():
    import numpy as np

    rng = np.random.RandomState(3)
    for n in (1, 5, 60, 127, 129, 400, 3000, 40000):
        x = np.unique(rng.randint(0, 2**62, n).astype(np.uint64))
        y = np.unique(np.concatenate([x[: int(0.9 * len(x))], rng.randint(0, 2**62, max(n // 10, 1)).astype(np.uint64)]))
        bound = near_dedup.Compared([near_dedup.parity(x), near_dedup.parity(y)]).apart(np.array([0, 1]), np.array([1, 0]))
        assert bound[0] == bound[1] <= len(np.setxor1d(x, y))
        both = near_dedup.Compared([near_dedup.parity(x), near_dedup.parity(y)])
        assert both.may(np.array([0, 1]), np.array([1, 0]), np.array([len(np.setxor1d(x, y))] * 2)).all()


def test_components(spark):
    links = [(i, i + 1) for i in range(30)] + [(100, 200), (200, 300), (50, 300), (7, 7)]
    random.Random(0).shuffle(links)
    got = {r.id: r.root for r in near_dedup.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(31)}, **{i: 50 for i in (50, 100, 200, 300)}}
