"""Online packing, hard negatives and whitening against brute force, and the hard cases that their docstrings state."""

import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.llm import hard_negatives, online_packing, whitening

NAN, INF = float("nan"), float("inf")
#: Other columns have names that the operators use themselves.
CLASHING = "row string, x string, n string, block string, part string, top string, task string, ids string"
EMBEDDINGS = f"vec_id long, embedding array<float>, label int, {CLASHING}"
DOCUMENTS = f"doc_id long, text string, {CLASHING}"


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(online_packing.default_tokenizer())


# ---------------------------------------------------------------- 11

PARTS = ["the", "Don't", "it's", "'ll", "é", "Ünder", "ß", "Привет", "日本", "a\nb", "\n", "\n\n", " ", "  ", "\t", " ", " ", "\x1f", "12", "½", "x_1", "<|endoftext|>", "...", "😀", "\r\n", "ª", "×", "'", "ſ", "ʼn", "҂"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(PARTS), st.text(max_size=6)), max_size=12), st.sampled_from(["", " "]))
def test_ids_are_the_library_s(library, parts, between):
    text = between.join(parts).encode("utf-8", "ignore").decode()
    assert online_packing.encoder_of(online_packing.default_tokenizer()).ids(text) == np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def check_packing(rows, got, library):
    """Every id of every document in exactly one piece, sequences without gaps, no padding at all."""
    ids = [np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for _, t in rows]
    want = defaultdict(list)
    for (doc_id, _), i in zip(rows, ids):
        want[doc_id, len(i)].append(i)
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r.doc_id, r.doc_tokens].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    assert sorted(pieces, key=str) == sorted(want, key=str)
    for key, own in pieces.items():
        assert sum(r.length for r in own) == sum(map(len, want[key]))
        for r in own:
            assert r.length > 0 and r.ids_crc32 in {zlib.crc32(i[r.start : r.start + r.length].tobytes()) for i in want[key]}
        if len(want[key]) == 1:
            spans = sorted((r.start, r.length) for r in own)
            assert [s for s, _ in spans] == [0, *np.cumsum([n for _, n in spans])[:-1].tolist()]
    for own in sequences.values():
        own.sort()
        assert [a for a, _ in own] == [0, *np.cumsum([n for _, n in own])[:-1].tolist()]
        length = sum(n for _, n in own)
        assert length == 2048 or length & length - 1 == 0
    return sequences


def document_rows(rng, n):
    rows = [(i, " ".join(rng.choice(PARTS[:6]) for _ in range(rng.choice([3, 40, 300, 700])))) for i in range(n)]
    return rows + [(n, None), (n + 1, ""), (n + 2, "long " * 9000), (n + 3, "<|endoftext|> x"), rows[0], (None, "no id"), (n + 4, "z" * 30_000)]


@pytest.mark.parametrize("partitions", [1, 5, 40])
def test_online_packing(spark, library, partitions):
    rows = document_rows(random.Random(3), 150)
    df = spark.createDataFrame([(*r, *"abcdefgh") for r in rows], DOCUMENTS).repartition(partitions)
    got = online_packing.pack_online(df)
    assert tuple(got.columns) == online_packing.OUT
    sequences = check_packing(rows, got.collect(), library)
    assert sum(sum(n for _, n in s) != 2048 for s in sequences.values()) <= 11


def test_online_packing_of_nothing_and_of_one(spark, library):
    df = spark.createDataFrame([], DOCUMENTS)
    assert online_packing.pack_online(df).count() == 0
    rows = [(7, None)]
    check_packing(rows, online_packing.pack_online(spark.createDataFrame(rows, "doc_id long, text string")).collect(), library)


def test_a_packer_s_open_windows_are_bounded():
    packer, rng = online_packing.Packer(0, capacity=100, windows=4), random.Random(1)
    for i in range(2000):
        packer.add((i, 0, 0, b"abcd" * rng.randint(1, 60)))
        assert len(packer.open) <= 4 and all(0 < r < 100 for r in packer.room)
    full = defaultdict(int)
    for p in packer.placed:
        full[p[5]] += p[2]
    assert set(full.values()) == {100}
    # placed where it fits best, and cut only where it fits nowhere
    packer = online_packing.Packer(0, capacity=10, windows=2)
    for i, n in enumerate((6, 7, 3, 5)):
        packer.add((i, 0, n, b"abcd" * n))
    assert [p[:3] for p in packer.placed] == [(1, 0, 7), (2, 0, 3)] and packer.room == [4, 5]
    packer.add((4, 0, 6, b"abcd" * 6))
    assert [p[:3] for p in packer.placed[2:]] == [(0, 0, 6), (4, 0, 4)] and packer.room == [5, 8]


# ---------------------------------------------------------------- 12


def brute_negatives(rows, least=80):
    taken = []
    for vec_id, vector, label in rows:
        if label is not None and vector is not None and all(c is not None and math.isfinite(c) for c in vector):
            taken.append((vec_id, label, [max(-(1 << 26), min(1 << 26, math.floor(256.0 * float(np.float32(c))))) for c in vector]))
    out = []
    last = lambda v: (v is None, v or 0)
    for a, label, x in taken:
        if a is None or a % 100:
            continue
        others = [(sum(p * q for p, q in zip(x, y)), i, k) for i, k, y in taken if i != a]
        others.sort(key=lambda o: (-o[0], last(o[1])))
        for score, positive, _ in [o for o in others if o[2] == label][:5]:
            fitting = [o for o in others if o[2] != label and least * score <= 100 * o[0] <= 100 * score][:5]
            out += [(a, positive, k + 1, i, score, s) for k, (s, i, _) in enumerate(fitting)]
    return sorted(out, key=str)


def negatives(spark, rows, n_parts=3):
    df = spark.createDataFrame([(*r, *"abcdefgh") for r in rows], EMBEDDINGS).repartition(n_parts)
    return sorted((tuple(r) for r in hard_negatives.hard_negatives(df, df["vec_id"] % 100 == 0).collect()), key=str)


def skewed_vectors(rng, n, dims=16):
    """Lengths and coordinates of very different size, copies, near copies, ties and all the rows that take no part."""
    base = rng.normal(size=(n, dims)) ** 3 * np.exp(rng.normal(size=(n, 1)))
    base[::3] = base[0]  # a third are copies
    base[1::5] = base[1] + rng.normal(size=base[1::5].shape) * 0.05
    rows = [(i * 20, [float(c) for c in v], int(rng.integers(0, 4))) for i, v in enumerate(base)]
    rows[7:9] = [(rows[7][0], [0.0] * dims, 1), (rows[8][0], [0.0] * dims, 2)]
    return rows + [(3, None, 1), (5, [1.0] * dims, None), (9, [1.0, None], 1), (11, [NAN] * dims, 1), (13, [INF] * dims, 1), (15, [2.0, 1.0], 2), (17, [], 3), (None, [3.0] * dims, 1), rows[0], rows[10], (-100, [-1.0] * dims, 0), (19, [3e38] + [0.0] * (dims - 1), 2), (200_000_000, [3e38] * dims, 2)]


@pytest.mark.parametrize("bucket", [8192, 16])
def test_hard_negatives(spark, monkeypatch, bucket):
    monkeypatch.setattr(hard_negatives, "BUCKET", bucket)
    monkeypatch.setattr(hard_negatives, "PART", 1 + bucket // 4)
    monkeypatch.setattr(hard_negatives, "SLOTS", 3)
    rows = skewed_vectors(np.random.default_rng(4), 400)
    want = brute_negatives(rows)
    assert negatives(spark, rows) == want and len(want) > 500


def test_hard_negatives_of_nothing(spark):
    assert negatives(spark, []) == []
    assert negatives(spark, [(1, [1.0], 1)]) == negatives(spark, [(100, [1.0], 1), (1, [1.0], 1)]) == []
    assert negatives(spark, [(100, [], 1), (1, [], 1), (2, [], 2), (3, [], 2)]) == [(100, 1, 1, 2, 0, 0), (100, 1, 2, 3, 0, 0)]


def test_coordinate_ranges_prune_and_lose_nothing():
    rng = np.random.default_rng(8)
    x = (rng.normal(size=(3000, 12)) * 200).astype(np.int32)
    x[:, 0] *= 30
    x[::4] = (rng.normal(size=(750, 12)) * 200).astype(np.int32)
    x[::4, 5] += 9000

    def block(x):
        n = len(x)
        row = {"n": n, "x": x.tobytes(), "orders": np.argsort(hard_negatives.directions(x), axis=0).T.astype(np.int32).tobytes()}
        return row | {k: np.arange(n, dtype=np.int64).tobytes() for k in ("rows", "ids", "labels")}

    bucket, anchors = hard_negatives.Bucket(block(x), 12), hard_negatives.Rows(block(x[:40].copy()), 12)
    scores = anchors.x @ bucket.x.T
    for share in (0.5, 0.9, 0.98, 1.1):
        need = share * anchors.length * bucket.longest
        seen, met = 0, set()
        for i, found in hard_negatives.candidates(anchors, bucket, need):
            found = np.arange(len(x)) if found is None else found
            assert set(np.nonzero(scores[i] >= need[i])[0]) <= set(found.tolist())
            seen += len(found)
            met.add(i)
        assert all(scores[i].max() < need[i] for i in range(40) if i not in met)
        if share >= 0.98:
            assert seen < 0.6 * scores.size  # the others are never scored


# ---------------------------------------------------------------- 13


def brute_whitening(rows):
    taken = [(i, v) for i, v, *_ in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    dims = max(len(v) for _, v in taken)
    x = [[math.floor(1024.0 * float(np.float32(c))) + 100_000 for c in v] + [100_000] * (dims - len(v)) for _, v in taken]
    n = len(x)
    sums = [sum(c) for c in zip(*x)]
    deviations = [sum((n * c - s) ** 2 for c, s in zip(row, sums)) for row in x]
    centred = np.array([[(n * c - s) / n for c, s in zip(row, sums)] for row in x])
    e, v = np.linalg.eigh(centred.T @ centred / n)
    return [i for i, _ in taken], n, deviations, centred, e[::-1], v[:, ::-1]


def whitened(spark, rows, partitions=3):
    df = spark.createDataFrame([(*r, *"abcdefgh") for r in rows], EMBEDDINGS).repartition(partitions)
    x = whitening.durable(whitening.integers(df))
    return whitening.whiten(x, whitening.fit(x)).collect()


def check_whitening(got, rows, kept):
    ids, n, deviations, centred, e, v = brute_whitening(rows)
    own = defaultdict(list)
    for r in got:
        own[r.component].append(r)
        assert r.n == n and r.identity_error <= 1e-8 and abs(r.explained / (e[r.component - 1] / e.sum()) - 1) < 1e-9
    assert sorted(own) == list(range(1, kept + 1))
    for k, rs in own.items():
        want = centred @ v[:, k - 1] / math.sqrt(e[k - 1])
        sign = 1 if abs(max(want, key=abs) - max((r.whitened for r in rs), key=abs)) < 1e-6 else -1
        assert sorted((r.vec_id or -1, r.deviation) for r in rs) == sorted((i or -1, d) for i, d in zip(ids, deviations))
        value = dict(zip(ids, sign * want))  # repeated rows are equal
        assert all(abs(r.whitened - value[r.vec_id]) < 1e-8 for r in rs)


def spread_vectors(rng, n, dims):
    v = rng.normal(size=(n, dims)) * 2.0 ** -np.arange(dims)[None, :] * 3 + rng.normal(size=dims) * 5
    return [(i, [float(np.float32(c)) for c in row], 0) for i, row in enumerate(v)]


def test_whitening(spark):
    rows = spread_vectors(np.random.default_rng(2), 300, 10)
    rows += [(900, None, 1), (901, [1.0, None], 1), (902, [NAN] * 10, 1), (903, [-INF] * 10, 1), (None, [1.0] * 10, 1), (904, [2.0, 1.0], 1), (905, [], 1), rows[3], rows[3]]
    check_whitening(whitened(spark, rows), rows, 8)


def test_whitening_of_skewed_copies_and_many_partitions(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN_IN", 3)  # partition sums meet in several rounds
    rows = spread_vectors(np.random.default_rng(5), 200, 5)
    rows += [(1000 + i, rows[0][1], 0) for i in range(150)]
    check_whitening(whitened(spark, rows, 17), rows, 5)


def test_whitening_without_full_rank(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [float(a), float(b), float(a + b), 7.0], 0) for i, (a, b) in enumerate(rng.integers(-9, 9, (50, 2)))]
    check_whitening(whitened(spark, rows), rows, 2)
    rows = spread_vectors(rng, 4, 9)  # fewer rows than dimensions
    check_whitening(whitened(spark, rows), rows, 3)
    for none in ([], [(1, [1.0, 2.0], 0)], [(i, [3.0, 4.0], 0) for i in range(5)], [(1, [], 0)]):
        assert whitened(spark, none) == []


def test_deviations_are_exact_or_null():
    x = np.array([[1 << 40, -(1 << 40)], [5, 7]])
    found = whitening.Whitening(2, [(1 << 40) + 5, 7 - (1 << 40)])
    big = sum((2 * int(c) - s) ** 2 for c, s in zip(x[0], found.sums))
    assert big >= 1 << 63 and found.deviations(x) == [None, None]
    found = whitening.Whitening(3_000_000, [9_000_000_000 + 1, 3])
    assert found.deviations(np.array([[3001, 0]])) == [(3_000_000 * 3001 - 9_000_000_001) ** 2 + 9]
