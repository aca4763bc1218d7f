"""Language-model scores by a Brown class-based bigram model (operator 5).

A text is its words (A-Z lower-cased) and one end. P(w | before) = P(class of w | class before) * P(w | class of w).

1. Texts are encoded once, in chunks with a list of words of their own, ordered by the words' buckets.
2. A start for the exchange: the FREQUENT most frequent words and the two-byte endings of all others, units few enough for one matrix of
   bigrams over the whole training corpus, move one by one to the class where the likelihood of class bigrams is
   greatest (`exchange`). The start class of a word is that of its unit.
3. Chunks send to each bucket, packed, their words with counts and with how often each start class stands before and after
   them; a bucket adds them up. Then all words with MIN_COUNT training tokens or more are exchanged, one by one, in
   parallel: each goes where the likelihood of its contexts is greatest, by the exact gain, given the class totals of the round before.
   Half of the words may move in a round; a round that lowers the likelihood is undone and the last one. Rarer words, and those not
   in training, keep the class of their ending. What meets on the driver is one table of classes by classes a round.
4. Chunks get back counts and classes of their own words and become sequences of classes. From these come class transitions,
   interpolated with class shares (Witten-Bell), and the scores; word emission has 0.5 added, with a place for unknown
   words in every class, so each distribution sums to 1.

Defined results: null or empty text is one token, its end; a null doc_id counts as training text; repeated rows count and are
scored each; with no training text, every count is 0; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import crc_mod, durable, table

CHUNK_BYTES = 16_000_000
#: Bytes of text to one bucket of words.
BUCKET_BYTES = 8_000_000
#: Units of the start.
FREQUENT, ENDINGS = 1000, 512
CLASSES = 48
PASSES = 8
#: Rounds over all words, and the training tokens that a word needs to be moved.
ROUNDS, MIN_COUNT = 4, 2
ADDED = 0.5

_PART = pa.struct([("bucket", pa.int64()), ("n", pa.int64()), ("words", pa.binary()), ("counts", pa.binary())])
_HEAVY = pa.struct([("word", pa.binary()), ("n", pa.int64())])
_ENCODED = pa.schema([("chunk", pa.int64()), *((x, pa.binary()) for x in ("ids", "valid", "held", "lengths", "tokens")), ("n_train_docs", pa.int64()), ("parts", pa.list_(_PART)), ("heavy", pa.list_(_HEAVY))])
ENCODED = "chunk long, ids binary, valid binary, held binary, lengths binary, tokens binary, n_train_docs long, parts array<struct<bucket: long, n: long, words: binary, counts: binary>>, heavy array<struct<word: binary, n: long>>"


def _pack(x: np.ndarray | bytes) -> bytes:
    raw = x if isinstance(x, bytes) else np.ascontiguousarray(x).tobytes()
    return len(raw).to_bytes(8, "little") + (pa.compress(raw, "zstd", asbytes=True) if raw else b"")


def _unpack(blob: bytes, kind=None):
    n = int.from_bytes(blob[:8], "little")
    raw = pa.decompress(blob[8:], n, "zstd", asbytes=True) if n else b""
    return raw if kind is None else np.frombuffer(raw, kind)


def _word_array(blobs: list[bytes]) -> pa.Array:
    """The words of packed lists; each word ends with a space."""
    data = b"".join(map(_unpack, blobs))
    ends = np.flatnonzero(np.frombuffer(data, np.uint8) == 32)
    starts = np.append(0, ends[:-1] + 1) if len(ends) else ends
    keep = np.ones(len(data), bool)
    keep[ends] = False
    offsets = np.append(starts - np.arange(len(starts)), len(data) - len(ends)).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.frombuffer(data, np.uint8)[keep].tobytes())])


def _units(words: pa.Array, frequent: list[bytes]) -> np.ndarray:
    """Unit of each word: its place among the frequent ones, or that of its last two bytes after them."""
    if not len(words):
        return np.empty(0, np.int64)
    ends = np.frombuffer(words.buffers()[1], np.int64, len(words) + 1, 0)
    data = np.append(np.uint8(0), np.frombuffer(words.buffers()[2], np.uint8)).astype(np.int64)
    stop, size = ends[1:], np.diff(ends)
    pair = data[stop] + 256 * np.where(size > 1, data[np.maximum(stop - 1, 0)], 0)
    ending = len(frequent) + pair * 40_503 // 64 % ENDINGS
    place = pc.index_in(words, value_set=pa.array(frequent, pa.large_binary())).fill_null(-1).to_numpy()
    return np.where(place >= 0, place, ending)


def encode(documents: DataFrame, n_buckets: int) -> DataFrame:
    """documents: doc_id, text, held_out. A row per chunk; tokens are places in the chunk's own list of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids: list = []
        held: list[bool] = []
        tokens: list[np.ndarray] = []
        local: dict[bytes, int] = {}
        size = 0

        def made() -> pa.RecordBatch:
            lengths = np.array([len(t) for t in tokens], np.int64)
            words = list(local)
            bucket = np.fromiter(map(zlib.crc32, words), np.uint64, len(words)) * np.uint64(n_buckets) >> np.uint64(32)
            order = np.argsort(bucket, kind="stable")
            place = np.empty(len(order), np.uint32)
            place[order] = np.arange(len(order))
            flat = place[np.concatenate(tokens).astype(np.int64)]
            counts = np.bincount(flat[np.repeat(~np.array(held, bool), lengths)], minlength=len(words))
            bucket = bucket[order].astype(np.int64)
            edges = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])).tolist() + [len(bucket)] if len(bucket) else [0]
            words = [words[i] for i in order.tolist()]
            parts = [{"bucket": int(bucket[a]), "n": z - a, "words": _pack(b" ".join(words[a:z]) + b" "), "counts": _pack(counts[a:z].astype(np.uint32))} for a, z in zip(edges, edges[1:])]
            heavy = [{"word": words[i], "n": int(counts[i])} for i in np.flatnonzero(counts * 4 * FREQUENT > counts.sum()).tolist()]
            row = (
                number, _pack(np.array([i or 0 for i in ids], np.int64)), _pack(np.array([i is not None for i in ids])), _pack(np.array(held, bool)), _pack(lengths),
                _pack(flat), len(held) - sum(held), parts, heavy,
            )
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, _ENCODED)], schema=_ENCODED)

        for b in batches:
            for doc_id, text, out in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist()):
                raw = (text.as_py() or "").encode("utf-8", "surrogatepass").lower()
                words = raw.split()
                try:
                    t = np.fromiter(map(local.__getitem__, words), np.uint32, len(words))
                except KeyError:
                    for w in words:
                        if w not in local:
                            local[w] = len(local)
                    t = np.fromiter(map(local.__getitem__, words), np.uint32, len(words))
                ids.append(doc_id)
                held.append(bool(out))
                tokens.append(t)
                size += len(raw)
                if size >= CHUNK_BYTES:
                    yield made()
                    number += 1
                    ids, held, tokens, local, size = [], [], [], {}, 0
        if ids:
            yield made()

    return documents.select("doc_id", "text", "held_out").mapInArrow(run, ENCODED)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        for i in range(b.num_rows):
            yield {name: b.column(k)[i].as_py() for k, name in enumerate(b.schema.names)}


def _with_ends(values: np.ndarray, lengths: np.ndarray, end) -> np.ndarray:
    """values of all documents, with `end` after each."""
    return np.insert(values, np.cumsum(lengths), end)


def _training(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and lengths of a chunk's training texts."""
    flat, lengths, held = _unpack(row["tokens"], np.uint32), _unpack(row["lengths"], np.int64), _unpack(row["held"], bool)
    return flat[np.repeat(~held, lengths)].astype(np.int64), lengths[~held]


def unit_bigrams(encoded: DataFrame, frequent: list[bytes]) -> np.ndarray:
    """How often a unit follows another in training text. Units: frequent words, then endings, then the end of a text."""
    n_units = len(frequent) + ENDINGS + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            unit = _units(_word_array([x["words"] for x in row["parts"]]), frequent)
            flat, lengths = _training(row)
            seq = np.append(n_units - 1, _with_ends(unit[flat], lengths, n_units - 1))
            pair, n = np.unique(seq[:-1] * n_units + seq[1:], return_counts=True)
            if len(pair):
                yield pa.RecordBatch.from_arrays([pa.array(pair, pa.int64()), pa.array(n, pa.int64())], names=["pair", "n"])

    counted = encoded.select("lengths", "held", "tokens", "parts").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    out = np.zeros((n_units, n_units))
    for r in counted.collect():  # bounded by the square of the units
        out[divmod(r.pair, n_units)] = r.n
    return out


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange(bigrams: np.ndarray, classes: int = CLASSES, passes: int = PASSES) -> np.ndarray:
    """Class of each unit. bigrams: counts of unit pairs; the last unit, the end of a text, keeps a class of its own."""
    n = len(bigrams)
    weight = bigrams.sum(axis=0)
    of = np.full(n, classes, np.int64)
    order = np.argsort(-weight[:-1], kind="stable")
    of[order] = np.arange(n - 1) % classes
    k = classes + 1
    one = np.eye(k)
    counts = one[of].T @ bigrams @ one[of]
    for _ in range(passes):
        moved = 0
        for u in order:
            if not weight[u] and not bigrams[u].any():
                continue
            old = of[u]
            right = np.bincount(of, weights=bigrams[u], minlength=k)  # classes after u
            left = np.bincount(of, weights=bigrams[:, u], minlength=k)
            own = bigrams[u, u]
            right[old] -= own
            left[old] -= own
            counts[old] -= right
            counts[:, old] -= left
            counts[old, old] -= own
            rows, cols = counts.sum(axis=1), counts.sum(axis=0)
            # gain of putting u into each class c: row c gets `right`, column c gets `left`, the corner also `own`
            gain = (_xlogx(counts + right) - _xlogx(counts)).sum(axis=1) + (_xlogx(counts + left[:, None]) - _xlogx(counts)).sum(axis=0)
            corner = np.diag(counts)
            gain += _xlogx(corner + right + left + own) - _xlogx(corner + right) - _xlogx(corner + left) + _xlogx(corner)
            gain -= _xlogx(rows + right.sum() + own) - _xlogx(rows) + _xlogx(cols + left.sum() + own) - _xlogx(cols)
            new = int(np.argmax(gain[:classes]))
            if gain[new] <= gain[old] + 1e-9:
                new = old
            counts[new] += right
            counts[:, new] += left
            counts[new, new] += own
            of[u] = new
            moved += new != old
        if not moved:
            break
    return of


# ---------------------------------------------------------------- all words

_SENT = "bucket long, chunk long, n long, words binary, counts binary, before binary, n_before binary, after binary, n_after binary"
_CONTEXTS = ("before", "n_before", "after", "n_after")
GATHERED = "bucket long, words binary, counts binary, start binary, before binary, n_before binary, after binary, n_after binary, chunks array<struct<chunk: long, places: binary>>"
_CHUNK = pa.struct([("chunk", pa.int64()), ("places", pa.binary())])
_GATHERED = pa.schema([("bucket", pa.int64()), *((x, pa.binary()) for x in ("words", "counts", "start", *_CONTEXTS)), ("chunks", pa.list_(_CHUNK))])


def _pack_keys(keys: np.ndarray) -> bytes:
    """Rising numbers."""
    return _pack(np.diff(keys, prepend=0).astype(np.uint32))


def _unpack_keys(blob: bytes) -> np.ndarray:
    return np.cumsum(_unpack(blob, np.uint32), dtype=np.int64)


def gather(encoded: DataFrame, frequent: list[bytes], of: np.ndarray) -> DataFrame:
    """A row per bucket: its words, their training counts and start classes, and how often a class stands before and after them, as
    rising word * (CLASSES + 1) + class; and for each chunk, which words its list holds."""
    k = CLASSES + 1

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            parts = row["parts"]
            if not parts:
                continue
            start = of[_units(_word_array([x["words"] for x in parts]), frequent)]
            flat, lengths = _training(row)
            seq = np.append(CLASSES, _with_ends(start[flat], lengths, CLASSES))
            place = np.delete(np.arange(1, len(seq)), np.cumsum(lengths) + np.arange(len(lengths)))  # tokens in seq
            edges = np.append(0, np.cumsum([x["n"] for x in parts]))
            sides = []
            for shift in (-1, 1):
                keys, n = np.unique(flat * k + seq[place + shift], return_counts=True)
                sides.append((keys, n, np.searchsorted(keys, edges * k)))
            out = []
            for i, x in enumerate(parts):
                packed = []
                for keys, n, at in sides:
                    packed += [_pack_keys(keys[at[i] : at[i + 1]] - edges[i] * k), _pack(n[at[i] : at[i + 1]].astype(np.uint32))]
                out.append((x["bucket"], row["chunk"], x["n"], x["words"], x["counts"], *packed))
            kinds = [pa.int64()] * 3 + [pa.binary()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds)], names=[x.split()[0] for x in _SENT.split(", ")])

    def add(t: pa.Table) -> pa.Table:
        rows = t.sort_by("chunk").to_pylist()
        everything = _word_array([x["words"] for x in rows]).dictionary_encode()
        place, words = everything.indices.to_numpy().astype(np.int64), everything.dictionary
        counts = np.bincount(place, weights=np.concatenate([_unpack(x["counts"], np.uint32) for x in rows]), minlength=len(words))
        edges = np.append(0, np.cumsum([x["n"] for x in rows]))
        sides = []
        for side in ("before", "after"):
            keys = np.concatenate([_unpack_keys(x[side]) + e * k for x, e in zip(rows, edges.tolist())])
            n = np.concatenate([_unpack(x[f"n_{side}"], np.uint32) for x in rows])
            keys, at = np.unique(place[keys // k] * k + keys % k, return_inverse=True)
            sides += [_pack_keys(keys), _pack(np.bincount(at, weights=n, minlength=len(keys)).astype(np.int64))]
        start = of[_units(words, frequent)].astype(np.uint8)
        chunks = [{"chunk": x["chunk"], "places": _pack(place[a:z].astype(np.uint32))} for x, a, z in zip(rows, edges.tolist(), edges[1:].tolist())]
        joined = _pack(b"".join(w + b" " for w in words.to_pylist()))
        out = (rows[0]["bucket"], joined, _pack(counts.astype(np.int64)), _pack(start), *sides, chunks)
        return pa.Table.from_arrays([pa.array([x], f.type) for x, f in zip(out, _GATHERED)], schema=_GATHERED)

    return encoded.select("chunk", "lengths", "held", "tokens", "parts").mapInArrow(send, _SENT).groupBy("bucket").applyInArrow(add, GATHERED)


class Words:
    """A bucket's words in the exchange: contexts[side]: (word, class, count) of what stands before and after them."""

    def __init__(self, row: dict):
        k = CLASSES + 1
        self.counts, self.of = _unpack(row["counts"], np.int64).astype(float), _unpack(row["start"], np.uint8).astype(np.int64)
        self.contexts = []
        for side in ("before", "after"):
            keys = _unpack_keys(row[side])
            self.contexts.append((keys // k, keys % k, _unpack(row[f"n_{side}"], np.int64).astype(float)))

    def totals(self) -> np.ndarray:
        """Flat sums by class: contexts before, contexts after, tokens, words in training."""
        k = CLASSES + 1
        sides = [np.bincount(self.of[w] * k + x, weights=n, minlength=CLASSES * k) for w, x, n in self.contexts]
        return np.concatenate([*sides, np.bincount(self.of, weights=self.counts, minlength=CLASSES), np.bincount(self.of, weights=self.counts > 0, minlength=CLASSES)])

    def move(self, totals: np.ndarray, turn: int) -> None:
        """Every second word, by turns, goes to the class of the greatest gain in likelihood; totals are those of all words."""
        k, m = CLASSES + 1, len(self.counts)
        free = (self.counts >= MIN_COUNT) & (np.arange(m) % 2 == turn % 2)
        gain = np.zeros((m, CLASSES))
        for at, (word, x, n) in zip((0, CLASSES * k), self.contexts):
            use = np.flatnonzero(free[word])
            sums = totals[at : at + CLASSES * k].reshape(CLASSES, k).T  # context by class
            before = _xlogx(sums)
            for i in range(0, len(use), 20_000):
                e = use[i : i + 20_000]
                w, c, size = word[e], x[e], n[e][:, None]
                more = _xlogx(sums[c] + size) - before[c]
                own = (np.arange(len(e)), self.of[w])
                more[own] = before[c, self.of[w]] - _xlogx(sums[c, self.of[w]] - n[e])
                first = np.flatnonzero(np.append(True, w[1:] != w[:-1]))
                gain[w[first]] += np.add.reduceat(more, first)
        tokens = totals[2 * CLASSES * k : 2 * CLASSES * k + CLASSES]
        which = np.flatnonzero(free)
        n, old = self.counts[which], self.of[which]
        less = _xlogx(tokens + n[:, None]) - _xlogx(tokens)
        less[np.arange(len(which)), old] = _xlogx(tokens[old]) - _xlogx(tokens[old] - n)
        gain = gain[which] - 2 * less
        new = gain.argmax(axis=1)
        better = gain[np.arange(len(which)), new] > gain[np.arange(len(which)), old] + 1e-9
        self.of[which[better]] = new[better]


def likelihood(totals: np.ndarray) -> float:
    """What moving words changes in the log likelihood of contexts given classes."""
    contexts = totals[: -2 * CLASSES]
    return float(_xlogx(contexts).sum() - 2 * _xlogx(totals[-2 * CLASSES : -CLASSES]).sum())


def _moved(row: dict, rounds: list[np.ndarray]) -> Words:
    """The bucket's words after the rounds, each given by the totals before it: cheaper to repeat than to store."""
    words = Words(row)
    for turn, totals in enumerate(rounds):
        words.move(totals, turn)
    return words


def class_totals(gathered: DataFrame, rounds: list[np.ndarray]) -> np.ndarray:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(2 * CLASSES * (CLASSES + 1) + 2 * CLASSES)
        for row in _rows(batches):
            sums += _moved(row, rounds).totals()
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(sums[at].astype(np.int64))], names=["at", "n"])

    out = np.zeros(2 * CLASSES * (CLASSES + 1) + 2 * CLASSES)
    for r in gathered.select("counts", "start", *_CONTEXTS).mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():  # of fixed size
        out[r["at"]] = r.n
    return out


class Learned:
    """Words by bucket, the rounds of the exchange and the sums that follow from them."""

    def __init__(self, encoded: DataFrame, rounds: int = ROUNDS):
        self.encoded = encoded
        heavy = encoded.select(F.explode("heavy").alias("x")).groupBy("x.word").agg(F.sum("x.n").alias("n")).orderBy(F.desc("n"), "word").limit(FREQUENT)
        frequent = [bytes(r.word) for r in heavy.collect()]
        bigrams = unit_bigrams(encoded, frequent)
        self.gathered = durable(gather(encoded, frequent, exchange(bigrams)))
        self.rounds: list[np.ndarray] = []
        self.totals = class_totals(self.gathered, [])
        self.likelihoods = [likelihood(self.totals)]
        for _ in range(rounds):
            after = class_totals(self.gathered, [*self.rounds, self.totals])
            if likelihood(after) <= self.likelihoods[-1]:
                break
            self.rounds.append(self.totals)
            self.totals = after
            self.likelihoods.append(likelihood(after))
        self.n_docs = encoded.agg(F.sum("n_train_docs")).first()[0] or 0
        self.total = int(self.totals[-2 * CLASSES : -CLASSES].sum()) + self.n_docs
        self.distinct = int(self.totals[-CLASSES:].sum()) + (self.n_docs > 0)

    def words(self) -> DataFrame:
        """word, count (of training tokens) and class of every word."""
        rounds = self.rounds

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for row in _rows(batches):
                words = _word_array([row["words"]]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([words, pa.array(_unpack(row["counts"], np.int64)), pa.array(_moved(row, rounds).of, pa.int32())], names=["word", "count", "class"])

        return self.gathered.mapInArrow(run, "word binary, count long, class int")

    def answers(self) -> DataFrame:
        """For each chunk and bucket: training counts and classes of the chunk's words, in its order."""
        rounds = self.rounds

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for row in _rows(batches):
                counts, of = _unpack(row["counts"], np.int64), _moved(row, rounds).of.astype(np.uint8)
                for x in row["chunks"]:
                    place = _unpack(x["places"], np.uint32)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([x["chunk"]], pa.int64()), pa.array([row["bucket"]], pa.int64()), pa.array([_pack(counts[place])], pa.binary()), pa.array([_pack(of[place])], pa.binary())], names=["chunk", "bucket", "counts", "classes"]
                    )

        return self.gathered.select("bucket", "counts", "start", *_CONTEXTS, "chunks").mapInArrow(run, "chunk long, bucket long, counts binary, classes binary")


# ---------------------------------------------------------------- scores

CLASSED = "ids binary, valid binary, held binary, lengths binary, classes binary, n_known binary, base binary, emitted binary"
_CLASSED = pa.schema([(x.split()[0], pa.binary()) for x in CLASSED.split(", ")])


def classed(learned: Learned) -> DataFrame:
    """Chunks as sequences of classes, with each text's known tokens, base score and sum of log10(count + ADDED)."""
    total, distinct, n_docs = learned.total, learned.distinct, learned.n_docs
    answers = learned.answers().groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("bucket", "counts", "classes"))).alias("answers"))
    base_all = float(np.log10(total + ADDED * (distinct + 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            found = row["answers"] or []
            count = np.concatenate([_unpack(x["counts"], np.int64) for x in found] or [np.empty(0, np.int64)])
            of = np.concatenate([_unpack(x["classes"], np.uint8) for x in found] or [np.empty(0, np.uint8)])
            flat, lengths = _unpack(row["tokens"], np.uint32), _unpack(row["lengths"], np.int64)
            starts = np.cumsum(lengths + 1) - lengths - 1
            add = lambda v, end: np.add.reduceat(_with_ends(v[flat], lengths, end), starts)
            logs, log_end = np.log10(count + ADDED), float(np.log10(n_docs + ADDED))
            out = (
                row["ids"], row["valid"], row["held"], row["lengths"], _pack(_with_ends(of[flat], lengths, np.uint8(CLASSES))), _pack(add((count > 0).astype(np.int64), int(n_docs > 0))),
                _pack(add(logs - base_all, log_end - base_all)), _pack(add(logs, log_end)),
            )
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in out], schema=_CLASSED)

    return learned.encoded.select("chunk", "ids", "valid", "held", "lengths", "tokens").join(answers, "chunk", "left").mapInArrow(run, CLASSED)


def class_bigrams(chunks: DataFrame) -> np.ndarray:
    """How often a class follows another in training text; the last class is the end of a text."""
    k = CLASSES + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(k * k, np.int64)
        for row in _rows(batches):
            train = np.repeat(~_unpack(row["held"], bool), _unpack(row["lengths"], np.int64) + 1)
            seq = np.append(CLASSES, _unpack(row["classes"], np.uint8)[train].astype(np.int64))
            sums += np.bincount(seq[:-1] * k + seq[1:], minlength=k * k)
        yield pa.RecordBatch.from_arrays([pa.array(range(k * k), pa.int64()), pa.array(sums)], names=["pair", "n"])

    out = np.zeros(k * k)
    for r in chunks.select("held", "lengths", "classes").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect():  # of fixed size
        out[r.pair] = r.n
    return out.reshape(k, k)


class Model:
    """Log10 probabilities: step[class before, class], and total[class], to be taken from log10(count + ADDED) of a word."""

    def __init__(self, bigrams: np.ndarray, kinds: np.ndarray):
        """bigrams: counts of classes; kinds: distinct words of each class."""
        k = len(bigrams)
        follow = bigrams.sum(axis=1, keepdims=True)
        distinct = (bigrams > 0).sum(axis=1, keepdims=True)
        share = (bigrams.sum(axis=0) + 1) / (bigrams.sum() + k)
        keep = np.divide(follow, follow + distinct, out=np.zeros_like(follow), where=follow > 0)
        seen = np.divide(bigrams, follow, out=np.zeros_like(bigrams), where=follow > 0)
        self.step = np.log10(keep * seen + (1 - keep) * share)
        self.total = np.log10(bigrams.sum(axis=0) + ADDED * (kinds + 1))


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
_SCORED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def learn(documents: DataFrame, rounds: int = ROUNDS) -> Learned:
    """documents: doc_id, text, held_out; what is not held out is learned from."""
    size = documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return Learned(durable(encode(documents, max(16, size // BUCKET_BYTES))), rounds)


def model_of(learned: Learned, chunks: DataFrame) -> Model:
    return Model(class_bigrams(chunks), np.append(learned.totals[-CLASSES:], float(learned.n_docs > 0)))


def score_texts(documents: DataFrame) -> DataFrame:
    """documents: doc_id, text, held_out; what is not held out is learned from."""
    learned = learn(documents)
    chunks = durable(classed(learned))
    model, total = model_of(learned, chunks), learned.total

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            lengths, of = _unpack(row["lengths"], np.int64), _unpack(row["classes"], np.uint8).astype(np.int64)
            before = np.append(CLASSES, of[:-1])
            steps = np.add.reduceat(model.step[before, of] - model.total[of], np.cumsum(lengths + 1) - lengths - 1)
            ids = pa.array(_unpack(row["ids"], np.int64), mask=~_unpack(row["valid"], bool))
            columns = [ids, pa.array(_unpack(row["held"], bool)), pa.array(lengths + 1), pa.array(_unpack(row["n_known"], np.int64)), pa.array(np.full(len(ids), total, np.int64))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(_unpack(row["base"], np.float64)), pa.array(steps + _unpack(row["emitted"], np.float64))], schema=_SCORED)

    return chunks.mapInArrow(run, SCORED)


def op5(spark, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce(crc_mod(F.col("doc_id")) == 1, F.lit(False)).alias("held_out"))
    return score_texts(documents)
