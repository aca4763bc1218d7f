"""Removal of long repeated byte strings across documents (operator 2).

A byte goes when it is covered by a string of LENGTH bytes that also starts in a document with a smaller doc_id. Unequal
runs are compared by bytes; hashes (64 bits beside the value) recognise equal ones.

1. Documents are packed into compressed blocks, the unit of all later steps.
2. Every LENGTH-byte window has a blocking value: the least hash of the shorter strings inside it, so equal windows have
   equal values, and neighbouring windows mostly share one: they form a run. Blocks send only their distinct values to
   buckets and get back one bit each: does another document have it?
3. Runs with a shared value meet by that value, at first as hashes of their bytes. Runs of one value and hash are one kind: all
   but the smallest document's are removed. Values found in very many blocks, or very often in one, or with a run too long to be
   of one short string (a repeating text) are dealt as single windows by window hash, in all blocks alike, so no value gathers
   many rows and equal windows always meet.
4. Where unequal runs meet, the bytes of one run of each kind are joined to one text. Its Burrows-Wheeler transform is searched breadth-first: an interval of
   suffixes that begin with w is extended backward to cw for each character c before it. Each extension that ends at a
   boundary not seen before fixes the common prefix there, by increasing value, and goes on; at LENGTH the search stops.
   What lies between boundaries then is one LENGTH-byte string, and its smallest document keeps it.

Defined results: null or empty text has no bytes, nothing is removed from a text below LENGTH bytes; a string repeated only
inside one document, or in rows with the same doc_id, stays; a null doc_id is smaller than nothing and has nothing
smaller; an empty table gives an empty result; other columns are ignored. Very long texts are read in overlapping panels.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import durable, table

LENGTH = 50
#: Bytes of the strings whose least hash is a window's blocking value; a window holds LENGTH - PART + 1 = 25 of them.
PART = 26
BLOCK_BYTES = 4_000_000
PANEL_BYTES = 1_000_000
#: Bytes of candidate runs that one bucket should hold.
BUCKET_BYTES = 2_000_000
#: A blocking value in more blocks than this is dealt window by window.
HOT_BLOCKS = 1024
#: So is one with more runs than this in a block, or with a run of more than LENGTH - PART + 1 windows anywhere.
HOT_RUNS = 200

_U = np.uint64
_r = np.random.RandomState(50)
_BYTE = _r.randint(0, 2**63, 256, np.uint64) * _U(2) + _r.randint(0, 2, 256, np.uint64)
_BASE = 0xD1342543DE82EF95
_powers: list[np.ndarray] = []


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if not _powers:
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(PANEL_BYTES + LENGTH + 1, base, _U)
            p[0] = 1
            _powers.append(np.cumprod(p, dtype=_U))
    return _powers[0], _powers[1]


class Panel:
    """Some bytes of one or more documents: row number and first place of each piece."""

    def __init__(self, data: np.ndarray, rows: np.ndarray, bases: np.ndarray, lengths: np.ndarray):
        self.data = data
        inverse = _tables()[1]
        n = len(data)
        sums = self.sums()
        piece = np.repeat(np.arange(len(lengths)), lengths)
        windows = n - LENGTH + 1
        if windows <= 0:
            self.start = self.end = np.empty(0, np.int64)
            self.value = self.content = np.empty(0, _U)
            self.row = self.at = np.empty(0, np.int64)
            return
        h = _mix((sums[PART:] - sums[:-PART]) * inverse[: n - PART + 1])
        for step in (1, 2, 4, 8):
            h = np.minimum(h[:-step], h[step:])
        least = np.minimum(h[: -(LENGTH - PART + 1 - 16)], h[LENGTH - PART + 1 - 16 :])
        ok = piece[:windows] == piece[LENGTH - 1 :]
        new = np.ones(windows, bool)
        new[1:] = (least[1:] != least[:-1]) | (piece[1:windows] != piece[: windows - 1]) | (ok[1:] != ok[:-1])
        new[:: 1 << 16] = True
        start = np.flatnonzero(new)
        end = np.append(start[1:], windows) - 1
        good = ok[start]
        self.start, self.end = start[good], end[good]
        self.value = least[self.start]
        self.content = self.hash_of(self.start, self.end + LENGTH, sums)
        own = piece[self.start]
        begins = np.cumsum(lengths) - lengths
        self.row, self.at = rows[own], self.start - begins[own] + bases[own]  # at: place of the first window in its document

    def sums(self) -> np.ndarray:
        """Running sums of the bytes' hashes; eight times the data, so they are made where they are needed and not kept."""
        out = np.zeros(len(self.data) + 1, _U)
        np.cumsum(_BYTE[self.data] * _tables()[0][: len(self.data)], out=out[1:])
        return out

    def hash_of(self, start: np.ndarray, stop: np.ndarray, sums: np.ndarray) -> np.ndarray:
        inverse = _tables()[1]
        return _mix((sums[stop] - sums[start]) * inverse[start] + (stop - start).astype(_U) * _U(0x9E3779B97F4A7C15))


def panels(payload: bytes, lengths: np.ndarray) -> Iterator[Panel]:
    """A block's documents, joined to panels; long ones in pieces that overlap by LENGTH - 1."""
    data = np.frombuffer(payload, np.uint8)
    at, group, size = 0, [], 0

    def made() -> Panel:
        rows, bases, froms, sizes = (np.array(x, np.int64) for x in zip(*group))
        return Panel(np.concatenate([data[f : f + s] for f, s in zip(froms, sizes)]), rows, bases, sizes)

    for row, n in enumerate(lengths.tolist()):
        for base in range(0, max(n - LENGTH + 1, 0), PANEL_BYTES):
            piece = min(PANEL_BYTES + LENGTH - 1, n - base)
            if size + piece > PANEL_BYTES + LENGTH - 1:
                yield made()
                group, size = [], 0
            group.append((row, base, at + base, piece))
            size += piece
        at += n
    if group:
        yield made()


def _blob(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).tobytes()


# ---------------------------------------------------------------- 1: blocks

BLOCKS = "block long, ids binary, valid binary, lengths binary, payload binary, size long, carried binary"
_BLOCKS = pa.schema([("block", pa.int64()), ("ids", pa.binary()), ("valid", pa.binary()), ("lengths", pa.binary()), ("payload", pa.binary()), ("size", pa.int64()), ("carried", pa.binary())])


def blocks(documents: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Rows of documents, packed; columns in `carry` come along as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids, texts, others, size = [], [], [], 0

        def made() -> pa.RecordBatch:
            known = np.array([i is not None for i in ids])
            payload = b"".join(texts)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, others[0].schema) as writer:
                for x in others:
                    writer.write_batch(x)
            row = (
                number, _blob(np.array([i or 0 for i in ids], np.int64)), _blob(known), _blob(np.array([len(t) for t in texts], np.int64)), pa.compress(payload, "zstd", asbytes=True), size,
                sink.getvalue().to_pybytes() if carry else b"",
            )
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, _BLOCKS)], schema=_BLOCKS)

        for b in batches:
            begins = 0
            for k, (doc_id, text) in enumerate(zip(b.column(0).to_pylist(), b.column(1))):
                raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
                ids.append(doc_id)
                texts.append(raw)
                size += len(raw)
                if size >= BLOCK_BYTES:
                    others.append(b.select(list(range(2, b.num_columns))).slice(begins, k + 1 - begins))
                    yield made()
                    number += 1
                    ids, texts, others, size, begins = [], [], [], 0, k + 1
            if begins < b.num_rows:
                others.append(b.select(list(range(2, b.num_columns))).slice(begins))
        if ids:
            yield made()

    return documents.select("doc_id", "text", *carry).mapInArrow(run, BLOCKS)


def _open(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, bytes]:
    """ids, which of them are not null, byte lengths, bytes."""
    payload = pa.decompress(row["payload"], row["size"], "zstd", asbytes=True) if row["size"] else b""
    return np.frombuffer(row["ids"], np.int64), np.frombuffer(row["valid"], bool), np.frombuffer(row["lengths"], np.int64), payload


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        for i in range(b.num_rows):
            yield {name: b.column(k)[i].as_py() for k, name in enumerate(b.schema.names)}


# ---------------------------------------------------------------- 2: which blocking values are shared


def _keys(value: np.ndarray, n_buckets: int) -> np.ndarray:
    """The bucket of a value above, 32 of its bits below."""
    return (value % _U(n_buckets)) << _U(32) | value >> _U(32)


def _block_runs(row: dict, n_buckets: int):
    """All runs of a block's documents: panel list, and key, row, doc_id of the runs one after another."""
    ids, _, lengths, payload = _open(row)
    found = list(panels(payload, lengths))
    if not found:
        empty = np.empty(0, np.int64)
        return found, np.empty(0, _U), empty, empty, ids
    rows = np.concatenate([p.row for p in found])
    keys = np.concatenate([_keys(p.value, n_buckets) for p in found])
    return found, keys, rows, ids[rows], ids


def shared_values(packed: DataFrame, n_buckets: int) -> DataFrame:
    """For each block and bucket: a bit for each of its distinct values in rising order, and one for being hot."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            found, keys, _, docs, _ = _block_runs(row, n_buckets)
            if not len(keys):
                continue
            order = np.argsort(keys)
            keys, docs = keys[order], docs[order]
            n_windows = np.concatenate([p.end - p.start + 1 for p in found])[order]
            first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            many = np.minimum.reduceat(docs, first) != np.maximum.reduceat(docs, first)
            often = np.diff(np.append(first, len(keys))) > HOT_RUNS
            # a run longer than one string can cause comes from a repeating text: few windows, many places
            often |= np.maximum.reduceat(n_windows, first) > LENGTH - PART + 1
            keys = keys[first]
            bucket = (keys >> _U(32)).astype(np.int64)
            edges = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])).tolist() + [len(keys)]
            low = keys.astype(np.uint32)
            parts = [(int(bucket[a]), row["block"], _blob(low[a:z]), _blob(np.packbits(many[a:z])), _blob(np.packbits(often[a:z]))) for a, z in zip(edges, edges[1:])]
            b, o, *bits = zip(*parts)
            yield pa.RecordBatch.from_arrays([pa.array(b, pa.int64()), pa.array(o, pa.int64()), *(pa.array(x, pa.binary()) for x in bits)], names=["bucket", "block", "values", "many", "often"])

    def answer(t: pa.Table) -> pa.Table:
        values = [np.frombuffer(x, np.uint32) for x in t.column("values").to_pylist()]
        many, often = (np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=len(v)) for x, v in zip(t.column(name).to_pylist(), values)]) for name in ("many", "often"))
        sizes = [len(v) for v in values]
        _, place, count = np.unique(np.concatenate(values), return_inverse=True, return_counts=True)
        several = np.bincount(place, weights=many, minlength=len(count)) > 0
        hot = (count > HOT_BLOCKS) | (np.bincount(place, weights=often, minlength=len(count)) > 0)
        shared, hot = ((count > 1) | several)[place], hot[place]
        cut = np.cumsum(sizes)[:-1]
        bits = [[_blob(np.packbits(x)) for x in np.split(y, cut)] for y in (shared, hot)]
        total = [int(x.sum()) for x in np.split(shared, cut)]
        return pa.Table.from_arrays(
            [t.column("block").combine_chunks(), t.column("bucket").combine_chunks(), pa.array(sizes, pa.int64()), pa.array(total, pa.int64()), pa.array(bits[0], pa.binary()), pa.array(bits[1], pa.binary())],
            names=["block", "bucket", "n", "n_shared", "shared", "hot"],
        )

    sent = packed.mapInArrow(send, "bucket long, block long, values binary, many binary, often binary")
    return sent.groupBy("bucket").applyInArrow(answer, "block long, bucket long, n long, n_shared long, shared binary, hot binary")


# ---------------------------------------------------------------- 3: shared runs meet


def _gather(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes data[start : start + size] of all places, one after another."""
    begins = np.cumsum(size) - size
    return data[np.arange(int(size.sum())) - np.repeat(begins - start, size)]


def _flags(parts: list[dict], name: str) -> np.ndarray:
    return np.concatenate([np.unpackbits(np.frombuffer(b[name], np.uint8), count=b["n"]) for b in parts]).astype(bool)


class SharedRuns:
    """A block's runs with a shared value, and their distinct kinds: runs of equal value and bytes. Kinds are in the order of
    (bucket, hash), so that answers about them can come back as bits."""

    def __init__(self, row: dict, n_buckets: int, n_out: int, with_bytes: bool):
        found, keys, _, _, ids = _block_runs(row, n_buckets)
        valid = np.frombuffer(row["valid"], bool)
        distinct = np.unique(keys)
        shared, hot_values = (_flags(row["bits"], x) for x in ("shared", "hot"))
        parts, at = [], 0
        for p in found:
            place = np.searchsorted(distinct, keys[at : at + len(p.row)])
            at += len(p.row)
            use = shared[place] & valid[p.row]
            hot = hot_values[place] & use  # by value alone: a short run must meet a long one's windows
            cold = use & ~hot
            n = (p.end - p.start + 1)[hot]
            within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            hot_start = np.repeat(p.start[hot], n) + within
            hot_hash = p.hash_of(hot_start, hot_start + LENGTH, p.sums()) if len(hot_start) else np.empty(0, _U)
            start = np.concatenate([p.start[cold], hot_start])
            size = np.concatenate([p.end[cold] - p.start[cold], np.zeros(len(hot_start), np.int64)]) + LENGTH
            parts.append(
                (
                    np.concatenate([_mix(_keys(p.value[cold], n_buckets)), _mix(hot_hash)]),
                    np.concatenate([p.content[cold], hot_hash]),
                    size,
                    np.concatenate([p.row[cold], np.repeat(p.row[hot], n)]),
                    np.concatenate([p.at[cold], np.repeat(p.at[hot], n) + within]),
                    _gather(p.data, start, size) if with_bytes else np.empty(0, np.uint8),
                )
            )
            p.data = None
        empty = (np.empty(0, _U), np.empty(0, _U), *(np.empty(0, np.int64) for _ in range(3)), np.empty(0, np.uint8))
        self.group, self.content, self.size, self.row, self.at, self.data = (np.concatenate(x) for x in zip(*parts)) if parts else empty
        self.doc = ids[self.row]
        bucket = (self.group % _U(n_out)).astype(np.int64)
        order = np.lexsort((self.doc, self.content, bucket))
        new = np.append(True, (self.content[order][1:] != self.content[order][:-1]) | (bucket[order][1:] != bucket[order][:-1])) if len(order) else np.empty(0, bool)
        self.kind = np.empty(len(order), np.int64)
        self.kind[order] = np.cumsum(new) - 1
        first = order[new]  # in the smallest document of each kind
        self.kind_bucket, self.kind_content, self.kind_group, self.kind_doc = bucket[first], self.content[first], (self.group[first] >> _U(32)).astype(np.uint32), self.doc[first]


def _by_bucket(bucket: np.ndarray) -> list[tuple[int, int, int]]:
    """(bucket, from, to) of a sorted array."""
    edges = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])).tolist() + [len(bucket)]
    return [(int(bucket[a]), a, z) for a, z in zip(edges, edges[1:])]


def settled_kinds(placed: DataFrame, bits: DataFrame, n_buckets: int, n_out: int) -> DataFrame:
    """For each block and bucket, a bit for each of its kinds: a smaller document of another block has it (gone); unequal runs
    of other documents share its value (open)."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            if not row["bits"]:
                continue
            runs = SharedRuns(row, n_buckets, n_out, with_bytes=False)
            if len(runs.kind_bucket):
                parts = [(b, row["block"], _blob(runs.kind_content[a:z]), _blob(runs.kind_group[a:z]), _blob(runs.kind_doc[a:z])) for b, a, z in _by_bucket(runs.kind_bucket)]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*parts), (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()))], names=["bucket", "block", "contents", "groups", "docs"])

    def answer(t: pa.Table) -> pa.Table:
        read = lambda x, kind: [np.frombuffer(v, kind) for v in t.column(x).to_pylist()]
        contents, groups, docs = read("contents", _U), np.concatenate(read("groups", np.uint32)), np.concatenate(read("docs", np.int64))
        sizes = [len(x) for x in contents]
        content = np.concatenate(contents)
        order = np.lexsort((docs, content, groups))
        g, c, d = groups[order], content[order], docs[order]
        new_group = np.append(True, g[1:] != g[:-1])
        new = new_group | np.append(True, c[1:] != c[:-1])
        kind = np.cumsum(new) - 1
        least = d[new]
        of_group = (np.cumsum(new_group) - 1)[new]
        starts = np.flatnonzero(np.append(True, of_group[1:] != of_group[:-1]))
        mixed = np.minimum.reduceat(least, starts) != np.maximum.reduceat(least, starts)
        gone, is_open = np.empty(len(d), bool), np.empty(len(d), bool)
        gone[order] = d > least[kind]
        is_open[order] = mixed[of_group][kind] & (d == least[kind])
        cut = np.cumsum(sizes)[:-1]
        out = [[_blob(np.packbits(x)) for x in np.split(y, cut)] for y in (gone, is_open)]
        return pa.Table.from_arrays([t.column("block").combine_chunks(), t.column("bucket").combine_chunks(), pa.array(sizes, pa.int64()), pa.array(out[0], pa.binary()), pa.array(out[1], pa.binary())], names=["block", "bucket", "n", "gone", "open"])

    sent = placed.join(bits, "block", "left").mapInArrow(send, "bucket long, block long, contents binary, groups binary, docs binary")
    return sent.groupBy("bucket").applyInArrow(answer, "block long, bucket long, n long, gone binary, open binary")


def merged(row: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """(row, first, last window) with overlapping and neighbouring ranges of a row joined."""
    if not len(row):
        return np.empty((0, 3), np.int64)
    order = np.lexsort((first, row))
    shift = row[order].astype(np.int64) << 33  # beyond any place in a document
    start, end = shift + first[order], np.maximum.accumulate(shift + last[order])
    new = np.append(True, start[1:] > end[:-1] + 1)
    stop = end[np.append(np.flatnonzero(new)[1:], len(end)) - 1]
    rows = row[order][new]
    return np.stack([rows, first[order][new], stop - (rows.astype(np.int64) << 33)], axis=1).astype(np.int64)


RUNS = "bucket long, block long, groups binary, sizes binary, docs binary, rows binary, places binary, bytes binary, done binary"
_RUNS = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), *((x, pa.binary()) for x in ("groups", "sizes", "docs", "rows", "places", "bytes", "done"))])


def open_runs(placed: DataFrame, bits: DataFrame, kinds: DataFrame, n_buckets: int, n_out: int) -> DataFrame:
    """Open runs with their bytes by bucket, and in `done` the (row, first, last window) that are settled already."""
    answers = kinds.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("bucket", "n", "gone", "open"))).alias("kinds"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            if not row["kinds"]:
                continue
            runs = SharedRuns(row, n_buckets, n_out, with_bytes=True)
            gone, is_open = (_flags(row["kinds"], x) for x in ("gone", "open"))
            over = gone[runs.kind] | (runs.doc > runs.kind_doc[runs.kind])
            done = merged(runs.row[over], runs.at[over], runs.at[over] + runs.size[over] - LENGTH)
            go = np.flatnonzero(is_open[runs.kind] & ~over)
            bucket = runs.kind_bucket[runs.kind[go]]
            order = np.argsort(bucket, kind="stable")
            go, bucket = go[order], bucket[order]
            begins = np.cumsum(runs.size) - runs.size
            parts = _by_bucket(bucket) if len(go) else [(row["block"] % n_out, 0, 0)]
            carrier = row["block"] % len(parts)  # one of the block's rows takes what is settled, another one for each block
            for k, (b, a, z) in enumerate(parts):
                i = go[a:z]
                out = (
                    b, row["block"], _blob(runs.group[i]), _blob(runs.size[i].astype(np.uint32)), _blob(runs.doc[i]), _blob(runs.row[i].astype(np.uint32)), _blob(runs.at[i].astype(np.uint32)),
                    _blob(_gather(runs.data, begins[i], runs.size[i])), _blob(done) if k == carrier else b"",
                )
                yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(out, _RUNS)], schema=_RUNS)

    return placed.join(bits, "block", "left").join(answers, "block", "left").mapInArrow(run, RUNS)


# ---------------------------------------------------------------- 4: the transform and its search


def suffix_order(text: np.ndarray, depth: int = 64) -> tuple[np.ndarray, np.ndarray, int]:
    """Order of all rotations by their first `depth` symbols, and the classes by their first 8 in that order."""
    n = len(text)
    packed = np.zeros(n, _U)
    twice = np.concatenate([text, text[:8]] if n >= 8 else [np.resize(text, n + 8)]).astype(_U)
    for k in range(8):
        packed = packed << _U(8) | twice[k : k + n]
    order = np.argsort(packed, kind="stable")
    first_new = np.append(True, packed[order][1:] != packed[order][:-1])
    rank = np.empty(n, np.int64)
    rank[order] = np.cumsum(first_new) - 1
    have, short = 8, rank.copy()
    while have < depth and rank[order[-1]] < n - 1:
        key = rank.astype(_U) << _U(32) | np.roll(rank, -have).astype(_U)
        order = np.argsort(key, kind="stable")
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.append(True, key[order][1:] != key[order][:-1])) - 1
        have *= 2
    return order, short[order], 8


def equal_strings(text: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Places in suffix order, and the class of each: places are in one class if `length` bytes from there are equal.

    Classes start as those of the first 8 bytes. Then intervals are extended backward, breadth-first, as the head of the module says."""
    n = len(text)
    order, short, depth = suffix_order(text)
    bwt = text[order - 1]
    last_to_first = np.empty(n, np.int64)
    last_to_first[np.argsort(bwt, kind="stable")] = np.arange(n)
    bound = np.append(True, short[1:] != short[:-1])  # bound[i]: suffixes i - 1 and i differ within the prefix so far
    bound = np.append(bound, True)
    left = np.flatnonzero(bound[:-1])
    right = np.append(left[1:], n)
    for _ in range(depth, length):
        if not len(left):
            break
        size = right - left
        source = np.repeat(np.arange(len(left)), size)
        at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size - left, size)
        # positions of one interval with one character before them go to neighbouring places, in order
        to = last_to_first[at]
        by = np.argsort(to, kind="stable")
        to, source, char = to[by], source[by], bwt[at][by]
        starts = np.flatnonzero(np.append(True, (to[1:] != to[:-1] + 1) | (source[1:] != source[:-1]) | (char[1:] != char[:-1])))
        new_left, new_right = to[starts], to[np.append(starts[1:], len(to)) - 1] + 1
        fresh = ~bound[new_right] | ~bound[new_left]
        bound[new_right] = True
        bound[new_left] = True
        left, right = new_left[fresh], new_right[fresh]
    return order, np.cumsum(bound[:-1]) - 1


RANGES = "block long, ranges binary"


def settle(runs: DataFrame) -> DataFrame:
    """By block: (row, first, last window) of everything to remove."""

    def run(t: pa.Table) -> pa.Table:
        out: dict[int, list[np.ndarray]] = {}
        cols = {x: t.column(x).to_pylist() for x in t.column_names}
        for block, done in zip(cols["block"], cols["done"]):
            if done:
                out.setdefault(block, []).append(np.frombuffer(done, np.int64).reshape(-1, 3))
        read = lambda x, kind: np.concatenate([np.frombuffer(v, kind) for v in cols[x]])
        groups, docs = read("groups", _U), read("docs", np.int64)
        sizes, rows, places = (read(x, np.uint32).astype(np.int64) for x in ("sizes", "rows", "places"))
        owner = np.repeat(np.array(cols["block"], np.int64), [len(v) // 8 for v in cols["docs"]])
        data = b"".join(cols["bytes"])
        stops = np.cumsum(sizes)
        # equal runs are one class
        seen: dict[bytes, int] = {}
        kind = np.fromiter((seen.setdefault(data[z - s : z], len(seen)) for z, s in zip(stops.tolist(), sizes.tolist())), np.int64, len(sizes))
        least = np.full(len(seen), np.iinfo(np.int64).max)
        np.minimum.at(least, kind, docs)
        gone = docs > least[kind]

        def emit(which: np.ndarray, first: np.ndarray, last: np.ndarray) -> None:
            triples = np.stack([rows[which], first, last], axis=1)
            by = np.argsort(owner[which], kind="stable")
            blocks_, cut = np.unique(owner[which][by], return_index=True)
            for b, x in zip(blocks_.tolist(), np.split(triples[by], cut[1:])):
                out.setdefault(b, []).append(x)

        emit(np.flatnonzero(gone), places[gone], places[gone] + sizes[gone] - LENGTH)
        # unequal runs with one value, of two documents or more
        sample = np.empty(len(seen), np.int64)
        sample[kind[::-1]] = np.arange(len(kind))[::-1]
        _, g, n = np.unique(groups[sample], return_inverse=True, return_counts=True)
        low, high = np.full(len(n), np.iinfo(np.int64).max), np.full(len(n), np.iinfo(np.int64).min)
        np.minimum.at(low, g, least)
        np.maximum.at(high, g, least)
        mixed = np.flatnonzero((n[g] > 1) & (low[g] != high[g]))
        if len(mixed):
            s = sample[mixed]
            size = sizes[s]
            text = _gather(np.frombuffer(data, np.uint8), stops[s] - size, size)
            order, string = equal_strings(text)
            member = np.repeat(np.arange(len(s)), size)
            begins = np.cumsum(size) - size
            whole = np.arange(len(text)) - begins[member] + LENGTH <= size[member]  # windows inside a run
            order, string = order[whole[order]], string[whole[order]]
            doc = least[mixed][member[order]]
            smallest = np.full(int(string.max()) + 1, np.iinfo(np.int64).max)
            np.minimum.at(smallest, string, doc)
            hit = np.sort(order[doc > smallest[string]])
            if len(hit):
                new = np.append(True, (hit[1:] != hit[:-1] + 1) | (member[hit[1:]] != member[hit[:-1]]))
                first = hit[new]
                last = hit[np.append(np.flatnonzero(new)[1:], len(hit)) - 1]
                m = member[first]
                first, last = first - begins[m], last - begins[m]
                # for every place where that run stands in its smallest document
                standing = np.flatnonzero(~gone & np.isin(kind, mixed[m]))
                standing = standing[np.argsort(kind[standing], kind="stable")]
                a, z = (np.searchsorted(kind[standing], mixed[m], side) for side in ("left", "right"))
                times = z - a
                which = standing[np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times - a, times)]
                emit(which, places[which] + np.repeat(first, times), places[which] + np.repeat(last, times))
        return pa.Table.from_arrays([pa.array(list(out), pa.int64()), pa.array([_blob(np.concatenate(x)) for x in out.values()], pa.binary())], names=["block", "ranges"])

    return runs.groupBy("bucket").applyInArrow(run, RANGES)


# ---------------------------------------------------------------- result

REMOVED = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, text_sha256 string, kept binary, kept_text string"
_REMOVED = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("text_sha256", pa.string()), ("kept", pa.binary()), ("kept_text", pa.string())])


def cut(placed: DataFrame, ranges: DataFrame, with_bytes: bool, with_text: bool, carried: str) -> DataFrame:
    joined = placed.join(ranges.groupBy("block").agg(F.collect_list("ranges").alias("ranges")), "block", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            ids, valid, lengths, payload = _open(row)
            found = np.concatenate([np.frombuffer(x, np.int64).reshape(-1, 3) for x in row["ranges"] or []] or [np.empty((0, 3), np.int64)])
            begins = np.cumsum(lengths) - lengths
            first, last = begins[found[:, 0]] + found[:, 1], begins[found[:, 0]] + found[:, 2] + LENGTH
            depth = np.zeros(len(payload) + 1, np.int32)
            np.add.at(depth, first, 1)
            np.add.at(depth, last, -1)
            gone = np.cumsum(depth[:-1]) > 0
            data = np.frombuffer(payload, np.uint8)
            out = []
            for doc, known, a, n in zip(ids.tolist(), valid.tolist(), begins.tolist(), lengths.tolist()):
                mask = gone[a : a + n]
                n_removed = int(mask.sum())
                kept = payload[a : a + n] if not n_removed else data[a : a + n][~mask].tobytes()
                spans = int(mask[0]) + int((mask[1:] & ~mask[:-1]).sum()) if n else 0
                digest = hashlib.sha256(kept).hexdigest()
                before = hashlib.sha256(payload[a : a + n]).hexdigest() if n_removed else digest
                out.append((doc if known else None, n, n_removed, spans, digest, before, kept if with_bytes else None, kept.decode("utf-8", "ignore") if with_text else None))
            columns = {f.name: pa.array(c, f.type) for c, f in zip(zip(*out), _REMOVED)}
            if carried:
                others = pa.ipc.open_stream(row["carried"]).read_all().combine_chunks()
                columns |= {name: others.column(name).combine_chunks() for name in others.column_names}
            yield pa.RecordBatch.from_pydict(columns)

    return joined.mapInArrow(run, REMOVED + carried)


def remove_repeats(documents: DataFrame, with_bytes: bool = True, with_text: bool = True, carry: tuple[str, ...] = ()) -> DataFrame:
    """A row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, text_sha256 (of all bytes) and, if asked for, the
    kept bytes, the text they make (a character that was cut apart goes), and other columns as they were."""
    kinds_of = {f.name: f.dataType.simpleString() for f in documents.schema.fields}
    carried = "".join(f", `{c}` {kinds_of[c]}" for c in carry)
    packed = durable(blocks(documents, carry))
    total = packed.agg(F.sum("size")).first()[0] or 0
    n_buckets = max(16, total // 13_000_000)
    answers = durable(shared_values(packed, n_buckets))
    n_shared = answers.agg(F.sum("n_shared")).first()[0] or 0
    n_out = max(16, n_shared * 62 // BUCKET_BYTES)
    # the same exchange of blocks serves all three joins
    placed = packed.repartition("block")
    bits = answers.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("bucket", "n", "shared", "hot"))).alias("bits"))
    kinds = settled_kinds(placed, bits, n_buckets, n_out)
    ranges = settle(open_runs(placed, bits, kinds, n_buckets, n_out))
    return cut(placed, ranges, with_bytes, with_text, carried)


def op2(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), with_bytes=False, with_text=False).drop("text_sha256", "kept", "kept_text")


OP2_SQL = r"""
WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
win AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 49)) AS i FROM b WHERE len(h) >= 100)),
least_ AS (SELECT s, min(doc_id) AS m FROM win GROUP BY s),
hit AS (SELECT doc_id, i, i > coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50, -1) AS new FROM win JOIN least_ USING (s) WHERE m < doc_id),
run AS (SELECT doc_id, i, sum(new::INT) OVER (PARTITION BY doc_id ORDER BY i) AS r FROM hit),
span AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS z FROM run GROUP BY doc_id, r),
cut AS (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM span),
kept AS (SELECT doc_id, sum(z - a)::BIGINT AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || substr(any_value(h), 2 * max(z) + 1) AS k FROM cut JOIN b USING (doc_id) GROUP BY doc_id)
SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(k, h))) AS kept_sha256 FROM b LEFT JOIN kept USING (doc_id)
"""
