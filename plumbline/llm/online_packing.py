"""Bounded-space online packing of tokenized documents into windows (operator 11).

Each partition reads its documents once, in order, with WINDOWS open windows. A document, as long as what is left of it is longer than a
window, fills windows of its own. The rest goes where it fits best; where none fits and no further window may be opened, the fullest one is
filled up with the rest's head and emitted, so emitted windows are full. What is in the open windows at a partition's end meets
that of other partitions, FAN_IN at a time, longest pieces first, packed in the same way in a tree of rounds. The last round
closes its windows: their pieces one after another fill whole windows, and the end is cut into powers of two, which need no padding.
Ids travel only with pieces of open windows, so a task holds at most FAN_IN * WINDOWS windows beside a document.

Defined results: null or empty text is one piece that holds id 1 alone; a text is encoded whole, and strings of special tokens in
it count as those tokens, as the tokenizer does by default; repeated rows are packed each; a null doc_id stays null; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import durable, table
from plumbline.llm.packing import byte_letters

CAPACITY = 2048
END_ID = 1
#: Open windows of a task.
WINDOWS = 64
FAN_IN = 16
#: Distinct words whose ids a worker remembers.
REMEMBERED = 600_000
#: Rows that a task hands to Spark at a time.
ROWS = 20_000
_WIDTH = 4

#: Characters of words that take the short way, beside line ends: the libraries agree on what they are.
_PLAIN = re.compile("[!-~A-Za-zÀ-ÖØ-öø-ſЀ-ҁ\n]+")
#: A mark at the end of a word, after one of these, is a piece of its own.
_MARKS, _BEFORE_MARK = ",.", frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")
#: A blank that begins a word: nothing joins the texts on its two sides. Other blanks are found with the rest of their piece.
_BEFORE_WORD = re.compile(r"(?= \S)")
_OTHER_BLANKS = [f" {c}" for c in map(chr, range(0x3001)) if c.isspace()]
#: How the tokenizer splits text.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class ByteEncoder:
    """Ids of a text as little-endian unsigned 32-bit numbers, by a byte-level BPE tokenizer. Words with the blank before them
    are encoded apart and remembered; those of plain characters by tiktoken, from the ranks that the tokenizer's own file gives."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core per task
        self.tokenizer = Tokenizer.from_file(path)
        self.words: dict[str, bytes] = {}
        text = json.loads(self.tokenizer.to_str())
        self.special = [t["content"] for t in text["added_tokens"]]
        before, model = text["pre_tokenizer"], text["model"]
        #: The short way holds for this kind of tokenizer only: pieces stand alone, and ids of merges rise in the merges' order.
        merged = [model["vocab"]["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in model.get("merges", [])]
        self.short = text["normalizer"] is None and model["type"] == "BPE" and before["type"] == "ByteLevel" and not before["add_prefix_space"] and before.get("use_regex", True)
        self.short = self.short and not model.get("ignore_merges") and merged == sorted(merged)
        if self.short:
            import tiktoken

            byte = {letter: b for b, letter in byte_letters().items()}
            ranks = {bytes(map(byte.__getitem__, t)): i for t, i in model["vocab"].items() if t not in self.special}
            self.plain = tiktoken.Encoding("words", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
            self.marks = {m: self.whole(m) for m in _MARKS}
            self.begins = np.zeros(max(ranks.values()) + 1, bool)
            self.begins[[i for t, i in ranks.items() if t[:1] == b" "]] = True

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def piece(self, piece: str) -> bytes:
        """Ids of a text's head, or of a piece that begins with a blank before a word."""
        if _PLAIN.fullmatch(piece, 1 if piece[:1] == " " else 0):
            return array("I", self.plain(piece)).tobytes()
        return self.whole(piece)

    def learn(self, words: set[str]) -> None:
        """Remembers words with the blank before them. Plain ones are encoded in one text: a token that begins with a blank begins a word there."""
        known = self.words
        marked = [w for w in words if w[-1] in _MARKS and w[-2:-1] in _BEFORE_MARK]
        fresh = [w for w in words.difference(marked).union(w[:-1] for w in marked) if w not in known]
        if plain := [w for w in fresh if _PLAIN.fullmatch(w)]:
            ids = np.array(self.plain(" " + " ".join(plain)), "<u4")
            starts, ids = (_WIDTH * np.append(np.flatnonzero(self.begins[ids]), len(ids))).tolist(), ids.tobytes()
            known.update((w, ids[a:z]) for w, a, z in zip(plain, starts, starts[1:]))
        known.update((w, self.whole(f" {w}")) for w in fresh if w not in known)
        known.update([(w, known[w[:-1]] + self.marks[w[-1]]) for w in marked])

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.short or any(s in text for s in self.special):
            return self.whole(text)
        if text[0] == " " or text[-1] == " " or any(b in text for b in _OTHER_BLANKS):
            return b"".join(map(self.piece, _BEFORE_WORD.split(text)))
        head, *words = text.split(" ")
        if missing := set(words).difference(self.words):
            if len(self.words) > REMEMBERED:
                self.words.clear()
                missing = set(words)
            self.learn(missing)
        return self.piece(head) + b"".join(map(self.words.__getitem__, words))


_encoders: dict[str, ByteEncoder] = {}


def encoder_of(path: str) -> ByteEncoder:
    """The worker's encoder for a tokenizer file."""
    if path not in _encoders:
        _encoders[path] = ByteEncoder(path)
    return _encoders[path]


#: A piece: doc_id, start, doc_tokens, ids.
Piece = tuple
#: A placed piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and its ids where its window is still open.
PLACED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary, task int"
PLACED_ARROW = pa.schema([*[(c, pa.int64()) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")], ("ids", pa.binary()), ("task", pa.int32())])
OUT = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def first_sequence(level: int, task: int) -> int:
    """Numbers of a task's sequences begin here: rounds and tasks have their own."""
    return level << 56 | task << 24


class Packer:
    """Open windows of one task."""

    def __init__(self, first: int, capacity: int = CAPACITY, windows: int = WINDOWS):
        self.next, self.capacity, self.most = first, capacity, windows
        self.open: list[list[Piece]] = []
        self.room: list[int] = []
        self.placed: list[tuple] = []

    def emit(self, pieces: list[Piece], keep: bool = False) -> None:
        at = 0
        for doc_id, start, doc_tokens, ids in pieces:
            n = len(ids) // _WIDTH
            self.placed.append((doc_id, start, n, zlib.crc32(ids), doc_tokens, self.next, at, ids if keep else None))
            at += n
        self.next += 1

    def add(self, piece: Piece) -> None:
        doc_id, start, doc_tokens, ids = piece
        n, whole = len(ids) // _WIDTH, self.capacity * _WIDTH
        while n >= self.capacity:
            self.emit([(doc_id, start, doc_tokens, ids[:whole])])
            start, ids, n = start + self.capacity, ids[whole:], n - self.capacity
        if not n:
            return
        fitting = [(room, w) for w, room in enumerate(self.room) if room >= n]
        if not fitting and len(self.open) == self.most:
            w = min(range(self.most), key=self.room.__getitem__)
            room = self.room[w]
            self.emit([*self.open.pop(w), (doc_id, start, doc_tokens, ids[: room * _WIDTH])])
            self.room.pop(w)
            start, ids, n = start + room, ids[room * _WIDTH :], n - room
        elif fitting:
            room, w = min(fitting)
            self.open[w].append((doc_id, start, doc_tokens, ids))
            self.room[w] = room - n
            if room == n:
                self.emit(self.open.pop(w))
                self.room.pop(w)
            return
        self.open.append([(doc_id, start, doc_tokens, ids)])
        self.room.append(self.capacity - n)

    def close(self, last: bool) -> None:
        """Hands on what the open windows hold, or, in the last round, cuts it into whole windows and powers of two."""
        if not last:
            for pieces in self.open:
                self.emit(pieces, keep=True)
            self.open = []
            return
        pieces = [p for w in self.open for p in w]
        left = sum(len(p[3]) // _WIDTH for p in pieces)
        window: list[Piece] = []
        size = room = min(self.capacity, 1 << left.bit_length() - 1) if left else 0
        for doc_id, start, doc_tokens, ids in pieces:
            while ids:
                part, ids = ids[: room * _WIDTH], ids[room * _WIDTH :]
                window.append((doc_id, start, doc_tokens, part))
                n = len(part) // _WIDTH
                start, room = start + n, room - n
                if not room:
                    self.emit(window)
                    window, left = [], left - size
                    size = room = min(self.capacity, 1 << left.bit_length() - 1) if left else 0
        self.open = []

    def batch(self, task: int) -> pa.RecordBatch:
        columns = [*zip(*self.placed), [task] * len(self.placed)]
        self.placed = []
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, PLACED_ARROW)], schema=PLACED_ARROW)


def local_pieces(documents: DataFrame, tokenizer: str) -> DataFrame:
    """All documents, packed inside each partition; pieces of windows that stay open have their ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        encoder, end, packer = encoder_of(tokenizer), END_ID.to_bytes(_WIDTH, "little"), Packer(first_sequence(0, task))
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                ids = encoder.ids(text.as_py()) + end
                packer.add((doc_id, 0, len(ids) // _WIDTH, ids))
                if len(packer.placed) >= ROWS:
                    yield packer.batch(task)
        packer.close(False)
        if packer.placed:
            yield packer.batch(task)

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PLACED)


def merged(pieces: DataFrame, level: int, last: bool) -> DataFrame:
    """Pieces of open windows, packed FAN_IN tasks at a time."""

    def run(key: tuple, t: pa.Table) -> pa.Table:
        task = key[0].as_py()
        packer = Packer(first_sequence(level, task))
        rows = t.select(["doc_id", "start", "doc_tokens", "ids", "sequence_id", "offset"]).to_pylist()
        for r in sorted(rows, key=lambda r: (-len(r["ids"]), r["sequence_id"], r["offset"])):
            packer.add((r["doc_id"], r["start"], r["doc_tokens"], r["ids"]))
        packer.close(last)
        return pa.Table.from_batches([packer.batch(task)])

    return pieces.withColumn("group", F.floor(F.col("task") / FAN_IN).cast("int")).groupBy("group").applyInArrow(run, PLACED)


def pack_online(documents: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    step = durable(local_pieces(documents, tokenizer or default_tokenizer()))
    done = step.filter("ids IS NULL").select(*OUT)
    tasks = (step.agg(F.max("task")).first()[0] or 0) + 1
    level = 0
    while True:
        level, tasks = level + 1, -(-tasks // FAN_IN)
        step = durable(merged(step.filter("ids IS NOT NULL"), level, tasks == 1))
        done = done.unionByName(step.filter("ids IS NULL").select(*OUT))
        if tasks == 1:
            return done


def op11(spark, sf_dir: str) -> DataFrame:
    return pack_online(table(spark, sf_dir, "documents"))
