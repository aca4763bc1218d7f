"""Best-fit packing of tokenized documents into sequences (operator 9).

Hierarchical residual packing. Each partition packs its pieces best-fit decreasing, block by block. What is left over of each
bin counts as one item: underfull bins of several partitions meet and are packed best-fit again, in a tree of rounds whose
width falls by FAN_IN until one group is left. A group hands on at most CARRIED bins, those with the most room, so no task
sees more than FAN_IN * CARRIED items. In the last round, all bins that are still underfull, handed on or not, are taken apart
and their pieces packed all together by counts: there are at most CAPACITY lengths, so a best-fit decreasing over (length,
count) is small, and pieces take its places by their rank. It stands where it needs fewer bins.

Defined results: null or empty text is one piece that holds id 0 alone; only documents longer than a sequence are cut;
repeated rows are packed each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import durable, small, table

CAPACITY = 2048
END_ID = 0
#: A bin with less room than this is final at once; it gains too little from another round.
NEARLY_FULL = 8
FAN_IN = 16
CARRIED = 2_000
#: Pieces that a partition packs together.
BLOCK = 50_000
#: Distinct words whose ids a worker remembers.
REMEMBERED = 300_000
#: White space that the tokenizer drops and that Python can split at without changing any id.
_BLANKS = "\t\n\r"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Words of these characters alone have their pieces found without the tokenizer's slower text steps: normal forms and
#: lower case change nothing but A-Z and Latin-1 capitals in them. An apostrophe or `<|` may begin a longer piece.
_PLAIN = re.compile(r"(?!.*<\|)[!-&(-~À-ÖØ-öø-ÿ]+")
_RUN = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|[!-&(-/:-@\[-`{-~]+")


def byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, all others for characters from 256 on, in order."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = (b for b in range(256) if b not in printable)
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


class Encoder:
    """Ids of a text as little-endian unsigned 32-bit numbers. The tokenizer drops white space and treats what stands
    between as its own, so words are encoded apart and remembered."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core per task
        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        self.runs: dict[str, bytes] = {}
        self.letters = byte_letters()
        text = json.loads(self.tokenizer.to_str())
        kinds = [x["type"] for x in text["pre_tokenizer"].get("pretokenizers", [text["pre_tokenizer"]])]
        #: The short way holds for this kind of tokenizer only.
        self.plain = kinds == ["Split", "ByteLevel"] and text["model"]["type"] == "BPE" and any(x["type"] == "Lowercase" for x in text["normalizer"].get("normalizers", []))

    def run(self, run: str) -> bytes:
        if run not in self.runs:
            if len(self.runs) > REMEMBERED:
                self.runs.clear()
            spelled = run if run.isascii() else "".join(self.letters[b] for b in run.encode())
            self.runs[run] = b"".join(t.id.to_bytes(4, "little") for t in self.tokenizer.model.tokenize(spelled))
        return self.runs[run]

    def word(self, word: str) -> bytes:
        if self.plain and _PLAIN.fullmatch(word):
            return b"".join(map(self.run, _RUN.findall(word.lower())))
        return b"".join(i.to_bytes(4, "little") for i in self.tokenizer.encode(word, add_special_tokens=False).ids)

    def ids(self, text: str | None) -> bytes:
        text = text or ""
        for blank in _BLANKS:
            text = text.replace(blank, " ")
        words = [w for w in text.split(" ") if w]
        known = self.known
        try:
            return b"".join(map(known.__getitem__, words))
        except KeyError:
            if len(known) > REMEMBERED:
                known.clear()
            for w in set(words):
                if w not in known:
                    known[w] = self.word(w)
            return b"".join(map(known.__getitem__, words))


_encoders: dict[str, Encoder] = {}


def encoder_of(path: str) -> Encoder:
    """The worker's encoder for a tokenizer file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def best_fit(sizes: list[int], capacity: int = CAPACITY) -> tuple[list[int], list[int], list[int]]:
    """Best-fit decreasing: the bin and the offset of each item, and the fill of each bin. A set of used room values,
    kept as the bits of one number, gives the tightest bin at once."""
    bins, offsets, fill = [0] * len(sizes), [0] * len(sizes), []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0
    for item in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        size = sizes[item]
        if fitting := rooms >> size:
            room = size + (fitting & -fitting).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            b, room = len(fill), capacity
            fill.append(0)
        bins[item], offsets[item] = b, fill[b]
        fill[b] += size
        if room := room - size:
            by_room[room].append(b)
            rooms |= 1 << room
    return bins, offsets, fill


OUT = ("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
#: Sequences of the last round are numbered from here on; others have the number of a partition's bin.
NEW_BINS = 1 << 62
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, bin long, at long, fill long, open boolean"
PIECES_ARROW = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("bin", pa.int64()), ("at", pa.int64()), ("fill", pa.int64()), ("open", pa.bool_())])


def emptiest(fill: list[int]) -> set[int]:
    """The bins to hand on to the next round: not nearly full, those with the most room first. Others wait for the last."""
    return set(sorted((b for b in range(len(fill)) if CAPACITY - fill[b] >= NEARLY_FULL), key=lambda b: (fill[b], b))[:CARRIED])


def _pack_block(rows: list[tuple], first_bin: int) -> pa.RecordBatch:
    bins, offsets, fill = best_fit([r[3] for r in rows])
    handed = emptiest(fill)
    columns = [*zip(*rows), [first_bin + b for b in bins], offsets, [fill[b] for b in bins], [b in handed for b in bins]]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, PIECES_ARROW)], schema=PIECES_ARROW)


def local_pieces(documents: DataFrame, tokenizer: str) -> DataFrame:
    """Pieces of all documents with their bin, the place in it and the bin's fill, packed inside each partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = encoder_of(tokenizer), END_ID.to_bytes(4, "little")
        next_bin = TaskContext.get().partitionId() << 40
        rows: list[tuple] = []
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                ids = encoder.ids(text.as_py()) + end
                for piece, at in enumerate(range(0, len(ids), 4 * CAPACITY)):
                    part = ids[at : at + 4 * CAPACITY]
                    rows.append((doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part)))
            if len(rows) >= BLOCK:
                yield _pack_block(rows, next_bin)
                next_bin += len(rows)
                rows = []
        if rows:
            yield _pack_block(rows, next_bin)

    return documents.select("doc_id", "text").mapInArrow(run, PIECES)


MOVES = "bin long, root long, at long, fill long, open boolean"
MOVES_ARROW = pa.schema([("bin", pa.int64()), ("root", pa.int64()), ("at", pa.int64()), ("fill", pa.int64()), ("open", pa.bool_())])


def _merge_round(bins: DataFrame, groups: int) -> DataFrame:
    """bins: bin, fill, group. Each group's bins are items of a best-fit; a row says where in which root a bin went,
    and whether that root is handed on."""

    def run(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by("bin")
        ids, sizes = t.column("bin").to_pylist(), t.column("fill").to_pylist()
        to, at, fill = best_fit(sizes)
        root = [-1] * len(fill)
        for i, b in enumerate(to):
            if root[b] < 0:
                root[b] = ids[i]
        handed = emptiest(fill)
        return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip((ids, [root[b] for b in to], at, [fill[b] for b in to], [b in handed for b in to]), MOVES_ARROW)], schema=MOVES_ARROW)

    return bins.withColumn("group", F.col("group") % groups).groupBy("group").applyInArrow(run, MOVES)


def best_fit_counts(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Best-fit decreasing of counts[size] items of each size: (size, rank, n, instance, each, at) says that the n items from
    that rank on go to bins from that instance on, `each` to a bin, the first at that offset. Like bins are one entry. Also the number of bins."""
    by_room: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # (first instance, how many)
    places, rooms, n_bins = [], 0, 0
    for size in sorted(counts, reverse=True):
        rank, left = 0, counts[size]
        while left:
            if fitting := rooms >> size:
                room = size + (fitting & -fitting).bit_length() - 1
                first, many = by_room[room].pop()
                if not by_room[room]:
                    rooms &= ~(1 << room)
            else:
                room, first, many = capacity, n_bins, -(-left // (capacity // size))
                n_bins += many
            each = min(room // size, left)
            take = min(many, left // each)
            places.append((size, rank, take * each, first, each, capacity - room))
            rank, left = rank + take * each, left - take * each
            for r, f, m in ((room - each * size, first, take), (room, first + take, many - take)):
                if m and r:
                    by_room[r].append((f, m))
                    rooms |= 1 << r
    return places, n_bins


def _repacked(pieces: DataFrame, places: list[tuple]) -> DataFrame:
    """pieces, of unique (bin, local), with the sequence and offset that `places` has for them."""
    places = pieces.sparkSession.createDataFrame(places, "_length long, _from long, _n long, _first long, _each long, _at long")
    # ranks within a length: those of a part, after the parts before it
    pieces = pieces.withColumn("part", F.shiftright(F.col("bin"), 40))
    parts = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = parts.select("length", "part", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
    ranked = pieces.withColumn("rank", F.row_number().over(Window.partitionBy("length", "part").orderBy("bin", "local")) - 1)
    ranked = ranked.join(before, ["length", "part"]).withColumn("rank", F.col("rank") + F.col("before"))
    within = F.col("rank") - F.col("_from")
    placed = ranked.join(F.broadcast(places), (F.col("length") == F.col("_length")) & within.between(F.lit(0), F.col("_n") - 1))
    return placed.withColumn("sequence_id", F.lit(NEW_BINS) + F.floor(within / F.col("_each")) + F.col("_first")).withColumn("offset", F.col("_at") + within % F.col("_each") * F.col("length"))


def pack(documents: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = durable(local_pieces(documents, tokenizer or default_tokenizer()))
    group = F.shiftright(F.col("bin"), 40)
    rooms = pieces.filter("open").select("bin", "fill").distinct()
    open_bins = durable(rooms.select("bin", "fill", group.alias("group")))
    underfull = F.col("fill") <= CAPACITY - NEARLY_FULL
    rest = pieces.filter(~F.col("open") & underfull).select("bin", "fill").distinct()
    width = (open_bins.agg(F.max("group")).first()[0] or 0) + 1
    moved = None  # bin, root, at: where each bin of the first level is now
    while True:
        groups = -(-width // FAN_IN)
        # neighbours in number meet: group g takes FAN_IN consecutive ones
        step = durable(_merge_round(open_bins.withColumn("group", F.floor(F.col("group") / FAN_IN)), groups))
        if moved is None:
            moved = step.select("bin", "root", "at")
        else:
            on = step.select(F.col("bin").alias("root"), F.col("root").alias("_root"), F.col("at").alias("_at"))
            moved = moved.join(on, "root", "left").select("bin", F.coalesce("_root", "root").alias("root"), (F.col("at") + F.coalesce("_at", F.lit(0))).alias("at"))
        moved = durable(moved)
        heads = step.filter(F.col("bin") == F.col("root"))
        rest = rest.unionByName(heads.filter(underfull if groups == 1 else ~F.col("open") & underfull).select("bin", "fill"))
        if groups == 1:
            break
        heads = heads.filter("open")
        level = open_bins.select("bin", F.floor(F.col("group") / FAN_IN).alias("group"))
        open_bins = heads.select("bin", "fill").join(level, "bin")
        width = groups
    rest = durable(rest)
    here = pieces.withColumnRenamed("at", "local").join(moved, "bin", "left")
    here = here.withColumn("sequence_id", F.coalesce("root", "bin")).withColumn("offset", F.col("local") + F.coalesce("at", F.lit(0)))
    here = here.join(small(rest.select(F.col("bin").alias("sequence_id"), F.lit(True).alias("loose"))), "sequence_id", "left")
    here = durable(here.select(*OUT, "bin", "local", F.coalesce("loose", F.lit(False)).alias("loose")))
    loose = here.filter("loose")
    counts = {r.length: r.n for r in loose.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most CAPACITY rows
    places, n_bins = best_fit_counts(counts)
    if n_bins >= rest.count():
        return here.select(*OUT)
    return here.filter(~F.col("loose")).select(*OUT).unionByName(_repacked(loose.drop("sequence_id", "offset"), places).select(*OUT))


def op9(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
