"""MinHash near-duplicate groups by an LSH forest (operator 10).

1. Every text becomes its set of 5-word shingles (64-bit hashes) and a MinHash signature of TREES x DEPTH values. Texts with
   one set are one class from here on, so groups of copies of any size count as one row.
2. Each tree sorts all signatures by its own DEPTH values, across the cluster. The rows beside a row share the longest
   prefixes with it; each row's two best neighbours are confirmed on full shingle sets, and groups are the connected
   components of confirmed links (large star, small star), computed by joins. This settles crowds of copies.
3. What is left is a question of regions: all rows of a tree that share its first SHARED values. Two texts of the
   threshold's similarity s share a region of one tree at least, but for a chance of (1 - s ** SHARED) ** TREES: 5e-9 at
   0.85, 6e-7 at 0.8. In a region, pairs of different groups are compared by the parity of their shingles' hash bits, a
   bound that never rules out a true link. Depth adapts to the region: one in which more than REGION rows
   are outside its largest group is walked again with deeper keys and more trees (LEVELS), which keeps that chance below 1e-6;
   what stays crowded at the last level is dealt in blocks of rows, two by two. A region gives all pairs that the bound leaves where
   they are few for its rows (EACH), so that it is walked once, else a spanning forest of them; the pairs are confirmed, and regions with a
   pair of a forest that fails give another one while that finds links, up to FORESTS, then all their pairs.

So no row has a limit on partners. A crowd of texts that differ from each other by little more than the threshold allows, without
links to merge them, is compared row by row in blocks: its cost grows with the square of its distinct texts.

Defined results: null or empty text and text of white space alone has no shingles and is a group of its own; fewer than 5
words are one shingle; rows with the same doc_id are one document; a null doc_id is linked with nothing and kept; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import gathered, parts_of, small, table

SHINGLE = 5
TREES, DEPTH = 20, 5
#: Rows on either side of a row that are looked at first.
BESIDE = 2
#: Values of a tree that make a region.
SHARED = 3
#: Rows outside a region's largest group that one task compares with the rest of it.
REGION = 4096
#: Values and trees of the regions that follow where a region is crowded: a pair at 0.8 is missed with a chance of 5e-7.
LEVELS = ((6, 48),)
#: A region with at most so many pairs a row that the bound leaves gives all of them at once; others give spanning forests.
EACH = 4
#: Spanning forests of a region that are tried before all of its pairs are.
FORESTS = 4
#: Link when 100 * intersection >= similarity * union; this is what the operator's query asks for.
SIMILARITY = 85
SEED = 97
#: Distinct words whose hashes a worker remembers.
REMEMBERED = 250_000

_U = np.uint64
_PLACE = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], _U)  # odd multipliers, one for each place
_words: dict[bytes, int] = {}


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _U(0x7FB5D329728EA185)
    x = (x ^ (x >> _U(27))) * _U(0x81DADEF4BC2DD44D)
    return x ^ (x >> _U(33))


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the 5-word shingles; of the whole sequence if it is shorter."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return np.empty(0, _U)
    try:
        h = np.fromiter(map(_words.__getitem__, words), _U, len(words))
    except KeyError:
        if len(_words) > REMEMBERED:
            _words.clear()
        for w in set(words):
            if w not in _words:
                _words[w] = xxhash.xxh64_intdigest(w)
        h = np.fromiter(map(_words.__getitem__, words), _U, len(words))
    if len(h) < SHINGLE:
        return _mix((h * _PLACE[: len(h)]).sum(dtype=_U, keepdims=True) + _U(len(h)))
    n = len(h) - SHINGLE + 1
    total = h[:n] * _PLACE[0]
    for k in range(1, SHINGLE):
        total += h[k : k + n] * _PLACE[k]
    return np.unique(_mix(total))


def _functions(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.RandomState(seed)
    return (r.randint(0, 2**32, n, np.uint64) << _U(32) | r.randint(0, 2**32, n, np.uint64)) | _U(1), r.randint(0, 2**63, n, np.uint64)


_FOREST = _functions(TREES * DEPTH, SEED)


def signature(shingles: np.ndarray, functions: tuple[np.ndarray, np.ndarray] = _FOREST) -> np.ndarray:
    """The minimum of each function, 32 bits each."""
    a, b = functions
    best = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(shingles), 1024):
        values = (shingles[at : at + 1024, None] * a + b) >> _U(32)
        best = np.minimum(best, values.min(axis=0).astype(np.uint32))
    return best


def parity(shingles: np.ndarray) -> bytes:
    """Bits, four or more for each shingle, at most 2 ** 16; each is the parity of the shingles that fall on it. Two sets differ in as many shingles
    at least as their bits differ."""
    n_bits = 1 << min(16, max(9, (4 * len(shingles) - 1).bit_length()))
    at = (_mix(shingles + _U(0x3C79AC492BA7B653)) & _U(n_bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=n_bits) & 1).astype(np.uint8)).tobytes()


SIGNED = "doc_id long, n_shingles long, h1 long, h2 long, sig binary, bits binary"


def signatures(documents: DataFrame) -> DataFrame:
    """Per row: set size, two hashes of the whole set, the signature (big-endian) and the parities."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, h1, h2, sigs, bits = [], [], [], [], []
            for text in b.column(1):
                s = shingle_set(text.as_py())
                n.append(len(s))
                h1.append(s.sum(dtype=_U))
                h2.append(_mix(s ^ _U(0x5851F42D4C957F2D)).sum(dtype=_U))
                sigs.append(signature(s).astype(">u4").tobytes())
                bits.append(parity(s))
            signed = lambda x: pa.array(np.array(x, _U).view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), signed(h1), signed(h2), pa.array(sigs, pa.binary()), pa.array(bits, pa.binary())], names=["doc_id", "n_shingles", "h1", "h2", "sig", "bits"])

    return documents.select("doc_id", "text").mapInArrow(run, SIGNED)


SCANNED = "a long, b long, shared int, tree int, key binary, id long"
_SCANNED = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("shared", pa.int32()), ("tree", pa.int32()), ("key", pa.binary()), ("id", pa.int64())])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by (tree, key, id): pairs of neighbours in one region with the length of their common prefix, and the rows of
    regions of two rows or more (of any number at the edges of the partition, where a region may go on in another)."""

    def members(tree: np.ndarray, key: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
        keys = pa.array([k.tobytes() for k in key[:, :SHARED]], pa.binary())
        return pa.RecordBatch.from_arrays([*(pa.nulls(len(tree), f.type) for f in list(_SCANNED)[:3]), pa.array(tree, pa.int32()), keys, pa.array(ids)], schema=_SCANNED)

    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = batch.column(0).to_numpy(), np.frombuffer(b"".join(batch.column(1).to_pylist()), ">u4").reshape(-1, DEPTH), batch.column(2).to_numpy()
        old = 0
        if held is None:
            yield members(*(x[:1] for x in rows))
        else:
            old = len(held[0])
            rows = tuple(np.concatenate(x) for x in zip(held, rows))
        tree, key, ids = rows
        held = tuple(x[-BESIDE:] for x in rows)
        same = np.append((tree[1:] == tree[:-1]) & (key[1:, :SHARED] == key[:-1, :SHARED]).all(axis=1), False)  # with the next row
        region = np.flatnonzero(same | np.append(False, same[:-1]))
        region = region[(region >= max(old - 1, 0)) & (region < len(tree) - 1)]
        if len(region):
            yield members(tree[region], key[region], ids[region])
        for by in range(1, BESIDE + 1):
            i = np.arange(max(old, by), len(tree))
            prefix = np.cumprod(key[i] == key[i - by], axis=1).sum(axis=1)
            good = (tree[i] == tree[i - by]) & (prefix >= SHARED) & (ids[i] != ids[i - by])
            i, prefix = i[good], prefix[good]
            if len(i):
                a, b = np.minimum(ids[i], ids[i - by]), np.maximum(ids[i], ids[i - by])
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(prefix, pa.int32()), *(pa.nulls(len(i), f.type) for f in list(_SCANNED)[3:])], schema=_SCANNED)
    if held is not None:
        yield members(*(x[-1:] for x in held))


def forest(classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """classes: id, sig. Neighbours a < b with the sum of their common prefixes; and (tree, key, id) of regions that may hold two rows."""
    order = ["tree", "key", "id"]
    trees = F.explode(F.array(*[F.struct(F.lit(t).alias("tree"), F.substring("sig", 4 * DEPTH * t + 1, 4 * DEPTH).alias("key")) for t in range(TREES)]))
    rows = classes.select(trees.alias("t"), "id").select("t.tree", "t.key", "id")
    scanned = gathered(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_scan, SCANNED))
    beside = scanned.filter(F.col("a").isNotNull()).groupBy("a", "b").agg(F.sum("shared").alias("shared"))
    return beside, scanned.filter(F.col("key").isNotNull()).select(*order).distinct()


def deeper(documents: DataFrame, ids: DataFrame, depth: int, trees: int) -> DataFrame:
    """(tree, key, id) of the documents in ids (id, of any number) by `trees` other trees; a key has `depth` values."""
    functions = _functions(depth * trees, SEED + depth)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                values = signature(shingle_set(text.as_py()), functions).reshape(trees, depth)
                keys = pa.array([v.tobytes() for v in values], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(range(trees), pa.int32()), keys, pa.array([doc_id] * trees, pa.int64())], names=["tree", "key", "id"])

    texts = documents.select("doc_id", "text").join(small(gathered(ids.select(F.col("id").alias("doc_id")).distinct())), "doc_id", "left_semi")
    return texts.mapInArrow(run, "tree int, key binary, id long").distinct()


#: Bytes of bits that are compared at a time.
COMPARED_BYTES = 4_000_000


class Compared:
    """Rows of regions, with bit matrices by length; `apart` bounds the number of shingles in which pairs of rows differ."""

    def __init__(self, bits: list[bytes]):
        size = np.array([len(x) for x in bits], np.int64)
        self.size, self.place, self.rows = size, np.empty(len(bits), np.int64), {}
        for n in np.unique(size).tolist():
            which = np.flatnonzero(size == n)
            self.place[which] = np.arange(len(which))
            self.rows[n] = np.frombuffer(b"".join(bits[i] for i in which), _U).reshape(len(which), -1)
        self.folded = {n: self._fold(x) for n, x in self.rows.items()}
        # parities of fewer bits are a weaker bound, but read a quarter of the bytes
        self.coarse = {n: self._fold(self.folded[n]) for n in self.rows if n >= 256}
        self.coarser = {n: self._fold(x) for n, x in self.coarse.items()}

    @staticmethod
    def _fold(x: np.ndarray) -> np.ndarray:
        return x[:, : x.shape[1] // 2] ^ x[:, x.shape[1] // 2 :]

    def may(self, i: np.ndarray, j: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """Which pairs may differ in `limit` shingles or fewer, by the coarse parities."""
        out = np.ones(len(i), bool)
        low, high = np.where(self.size[i] <= self.size[j], i, j), np.where(self.size[i] <= self.size[j], j, i)
        for n, rows in self.coarse.items():
            for m, other in ((n, rows), (2 * n, self.coarser.get(2 * n))):
                at = np.flatnonzero((self.size[low] == n) & (self.size[high] == m))
                step = max(1, 4 * COMPARED_BYTES // n)
                for k in range(0, len(at), step):
                    x = at[k : k + step]
                    out[x] = np.bitwise_count(rows[self.place[low[x]]] ^ other[self.place[high[x]]]).sum(axis=1, dtype=np.int64) <= limit[x]
        return out

    def apart(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i), np.int64)
        low, high = np.where(self.size[i] <= self.size[j], i, j), np.where(self.size[i] <= self.size[j], j, i)
        for n in self.rows:
            for other in (self.rows, self.folded):
                m = n if other is self.rows else 2 * n
                at = np.flatnonzero((self.size[low] == n) & (self.size[high] == m))
                step = max(1, COMPARED_BYTES // n)
                for k in range(0, len(at), step):
                    x = at[k : k + step]
                    out[x] = np.bitwise_count(self.rows[n][self.place[low[x]]] ^ other[m][self.place[high[x]]]).sum(axis=1, dtype=np.int64)
        return out


PAIRS = "tree int, key binary, a long, b long, whole boolean"
_PAIRS = pa.schema([("tree", pa.int32()), ("key", pa.binary()), ("a", pa.int64()), ("b", pa.int64()), ("whole", pa.bool_())])
#: Rows of whole regions that are compared at a time, at least.
TOGETHER = 4_000


def _compare(batches: Iterator[pa.RecordBatch], similarity: int, attempt: int | None) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by region: pairs of different groups that may be similar enough. All of a region's (whole) if they are few or attempt is
    None; else as many as join the groups that they can join, the likeliest first (attempt 0) or others (further attempts)."""

    def pairs_of(t: pa.Table) -> Iterator[pa.RecordBatch]:
        cols = {x: t.column(x).combine_chunks() for x in t.column_names}
        region, ids, root, n = (cols[x].to_numpy() for x in ("region", "id", "root", "n"))
        minor = cols["minor"].to_numpy(zero_copy_only=False)
        rows = Compared(cols["bits"].to_pylist())
        starts = np.flatnonzero(np.append(True, region[1:] != region[:-1]))
        stops = np.append(starts[1:], len(region))
        sizes = np.repeat(stops - starts, stops - starts)
        few = sizes <= 64

        def good(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            keep = (root[i] != root[j]) & (100 * np.minimum(n[i], n[j]) >= similarity * np.maximum(n[i], n[j]))
            i, j = i[keep], j[keep]
            keep = rows.may(i, j, (100 - similarity) * (n[i] + n[j]) // (100 + similarity))
            i, j = i[keep], j[keep]
            apart = rows.apart(i, j)
            keep = (100 + similarity) * apart <= (100 - similarity) * (n[i] + n[j])
            return i[keep], j[keep], apart[keep]

        found = []
        for by in range(1, min(64, int((stops - starts).max()))):
            i = np.flatnonzero(few[by:] & (region[by:] == region[:-by])) + by
            if len(i):
                found.append(good(i, i - by))
        for a, z in zip(starts.tolist(), stops.tolist()):
            if z - a > 64:
                everyone, some = np.arange(a, z), np.flatnonzero(minor[a:z]) + a
                step = max(1, 100_000 // (z - a))
                for k in range(0, len(some), step):
                    i, j = np.repeat(some[k : k + step], z - a), np.tile(everyone, len(some[k : k + step]))
                    once = ~minor[j] | (i < j)
                    found.append(good(i[once], j[once]))
        if not found:
            return
        i, j, apart = (np.concatenate(x) for x in zip(*found))
        whole = np.ones(len(i), bool)
        if attempt is not None:
            number = np.repeat(np.arange(len(starts)), stops - starts)
            whole = (np.bincount(number[i], minlength=len(starts)) <= EACH * (stops - starts))[number[i]]
            mixed = _mix((ids[i] * 31 + ids[j]).astype(_U) + _PLACE[:1] * _U(attempt))
            order = np.lexsort((apart if attempt == 0 else mixed, region[i]))
            above: dict[tuple[int, int], tuple[int, int]] = {}

            def top(x: tuple[int, int]) -> tuple[int, int]:
                while x in above:
                    x = above[x]
                return x

            taken = np.flatnonzero(whole).tolist()
            for k in order[~whole[order]].tolist():
                x, y = top((region[i[k]], root[i[k]])), top((region[j[k]], root[j[k]]))
                if x != y:
                    above[x] = y
                    taken.append(k)
            i, j, whole = i[taken], j[taken], whole[taken]
        if len(i):
            at = pa.array(i)
            yield pa.RecordBatch.from_arrays([cols["tree"].take(at), cols["key"].take(at), pa.array(np.minimum(ids[i], ids[j])), pa.array(np.maximum(ids[i], ids[j])), pa.array(whole)], schema=_PAIRS)

    held: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        held.append(b)
        size += b.num_rows
        if size < TOGETHER:
            continue
        t = pa.Table.from_batches(held)
        region = t.column("region").to_numpy()
        done = np.flatnonzero(region != region[-1])
        if len(done):
            ready = int(done[-1]) + 1
            yield from pairs_of(t.slice(0, ready).combine_chunks())
            held = t.slice(ready).combine_chunks().to_batches()
            size = t.num_rows - ready
    if size:
        yield from pairs_of(pa.Table.from_batches(held))


def compared(members: DataFrame, regions: DataFrame, classes: DataFrame, similarity: int, attempt: int | None) -> DataFrame:
    """members: tree, key, id, root; regions: tree, key, main, n_rows, n_minor; classes: id, n_shingles, bits. Pairs as _compare has them.

    Rows of the region's largest group are dealt in blocks, the others go to each block; with more than REGION others, all rows are
    dealt in blocks that meet two by two."""
    here = members.join(small(regions), ["tree", "key"]).withColumn("minor", F.col("root") != F.col("main"))
    own, every = F.pmod(F.xxhash64("id"), F.col("_blocks")), F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)
    here = here.withColumn("_blocks", F.ceil(F.col("n_rows") / F.lit(REGION // 2)).cast("long"))
    crowded = F.col("n_minor") > REGION
    two = F.transform(F.filter(every, lambda x: x != own), lambda x: F.least(x, own) * F.col("_blocks") + F.greatest(x, own))
    parts = F.when(F.col("n_rows") <= REGION, F.array(F.lit(0).cast("long"))).when(crowded, two).when(F.col("minor"), every).otherwise(F.array(own))
    here = here.withColumn("part", F.explode(parts)).join(classes.select("id", F.col("n_shingles").alias("n"), "bits"), "id")
    here = here.select("tree", "key", F.xxhash64("tree", "key", "part").alias("region"), "id", "root", "n", (F.col("minor") | crowded).alias("minor"), "bits")
    return here.repartition("region").sortWithinPartitions("region", "id").mapInArrow(partial(_compare, similarity=similarity, attempt=attempt), PAIRS)


def confirmed(pairs: DataFrame, documents: DataFrame, similarity: int) -> DataFrame:
    """Those of the pairs whose full shingle sets are similar enough."""
    wanted = gathered(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
    texts = gathered(documents.select("doc_id", "text").join(small(wanted), "doc_id", "left_semi"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for s, t in zip(b.column(2), b.column(3)):
                x, y = shingle_set(s.as_py()), shingle_set(t.as_py())
                shared = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * shared >= similarity * (len(x) + len(y) - shared))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    side = lambda x: texts.select(F.col("doc_id").alias(x), F.col("text").alias(f"text_{x}"))
    both = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").select("a", "b", "text_a", "text_b")
    return both.mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """id and root (the least id reachable) of every id in links (a, b), by alternating large-star and small-star steps."""
    edges = gathered(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    parts = parts_of(edges.count())  # stars never have more edges
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).coalesce(parts).filter("u <> v").distinct().coalesce(parts)
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        stars = large.join(lower, "u")
        after = gathered(stars.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(lower.select("u", F.col("m").alias("v"))).coalesce(parts).filter("u <> v").distinct())
        # star-shaped: no root has a root of its own
        if after.join(after.select(F.col("u").alias("v")).distinct(), "v", "left_semi").isEmpty() and after.groupBy("u").agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
            return after.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(after.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())
        edges = after


def _rooted(members: DataFrame, links: DataFrame) -> DataFrame:
    """members with the root of each id; links: id, root."""
    return members.join(small(links), "id", "left").select("tree", "key", "id", F.coalesce("root", "id").alias("root"))


def open_regions(members: DataFrame) -> DataFrame:
    """Regions that hold more than one group: tree, key, main (the largest group), n_rows, n_minor (rows of others)."""
    sizes = members.groupBy("tree", "key", "root").agg(F.count("*").alias("n"))
    regions = sizes.groupBy("tree", "key").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.sum("n").alias("n_rows"), F.max("n").alias("most"), F.count("*").alias("groups"))
    return regions.filter("groups > 1").select("tree", "key", "main", "n_rows", (F.col("n_rows") - F.col("most")).alias("n_minor"))


def link(classes: DataFrame, documents: DataFrame, similarity: int) -> DataFrame:
    """id and root of all classes that have a confirmed link."""

    def grown(links: DataFrame | None, found: DataFrame) -> DataFrame:
        edges = found if links is None else links.select(F.col("id").alias("a"), F.col("root").alias("b")).unionByName(found)
        return gathered(components(edges))

    beside, members = forest(classes)
    ends = beside.unionByName(beside.select(F.col("b").alias("a"), F.col("a").alias("b"), "shared"))
    best = ends.withColumn("rank", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("shared"), "b"))).filter("rank <= 2")
    tested = gathered(best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    links = grown(None, confirmed(tested, documents, similarity))
    for depth, trees in (*LEVELS, (None, None)):
        members = gathered(members)
        rooted = _rooted(members, links)
        regions = gathered(open_regions(rooted))
        crowded = regions.filter(F.col("n_minor") > REGION)
        more = depth is not None and not crowded.isEmpty()
        if more:
            regions = regions.filter(F.col("n_minor") <= REGION)
        attempt = 0
        while True:
            pairs = gathered(compared(rooted, regions, classes, similarity, attempt))
            fresh = gathered(pairs.select("a", "b").distinct().join(tested, ["a", "b"], "left_anti"))
            good = gathered(confirmed(fresh, documents, similarity))
            links = grown(links, good)
            if attempt is None:
                break
            tested = gathered(tested.unionByName(fresh))
            # regions that gave a forest with a pair that isn't a link, and ends that are still apart
            root_of = lambda x: links.select(F.col("id").alias(x), F.col("root").alias(f"root_{x}"))
            apart = pairs.filter("NOT whole").join(root_of("a"), "a", "left").join(root_of("b"), "b", "left").filter(F.coalesce("root_a", "a") != F.coalesce("root_b", "b"))
            again = gathered(apart.select("tree", "key").distinct())
            if again.isEmpty():
                break
            rooted = _rooted(members.join(small(again), ["tree", "key"], "left_semi"), links)
            regions = gathered(open_regions(rooted))
            # further forests while they find links
            attempt = attempt + 1 if attempt + 1 < FORESTS and not good.isEmpty() else None
        if not more:
            return links
        ids = members.join(small(crowded.select("tree", "key")), ["tree", "key"], "left_semi").select("id")
        members = deeper(documents, ids, depth, trees)
    return links


def near_duplicates(documents: DataFrame, similarity: int = SIMILARITY) -> DataFrame:
    """A row per document: doc_id, n_shingles, component_id, kept. Texts are linked from `similarity` hundredths on."""
    signed = gathered(signatures(documents))
    same = ["n_shingles", "h1", "h2"]
    grouped = signed.filter((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()).groupBy(*same).agg(F.min(F.struct("doc_id", "sig", "bits")).alias("x"))
    classes = gathered(grouped.select(*same, F.col("x.doc_id").alias("id"), F.col("x.sig").alias("sig"), F.col("x.bits").alias("bits")))
    roots = link(classes.select("id", "n_shingles", "sig", "bits"), documents, similarity)
    rooted = classes.select(*same, "id").join(roots, "id", "left").select(*same, F.coalesce("root", "id").alias("component_id"))
    out = signed.select("doc_id", *same).join(rooted, same, "left")
    found = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", found.alias("component_id"), F.coalesce(F.col("doc_id") == found, F.lit(True)).alias("kept"))


def op10(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


OP10_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN w ELSE w[i : i + 4] END AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * k >= 85 * (x.n + y.n - k)),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
root AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM documents JOIN root USING (doc_id) LEFT JOIN n USING (doc_id)
"""
