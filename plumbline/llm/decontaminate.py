"""Benchmark decontamination (operator 6, built-in functions only).

An item leaks into a document when some window of the document, as long as the item, has a weighted similarity of 0.8 or
more with it: the shared weight of their 5-word shingles over the joint weight, a shingle's weight being how often it
occurs. Steps:

1. Windows. Places of documents whose shingle also occurs in some item; a window that is similar enough to an item has enough such places,
   and moving a window right to the first of that item's loses none, so windows of an item's size that start at such a place and
   hold enough of them, whichever items they are from, are all there is. Only texts with such windows are split a second time, for the windows' shingles.
2. Candidates. SimHash fingerprints of windows and items, BITS wide, in BLOCKS blocks: windows meet all items of their size with an
   equal block, which finds every pair that differs in fewer bits than there are blocks, and those within RADIUS go on. Repeats of a
   shingle vote as shingles of their own, so bits are independent. At similarity 0.8 a bit differs with
   probability acos(8/9) / pi = 0.15 for long items and 0.19 for the worst of up to 120 shingles, so no block is equal with a
   chance of 4e-5 to 1.4e-3, and more than RADIUS bits differ with one below 1e-7.
3. Rescue. That chance is no promise, so pairs of a window and an item that share enough places but whose fingerprints have no equal block, or are
   beyond RADIUS, are added.
4. Exact similarity of all of them. A window counts for an item where it starts at one of the item's own places, or is the text's last; so what is found
   of a document and an item depends on these two alone.

Words are those between white space, A-Z lower-cased; an item of fewer than 5 words is one shingle, its whole sequence.
Shingles are compared by 64-bit hashes.

Defined results: null or empty texts and texts of white space leak nothing and hold nothing; a document shorter than an
item is compared whole; rows with the same doc_id and text are one document; a null doc_id or item_id is kept as it is;
an empty table on either side gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import durable, lower_ascii, small, table, words_of

SHINGLE = 5
#: Similarity in hundredths.
SIMILARITY = 80
#: Width of a fingerprint, its blocks (of 8 bits), and the bits in which a candidate may differ.
BITS, BLOCKS, RADIUS = 256, 32, 84


def let(value: Column, use) -> Column:
    """use(value), with value worked out once however the optimizer moves the expression."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def shingles(words: Column, k: Column) -> Column:
    """Hashes of all runs of k words; empty if there are fewer."""
    return let(words, lambda w: F.when(F.size(w) >= k, F.transform(F.sequence(F.lit(1), F.size(w) - k + 1), lambda i: F.xxhash64(F.slice(w, i, k)))).otherwise(F.array().cast("array<bigint>")))


def occurrences(hashes: Column) -> Column:
    """The hashes, each repeat of one as a hash of its own: shared weight becomes the number of shared values."""
    number = lambda s: F.transform(s, lambda h, i: let(i + 1 - F.array_position(s, h).cast("int"), lambda n: F.when(n == 0, h).otherwise(F.xxhash64(h, n))))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), hashes).otherwise(let(F.sort_array(hashes), number))


def simhash(hashes: Column) -> Column:
    """BITS / 64 longs; each bit is set where more than half of the shingles, repeats included, have it set."""
    n, one = F.size(hashes), lambda bit: F.call_function("shiftleft", F.lit(1).cast("long"), bit)

    def word(k: int) -> Column:
        own = F.transform(hashes, lambda h: F.xxhash64(h, F.lit(k)))
        votes = lambda all_, bit: F.aggregate(all_, F.lit(0), lambda s, h: s + F.bit_get(h, bit))
        return let(own, lambda all_: F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), lambda acc, bit: F.when(votes(all_, bit) * 2 > n, acc.bitwiseOR(one(bit))).otherwise(acc)))

    return F.array(*[word(k) for k in range(BITS // 64)])


def blocks(fingerprint: Column) -> Column:
    """BLOCKS structs (block, value) that together hold all bits."""
    wide = BITS // BLOCKS
    return F.array(*[F.struct(F.lit(i).alias("block"), F.shiftrightunsigned(fingerprint[i * wide // 64], i * wide % 64).bitwiseAND(F.lit((1 << wide) - 1).cast("long")).alias("value")) for i in range(BLOCKS)])


def apart(a: Column, b: Column) -> Column:
    """Bits in which two fingerprints differ."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def near_pairs(windows: DataFrame, items: DataFrame) -> DataFrame:
    """(window, item) within RADIUS that have an equal block. windows: window, k, n_item, print; items: item, k, n_item, print."""
    left = windows.select("window", "k", "n_item", "print", F.explode(blocks(F.col("print"))).alias("b")).select("window", "k", "n_item", "print", "b.block", "b.value")
    right = items.select("item", "k", "n_item", F.col("print").alias("item_print"), F.explode(blocks(F.col("print"))).alias("b")).select("item", "k", "n_item", "item_print", "b.block", "b.value")
    return left.join(small(durable(right)), ["k", "n_item", "block", "value"]).filter(apart(F.col("print"), F.col("item_print")) <= RADIUS).select("window", "item").distinct()


def meets(a: Column, b: Column) -> Column:
    """Whether near_pairs finds two fingerprints of a size."""
    return F.exists(F.zip_with(blocks(a), blocks(b), lambda x, y: x["value"] == y["value"]), lambda e: e) & (apart(a, b) <= RADIUS)


def find_leaks(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The best window of each document and item that are similar enough: doc_id, item_id, start_word, n_words, similarity
    and text_key, xxhash64 of the document's text."""
    items = benchmark.select("item_id", words_of(lower_ascii(F.col("text"))).alias("w")).filter(F.size("w") > 0)
    items = items.select("item_id", "w", F.least(F.size("w"), F.lit(SHINGLE)).alias("k"))
    items = items.select("item_id", "k", shingles(F.col("w"), F.col("k")).alias("h")).distinct()
    items = durable(items.select(F.monotonically_increasing_id().alias("item"), "item_id", "k", F.size("h").alias("n_item"), "h"))
    index = durable(items.select("item", "k", "n_item", F.explode("h").alias("h")).groupBy("item", "k", "n_item", "h").agg(F.count("*").cast("int").alias("in_item")))
    ks = sorted(r.k for r in items.select("k").distinct().collect())  # at most SHINGLE values

    def split(texts: DataFrame) -> DataFrame:
        docs = texts.select("doc_id", F.xxhash64("text").alias("key"), words_of(lower_ascii(F.col("text"))).alias("w"))
        each = [docs.select("doc_id", "key", F.lit(k).alias("k"), shingles(F.col("w"), F.lit(k)).alias("s")) for k in ks]
        return reduce(DataFrame.unionByName, each)

    if not ks:
        return documents.sparkSession.createDataFrame([], "doc_id long, item_id long, start_word int, n_words int, similarity double, text_key long")
    places = split(documents).select("doc_id", "key", "k", F.size("s").alias("n_doc"), F.posexplode_outer("s").alias("at", "h"))
    hits = places.join(small(index.select("item", "k", "n_item", "h")), ["k", "h"]).select("doc_id", "key", "k", "n_doc", "item", "n_item", "at")
    hits = durable(hits)
    place = ["doc_id", "key", "k", "n_item", "n", "n_doc", "start"]

    def windows_of(hits: DataFrame, *by: str) -> DataFrame:
        """Windows that start at one of the places and hold enough of them: by, place."""
        runs = hits.groupBy(*by, "doc_id", "key", "k", "n_doc", "n_item").agg(F.sort_array(F.collect_set("at")).alias("at")).withColumn("n", F.least("n_doc", "n_item"))
        runs = runs.withColumn("least", F.ceil(F.lit(SIMILARITY) * (F.col("n") + F.col("n_item")) / F.lit(100 + SIMILARITY)).cast("int")).filter(F.size("at") >= F.col("least"))
        starts = F.filter("at", lambda a, i: F.get(F.col("at"), i + F.col("least") - 1) - a < F.col("n"))
        return runs.withColumn("start", F.explode(F.array_distinct(F.transform(starts, lambda a: F.least(a, F.col("n_doc") - F.col("n")))))).select(*by, *place)

    held = durable(windows_of(hits))

    # their shingles, from those texts again
    wanted = small(durable(held.select(F.col("doc_id").alias("_id"), F.col("key").alias("_key")).distinct()))
    texts = documents.select("doc_id", "text").join(wanted, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_key")), "left_semi")
    texts = split(texts).dropDuplicates(["doc_id", "key", "k"]).select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), F.col("k").alias("_k"), "s")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key")) & (F.col("k") == F.col("_k"))
    windows = held.join(texts, same).select(*place, F.slice("s", F.col("start") + 1, F.col("n")).alias("h"))
    windows = durable(windows.withColumn("print", simhash(occurrences(F.col("h")))).withColumn("window", F.monotonically_increasing_id()))

    prints = durable(items.select("item", "k", "n_item", simhash(occurrences(F.col("h"))).alias("print")))
    near = near_pairs(windows, prints).join(windows.select("window", F.get("h", F.lit(0)).alias("first"), (F.col("start") == F.col("n_doc") - F.col("n")).alias("last")), "window")
    starting = index.select("item", F.col("h").alias("first"), F.lit(True).alias("starts"))
    near = near.join(small(starting), ["item", "first"], "left").filter(F.col("last") | F.col("starts")).select("window", "item")
    numbers = windows.select("window", "print", *[F.col(c).alias(f"_{c}") for c in place])
    rescued = windows_of(hits, "item").join(numbers, reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in place]))
    rescued = rescued.join(small(prints.select("item", F.col("print").alias("item_print"))), "item").filter(~meets(F.col("print"), F.col("item_print"))).select("window", "item")
    pairs = near.unionByName(rescued)

    own = ["window", "doc_id", "key", "item", "k", "n_item", "n", "start"]
    counted = windows.join(pairs, "window").select(*own, F.explode("h").alias("h")).groupBy(*own, "h").agg(F.count("*").cast("int").alias("in_window"))
    shared = counted.join(small(index.select("item", "h", "in_item")), ["item", "h"]).groupBy(*own).agg(F.sum(F.least("in_window", "in_item")).alias("shared"))
    joint = F.col("n") + F.col("n_item") - F.col("shared")
    found = shared.filter(100 * F.col("shared") >= SIMILARITY * joint).withColumn("similarity", F.col("shared") / joint)
    best = found.groupBy("doc_id", "key", "item").agg(F.max_by(F.struct("start", "n", "k", "similarity"), F.struct("similarity", -F.col("start"))).alias("b"))
    return best.join(small(items.select("item", "item_id")), "item").select(
        "doc_id", "item_id", F.col("b.start").cast("int").alias("start_word"), (F.col("b.n") + F.col("b.k") - 1).cast("int").alias("n_words"), F.col("b.similarity").alias("similarity"), F.col("key").alias("text_key")
    )


def op6(spark, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_key")


OP6_SQL = rf"""
WITH itemw AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM benchmark),
items AS (SELECT *, least(len(w), {SHINGLE}) AS k, len(w) - least(len(w), {SHINGLE}) + 1 AS n_item FROM itemw WHERE len(w) > 0),
itemx AS (SELECT item_id, k, n_item, list_slice(w, i, i + k - 1) AS h, count(*) AS in_item FROM (SELECT *, unnest(range(1, n_item + 1)) AS i FROM items) GROUP BY ALL),
docw AS (SELECT DISTINCT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
docx AS (SELECT doc_id, k, n_doc, i - 1 AS pos, list_slice(w, i, i + k - 1) AS h FROM (
  SELECT doc_id, k, w, len(w) - k + 1 AS n_doc, unnest(range(1, len(w) - k + 2)) AS i FROM docw, (SELECT DISTINCT k FROM items) WHERE len(w) >= k)),
hits AS (SELECT d.doc_id, x.item_id, d.k, n_doc, n_item, least(n_doc, n_item) AS n, d.pos, d.h, in_item FROM docx d JOIN itemx x ON d.k = x.k AND d.h = x.h),
starts AS (SELECT DISTINCT doc_id, item_id, k, least(pos, n_doc - n) AS start_word FROM hits),
kept AS (SELECT s.doc_id, s.item_id, s.k, s.start_word, x.n, x.n_item, x.h, least(count(*), max(in_item)) AS shared FROM starts s
  JOIN hits x ON s.doc_id = x.doc_id AND s.item_id = x.item_id AND x.pos BETWEEN s.start_word AND s.start_word + x.n - 1 GROUP BY ALL),
sums AS (SELECT doc_id, item_id, k, start_word, n, n_item, sum(shared) AS shared FROM kept GROUP BY ALL),
best AS (SELECT *, shared::DOUBLE / (n + n_item - shared) AS similarity, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY shared::DOUBLE / (n + n_item - shared) DESC, start_word) AS r
  FROM sums WHERE 100 * shared >= {SIMILARITY} * (n + n_item - shared))
SELECT doc_id, item_id, start_word::INT AS start_word, (n + k - 1)::INT AS n_words, similarity FROM best WHERE r = 1
"""
