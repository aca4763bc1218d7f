"""Token counts of a unigram tokenizer, without making tokens (operator 8).

A vocabulary of pieces with scores splits each word into the pieces with the greatest score sum. An Aho-Corasick
automaton lists the pieces that match a word; dynamic programming over its places carries only the best sum and its
number of pieces. Ties follow the exact rules of the tokenizers library's unigram model: places are filled from left to
right, candidates for a place come by rising start, and a later one wins only with a strictly greater sum. A character
without a piece of its own may be unknown, at the least score minus 10, and then counts as its UTF-8 bytes (byte fallback).

Words are split at white space and each begins with the mark U+2581, as with an always-prepending, splitting pre-tokenizer,
so a text's count is the sum over its words, and each distinct word is worked out once per worker (the store of results
is bounded and only saves time).

Defined results: null or empty text and text of white space alone count 0; a word of any length is worked out whole;
repeated rows are counted each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import SEPARATOR_CHARS, table

MARK = "▁"
UNKNOWN_PENALTY = 10.0
#: Distinct words whose counts a worker remembers.
REMEMBERED = 500_000


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def read_vocabulary(path: str) -> list[tuple[str, float]]:
    """Ordinary pieces and their scores from a sentencepiece file; control, unknown and byte pieces are left out."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = (i for i in range(sp.vocab_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)))
    return [(sp.id_to_piece(i), sp.get_score(i)) for i in ids]


class Counter:
    """Number of pieces of a word (mark included) under a vocabulary."""

    def __init__(self, vocabulary: list[tuple[str, float]]):
        self.automaton = ahocorasick.Automaton()
        for piece, value in vocabulary:
            self.automaton.add_word(piece, (len(piece), float(value)))
        self.automaton.make_automaton()
        self.unknown = min((s for _, s in vocabulary), default=0.0) - UNKNOWN_PENALTY
        self.known: dict[str, int] = {}

    def word(self, word: str) -> int:
        n = len(word)
        best, pieces = [0.0] + [None] * n, [0] * (n + 1)
        matches = self.automaton.iter(word)  # by rising end
        match = next(matches, None)
        for end in range(1, n + 1):
            found = []
            while match is not None and match[0] == end - 1:
                found.append(match[1])
                match = next(matches, None)
            found.sort(reverse=True)  # rising start: the longest piece first
            single = False
            here, count = None, 0
            for length, value in found:
                single = single or length == 1
                total = best[end - length] + value
                if here is None or total > here:
                    here, count = total, pieces[end - length] + 1
            if not single:
                total = best[end - 1] + self.unknown
                if here is None or total > here:
                    here, count = total, pieces[end - 1] + len(word[end - 1].encode("utf-8", "surrogatepass"))
            best[end], pieces[end] = here, count
        return pieces[n]

    def text(self, text: str | None) -> int:
        text = text or ""
        for blank in SEPARATOR_CHARS[1:]:
            text = text.replace(blank, " ")
        words = [w for w in text.split(" ") if w]
        known = self.known
        try:
            return sum(map(known.__getitem__, words))
        except KeyError:
            if len(known) > REMEMBERED:
                known.clear()
            for w in set(words):
                if w not in known:
                    known[w] = self.word(MARK + w)
            return sum(map(known.__getitem__, words))


_counters: dict[str, Counter] = {}


def counter_of(path: str) -> Counter:
    """The worker's counter for a vocabulary file."""
    if path not in _counters:
        _counters[path] = Counter(read_vocabulary(path))
    return _counters[path]


def count_tokens(documents: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id and n_tokens of every whole text."""
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_of(path)
        for b in batches:
            counts = [counter.text(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64())], names=["doc_id", "n_tokens"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long")


def op8(spark, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents")).select("doc_id", F.col("n_tokens"))
