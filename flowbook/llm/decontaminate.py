"""Benchmark decontamination: rare word seeds, then local alignment.

The items' words are counted over all documents in one pass (each task sends at
most one number per word).  An item's seeds are its rarest words, as many as
cover ``COVER`` of its length and always more than half of it, so hot ones too
where the rare ones do not reach that far.  An alignment (match 2, mismatch and
gap -1) that reaches ``SIMILARITY`` of the item's full score matches at least
that share of its words and spans at most twice its length: it cannot miss more
seeds than the item has words outside it, so ``need`` of the seeds stand within
``span`` words of the document.  Longer n-grams give no such bound: a copy with
a word put in after each word reaches 0.5 without a common 2-gram.  In a second
pass every passage with so many seeds is aligned with the item by
Smith-Waterman over words; what the search finds is what the alignment of all
documents with all items would find, whatever the other documents hold.

The benchmark is the query set: it is read in blocks of ``BLOCK_ITEMS`` items,
whose words (a bounded number) are broadcast.  Documents are never shuffled,
and a document's work is done where it is read.

Defined results: null texts are empty; an item without words is never found;
equal items are each found; ``seeds`` counts the seeds in the aligned stretch;
repeated documents each get their rows; null ids are kept.  An empty benchmark
finds nothing, an empty table gives no rows.  Other columns are kept by
``remove`` and not returned by ``find``.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from flowbook.llm.common import ship, table

ship(__name__)

SIMILARITY = 0.5
COVER = 0.7
BLOCK_ITEMS = 5000
MATCH, MISMATCH, GAP = 2, -1, -1
#: Words other than the benchmark's that a task counts before it drops them.
HELD_WORDS = 1 << 17


#: The bytes of Latin-1 texts, spaces for what stands between words.
WORD_BYTES = bytes(i if chr(i).isalnum() else 32 for i in range(256))


def words_of(text: str | None) -> list[str]:
    """Lower-cased runs of letters and digits."""
    low = (text or "").lower()
    try:
        return low.encode("latin-1").translate(WORD_BYTES).decode("latin-1").split()
    except UnicodeEncodeError:
        return re.findall(r"[^\W_]+", low)


Item = tuple[int | None, list[str]]


class Index:
    """Items as codes of their words, and the words that are their seeds."""

    def __init__(self, items: list[Item], counts: dict[str, int]):
        self.items, places = items, defaultdict(list)
        self.need, self.span = np.zeros(len(items), np.int64), np.zeros(len(items), np.int64)
        for number, (_, words) in enumerate(items):
            held, covered = Counter(words), 0
            matched = math.ceil(SIMILARITY * len(words))  # by any alignment that counts
            least = max(len(words) - matched + 1, COVER * len(words))
            for w in sorted(held, key=lambda w: (counts.get(w, 0), w)):
                if covered >= least:
                    break
                covered += held[w]
                places[w].append(number)
            self.need[number] = matched - (len(words) - covered)
            self.span[number] = math.floor((3 - 2 * SIMILARITY) * len(words))
        self.code = {w: i for i, w in enumerate(dict.fromkeys(w for _, words in items for w in words))}
        self.own = [np.array([self.code[w] for w in words], np.int64) for _, words in items]
        self.bags = [np.unique(own, return_counts=True) for own in self.own]
        self.size = np.array([len(places.get(w, ())) for w in self.code], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.places = np.array([n for w in self.code for n in places.get(w, ())], np.int32)

    def search(self, words: list[str]) -> list[tuple[int | None, float, int, int, int]]:
        """item_id, similarity, first and last word (exclusive), seeds: the best
        passage for each item that the document holds."""
        text = np.fromiter(map(self.code.get, words, repeat(-1)), np.int64, len(words))
        at = np.flatnonzero(text >= 0)
        at = at[self.size[text[at]] > 0]
        if not len(at):
            return []
        codes = text[at]
        size = self.size[codes]
        item = self.places[np.arange(size.sum()) + np.repeat(self.start[codes] - (np.cumsum(size) - size), size)]
        order = np.argsort(item, kind="stable")
        item, at = item[order], np.repeat(at, size)[order]
        last = np.arange(len(item)) + self.need[item] - 1  # the seed that makes them enough
        first = np.flatnonzero(last < len(item))
        last = last[first]
        first = first[(item[last] == item[first]) & (at[last] - at[first] < self.span[item[first]])]
        if not len(first):
            return []
        item, last = item[first], first + self.need[item[first]] - 1
        begin, end = np.maximum(at[last] - self.span[item] + 1, 0), np.minimum(at[first] + self.span[item], len(words))
        fresh = np.flatnonzero(np.r_[True, (item[1:] != item[:-1]) | (begin[1:] > end[:-1])])
        final = np.r_[fresh[1:], len(item)] - 1
        best: dict[int, tuple] = {}
        for n, a, b, seeds in zip(item[fresh].tolist(), begin[fresh].tolist(), end[final].tolist(), (last[final] - first[fresh] + 1).tolist()):
            hit = _aligned(self.own[n], self.bags[n], text[a:b])
            if hit and (n not in best or hit[0] > best[n][1]):
                best[n] = (self.items[n][0], hit[0], a + hit[1], a + hit[2], seeds)
        return list(best.values())


def _table(item: list[int], passage: np.ndarray) -> tuple[int, int, int]:
    """Best local score and where it ends in item and passage (exclusive)."""
    slope = -GAP * np.arange(len(passage) + 1)
    row, best = np.zeros(len(passage) + 1, np.int64), (0, 0, 0)
    for i, word in enumerate(item):
        step = np.maximum(row + GAP, 0)
        step[1:] = np.maximum(step[1:], row[:-1] + np.where(passage == word, MATCH, MISMATCH))
        row = np.maximum.accumulate(step + slope) - slope  # gaps along the passage
        j = int(row.argmax())
        if row[j] > best[0]:
            best = (int(row[j]), i + 1, j)
    return best


def _aligned(item: np.ndarray, bag: tuple[np.ndarray, np.ndarray], text: np.ndarray) -> tuple[float, int, int] | None:
    """``align`` of codes; ``bag`` holds the item's codes, ascending, and how often it has each."""
    need, (kinds, held) = SIMILARITY * MATCH * len(item), bag
    at = np.minimum(np.searchsorted(kinds, text), len(kinds) - 1)
    inside = kinds[at] == text
    if MATCH * int(np.minimum(np.bincount(at[inside], minlength=len(kinds)), held).sum()) < need:
        return None
    # No stretch scores more than its words would if each one that the item has were matched.
    most = np.cumsum(np.r_[0, np.where(inside, MATCH, max(MISMATCH, GAP))])
    if (most - np.minimum.accumulate(most)).max() < need:
        return None
    coded = item.tolist()
    score, end_i, end = _table(coded, text)
    if score < need:
        return None
    _, _, back = _table(coded[:end_i][::-1], text[:end][::-1])
    return score / (MATCH * len(item)), end - back, end


def align(item: list[str], passage: list[str]) -> tuple[float, int, int] | None:
    """Similarity (local score over the item's own) and the aligned part of the
    passage, or None under ``SIMILARITY``."""
    number: dict[str, int] = {}
    coded = np.array([number.setdefault(w, len(number)) for w in item], np.int64)
    return _aligned(coded, np.unique(coded, return_counts=True), np.array([number.get(w, -1) for w in passage], np.int64))


def blocks(docs: DataFrame, benchmark: DataFrame) -> Iterator[tuple[list[Item], dict[str, int]]]:
    """The benchmark's items by the block, with their words' counts over ``docs``."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")
    block: list[Item] = []
    for row in rows.toLocalIterator():
        if words := words_of(row["text"]):
            block.append((row["item_id"], words))
        if len(block) == BLOCK_ITEMS:
            yield block, _counts(docs, block)
            block = []
    if block:
        yield block, _counts(docs, block)


def _counts(docs: DataFrame, items: list[Item]) -> dict[str, int]:
    known = sorted({w for _, words in items for w in words})
    shared = docs.sparkSession.sparkContext.broadcast({w: i for i, w in enumerate(known)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value
        counts: Counter = Counter()
        for batch in batches:
            for text in batch["text"]:
                counts.update(words_of(text.as_py()))
                if len(counts) > len(number) + HELD_WORDS:  # other words go at times, and at the end
                    counts = Counter({w: n for w, n in counts.items() if w in number})
        counts = Counter({w: n for w, n in counts.items() if w in number})
        yield pa.RecordBatch.from_pydict({"word": pa.array([number[w] for w in counts], pa.int32()), "n": pa.array(counts.values(), pa.int64())})

    counted = docs.select("text").mapInArrow(run, "word int, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {known[r["word"]]: r["n"] for r in counted.collect()}


FOUND = "doc_id long, item_id long, similarity double, first_word long, end_word long, seeds long"


def find(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row (see ``FOUND``) for each document and item found in it."""
    spark = docs.sparkSession
    rows, out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), spark.createDataFrame([], FOUND)
    schema = to_arrow_schema(out.schema)
    for block in blocks(rows, benchmark):
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own = Index(*shared.value)
            for batch in batches:
                hits = [(i, *hit) for i, t in zip(batch["doc_id"].to_pylist(), batch["text"]) for hit in own.search(words_of(t.as_py()))]
                columns = zip(*hits) if hits else [()] * len(schema)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

        out = out.union(rows.mapInArrow(run, FOUND))
    return out


def remove(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold an item."""
    for block in blocks(docs, benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own = Index(*shared.value)
            for batch in batches:
                clean = [not own.search(words_of(t.as_py())) for t in batch["text"]]
                yield batch.filter(pa.array(clean, pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
