"""Grouping spelling variants by reduced-alphabet neighbourhoods.

Words are counted over all texts: maximal runs of letters, A-Z lower-cased, one
letter deleted where the run's checksum says so.  Letters are hashed to
``SYMBOLS`` symbols; two words one edit apart have reduced words that are equal
or one edit apart.  So every distinct reduced word lists its full one-edit
neighbourhood (itself, deletions, replacements, insertions), each neighbour as
a 64-bit polynomial hash that follows from prefix and suffix hashes in constant
time, however long the word.  Of two reduced words the one with the smaller
hash lists the other, which halves what is shuffled and loses nothing.  The
neighbourhoods are joined with the hashes of the reduced vocabulary, the pairs
of reduced words with their words, and the edit distance of the original words
decides: neither the small alphabet nor a collision can add a pair.

A word's form is its near word of the largest count, if that is at least
``RATIO`` times its own; along a chain of forms counts grow by that factor, so
the chain's length is at most log of the largest count, and pointer jumping
ends it in as many rounds as that length has binary digits.

Defined results: null text has no words; a null doc_id counts as an empty text;
repeated rows count each; an empty table gives no rows.  Words of any length
are grouped.  Other columns are neither read nor returned.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowbook.llm.common import keep, ship, table

ship(__name__)

LETTERS = "a-zÀ-ÿ"
LEAST_LETTERS = 7
LEAST_COUNT = 2
RATIO = 10
DELETED = 31
SYMBOLS = 6
#: Words that a task counts before it sends them on.
HELD = 200_000
#: Neighbours that a task makes at once.
CHUNK = 1 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)


def damaged(doc_id: int | None, run: str) -> str:
    """The run, without the letter that its checksum deletes, if any."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    if h % DELETED:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def counts(docs: DataFrame, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT) -> DataFrame:
    """word, n."""
    runs = re.compile(f"[{LETTERS}]{{{least_letters},}}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_pydict({"word": pa.array(held.keys(), pa.string()), "n": pa.array(held.values(), pa.int64())})
            held.clear()
            return made

        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"]):
                # bytes.lower() changes A-Z only
                for word, n in Counter(runs.findall((text.as_py() or "").encode().lower().decode())).items():
                    word = damaged(doc_id, word)
                    if len(word) >= least_letters:
                        held[word] += n
                if len(held) >= HELD:
                    yield out()
        yield out()

    parts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def symbol(letter: str, symbols: int = SYMBOLS) -> int:
    """1 to ``symbols``; 0 is no symbol."""
    return zlib.crc32(letter.encode()) % symbols + 1


def _powers(n: int) -> np.ndarray:
    return np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, BASE, np.uint64))])


def _prefixes(rows: np.ndarray) -> np.ndarray:
    """Polynomial hashes of the first 0, 1, ... symbols of each row."""
    out = np.zeros((len(rows), rows.shape[1] + 1), np.uint64)
    for i in range(rows.shape[1]):
        out[:, i + 1] = out[:, i] * BASE + rows[:, i]
    return out


def _suffixes(rows: np.ndarray, powers: np.ndarray) -> np.ndarray:
    """Polynomial hashes of the symbols from 0, 1, ... on."""
    length = rows.shape[1]
    parts = rows * powers[:length][::-1]
    return np.concatenate([np.cumsum(parts[:, ::-1], axis=1, dtype=np.uint64)[:, ::-1], np.zeros((len(rows), 1), np.uint64)], axis=1)


def reduced(words: list[str], symbols: int = SYMBOLS) -> list[str]:
    """Each word with its letters hashed to the symbols a, b, ..."""
    names = {ord(c): chr(96 + symbol(c, symbols)) for c in set().union(*words)}
    return [w.translate(names) for w in words]


def blocks(codes: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of reduced words of one length: their places, and a matrix of
    their symbols as numbers from 1."""
    by_length: dict[int, list[int]] = {}
    for i, w in enumerate(codes):
        by_length.setdefault(len(w), []).append(i)
    for length, places in by_length.items():
        step = max(1, CHUNK // (length + 1))
        for at in range(0, len(places), step):
            own = places[at : at + step]
            flat = np.frombuffer("".join(codes[i] for i in own).encode(), np.uint8)
            yield np.array(own), flat.reshape(len(own), length).astype(np.uint64) - np.uint64(96)


def hashes(codes: list[str]) -> np.ndarray:
    """The hash of each reduced word, as a signed long."""
    out = np.zeros(len(codes), np.uint64)
    for places, rows in blocks(codes):
        out[places] = _prefixes(rows)[:, -1]
    return out.view(np.int64)


def neighbours(rows: np.ndarray, symbols: int = SYMBOLS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, hash) of the one-edit neighbourhood of each row of symbols, the row
    itself included, each neighbour once."""
    n, length = rows.shape
    powers = _powers(length + 1)
    before, after = _prefixes(rows), _suffixes(rows, powers)
    every = np.arange(n)
    yield every, before[:, -1]
    step = max(1, CHUNK // (n * symbols))
    for lo in range(0, length + 1, step):
        at = np.arange(lo, min(lo + step, length + 1))  # insertions before these
        inside = at[at < length]
        left = np.where(at > 0, rows[:, np.maximum(at - 1, 0)], np.uint64(0)) if length else np.zeros((n, len(at)), np.uint64)
        # of equal neighbours in a row, the first one is deleted; a symbol is inserted after its equals' first
        row, i = np.nonzero(rows[:, inside] != left[:, : len(inside)])
        j = inside[i]
        yield row, before[row, j] * powers[length - 1 - j] + after[row, j + 1]
        for s in np.arange(1, symbols + 1, dtype=np.uint64):
            row, i = np.nonzero(rows[:, inside] != s)
            j = inside[i]
            yield row, before[row, j] * powers[length - j] + s * powers[length - 1 - j] + after[row, j + 1]
            row, i = np.nonzero(left != s)
            j = at[i]
            yield row, before[row, j] * powers[length + 1 - j] + s * powers[length - j] + after[row, j]


def near_pairs(vocabulary: DataFrame, symbols: int = SYMBOLS) -> DataFrame:
    """a, n_a, b, n_b: every pair of words one edit apart, in one direction."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            short = reduced(batch["word"].to_pylist(), symbols)
            yield pa.RecordBatch.from_pydict({"word": batch["word"], "n": batch["n"], "reduced": short, "code": hashes(short)})

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, rows in blocks(batch["reduced"].to_pylist()):
                own = _prefixes(rows)[:, -1].view(np.int64)
                for row, key in neighbours(rows, symbols):
                    code, other = own[row], key.view(np.int64)
                    upper = other >= code
                    yield pa.RecordBatch.from_pydict({"code": code[upper], "other": other[upper]})

    words = keep(vocabulary.select("word", "n").mapInArrow(hashed, "word string, n long, reduced string, code long"), "spelling-words")
    short = keep(words.select("reduced", "code").distinct(), "spelling-reduced")
    lists = short.select("reduced").mapInArrow(listed, "code long, other long")
    # distinct: a collision of two reduced words would repeat a pair
    met = keep(lists.join(short.select(F.col("code").alias("other")), "other").distinct(), "spelling-met")
    a = words.select("code", F.col("word").alias("a"), F.col("n").alias("n_a"))
    b = words.select(F.col("code").alias("other"), F.col("word").alias("b"), F.col("n").alias("n_b"))
    both = met.join(a, "code").join(b, "other")
    close = (F.abs(F.length("a") - F.length("b")) <= 1) & (F.levenshtein("a", "b", 1) == 1)
    return both.where((F.col("code") != F.col("other")) | (F.col("a") < F.col("b"))).where(close).select("a", "n_a", "b", "n_b")


def roots(forms: DataFrame, rounds: int) -> DataFrame:
    """word, root: the end of each chain of (word, form)."""
    jumps = forms.select("word", F.col("form").alias("root"))
    for _ in range(rounds):
        ahead = jumps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        jumps = keep(jumps.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "spelling-roots")
    return jumps


def variants(docs: DataFrame, ratio: int = RATIO, symbols: int = SYMBOLS) -> DataFrame:
    """word, form, root, n, n_near, form_n; one row per word."""
    vocabulary = keep(counts(docs), "spelling-counts")
    pairs = keep(near_pairs(vocabulary, symbols), "spelling-pairs")
    directed = pairs.select(F.col("a").alias("word"), F.col("n_a").alias("n"), F.col("b").alias("form"), F.col("n_b").alias("form_n")).union(pairs.select("b", "n_b", "a", "n_a"))
    best = F.min(F.struct((-F.col("form_n")).alias("less"), "form")).alias("best")
    near = directed.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.max("n").alias("n"), best)
    is_form = -F.col("best.less") >= ratio * F.col("n")
    near = near.select("word", "n_near", F.when(is_form, F.col("best.form")).alias("form"), F.when(is_form, -F.col("best.less")).alias("form_n"))
    near = keep(near, "spelling-near")
    top = vocabulary.agg(F.max("n")).first()[0] or 1
    longest = max(1, math.floor(math.log(top, ratio)) + 1)  # of a chain: every step multiplies the count
    ends = roots(near.where("form is not null"), max(1, longest.bit_length()))
    found = vocabulary.join(near, "word", "left").join(ends, "word", "left")
    return found.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"))
