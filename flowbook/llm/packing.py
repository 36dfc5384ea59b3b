"""Order-preserving sequence packing by dynamic programming.

The documents of a task form one stream of token ids in their order.  Windows
of at most ``limit`` ids may end at a document's end (free), at a sentence end
inside a document (a small truncation penalty) or, where sentences are long,
at a hard cut (a larger one).  A sequence is padded to ``limit`` unless its length is
a power of two.  ``best_cuts`` finds the cuts of least padding plus penalties:
with f(j) the least cost of a stream cut at boundary j,

    f(j) = penalty(j) + min { limit - (b(j) - b(i)) + f(i) : b(j) - b(i) <= limit }
                    or, if less, min { f(i) : b(j) - b(i) = 1, 2, 4, ... <= limit }

A monotone queue holds the first minimum and the second has at most one
boundary for each power, so that each boundary costs constant time.  Streams are worked off in blocks of ``BLOCK`` ids; the last,
open window of a block begins the next one, so only the last sequence of a
task is cut short.  Nothing is shuffled.

Ids are those of the ``tokenizers`` file; the same vocabulary as ranks gives
equal ids (tested) at four times the speed.  Texts are split at single spaces,
each of which begins a new pre-token, and the ids of repeated pieces are
remembered in a bounded table.

Defined results: null text is an empty text and yields the end id alone;
repeated rows are packed once each; a null doc_id stays null; an empty table
gives no rows; other columns are neither read nor returned.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowbook.llm.common import ship, table

ship(__name__)

LIMIT = 1024
END_ID = 0
BLOCK = 1 << 20
REMEMBERED = 1 << 19
SENTENCE_PENALTY = 2
HARD_PENALTY = 4
HARD_STEP = 16
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
SPECIAL = "<|endoftext|>"
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Encoder:
    """Ids of a text as little-endian 32-bit bytes."""

    def __init__(self, vocabulary: str, ranks: str):
        import tiktoken

        with open(ranks, "rb") as lines:
            self.tokens = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        rank = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=self.tokens, special_tokens={})
        self.plain, self.vocabulary, self.slow = rank.encode_ordinary, vocabulary, None
        self.spaces = re.compile(r"\s\s")
        self.known: dict[str, bytes] = {}
        self.opens = np.zeros(max(self.tokens.values()) + 1, bool)  # tokens that begin with a space
        self.opens[[i for token, i in self.tokens.items() if token.startswith(b" ")]] = True

    def ends(self) -> np.ndarray:
        """By id: whether a sentence can end after it."""
        flags = np.zeros(max(self.tokens.values()) + 2, bool)
        for token, i in self.tokens.items():
            flags[i] = token.endswith((b".", b"!", b"?")) or b"\n" in token
        return flags

    def special(self, text: str) -> bytes:
        from tokenizers import Tokenizer

        self.slow = self.slow or Tokenizer.from_file(self.vocabulary)
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, pieces: list[str]) -> None:
        """Remember the ids of pieces, encoded as one text: pieces hold no space,
        so each one's ids begin at the next token that begins with a space."""
        ids = np.array(self.plain(" " + " ".join(pieces)), "<u4")
        at = [*(4 * np.flatnonzero(self.opens[ids])).tolist(), 4 * len(ids)]
        data = ids.tobytes()
        self.known.update(zip(pieces, (data[a:b] for a, b in zip(at, at[1:]))))

    def __call__(self, text: str) -> np.ndarray:
        if SPECIAL in text:
            data = self.special(text)
        elif self.spaces.search(text):
            data = np.array(self.plain(text), "<u4").tobytes()
        else:
            first, *pieces = text.split(" ")
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            found = list(map(self.known.get, pieces))
            if None in found:
                new = {p for p, ids in zip(pieces, found) if ids is None}
                if "" in new:  # a space that ends the text
                    new.remove("")
                    self.known[""] = np.array(self.plain(" "), "<u4").tobytes()
                if new:
                    self.learn(list(new))
                found = map(self.known.__getitem__, pieces)
            data = np.array(self.plain(first), "<u4").tobytes() + b"".join(found)
        return np.frombuffer(data + END_ID.to_bytes(4, "little"), "<u4")


def _powers(bounds: np.ndarray, limit: int) -> tuple[list[int], list[int], list[int]]:
    """For all j, the boundaries i with b(j) - b(i) = 1, 2, 4, ..., by j, those
    differences, and where the ones of each j begin."""
    place = np.full(int(bounds[-1]) + 1, -1, np.int32)
    place[bounds] = np.arange(len(bounds), dtype=np.int32)
    steps = 1 << np.arange(limit.bit_length())
    back = bounds[:, None] - steps
    found = np.where(back >= 0, place[np.maximum(back, 0)], -1)
    j, k = np.nonzero(found >= 0)
    return found[j, k].tolist(), steps[k].tolist(), np.searchsorted(j, np.arange(len(bounds) + 1)).tolist()


def best_cuts(bounds: np.ndarray, penalties: np.ndarray, limit: int) -> np.ndarray:
    """Indices into ``bounds`` (ascending, from 0, no step over ``limit``) of
    the cuts of least padding plus penalties, the last bound included."""
    b, pen, m = bounds.tolist(), penalties.tolist(), len(bounds)
    least, back = [0] * m, [0] * m  # least[j]: f(j) + b(j)
    queue, head, tail = [0] * m, 0, 0
    exact, steps, begin = _powers(bounds, limit)
    first = begin[1]
    for j, (reach, penalty, last) in enumerate(zip((bounds[1:] - limit).tolist(), pen[1:], begin[2:]), 1):
        while b[queue[head]] < reach:
            head += 1
        i = queue[head]
        cost = least[i] + limit
        if first < last:
            for e in range(first, last):
                other = least[exact[e]] + steps[e]
                if other < cost:
                    cost, i = other, exact[e]
            first = last
        back[j] = i
        least[j] = cost = cost + penalty
        while tail >= head and least[queue[tail]] > cost:
            tail -= 1
        tail += 1
        queue[tail] = j
    cuts, j = [], m - 1
    while j > 0:
        cuts.append(j)
        j = back[j]
    return np.array(cuts[::-1], np.int64)


def boundaries(ids: np.ndarray, doc_ends: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the stream may be cut, and at what penalty."""
    total = int(doc_ends[-1])
    free = np.zeros(total + 1, np.int64)
    free[np.flatnonzero(ends[ids]) + 1] = 1
    free[doc_ends] = 2
    free[0] = 2
    at = np.flatnonzero(free)
    gaps = np.flatnonzero(np.diff(at) > 2 * HARD_STEP)
    hard = [np.arange(at[g] + HARD_STEP, at[g + 1], HARD_STEP) for g in gaps.tolist()]
    where = np.concatenate([at, *hard])
    order = np.argsort(where, kind="stable")
    penalty = np.where(free[where] == 2, 0, np.where(free[where] == 1, SENTENCE_PENALTY, HARD_PENALTY))
    return where[order], penalty[order]


class Stream:
    """The open part of a task's stream: documents, or the rest of one."""

    def __init__(self, part: int, ends: np.ndarray, limit: int):
        self.docs: list[tuple[int | None, np.ndarray, int]] = []  # id, all ids, ids before the open part
        self.size, self.next, self.ends, self.limit = 0, part << 40, ends, limit

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id, ids, 0))
        self.size += len(ids)

    def flush(self, last: bool) -> pa.RecordBatch:
        ids = np.concatenate([d[1][d[2] :] for d in self.docs])
        doc_ends = np.cumsum([len(d[1]) - d[2] for d in self.docs])
        bounds, penalties = boundaries(ids, doc_ends, self.ends)
        cuts = bounds[best_cuts(bounds, penalties, self.limit)]
        if not last:
            cuts = cuts[:-1]
        done = int(cuts[-1]) if len(cuts) else 0
        edges = np.unique(np.concatenate([[0], cuts, doc_ends[doc_ends < done]]))
        left, right = edges[:-1], edges[1:]
        which = np.searchsorted(doc_ends, left, side="right")
        window = np.searchsorted(cuts, left, side="right")
        opened = np.concatenate([[0], cuts])
        before = np.concatenate([[0], doc_ends])
        skipped = np.array([d[2] for d in self.docs], np.int64)
        data = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
        frame = pa.RecordBatch.from_pydict({
            "doc_id": pa.array([self.docs[w][0] for w in which.tolist()], pa.int64()),
            "start": left - before[which] + skipped[which],
            "length": right - left,
            "ids_crc32": pa.array([zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(left.tolist(), right.tolist())], pa.int64()),
            "doc_tokens": np.array([len(d[1]) for d in self.docs], np.int64)[which],
            "sequence_id": self.next + window,
            "offset": left - opened[window],
        })
        self.next += len(cuts)
        first = int(np.searchsorted(doc_ends, done, side="right"))
        rest = self.docs[first:]
        if rest:
            doc_id, tokens, skip = rest[0]
            rest[0] = (doc_id, tokens, skip + done - int(before[first]))
        self.docs, self.size = rest, int(doc_ends[-1]) - done
        return frame


def pack(docs: DataFrame, limit: int = LIMIT, vocabulary: str = VOCABULARY, ranks: str = RANKS) -> DataFrame:
    """One row per piece; see ``SCHEMA``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(vocabulary, ranks)
        stream = Stream(TaskContext.get().partitionId(), encode.ends(), limit)
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"]):
                stream.add(doc_id, encode(text.as_py() or ""))
                if stream.size >= BLOCK:
                    yield stream.flush(last=False)
        if stream.docs:
            yield stream.flush(last=True)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
