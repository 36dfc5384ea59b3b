"""Toxicity by compression distance.

Two zstandard dictionaries are made: one trained on windows of ordinary text,
one of the marks of toxic text.  A toxic document is mostly ordinary prose, so
its marks are the words and beginnings of words (of any length; the words'
documents are counted over all learning rows) that at least ``CONTRAST`` times
the share of toxic documents as of ordinary ones hold, and that pass a
significance test (Chernoff's bound on the binomial tail, over all tested words
together at ``RATE``); a dictionary of whole toxic documents would only hold more prose
(measured: 0.63 instead of 0.94 area under the curve).  The toxic dictionary is
as long as its marks.  Marks under ``SHORT`` bytes are too short for a match to
save anything, so words with such a mark are followed by its digest.
Every window of a text is compressed against the ordinary
dictionary alone and against both; the bytes that the toxic one saves are the
window's gain.  A document's gains (largest, largest three, mean, share and
number over ``GAIN``) make a logistic score, and an isotonic curve calibrates
it.

Learned from: rows with a label whose crc32(doc_id as text) mod 4 is not 2.
Of these, rows of remainders 0 and 1 give the marks, up to ``LEARNED`` of
either label (all of them below that; else by hash of the id): their ids are
broadcast, so no text is shuffled at any size.  Up to ``SAMPLE`` ordinary ones,
by hash of the id, with up to ``SAMPLE_WINDOWS`` evenly spaced windows each,
train the ordinary dictionary; up to ``SAMPLE`` rows of remainder 3 fit the
weights; all rows of remainder 3 give the curve.  Scoring takes whole texts.
Labels, language, source and doc_id are no inputs.

Defined results: null text is an empty text; an empty text has no gain and is
scored like a text without one; repeated rows get equal scores; a null doc_id
has no label.  If either label is missing, nothing is learned and all scores
are 0.  An empty table gives no rows.  Other columns are neither read nor
returned.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowbook.llm.calibration import calibrated, curve, labelled, remainder
from flowbook.llm.common import keep, ship, table

ship(__name__)

WINDOW = 64
ORDINARY_BYTES = 32768
SAMPLE = 4000
#: Labelled rows of either label that the marks are counted over.
LEARNED = 50_000
#: Steps of the hash that a share of the ids is taken by.
STEPS = 1 << 20
SAMPLE_WINDOWS = 256
CONTRAST = 8
RATE = 0.05
START = 12
SHORT = 4
KEYS = 200_000
GAIN = 4
FOLDS = 4
HELD = 2
CUT = 0.3
GAINS = 6
#: Windows that one call compresses, at least.
TOGETHER = 1 << 14
#: Of the hash of four bytes.
GRAM_BITS = 18
#: Letters and bytes of letters outside ASCII.
TOKEN = rb"[^\x00-\x40\x5b-\x60\x7b-\x7f]+"
Marks = dict[bytes, float]


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def _cuts(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Where windows of about ``WINDOW`` bytes begin among the words (the last
    number ends the last one), and how many bytes stand before each word."""
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    cuts = np.unique(np.minimum(np.searchsorted(ends, np.arange(WINDOW, ends[-1] + WINDOW, WINDOW)) + 1, len(words)))
    return np.append(0, cuts), np.append(0, ends)


def windows(text: str | None) -> list[bytes]:
    """The lower-cased words of a text in windows of about ``WINDOW`` bytes."""
    words = _words(text)
    if not words:
        return []
    at, _ = _cuts(words)
    return [b" " + b" ".join(words[a:b]) + b" " for a, b in zip(at.tolist(), at[1:].tolist())]


def _starts(token: bytes) -> list[bytes]:
    """A token's beginnings, and the whole of it (with a space)."""
    return [*(token[:k] for k in range(1, min(len(token), START) + 1)), token + b" "]


def _digest(mark: bytes) -> bytes:
    return blake2b(mark, digest_size=6).hexdigest().encode()


def _grams(data: bytes) -> np.ndarray:
    """Hashes of the four bytes from each place on."""
    a = np.frombuffer(data, np.uint8).astype(np.uint32)
    if len(a) < 4:
        return np.zeros(0, np.int64)
    codes = a[:-3] | a[1:-2] << np.uint32(8) | a[2:-1] << np.uint32(16) | a[3:] << np.uint32(24)
    return (codes * np.uint32(2654435761) >> np.uint32(32 - GRAM_BITS)).astype(np.int64)


class Speller:
    """Words, each followed by the digests of its short marks."""

    def __init__(self, marks: Marks):
        self.marks, self.token, self.known = marks, re.compile(TOKEN), {}
        self.short = any(len(m.strip()) < SHORT for m in marks)

    def spelled(self, word: bytes) -> bytes:
        best = [max(f, key=lambda m: (self.marks[m], m)) for t in self.token.findall(word) if (f := [m for m in _starts(t) if m in self.marks])]
        return b" ".join([word, *(_digest(m) for m in best if len(m.strip()) < SHORT)])

    def __call__(self, words: list[bytes]) -> list[bytes]:
        if not self.short:
            return words
        if len(self.known) >= KEYS:
            self.known.clear()
        for word in set(words).difference(self.known):
            self.known[word] = self.spelled(word)
        return list(map(self.known.__getitem__, words))


def toxic_content(marks: Marks) -> bytes:
    """The toxic dictionary: every mark once, the strongest at the near end."""
    return b"".join(b" " + (_digest(m) + b" " if len(m.strip()) < SHORT else m) for m in sorted(marks, key=lambda m: (marks[m], m)))


def toxic_marks(rows: DataFrame) -> Marks:
    """Marks and the strength of their evidence (-log of the bound on the tail),
    from all ``rows`` (toxic, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token, held = re.compile(TOKEN), (Counter(), Counter())

        def out() -> pa.RecordBatch:
            keys = list(held[0] | held[1])
            made = pa.RecordBatch.from_pydict({"mark": pa.array(keys, pa.binary()), **{n: pa.array([h[k] for k in keys], pa.int64()) for n, h in zip(("ordinary", "toxic"), held)}})
            for h in held:
                h.clear()
            return made

        for batch in batches:
            for text, toxic in zip(batch["text"], batch["toxic"].to_pylist()):
                tokens = {t for w in set(_words(text.as_py())) for t in token.findall(w)}
                held[toxic].update({s for t in tokens for s in _starts(t)})
                if len(held[0]) + len(held[1]) >= KEYS:
                    yield out()
        yield out()

    total = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(total) < 2:
        return {}
    share = total[True] / (total[True] + total[False])
    counts = rows.select("toxic", "text").mapInArrow(run, "mark binary, ordinary long, toxic long").groupBy("mark").agg(F.sum("ordinary").alias("o"), F.sum("toxic").alias("t")).where("t > 0")
    tail = F.col("t") * F.log(F.col("t") / ((F.col("t") + F.col("o")) * F.lit(share)))
    rest = F.when(F.col("o") > 0, F.col("o") * F.log(F.col("o") / ((F.col("t") + F.col("o")) * F.lit(1 - share)))).otherwise(0.0)
    over = F.col("t") > F.lit(share) * (F.col("t") + F.col("o"))
    counts = keep(counts.withColumn("evidence", F.when(over, tail + rest).otherwise(0.0)), "toxicity-marks")
    least = math.log(max(counts.count(), 1) / RATE)
    found = {bytes(r["mark"]): (r["t"], r["o"], r["evidence"]) for r in counts.where(F.col("evidence") >= least).collect()}

    def contrast(t: int, o: int) -> bool:
        return t > 0 and t * total[False] >= CONTRAST * o * total[True]

    found = {m: n for m, n in found.items() if contrast(*n[:2])}
    # A beginning is a mark only by the documents that its commonest longer mark leaves.
    longer: dict[bytes, tuple[int, int]] = {}
    for mark, n in found.items():
        for k in range(1, len(mark)):
            longer[mark[:k]] = max(longer.get(mark[:k], (0, 0)), n[:2])
    return {m: e for m, (t, o, e) in found.items() if contrast(t - longer.get(m, (0, 0))[0], o - longer.get(m, (0, 0))[1])}


def train(size: int, samples: list[bytes]) -> bytes:
    """A trained dictionary, or the samples themselves if they are too few."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(dict.fromkeys(samples))[:size]


class Distance:
    """Gains of the toxic dictionary on windows.  The shortest match is four
    bytes: a window that shares no four bytes with the toxic marks has no gain
    and is not compressed."""

    def __init__(self, ordinary: bytes, marks: Marks):
        self.spelled = Speller(marks) if marks else None
        content = toxic_content(marks)
        self.plain, self.both = self._made(ordinary), self._made(content + ordinary)
        self.held = np.zeros(1 << GRAM_BITS, bool)
        self.held[_grams(content)] = True

    @staticmethod
    def _made(content: bytes) -> zstandard.ZstdCompressor:
        # Large tables and raw content: lengths then differ by what matches,
        # not by chance collisions or entropy tables.  The window reaches over
        # the whole dictionary.
        reach = max(17, (2 * len(content)).bit_length())
        how = zstandard.ZstdCompressionParameters(
            window_log=reach, hash_log=reach - 1, chain_log=reach - 1, search_log=6, min_match=4, target_length=64,
            strategy=zstandard.STRATEGY_GREEDY, write_content_size=0, write_checksum=0, write_dict_id=0,
        )
        words = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        words.precompute_compress(compression_params=how)
        return zstandard.ZstdCompressor(dict_data=words, compression_params=how)

    def near(self, text: str | None) -> tuple[int, np.ndarray, list[bytes]]:
        """How many windows a text has, and which ones may have a gain."""
        words = self.spelled(_words(text)) if self.spelled else _words(text)
        if not words:
            return 0, np.zeros(0, np.int64), []
        cuts, before = _cuts(words)
        data = b" " + b" ".join(words) + b" "
        low, high = before[cuts[:-1]], before[cuts[1:]] + 1
        shared = np.append(0, np.cumsum(self.held[_grams(data)]))
        last = len(shared) - 1
        near = np.flatnonzero(shared[np.clip(high - 3, 0, last)] > shared[np.minimum(low, last)])
        return len(low), near, [data[a:b] for a, b in zip(low[near].tolist(), high[near].tolist())]

    def many(self, texts: Iterable[str | None]) -> Iterator[np.ndarray]:
        """Bytes that the toxic dictionary saves, by window, for each text; the
        windows of many texts are compressed in one call."""
        waiting, parts = [], []

        def closed() -> Iterator[np.ndarray]:
            saved = np.zeros(0, np.int64)
            if parts:
                plain, both = (np.fromiter(map(len, c.multi_compress_to_buffer(parts, threads=1)), np.int64, len(parts)) for c in (self.plain, self.both))
                saved = plain - both
            at = 0
            for n, near in waiting:
                out = np.zeros(n, np.int64)
                out[near] = saved[at : at + len(near)]
                at += len(near)
                yield out
            waiting.clear()
            parts.clear()

        for text in texts:
            n, near, own = self.near(text)
            waiting.append((n, near))
            parts += own
            if len(parts) >= TOGETHER:
                yield from closed()
        yield from closed()

    def gains(self, text: str | None) -> np.ndarray:
        return next(self.many([text]))

    def __call__(self, text: str | None) -> np.ndarray:
        return self.described(self.gains(text))

    @staticmethod
    def described(gains: np.ndarray) -> np.ndarray:
        """The numbers that describe a document's gains."""
        gains = np.sort(gains)[::-1]
        if not len(gains):
            return np.zeros(GAINS)
        over = (gains >= GAIN).sum()
        return np.array([gains[0] / 4, gains[:3].mean() / 4, gains.mean() * 4, 4 * over / len(gains), np.log1p(over), np.log1p(len(gains)) / 4])


def logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights (the last is the constant) by Newton steps with a small ridge."""
    x, w = np.column_stack([x, np.ones(len(x))]), np.zeros(x.shape[1] + 1)
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w += np.linalg.solve((x.T * (p * (1 - p) + 1e-9)) @ x + 0.1 * np.eye(len(w)), x.T @ (y - p) - 0.1 * w)
    return w


def _sampled(rows: DataFrame, n: int) -> DataFrame:
    return rows.orderBy(F.xxhash64("l_id"), "l_id").limit(n)


def _bounded(rows: DataFrame, n: int) -> DataFrame:
    """All rows, or a share of them by hash of the id that stays under ``n``
    (aimed at 95 % of it, eleven standard deviations below for ``LEARNED``)."""
    share = min(1.0, 0.95 * n / max(rows.count(), 1))
    return rows if share == 1.0 else rows.where(F.pmod(F.xxhash64("l_id"), F.lit(STEPS)) < int(share * STEPS))


def dictionaries(docs: DataFrame, known: DataFrame) -> tuple[bytes, Marks] | None:
    """The ordinary dictionary, from a bounded sample, and the marks of toxic
    text, from the learning rows; ``known`` has l_id, toxic (boolean) and fold."""
    pool, texts = known.where("fold < 2"), docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    chosen = _sampled(pool.where("not toxic"), SAMPLE).select("l_id")
    rows = texts.join(F.broadcast(chosen), F.col("doc_id") == F.col("l_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [windows(t.as_py()) for t in batch["text"]]
            parts = [[p[i] for i in np.unique(np.linspace(0, len(p) - 1, SAMPLE_WINDOWS).astype(int))] if len(p) > SAMPLE_WINDOWS else p for p in parts]
            yield pa.RecordBatch.from_pydict({"parts": pa.array(parts, pa.list_(pa.binary()))})

    ordinary = [[bytes(p) for p in r["parts"]] for r in rows.select("text").mapInArrow(run, "parts array<binary>").collect()]
    if not ordinary or not pool.where("toxic").limit(1).count():
        return None
    ids = _bounded(pool.where("toxic"), LEARNED).union(_bounded(pool.where("not toxic"), LEARNED))
    learned = texts.where(remainder("doc_id", FOLDS) < HELD).join(F.broadcast(ids), F.col("doc_id") == F.col("l_id"))
    return train(ORDINARY_BYTES, [p for doc in ordinary for p in doc]), toxic_marks(learned.select("toxic", "text"))


def scores(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> DataFrame:
    """doc_id, held_out, score, predicted; one row per row of ``docs``."""
    known = labelled(labels, label).select("l_id", (F.col("label") >= 0.5).alias("toxic"), remainder("l_id", FOLDS).alias("fold"))
    known = keep(known.where(F.col("fold") != HELD), "toxicity-labels")
    held = (remainder("doc_id", FOLDS) == HELD).alias("held_out")
    nothing = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held, F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    content = dictionaries(docs, known)
    if content is None:
        return nothing

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distance = Distance(*content)
        for batch in batches:
            gains = [distance.described(g) for g in distance.many(t.as_py() for t in batch["text"])]
            yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"], "gains": pa.array(gains, pa.list_(pa.float64()))})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, gains array<double>")
    rows = keep(rows, "toxicity-gains")
    judged = keep(rows.join(known.where("fold = 3"), F.col("doc_id") == F.col("l_id")).select("l_id", "toxic", "gains"), "toxicity-judged")
    fit = _sampled(judged, SAMPLE).collect()
    if not fit:
        return nothing
    weights = logistic(np.array([r["gains"] for r in fit]), np.array([float(r["toxic"]) for r in fit]))
    linear = sum((F.col("gains")[i] * F.lit(float(w)) for i, w in enumerate(weights[:-1])), F.lit(float(weights[-1])))
    raw = (1 / (1 + F.exp(-linear))).alias("raw")
    points = curve(judged.select(raw, F.col("toxic").cast("int").alias("y")), "raw", "y", 0.0, 1.0)

    def calibrate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = calibrated(batch["raw"].to_numpy(zero_copy_only=False), points)
            yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"], "score": pa.array(score, pa.float64())})

    scored = rows.select("doc_id", raw).mapInArrow(calibrate, "doc_id long, score double")
    return scored.select("doc_id", held, "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
