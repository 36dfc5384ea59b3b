"""SentencePiece encoding and decoding by vectorised merge rounds.

The pieces of a BPE model are read once, on the driver, into a table of merges:
a key for every way to split a piece into two symbols, the piece that it makes
and the rank of its score.  A text is cut where no merge can cross (before a
space mark that follows another character, and around characters that no
longer piece holds); each distinct word of a block of texts is encoded once and
remembered in a bounded table.

The symbols of all new words lie in one flat array.  A round looks up the rank
of every neighbouring pair, takes each word's minimum by segments, merges every
leftmost, non-overlapping occurrence of it at once, and compacts the array;
words without a pair leave it, until none remains.

The library merges one pair at a time, always the best one.  Merging all
occurrences together is the same unless a merge makes a pair that ranks at
least as well as itself with the symbol left or right of it (scores that tie,
such as those of runs of spaces, or a piece better than its parts).  The round
looks these pairs up as well, and a word that has one is finished pair by pair
on a heap.

Characters outside the vocabulary become byte pieces.  Decoding gathers the
pieces' bytes by id, drops the leading space mark's space, and replaces bytes
that are no UTF-8 one by one.

Models must be BPE with byte pieces, identity normalisation and a leading space
mark; others raise ValueError.

Defined results: a null text is an empty text and yields the begin and end ids
alone, which decode to the empty text; a null doc_id stays null; repeated rows
are encoded once each; an empty table gives no rows; other columns are neither
read nor returned.  Texts are worked off in slices, cut at words, of about
``SLICE`` characters.
"""

from __future__ import annotations

import codecs
import heapq
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowbook.llm.common import ship, table

ship(__name__)

MODEL = public_tokenizers.path("piece_bpe_32k.model")
MARK = "▁"
SLICE = 1 << 20
REMEMBERED = 1 << 18
#: Rows that a task works on at once.
ROWS = 1024
#: Slots of the table of merges for each of them, at least, and its hash.
SPARE = 8
MIX = np.uint64(0x9E3779B97F4A7C15)
#: Symbols are piece ids, or SYMBOLS' upper part: ``size`` + code point.
SHIFT = np.int64(21)
NONE = np.iinfo(np.int32).max
CODE_POINTS = 0x110000


class Tables(NamedTuple):
    """What encoding and decoding need of a model."""

    size: int
    begin: int
    end: int
    bytes_from: np.ndarray  # id of each byte's piece
    chars: np.ndarray  # code points that are pieces, and their ids
    char_ids: np.ndarray
    keys: np.ndarray  # left << SHIFT | right
    made: np.ndarray  # the piece made, and the rank of its score
    ranks: np.ndarray
    joined: str  # characters of longer pieces, but the space mark
    surfaces: np.ndarray  # bytes of all pieces, one after another
    starts: np.ndarray
    lengths: np.ndarray
    marked: np.ndarray  # pieces that begin with the space mark
    control: np.ndarray


def load(path: str = MODEL) -> Tables:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size = model.get_piece_size()
    every = [model.id_to_piece(i) for i in range(size)]
    byte = {every[i]: i for i in range(size) if model.is_byte(i)}
    control = np.array([model.is_control(i) for i in range(size)])
    plain = [i for i in range(size) if not (model.is_byte(i) or control[i] or model.is_unknown(i))]
    probe = "  a  b\n　ﬁ\x00 "
    if len(byte) != 256 or model.normalize(probe) != MARK + probe.replace(" ", MARK) or any(model.is_unused(i) for i in range(size)) or CODE_POINTS + size > 1 << int(SHIFT):
        raise ValueError("only BPE models with byte pieces, identity normalisation and a leading space mark are known")
    if any(re.search(f"[^{MARK}]{MARK}", every[i]) for i in plain):
        raise ValueError("a piece crosses the beginning of a word")

    ids = {every[i]: i for i in plain}
    inside = {c for p in ids if len(p) > 1 for c in p}

    def symbol(part: str) -> int | None:
        return ids.get(part, size + ord(part) if len(part) == 1 else None)

    scores = {i: model.get_score(i) for i in plain}
    rank_of = {s: r for r, s in enumerate(sorted(set(scores.values()), reverse=True))}
    merges = {}
    for piece, i in ids.items():
        for k in range(1, len(piece)):
            left, right = symbol(piece[:k]), symbol(piece[k:])
            if left is not None and right is not None:
                merges[left << int(SHIFT) | right] = (i, rank_of[scores[i]])
    keys = np.array(sorted(merges), np.int64)
    values = np.array([merges[k] for k in keys.tolist()], np.int32).reshape(-1, 2)
    texts = [bytes([int(p[3:5], 16)]) if p in byte else b"" if control[i] else " ⁇ ".encode() if model.is_unknown(i) else p.replace(MARK, " ").encode() for i, p in enumerate(every)]
    lengths = np.array(list(map(len, texts)), np.int64)
    single = sorted((ord(p), i) for p, i in ids.items() if len(p) == 1)
    return Tables(
        size, model.bos_id(), model.eos_id(), np.array([byte[f"<0x{b:02X}>"] for b in range(256)], np.int64),
        np.array([c for c, _ in single]), np.array([i for _, i in single]), keys, values[:, 0].copy(), values[:, 1].copy(), "".join(sorted(inside - {MARK})),
        np.frombuffer(b"".join(texts), np.uint8), np.cumsum(lengths) - lengths, lengths, np.array([p.startswith(MARK) for p in every]), control,
    )


def _spread(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... within each group of the given sizes."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


class Encoder:
    def __init__(self, t: Tables):
        self.t = t
        self.symbols = np.arange(CODE_POINTS, dtype=np.int64) + t.size
        self.symbols[t.chars] = t.char_ids
        joined = "".join(map(re.escape, t.joined))
        self.words = re.compile(f"{MARK}+[{joined}]*|[{joined}]+|[^{MARK}{joined}]" if joined else f"{MARK}+|[^{MARK}]", re.DOTALL)
        self.known: dict[str, bytes] = {}
        # Merges in a hash table with linear probing; slot 0 of the values means none.
        self.bits = max(4, (SPARE * len(t.keys) - 1).bit_length())
        self.slots, self.entry = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int32)
        self.made, self.ranks = np.append(np.int32(0), t.made), np.append(np.int32(NONE), t.ranks)
        waiting, step = np.arange(len(t.keys)), 0
        while len(waiting):
            slot = self.slot(t.keys[waiting], step)
            slot, first = np.unique(slot, return_index=True)
            free = self.slots[slot] < 0
            self.slots[slot[free]], self.entry[slot[free]] = t.keys[waiting[first[free]]], waiting[first[free]] + 1
            waiting, step = np.delete(waiting, first[free]), step + 1

    def slot(self, key: np.ndarray, step: int) -> np.ndarray:
        return ((key.astype(np.uint64) * MIX >> np.uint64(64 - self.bits)).astype(np.int64) + step) & ((1 << self.bits) - 1)

    def look(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The piece that each pair makes and its rank; ``NONE`` where none."""
        key = left << SHIFT | right
        at = self.slot(key, 0)
        there = self.slots[at]
        found = np.where(there == key, self.entry[at], 0)
        open_, step = np.flatnonzero((there != key) & (there >= 0)), 1
        while len(open_):
            at = self.slot(key[open_], step)
            there = self.slots[at]
            hit = there == key[open_]
            found[open_[hit]] = self.entry[at[hit]]
            open_, step = open_[~hit & (there >= 0)], step + 1
        return self.made[found], self.ranks[found]

    def one_by_one(self, symbols: list[int]) -> list[int]:
        """A word finished by single merges, the best and leftmost first."""
        merge = dict[tuple[int, int], tuple[int, int]]()

        def pair(a: int, b: int) -> tuple[int, int]:
            if (a, b) not in merge:
                made, rank = self.look(np.array([a]), np.array([b]))
                merge[a, b] = int(rank[0]), int(made[0])
            return merge[a, b]

        n, after, before = len(symbols), list(range(1, len(symbols) + 1)), list(range(-1, len(symbols) - 1))
        heap = [(rank, i, symbols[i], symbols[i + 1], made) for i in range(n - 1) for rank, made in [pair(symbols[i], symbols[i + 1])] if rank != NONE]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, made = heapq.heappop(heap)
            j = after[i]
            if j >= n or symbols[i] != a or symbols[j] != b:
                continue
            symbols[i], symbols[j], after[i] = made, -1, after[j]
            if after[j] < n:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n:
                    rank, new = pair(symbols[x], symbols[y])
                    if rank != NONE:
                        heapq.heappush(heap, (rank, x, symbols[x], symbols[y], new))
        return [s for s in symbols if s >= 0]

    def merged(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers, ascending, and the symbols that no merge is left for."""
        flat = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        symbol = self.symbols[flat]
        word = np.repeat(np.arange(len(words)), list(map(len, words)))
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbol):
            made, rank = self.look(symbol[:-1], symbol[1:])
            rank = np.append(np.where(word[:-1] == word[1:], rank, NONE), NONE)
            starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            sizes = np.diff(np.append(starts, len(word)))
            least = np.repeat(np.minimum.reduceat(rank, starts), sizes)
            over = least == NONE
            # Of overlapping occurrences every second one, from the left.
            hit = np.flatnonzero((rank == least) & ~over)
            head = np.append(True, np.diff(hit) != 1) if len(hit) else np.zeros(0, bool)
            run = np.flatnonzero(head)
            hit = hit[_spread(np.diff(np.append(run, len(hit)))) % 2 == 0]
            new = made[hit]
            # The pairs of each new piece with what stands left (merged already) and right of it.
            state = symbol.copy()
            state[hit + 1] = new
            left = np.maximum(hit - 1, 0)
            right = np.minimum(hit + 2, len(symbol) - 1)
            _, l_rank = self.look(state[left], new)
            _, r_rank = self.look(new, symbol[right])
            l_rank[(hit == 0) | (word[left] != word[hit])] = NONE
            r_rank[(hit + 2 > len(symbol) - 1) | (word[right] != word[hit])] = NONE
            overtaken = np.unique(word[hit[np.minimum(l_rank, r_rank) <= rank[hit]]])
            if len(overtaken):
                singly = np.isin(word, overtaken)
                edges = np.flatnonzero(np.append(True, word[singly][1:] != word[singly][:-1]))
                for w, part in zip(word[singly][edges].tolist(), np.split(symbol[singly], edges[1:])):
                    out = np.array(self.one_by_one(part.tolist()), np.int64)
                    done.append((np.full(len(out), w), out))
                over |= singly
                finished = over & ~singly
            else:
                finished = over
            done.append((word[finished], symbol[finished]))
            symbol[hit] = np.where(over[hit], symbol[hit], new)
            stays = ~over
            stays[hit + 1] = False
            symbol, word = symbol[stays], word[stays]
        numbers = np.concatenate([d[0] for d in done]) if done else np.zeros(0, np.int64)
        order = np.argsort(numbers, kind="stable")
        return numbers[order], (np.concatenate([d[1] for d in done]) if done else np.zeros(0, np.int64))[order]

    def learn(self, words: list[str]) -> None:
        """Remember the ids of ``words``."""
        if len(self.known) + len(words) > REMEMBERED:
            self.known.clear()
        numbers, symbol = self.merged(words)
        # Characters without a piece become the bytes of their UTF-8 form.
        point = symbol - self.t.size
        width = np.where(point < 0, 1, 1 + (point >= 0x80) + (point >= 0x800) + (point >= 0x10000))
        n, k = np.repeat(width, width), _spread(width)
        c = np.repeat(point, width)
        lead = np.where(n == 1, c, (c >> 6 * (n - 1)) | np.array([0, 0, 0xC0, 0xE0, 0xF0])[n])
        byte = np.where(k == 0, lead, 0x80 | (c >> np.maximum(6 * (n - 1 - k), 0)) & 0x3F)
        ids = np.where(c < 0, c + self.t.size, self.t.bytes_from[np.where(c < 0, 0, byte)]).astype("<u4")
        ends = np.cumsum(np.bincount(np.repeat(numbers, width), minlength=len(words)) * 4).tolist()
        data = ids.tobytes()
        for word, lo, hi in zip(words, [0, *ends], ends):
            self.known[word] = data[lo:hi]

    def slices(self, text: str) -> Iterator[str]:
        """The normalised text, in parts that begin at a word."""
        if not text:
            return
        text, at = MARK + text.replace(" ", MARK), 0
        while at < len(text):
            end = at + SLICE
            if end < len(text):
                cut = max(text.rfind(MARK, at + 1, end), at)
                while cut > at and text[cut - 1] == MARK:
                    cut -= 1
                if cut == at:  # no word begins here: go on to the next one
                    m = re.compile(f"(?<!{MARK}){MARK}").search(text, end)
                    cut = m.start() if m else len(text)
                end = cut
            yield text[at:end]
            at = end

    def __call__(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, begin and end included, as little-endian
        unsigned 32-bit integers."""
        outs, waiting, size = [[self.t.begin.to_bytes(4, "little")] for _ in texts], [], 0

        def flush() -> None:
            new = set().union(*(w for _, w in waiting))
            if len(self.known) + len(new) > REMEMBERED:
                self.known.clear()
            self.learn(list(new.difference(self.known)))
            known = self.known
            for i, words in waiting:
                outs[i].append(b"".join([known[w] for w in words]))
            waiting.clear()

        for i, text in enumerate(texts):
            for part in self.slices(text):
                waiting.append((i, self.words.findall(part)))
                size += len(part)
                if size >= SLICE:
                    flush()
                    size = 0
        flush()
        end = self.t.end.to_bytes(4, "little")
        return [b"".join([*out, end]) for out in outs]


def decoded(t: Tables, ids: np.ndarray) -> str:
    """The text of an id sequence.  Control pieces have no text, but bytes on
    either side of one are not joined to a character."""
    texts, first = [], True
    for own in np.split(ids, np.flatnonzero(np.diff(t.control[ids])) + 1):
        if len(own) and not t.control[own[0]]:
            lengths = t.lengths[own]
            data = t.surfaces[np.repeat(t.starts[own], lengths) + _spread(lengths)].tobytes()
            data = data[1:] if first and t.marked[own[0]] else data
            first = False
            try:
                texts.append(data.decode())
            except UnicodeDecodeError:
                texts.append(_lenient(data))
    return "".join(texts)


def _each(error: UnicodeDecodeError) -> tuple[str, int]:
    return "\ufffd", error.start + 1


def _lenient(data: bytes) -> str:
    """Every byte that is not part of a character becomes one U+FFFD."""
    codecs.register_error("each-byte", _each)
    return data.decode("utf-8", "each-byte")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return (batch.slice(at, ROWS) for batch in batches for at in range(0, batch.num_rows, ROWS))


def encode(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit integers, the begin
    and end ids included); one row per row."""
    tables = load(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tables)
        for batch in _cut(batches):
            ids = encoder([t.as_py() or "" for t in batch["text"]])
            yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"], "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()), "ids": pa.array(ids, pa.binary())})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """``encoded`` (doc_id, n_tokens, ids) with its text."""
    tables = load(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _cut(batches):
            texts = [decoded(tables, np.frombuffer(x.as_py(), "<u4").astype(np.int64)) for x in batch["ids"]]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "text"])

    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(run, "doc_id long, n_tokens long, ids binary, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decode(encode(table(spark, sf_dir, "documents")))
    return rows.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))
