"""SimHash near-duplicates: a byte-position inverted index with count filtering.

Fingerprints are 64 bits over word shingles.  Two fingerprints within
``max_bits`` = 2 bits share at least 6 of their 8 positional bytes: that is
the guaranteed minimum of the count filter.  Postings of single bytes would
hold 1/256 of the corpus each, so the index intersects the postings of four
positions at a time: a posting is a set of four positions and their bytes.  The
14 sets are chosen so that any three positions lie together in exactly one of
them (the Steiner system S(3, 4, 8)).  How many postings a pair shares then
tells how many positional bytes it shares:

    bytes shared      8    7    6    5    4    fewer
    postings shared  14    7    3    1    0-1    0

* The postings shared by each pair are tallied, and pairs with fewer than 3 are
  dropped: they share fewer than 6 bytes.  The Hamming distance verifies the
  rest.
* A posting of more than ``PAIR_LIMIT`` fingerprints (a large group of near
  copies) is never paired.  Two fingerprints are within two bits exactly if they
  share a *midpoint*, a value at most one bit from both.  Each fingerprint of
  such postings is listed under its 65 midpoints, and a midpoint links its
  members to the smallest of them: the same components from a linear number of
  rows.  A near pair that shares such a posting is linked there; one that
  shares none has all its postings in the tally.

Defined results: null text is an empty text; a text without words has
fingerprint zero and links like any other; repeated rows and repeated doc_ids
each keep their row; a null doc_id never lowers a component_id, and a
component of null ids alone has a null component_id.  An empty table gives no
rows.  Other columns are neither read nor returned.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations, repeat
from operator import xor

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowbook.llm.common import free_names, keep, ship, table, text_md5

ship(__name__)

SHINGLE = 3
MAX_BITS = 2
SEED = 42
PAIR_LIMIT = 32

#: Bits of every byte value, most significant first.
BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
CHUNK = 1 << 16


def shingle_hashes(text: str | None, width: int = SHINGLE) -> np.ndarray:
    """XXH64 of every ``width``-word shingle of the lower-cased text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    runs = map(b" ".join, zip(*(words[i:] for i in range(width))))
    return np.fromiter(map(xxhash.xxh64_intdigest, runs, repeat(SEED)), np.uint64, len(words) - width + 1)


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """Bit i is 1 if it is set in over half of the shingle hashes."""
    hashes = shingle_hashes(text, width)
    counts = np.zeros(2048, np.int64)
    for at in range(0, len(hashes), CHUNK):
        cells = hashes[at : at + CHUNK].astype(">u8").view(np.uint8).reshape(-1, 8) + np.arange(8, dtype=np.int64) * 256
        counts += np.bincount(cells.ravel(), minlength=2048)
    bits = (counts.reshape(8, 256) @ BYTE_BITS).ravel() * 2 > len(hashes)
    return int(np.packbits(bits).view(">i8")[0])


def fingerprints(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """doc_id, md5 (of the text), fp (the 64 bits as a long); one row per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t.as_py(), width) for t in batch["text"]]
            yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"], "md5": batch["md5"], "fp": pa.array(fps, pa.int64())})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_md5().alias("md5"))
    return rows.mapInArrow(run, "doc_id long, md5 string, fp long")


#: Postings that a pair sharing 6 of 8 bytes has in common.
LEAST_SHARED = 3


def position_sets() -> list[tuple[int, ...]]:
    """Sets of four of the 8 positions, any three positions in one set alone:
    numbers of 3 bits whose exclusive or is zero."""
    return [c for c in combinations(range(8), 4) if reduce(xor, c) == 0]


def _byte(fp: Column, position: int) -> Column:
    return F.shiftrightunsigned(fp, 56 - 8 * position).bitwiseAND(F.lit(0xFF))


def links(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Links (a, b), a < b, between *distinct* fingerprints ``fps(fp)``; their
    transitive closure is that of all pairs within ``max_bits`` bits."""
    if max_bits != 2:
        raise ValueError("the tally is laid out for two differing bits")
    sets = position_sets()
    keys = [
        F.struct(F.lit(k).alias("k"), reduce(Column.__add__, [F.shiftleft(_byte(F.col("fp"), p), 24 - 8 * i) for i, p in enumerate(s)]).alias("v"))
        for k, s in enumerate(sets)
    ]
    postings = fps.select("fp", F.explode(F.array(*keys)).alias("key")).select("fp", "key.k", "key.v")
    lengths = postings.groupBy("k", "v").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    listed = keep(postings.join(lengths, ["k", "v"]), "simhash-postings")

    short = listed.where(F.col("n") <= PAIR_LIMIT)
    a, b = short.select("k", "v", F.col("fp").alias("a")), short.select("k", "v", F.col("fp").alias("b"))
    tallied = a.join(b, ["k", "v"]).where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))
    near = tallied.where(F.col("shared") >= LEAST_SHARED).select("a", "b")

    flips = F.array(*[F.lit(1 << s if s < 63 else -(1 << 63)) for s in range(64)])
    crowded = listed.where(F.col("n") > PAIR_LIMIT).select("fp").distinct()
    middles = crowded.select("fp", F.explode(F.concat(F.array(F.col("fp")), F.transform(flips, lambda x: F.col("fp").bitwiseXOR(x)))).alias("mid"))
    centres = middles.groupBy("mid").agg(F.min("fp").alias("a"), F.max("fp").alias("top")).where("a < top").select("mid", "a")
    starred = middles.join(centres, "mid").where("a < fp").select("a", F.col("fp").alias("b"))

    both = near.union(starred)
    return both.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): connected components by large-star and small-star rounds,
    root the smallest node.  Each round is a written table."""
    spark = edges.sparkSession

    def measure(e: DataFrame) -> tuple:
        r = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        return r[0], r[1]

    # Star edges always run from the smaller end (a) to the larger (b).
    stars, before = keep(edges.select("a", "b"), "star"), None
    now = measure(stars)
    while now != before:
        both = stars.union(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = keep(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m")), "star-low")
        large = both.where("b > a").join(low, "a").select(F.col("m").alias("a"), "b").where("a < b").distinct()
        large = keep(large, "star-large")
        low = keep(large.groupBy("b").agg(F.min("a").alias("m")), "star-low")
        small = large.join(low, "b").select("m", F.explode(F.array("a", "b")).alias("b"))
        stars = keep(small.select(F.col("m").alias("a"), "b").where("a < b").distinct(), "star")
        before, now = now, measure(stars)
    return stars.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root")) if now[0] else (
        spark.createDataFrame([], "node long, root long")
    )


def groups(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """fp, component_id (smallest doc_id of the component) and md5 (of the
    smallest text digest that this id has): one row per distinct fingerprint."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "md5")).alias("first")
    distinct = keep(prints.groupBy("fp").agg(first), "simhash-distinct")
    roots = components(links(distinct.select("fp"), max_bits))
    rooted = keep(
        distinct.join(roots, distinct.fp == roots.node, "left").select("fp", F.coalesce("root", "fp").alias("root"), "first"),
        "simhash-rooted",
    )
    least = keep(rooted.groupBy("root").agg(F.min("first").alias("first")), "simhash-least")
    return rooted.select("fp", "root").join(least, "root").select("fp", F.col("first.doc_id").alias("component_id"), F.col("first.md5").alias("md5"))


def near_duplicates(docs: DataFrame, width: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """doc_id, md5, fp, component_id, first_md5; one row per row of ``docs``."""
    prints = keep(fingerprints(docs, width), "simhash-prints")
    found = keep(groups(prints, max_bits).withColumnRenamed("md5", "first_md5"), "simhash-groups")
    return prints.join(found, "fp").select("doc_id", "md5", "fp", "component_id", "first_md5")


def keep_one(docs: DataFrame, width: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with one document of each near-duplicate group: that with the
    smallest doc_id; of repeated rows of that document, one."""
    prints = keep(fingerprints(docs, width), "simhash-prints")
    own, first, digest = free_names(docs, "__md5", "__id", "__kept")
    kept = groups(prints, max_bits).select(F.col("component_id").alias(first), F.col("md5").alias(digest)).distinct()
    tagged = docs.withColumn(own, text_md5())
    hit = tagged.join(kept, tagged["doc_id"].cast("long").eqNullSafe(F.col(first)) & (F.col(own) == F.col(digest)))
    return hit.dropDuplicates(["doc_id", own]).select(*[hit[c] for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
