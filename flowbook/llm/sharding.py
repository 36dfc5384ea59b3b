"""K-d tree sharding by bytes, in DataFrame functions alone.

Groups of equal texts are points in metadata space (size, text, source,
language; of a group whose copies differ in source or language, the smallest
name).  A node
that must become k shards is split along its widest dimension, relative to
that dimension's range over all documents, at the weighted quantile that gives
k // 2 shards' share of the bytes to the left.  A node of one shard is a leaf,
which then holds the target bytes (total / shards) up to one document.

Every coordinate is a key of 63 bits: 32 of the dimension, 31 of a hash of the
text.  So equal values (a source with a third of the rows) can be split too,
and equal texts stay together: their rows have the same keys.  Only a group of
more than ``GROUP_SHARE`` of a leaf's bytes is hashed by row instead and may be
split, as leaves of near equal bytes need.  The quantile is found by distributed counting: the
node's key range is cut into ``BINS`` bins, their bytes are summed, and the bin
that holds the quantile is cut again, until its bytes are below ``TOLERANCE``
of a shard.  Per pass at most one row per node reaches the driver, and all
nodes of a level are worked off together.  Texts are read once and never
shuffled; slots come from row numbers in hashed parts of a shard plus the
part's offset, so that no task gets a whole shard.

Defined results: null text is an empty text (16 bytes); a null dimension is
zero; repeated rows are placed one by one; a null doc_id is kept.  An empty
table gives no rows; with fewer rows than shards some shards stay empty.
Other columns are neither read nor returned.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowbook.llm.common import keep, table

SHARDS = 40
OVERHEAD = 16
BINS = 4096
TOLERANCE = 1e-3
PART_ROWS = 20_000
LOW_BITS = 31
AXES = 4
#: Of a leaf's bytes: groups of equal texts up to this size are never split.
GROUP_SHARE = 0.25


@dataclass
class Node:
    """Rows under a node: ``shards`` leaves from number ``first`` on."""

    shards: int
    first: int
    axis: int = 0
    split: int | None = None  # rows with a smaller key go left
    low: int = 0  # what is left of the search
    high: int = 0
    before: int = 0
    target: float = 0.0


def metadata(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, row (a stable number) and the keys k0..k3."""
    text = F.coalesce(F.col("text"), F.lit(""))
    size = (F.octet_length(text) + OVERHEAD).cast("long")

    def named(c: str) -> Column:
        return F.crc32(F.coalesce(F.col(c).cast("string"), F.lit("")))

    rows = docs.select(
        "doc_id", size.alias("size"), F.crc32(text).alias("text_crc32"), F.monotonically_increasing_id().alias("row"),
        F.md5(text).alias("md5"), named("source").alias("source"), named("lang").alias("lang"),
    )
    rows = keep(rows, "shard-rows")
    # Written, so that the join below has two plain exchanges and can split a text that many rows share.
    groups = rows.groupBy(F.col("md5").alias("g_md5")).agg(F.sum("size").alias("bytes"), F.min("source").alias("g_source"), F.min("lang").alias("g_lang"), F.count(F.lit(1)).alias("n"))
    groups = keep(groups.where("n > 1").drop("n"), "shard-groups")
    largest = GROUP_SHARE * (rows.agg(F.sum("size")).first()[0] or 0) / shards
    joined = rows.join(groups, F.col("md5") == F.col("g_md5"), "left")
    dims = [F.floor(F.log2(F.col("size").cast("double")) * (1 << 26)), F.col("text_crc32"), F.coalesce("g_source", "source"), F.coalesce("g_lang", "lang")]
    hashed = F.when(F.col("bytes") > largest, F.xxhash64("row", "md5")).otherwise(F.xxhash64("md5"))
    tie = F.shiftrightunsigned(hashed, 64 - LOW_BITS)
    keys = [(F.shiftleft(d.cast("long"), LOW_BITS) + tie).alias(f"k{i}") for i, d in enumerate(dims)]
    return keep(joined.select("doc_id", "size", "text_crc32", "row", *keys), "shard-metadata")


def _by_node(values: dict[int, int | float], kind: str) -> Column:
    """The value of the row's node, from a constant array; null for others."""
    cells = [F.lit(values.get(i)).cast(kind) for i in range(max(values, default=0) + 1)]
    return F.get(F.array(*cells), F.col("node"))


def _key(axis: Column, axes: int) -> Column:
    return F.get(F.array(*[F.col(f"k{i}") for i in range(axes)]), axis)


def _down(rows: DataFrame, level: dict[int, Node], axes: int) -> DataFrame:
    """Rows moved to the children of this level's split nodes: a written table,
    so that the next level's passes read a plain column."""
    split = {i: n for i, n in level.items() if n.split is not None}
    bound = _by_node({i: n.split for i, n in split.items()}, "long")
    right = _key(_by_node({i: n.axis for i, n in split.items()}, "int"), axes) >= bound
    child = 2 * F.col("node") + F.when(right, 1).otherwise(0)
    return keep(rows.withColumn("node", F.when(bound.isNotNull(), child).otherwise(F.col("node"))), "shard-level")


def _search(rows: DataFrame, nodes: dict[int, Node], axes: int, tolerance: float) -> None:
    """Set the split of every node at its weighted quantile."""
    rows = rows.select("node", "size", _key(_by_node({i: n.axis for i, n in nodes.items()}, "int"), axes).alias("key"))
    while nodes:
        width = {i: -(-(n.high - n.low + 1) // BINS) for i, n in nodes.items()}
        low, high = (_by_node({i: getattr(n, end) for i, n in nodes.items()}, "long") for end in ("low", "high"))
        inside = rows.where(F.col("key").between(low, high)).select("node", "size", (F.col("key") - low).alias("up"), _by_node(width, "long").alias("wide"))
        inside = inside.withColumn("bin", F.expr("up div wide"))
        sums = inside.groupBy("node", "bin").agg(F.sum("size").alias("bytes"))
        over = W.partitionBy("node").orderBy("bin")
        sums = sums.withColumn("upto", F.sum("bytes").over(over) + _by_node({i: n.before for i, n in nodes.items()}, "long"))
        target = _by_node({i: n.target for i, n in nodes.items()}, "double")
        found = sums.where((F.col("upto") >= target) & (F.col("upto") - F.col("bytes") < target)).collect()
        open_: dict[int, Node] = {}
        for r in found:
            node, w = nodes[r["node"]], width[r["node"]]
            start = node.low + r["bin"] * w
            node.before = r["upto"] - r["bytes"]
            if w == 1 or r["bytes"] <= tolerance:
                nearer = node.target - node.before < r["upto"] - node.target
                node.split = start if nearer else start + w
            else:
                node.low, node.high = start, min(start + w - 1, node.high)
                open_[r["node"]] = node
        nodes = open_


def build(meta: DataFrame, shards: int = SHARDS, axes: int = AXES) -> tuple[DataFrame, dict[int, int]]:
    """``meta`` with each row's leaf as ``node``, and the leaves' shards."""
    rows, level, leaves, ranges, tolerance = meta.withColumn("node", F.lit(1)), {1: Node(shards, 0)}, {}, None, 0.0
    while level:
        ends = [f(f"k{i}").alias(f"{n}{i}") for i in range(axes) for n, f in (("lo", F.min), ("hi", F.max))]
        stats = {r["node"]: r for r in rows.groupBy("node").agg(F.sum("size").alias("bytes"), *ends).collect()}
        if not stats:
            return rows, {1: 0}
        if ranges is None:
            ranges = [max(1, stats[1][f"hi{i}"] - stats[1][f"lo{i}"]) for i in range(axes)]
            tolerance = TOLERANCE * stats[1]["bytes"] / shards
        leaves |= {i: n.first for i, n in level.items() if n.shards == 1}
        todo = {i: n for i, n in level.items() if n.shards > 1 and i in stats}
        for i, node in todo.items():
            r = stats[i]
            node.axis = max(range(axes), key=lambda a: ((r[f"hi{a}"] - r[f"lo{a}"]) / ranges[a], -a))
            node.low, node.high = r[f"lo{node.axis}"], r[f"hi{node.axis}"]
            node.target = r["bytes"] * (node.shards // 2) / node.shards
        if todo:
            _search(rows, dict(todo), axes, tolerance)
            rows = _down(rows, todo, axes)
        level = {}
        for i, n in todo.items():
            left = n.shards // 2
            level |= {2 * i: Node(left, n.first), 2 * i + 1: Node(n.shards - left, n.first + left)}
    return rows, leaves


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot; one row per row of ``docs``."""
    meta = metadata(docs, shards)
    placed, leaves = build(meta, shards)
    placed = placed.withColumn("shard", _by_node(leaves, "int"))
    parts = max(8, -(-meta.count() // (shards * PART_ROWS)))
    placed = placed.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int"))
    sizes = placed.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(W.partitionBy("shard").orderBy("part")) - F.col("n")
    offsets = sizes.select("shard", "part", before.alias("before"))
    within = F.row_number().over(W.partitionBy("shard", "part").orderBy("doc_id", "row")) - 1
    rows = placed.select("doc_id", "size", "text_crc32", "shard", "part", within.alias("within"))
    return rows.join(offsets, ["shard", "part"]).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("within")).cast("long").alias("slot")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard(table(spark, sf_dir, "documents"))
    return placed.select(
        F.col("doc_id").cast("long").alias("doc_id"), "size", "text_crc32",
        F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )
