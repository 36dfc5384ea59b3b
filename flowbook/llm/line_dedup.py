"""Repeated line runs: a suffix array over line ids by distributed prefix
doubling, longest-common-prefix intervals, and deletion of later copies.

A run is a sequence of whole lines of one document.  Of every repeated run of
at least ``MIN_WORDS`` words the first copy in corpus order (doc_id, then line)
stays and the lines of all others are deleted; runs are taken at their maximal
length, so a line goes if any run through it has an earlier copy.

1. Lines that occur once can be in no run: they cut documents into fragments of
   repeated lines, and fragments of too few words are dropped.  What is left is
   numbered in corpus order (``s``): the text of the suffix array.
2. Prefix doubling: suffixes are ranked by their first 1, 2, 4, ... lines.  A
   round joins each suffix with the rank 2^k lines on, sorts by range over
   (rank, rank, s) and counts: a task numbers its own groups, and one row per
   task carries counts and open groups over to the next.  The place ``s`` in
   the sort key splits a group of copies over tasks.
3. Longest common prefixes with the neighbour in the array: by Kärkkäinen's
   rule a suffix whose neighbour is preceded by the same line has its
   predecessor's value less one, so only the others compare lines.
4. The longest run with an earlier copy that begins at a suffix is the widest
   LCP interval in which it is not the first: its nearest smaller ``s`` to the
   left or right in the array.  Tasks answer this with a stack over their part
   of the array; what reaches over the ends of parts is a short staircase
   (prefix length, smallest s), one per part, which the driver chains.

Defined results: null text is an empty text; line ends are LF, and a text whose
lines all go is empty; rows equal in doc_id and text are one document and get
the same result; texts of one doc_id follow each other by md5; a null doc_id
comes last.  An empty table gives no rows.  Other columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowbook.llm.common import keep, ship, table, text_md5

ship(__name__)

MIN_WORDS = 1
P = "__lines_"


def fragments(docs: DataFrame, min_words: int) -> DataFrame:
    """The suffix array's text: s (place), none, doc_id, md5, pos (line
    number), line (md5), before (line before it in the fragment), at (place in
    the fragment), rest (lines from here on), upto (words from the fragment's
    beginning to this line's end)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text in batch["text"]:
                own = (text.as_py() or "").encode().split(b"\n")
                found.append([{"line": md5(x).digest(), "words": len(x.split())} for x in own])
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["md5"], pa.array(found, line_type)], ["doc_id", "md5", "lines"])

    line_type = pa.list_(pa.struct([("line", pa.binary()), ("words", pa.int32())]))
    key = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_md5().alias("md5"), "text")
    each = key.mapInArrow(run, "doc_id long, md5 string, lines array<struct<line:binary,words:int>>")
    # Rows equal in doc_id and text are one document: told apart by narrow rows.
    whole = each.groupBy("doc_id", "md5").agg(F.first("lines").alias("lines"))
    lines = whole.select("doc_id", "md5", F.posexplode("lines").alias("pos", "l"))
    lines = keep(lines.select(F.col("doc_id").isNull().alias("none"), "doc_id", "md5", "pos", "l.line", "l.words"), "lines-all")
    many = keep(lines.groupBy("line").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("line").alias("l")), "lines-many")
    repeated = lines.join(many, F.col("line") == F.col("l")).drop("l")
    doc = W.partitionBy("none", "doc_id", "md5").orderBy("pos")
    cut = repeated.withColumn("part", F.col("pos") - F.row_number().over(doc))
    whole = W.partitionBy("none", "doc_id", "md5", "part")
    inside = whole.orderBy("pos")
    cut = cut.select(
        "none", "doc_id", "md5", "pos", "line",
        F.coalesce(F.lag("line").over(inside), F.lit(b"")).alias("before"),
        (F.row_number().over(inside) - 1).cast("long").alias("at"),
        F.count(F.lit(1)).over(whole).alias("lines"),
        F.sum("words").over(inside).cast("long").alias("upto"),
        F.sum("words").over(whole).alias("all"),
    ).where(F.col("all") >= min_words)
    cut = cut.withColumn("rest", F.col("lines") - F.col("at")).drop("lines", "all")
    ordered = cut.repartitionByRange("none", "doc_id", "md5").sortWithinPartitions("none", "doc_id", "md5", "pos")
    return keep(ordered.select(F.monotonically_increasing_id().alias("s"), "*"), "lines-text")


def _numbered(rows: DataFrame, *keys: str) -> DataFrame:
    """``rows`` (keys, s) in order of (keys, s): s, part, idx (place in the
    part), group (the place in the part of the first row of equal keys), open
    (its group began at the part's beginning).  One extra row per part with
    null s holds size, first and last key and last group."""
    schema = pa.schema([("s", pa.int64()), ("part", pa.int32()), ("idx", pa.int64()), ("group", pa.int64()), ("open", pa.bool_()), ("first", pa.string()), ("last", pa.string()), ("s0", pa.int64()), ("s1", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, group, first, last, s0, s1 = TaskContext.get().partitionId(), 0, 0, None, None, None, None
        for batch in batches:
            groups = []
            for key in zip(*(batch[k].to_pylist() for k in keys)):
                if key != last:
                    group, last = at, key
                    first = first or key
                groups.append(group)
                at += 1
            if groups:
                s = batch["s"].to_pylist()
                s0, s1 = s[0] if s0 is None else s0, s[-1]
                n, none = len(groups), [None] * len(groups)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip([s, [part] * n, range(at - n, at), groups, [g == 0 for g in groups], none, none, none, none], schema)], schema=schema)
        if at:
            yield pa.RecordBatch.from_pylist([{"part": part, "idx": at, "group": group, "first": repr(first), "last": repr(last), "s0": s0, "s1": s1}], schema)

    kinds = "s long, part int, idx long, group long, open boolean, first string, last string, s0 long, s1 long"
    ordered = rows.select(*keys, "s").repartitionByRange(*keys, "s").sortWithinPartitions(*keys, "s")
    return keep(ordered.mapInArrow(run, kinds), "lines-sorted")


def _parts(numbered: DataFrame) -> list:
    """A row per part, in order: as many as the sort had tasks."""
    return sorted(numbered.where("s is null").collect(), key=lambda r: r["part"])


def ranked(rows: DataFrame, *keys: str) -> DataFrame:
    """s, rank: 1 and the number of rows with smaller keys."""
    numbered = _numbered(rows, *keys)
    offset, carried, before = [], 0, None
    total = 0
    for r in _parts(numbered):
        start = carried if before == r["first"] else total  # where the part's first group began
        offset.append((r["part"], total, start))
        carried = start if r["group"] == 0 else total + r["group"]
        before, total = r["last"], total + r["idx"]
    places = numbered.sparkSession.createDataFrame(offset, "part int, offset long, start long")
    rank = F.when(F.col("open"), F.col("start")).otherwise(F.col("offset") + F.col("group")) + 1
    return keep(numbered.where("s is not null").join(F.broadcast(places), "part").select("s", rank.alias("rank")), "lines-rank")


def suffix_ranks(text: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(s, line number) and (s, final rank); equal ranks are equal fragments' ends."""
    longest = text.agg(F.max("rest")).first()[0] or 0
    rank = first = ranked(text.select("line", "s"), "line")
    rests, step = text.select("s", "rest"), 1
    while step < longest:
        ahead = rank.select((F.col("s") - step).alias("s"), F.col("rank").alias("ahead"))
        both = rank.join(rests, "s").join(ahead, "s", "left")
        second = F.when(F.col("rest") > step, F.col("ahead")).otherwise(F.lit(0))
        rank = ranked(both.select("s", "rank", second.alias("second")), "rank", "second")
        step *= 2
    return first, rank


def neighbours(rank: DataFrame) -> DataFrame:
    """The suffix array: s, part, idx and prev, the s of the row before."""
    numbered = _numbered(rank, "rank")
    last, firsts = None, []
    for r in _parts(numbered):
        firsts.append((r["part"], last))
        last = r["s1"]
    ends = numbered.sparkSession.createDataFrame(firsts, "part int, carried long")
    rows = numbered.where("s is not null").select("s", "part", "idx")
    before = F.lag("s").over(W.partitionBy("part").orderBy("idx"))
    return keep(rows.join(F.broadcast(ends), "part").select("s", "part", "idx", F.coalesce(before, F.col("carried")).alias("prev")), "lines-array")


def common_prefixes(text: DataFrame, first: DataFrame, array: DataFrame) -> DataFrame:
    """s, part, idx, lcp: lines in common with the array's row before."""
    lines = keep(text.select("s", "before", "at", "rest").join(first, "s"), "lines-numbered")
    fid = (F.col("s") - F.col("at")).alias("fid")
    whole = lines.groupBy(fid).agg(F.array_sort(F.collect_list(F.struct("at", "rank"))).alias("lines"))
    whole = keep(whole.select("fid", F.transform("lines", lambda x: x["rank"]).alias("lines")), "lines-fragments")

    def side(name: str) -> DataFrame:
        return lines.select(F.col("s").alias(f"{name}_s"), fid.alias(f"{name}_fid"), F.col("at").alias(f"{name}_at"), F.col("before").alias(f"{name}_before"), F.col("rank").alias(f"{name}_line"))

    a, b = side("a"), side("b")
    pairs = array.select("s", "prev").join(a, F.col("s") == F.col("a_s")).join(b, F.col("prev") == F.col("b_s"), "left")
    same_first = F.coalesce(F.col("a_line") == F.col("b_line"), F.lit(False))
    follows = same_first & (F.length("a_before") > 0) & (F.col("a_before") == F.col("b_before"))
    pairs = keep(pairs.select("s", "a_fid", "a_at", "b_fid", "b_at", same_first.alias("same"), follows.alias("follows")), "lines-pairs")
    compared = pairs.where("same and not follows")
    compared = compared.join(whole.select(F.col("fid").alias("a_fid"), F.col("lines").alias("a_lines")), "a_fid")
    compared = compared.join(whole.select(F.col("fid").alias("b_fid"), F.col("lines").alias("b_lines")), "b_fid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for a, i, b, j in zip(*(batch[c] for c in ("a_lines", "a_at", "b_lines", "b_at"))):
                x, y = (v.values.to_numpy()[k.as_py() :] for v, k in ((a, i), (b, j)))
                n = min(len(x), len(y))
                unlike = (x[:n] != y[:n]).nonzero()[0]
                found.append(int(unlike[0]) if len(unlike) else n)
            yield pa.RecordBatch.from_pydict({"s": batch["s"], "lcp": pa.array(found, pa.int64())})

    known = compared.select("s", "a_lines", "a_at", "b_lines", "b_at").mapInArrow(run, "s long, lcp long")
    known = known.union(pairs.where("not same").select("s", F.lit(0).cast("long"))).withColumnRenamed("s", "k_s")
    filled = pairs.select("s", F.col("a_fid").alias("fid")).join(known, F.col("s") == F.col("k_s"), "left")
    reach = F.last(F.col("s") + F.col("lcp"), ignorenulls=True).over(W.partitionBy("fid").orderBy("s"))
    filled = filled.select(F.col("s").alias("f_s"), (reach - F.col("s")).alias("lcp"))
    return keep(array.select("s", "part", "idx").join(filled, F.col("s") == F.col("f_s")).drop("f_s"), "lines-lcp")


def _stairs(steps: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Of (prefix length, s), the smallest s for each length or more, by length."""
    out: list[tuple[int, int]] = []
    for v, s in sorted(steps, key=lambda x: (-x[0], x[1])):
        if v > 0 and (not out or s < out[-1][1]):
            out.append((v, s))
    return out[::-1]


def _capped(steps: list[tuple[int, int]], most: int) -> list[tuple[int, int]]:
    return [(min(v, most), s) for v, s in steps]


FAR = 1 << 60


def _edge(s: list[int], links: list[int]) -> list[tuple[int, int]]:
    """Stairs seen from before s[0]; links[i] is the prefix length of i and i + 1."""
    steps, v, low = [], FAR, None
    for i, x in enumerate(s):
        if low is None or x < low:
            steps.append((v, x))
            low = x
        if i < len(links):
            v = min(v, links[i])
        if v == 0:
            break
    return _stairs(steps)


def _longest(s: list[int], links: list[int], carried: list[tuple[int, int]]) -> list[int]:
    """For each row, the prefix length that it shares with the nearest smaller
    s before it; links[i] joins row i with row i - 1 (links[0] with what is
    carried), ``carried`` are the stairs of all earlier parts."""
    stack = [(x, carried[i - 1][0] if i else 0) for i, (_, x) in enumerate(carried)]
    out = []
    for i, x in enumerate(s):
        m = (carried[-1][0] if carried else 0) if i == 0 else links[i]
        while stack and stack[-1][0] > x:
            m = min(m, stack.pop()[1])
        m = m if stack else 0
        out.append(m)
        stack.append((x, m))
    return out


def earlier_runs(rows: DataFrame) -> DataFrame:
    """s, run: lines of the longest run from s on that has an earlier copy."""

    def edges(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("idx")
        s, lcp = part["s"].tolist(), part["lcp"].tolist()
        left, right = _edge(s, lcp[1:]), _edge(s[::-1], lcp[:0:-1])
        return pd.DataFrame({"part": [key[0]], "link": [lcp[0]], "least": [min(lcp[1:], default=FAR)], "left": [[list(x) for x in left]], "right": [[list(x) for x in right]]})

    kinds = "part int, link long, least long, left array<array<long>>, right array<array<long>>"
    ends = sorted(rows.groupBy("part").applyInPandas(edges, kinds).collect(), key=lambda r: r["part"])
    before: dict[int, list] = {}
    after: dict[int, list] = {}
    stairs: list[tuple[int, int]] = []
    for i, r in enumerate(ends):
        if i:
            last = ends[i - 1]
            stairs = _stairs(_capped([*map(tuple, last["right"])], r["link"]) + _capped(stairs, min(last["least"], r["link"])))
        before[r["part"]] = stairs
    stairs = []
    for i in range(len(ends) - 1, -1, -1):
        if i + 1 < len(ends):
            following = ends[i + 1]
            stairs = _stairs(_capped([*map(tuple, following["left"])], following["link"]) + _capped(stairs, min(following["least"], following["link"])))
        after[ends[i]["part"]] = stairs
    carried = rows.sparkSession.sparkContext.broadcast((before, after))

    def resolve(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("idx")
        s, lcp = part["s"].tolist(), part["lcp"].tolist()
        left = _longest(s, lcp, carried.value[0][key[0]])
        right = _longest(s[::-1], [0, *lcp[:0:-1]], carried.value[1][key[0]])[::-1]
        return pd.DataFrame({"s": s, "run": [max(a, b) for a, b in zip(left, right)]})

    return rows.groupBy("part").applyInPandas(resolve, "s long, run long")


def deleted_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, md5, ranges (of line numbers, end exclusive) to delete."""
    text = fragments(docs, min_words)
    if text.isEmpty():
        return docs.sparkSession.createDataFrame([], "doc_id long, md5 string, ranges array<struct<from:int,to:int>>")
    first, rank = suffix_ranks(text)
    runs = keep(earlier_runs(common_prefixes(text, first, neighbours(rank))).where("run > 0"), "lines-runs")
    ends = text.select(F.col("s").alias("e"), F.col("upto").alias("e_upto"))
    starts = text.select(F.col("s").alias("b"), "none", "doc_id", "md5", "pos", "upto", "at")
    words = text.select((F.col("s") + 1).alias("p"), F.col("upto").alias("p_upto"))
    found = runs.join(starts, F.col("s") == F.col("b")).join(ends, F.col("s") + F.col("run") - 1 == F.col("e"))
    found = found.join(words, F.col("s") == F.col("p"), "left")
    base = F.when(F.col("at") > 0, F.col("p_upto")).otherwise(F.lit(0))
    found = found.where(F.col("e_upto") - base >= min_words)
    ranges = F.collect_list(F.struct(F.col("pos").alias("from"), (F.col("pos") + F.col("run")).cast("int").alias("to")))
    # Of the runs of a document, those that reach past all earlier ones.
    doc = W.partitionBy("none", "doc_id", "md5").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    reach = F.coalesce(F.max(F.col("pos") + F.col("run")).over(doc), F.lit(-1))
    found = found.withColumn("reach", reach).where(F.col("pos") + F.col("run") > F.col("reach"))
    return found.groupBy("none", "doc_id", "md5").agg(ranges.alias("ranges")).drop("none")


def remove_repeats(docs: DataFrame, min_words: int = MIN_WORDS, counts: bool = False) -> DataFrame:
    """``docs`` with the later copies of repeated runs cut out of the text; with
    ``counts``, also n_lines (before) and removed_lines."""
    cuts = keep(deleted_lines(docs, min_words), "lines-deleted").select(F.col("doc_id").alias(P + "id"), F.col("md5").alias(P + "md5"), F.col("ranges").alias(P + "ranges"))
    names = docs.columns
    tagged = docs.withColumn(P + "key", text_md5())
    # The cuts grow with the corpus: joined by sorting at every size.
    joined = tagged.join(cuts.hint("merge"), tagged["doc_id"].cast("long").eqNullSafe(F.col(P + "id")) & (F.col(P + "key") == F.col(P + "md5")), "left")

    def stays(line: Column, i: Column) -> Column:
        return ~F.exists(P + "ranges", lambda r: (i >= r["from"]) & (i < r["to"]))

    lines = F.split(tagged["text"], "\n")
    left = F.filter(lines, stays)
    text = F.when(F.col(P + "ranges").isNull(), tagged["text"]).otherwise(F.array_join(left, "\n"))
    out = [text.alias(c) if c == "text" else tagged[c] for c in names]
    if counts:
        n = F.coalesce(F.size(lines), F.lit(1))
        out += [n.alias("n_lines"), F.when(F.col(P + "ranges").isNull(), 0).otherwise(n - F.size(left)).alias("removed_lines")]
    return joined.select(*out)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs, counts=True)
