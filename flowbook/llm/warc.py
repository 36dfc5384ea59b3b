"""WARC archives: writing with revisit records, and boundary-chain reading.

Writing: records with equal payloads of at least ``least`` bytes share one
response, that of the largest page_id; the others become revisit records that
name it and its digest and carry no payload.  A record is one line of Spark's
text sink with CR LF CR LF as the line end, so any number of tasks write plain
WARC files into the shared folder.

Reading: the files are split at the magic ``WARC/1.0``, wherever it stands, by
Hadoop's delimited input, in as many splits as the files have blocks.  Each
piece is a *candidate* record: its task emits its offset and, if its header
block parses, the offset where its successor must begin (header and
Content-Length and the record end).  A payload may hold the magic, even a
whole well-formed record, so candidates prove nothing; what is reachable from
the file's start is true.  Pointer jumping finds it in log2(records per file)
rounds: reached offsets are joined with the jumps, then the jumps with
themselves.  A chain that leaves the file or meets a piece that is no record
ends there.  Pieces inside a record are given back to its payload: records
list the blocks of the file that they span, and the piece's block joins them.

Defined results: a null payload is empty; all pages with equal payloads, also
repeated rows of one page_id, count as one group, and of repeated rows of the
largest page_id all are responses; a null page_id is written as such, ranks
below any other and is read back as null.  An empty table writes no record and
reads none.  Other columns are neither written nor returned.  Payloads are
UTF-8.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowbook.llm.common import keep, ship, table
from flowbook.session import scratch_path

ship(__name__)

MAGIC = "WARC/1.0\r\n"
END = "\r\n\r\n"
LEAST = 0
#: Granularity at which records list what they span.
BLOCK = 1 << 20
FIXED_DATE = "2000-01-01T00:00:00Z"


def _digest(sha1: Column) -> Column:
    """Bare upper-case base32 SHA-1 from its 40 hex digits: eight numbers of 20
    bits, four letters each."""
    letters = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    numbers = [F.conv(F.substring(sha1, 5 * i + 1, 5), 16, 10).cast("int") for i in range(8)]
    return F.concat(*[F.substring(letters, F.shiftright(n, at).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for n in numbers for at in (15, 10, 5, 0)])


def write(pages: DataFrame, path: str, least: int = LEAST) -> None:
    """Archive (page_id, url, html) rows under ``path``."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url"), F.lit("")).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("bytes", F.octet_length("payload").cast("long"))
    # One row per payload, written so that the join below sees two plain
    # exchanges and can split a payload that a third of the pages share.
    group = rows.groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("n")).where("n > 1")
    group = keep(group.select(F.col("digest").alias("g_digest"), "keeper"), "warc-groups")
    joined = rows.join(group, F.col("digest") == F.col("g_digest"), "left")
    revisit = (F.col("bytes") >= least) & F.col("keeper").isNotNull() & (F.coalesce(F.col("page_id"), F.lit(-(1 << 63))) < F.col("keeper"))

    def name(page_id: Column) -> Column:
        return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(">"))

    head = F.concat(
        F.lit(MAGIC + "WARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: "), name(F.col("page_id")),
        F.lit(f"\r\nWARC-Date: {FIXED_DATE}\r\nWARC-Target-URI: "), F.regexp_replace("url", "[\r\n]", "%0A"),
        F.lit("\r\nWARC-Payload-Digest: sha1:"), _digest(F.col("digest")),
        F.when(revisit, F.concat(F.lit("\r\nWARC-Refers-To: "), name(F.col("keeper")), F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))).otherwise(""),
        F.lit("\r\nX-Payload-Bytes: "), F.col("bytes").cast("string"),
        F.lit("\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.when(revisit, F.lit("0")).otherwise(F.col("bytes").cast("string")),
        F.lit(END),
    )
    record = F.concat(head, F.when(revisit, "").otherwise(F.col("payload")))
    joined.select(record.alias("value")).write.option("lineSep", END).text(path)


_FIELD = re.compile(rb"([!-9;-~]+):[ \t]*([^\r\n]*)\r\n")


def parse(piece: bytes) -> tuple[dict[str, str], int] | None:
    """The header fields of what follows a magic, and where they end."""
    at, fields = 0, {}
    while not piece.startswith(b"\r\n", at):
        m = _FIELD.match(piece, at)
        if not m:
            return None
        fields[m[1].decode().lower()] = m[2].decode("utf-8", "replace")
        at = m.end()
    if not re.fullmatch(r"[0-9]{1,18}", fields.get("content-length", "")):
        return None
    return fields, at + 2


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


PIECES = (
    "file long, block long, up long, size long, file_size long, head long, length long, type string, page string, "
    "refers string, stated string, stated_bytes long, whole boolean, digest string, body binary"
)
TEXTS = ("type", "page", "refers", "stated")


def pieces(spark: SparkSession, path: str, bodies: bool = False) -> DataFrame:
    """What stands between the magics of the files under ``path``: file (a
    number), start (offset after the magic), size, file_size; head, length and
    the header fields if it looks like a record; whole (it ends where such a
    record would) and then the payload's digest; its bytes if ``bodies``."""
    lines = spark.read.option("lineSep", MAGIC).text(path)
    meta = [F.col(f"_metadata.file_{c}").alias(f"file_{c}") for c in ("block_start", "size")]
    lines = lines.select(F.xxhash64("_metadata.file_path").alias("file"), *meta, F.col("value").cast("binary").alias("value"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, up = None, 0  # rows of a split come in its order
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                split, piece = (row["file"], row["file_block_start"]), row["value"]
                up = up if split == here else 0
                here, out = split, {"file": split[0], "block": split[1], "up": up, "size": len(piece), "file_size": row["file_size"]}
                if found := parse(piece):
                    fields, head = found
                    length = int(fields["content-length"])
                    out |= {"head": head, "length": length, "whole": piece[head + length :] == END.encode()}
                    out |= {"type": fields.get("warc-type"), "page": fields.get("warc-record-id"), "refers": fields.get("warc-refers-to"), "stated": fields.get("warc-payload-digest", "").removeprefix("sha1:")}
                    out |= {"stated_bytes": int(n) if (n := fields.get("x-payload-bytes", "")).isdigit() else None}
                    out |= {"digest": base32_sha1(piece[head : head + length]) if out["whole"] else None}
                out |= {"body": piece} if bodies else {}
                rows.append(out)
                up += len(piece) + len(MAGIC)
            yield pa.RecordBatch.from_pylist(rows, schema)

    kinds = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}
    schema = pa.schema([(n, kinds[k]) for n, k in (c.split() for c in PIECES.split(", "))])
    found = lines.mapInArrow(run, PIECES)
    if not bodies:
        found = keep(found.drop("body"), "warc-pieces")
    # A split's first piece starts where the pieces of the earlier splits end.
    splits = found.groupBy("file", "block").agg(F.sum(F.col("size") + len(MAGIC)).alias("all"))
    before = F.sum("all").over(W.partitionBy("file").orderBy("block")) - F.col("all")
    splits = splits.select("file", "block", before.alias("before"))
    return found.join(splits, ["file", "block"]).withColumn("start", F.col("before") + F.col("up")).drop("before", "up", "block")


def reachable(candidates: DataFrame) -> DataFrame:
    """The (file, start) that the chain from each file's first magic reaches;
    ``candidates`` has file, start and next, the start its successor must have."""
    jumps = keep(candidates.select("file", "start", "next"), "warc-jumps")
    reached = jumps.where(F.col("start") == len(MAGIC)).select("file", "start")
    starts = jumps.select(F.col("file").alias("f"), F.col("start").alias("s"), F.col("next").alias("n"))
    jumps = keep(jumps.join(starts, (F.col("file") == F.col("f")) & (F.col("next") == F.col("s"))).select("file", "start", "next"), "warc-jumps")
    while not jumps.isEmpty():
        landed = reached.join(jumps, ["file", "start"]).select("file", F.col("next").alias("start"))
        reached = keep(reached.union(landed), "warc-reached")
        second = jumps.select(F.col("file").alias("f"), F.col("start").alias("s"), F.col("next").alias("n"))
        jumps = keep(jumps.join(second, (F.col("file") == F.col("f")) & (F.col("next") == F.col("s"))).select("file", "start", F.col("n").alias("next")), "warc-jumps")
    return reached


def _assembled(broken: DataFrame, inner: DataFrame) -> DataFrame:
    """file, start, payload of records that later magics cut: their own piece
    and all the pieces that begin inside them."""
    last = F.col("start") + F.col("head") + F.col("length")
    spans = broken.select("file", "start", "head", "length", last.alias("last"), F.explode(F.sequence(F.floor(F.col("start") / BLOCK), F.floor(last / BLOCK))).alias("at"))
    parts = inner.select("file", F.col("start").alias("from"), F.floor(F.col("start") / BLOCK).alias("at"), "body")
    held = spans.join(parts, ["file", "at"]).where((F.col("from") >= F.col("start")) & (F.col("from") <= F.col("last") + len(MAGIC)))
    listed = held.groupBy("file", "start", "head", "length").agg(F.array_sort(F.collect_list(F.struct("from", "body"))).alias("parts"))
    # Binary pieces joined by the magic that stood between them.
    text = F.array_join(F.transform("parts", lambda p: p["body"].cast("string")), MAGIC).cast("binary")
    return listed.select("file", "start", F.substring(text, F.col("head").cast("int") + 1, F.col("length").cast("int")).alias("payload"))


def read(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """The true records of the archives under ``path``: page, type, refers,
    digest and bytes of the (full) payload, and the stored payload if
    ``payloads``.  A record that the file's end cuts short is none."""
    found = pieces(spark, path)
    ends = F.col("start") + F.col("head") + F.col("length") + len(END)
    looks = found.where(F.col("head").isNotNull() & (ends <= F.col("file_size")))
    true = keep(reachable(looks.select("file", "start", (ends + len(MAGIC)).alias("next"))), "warc-true")
    records = keep(looks.join(true, ["file", "start"]), "warc-records")
    wanted = records if payloads else records.where(~F.col("whole"))
    if wanted.isEmpty():
        stored = spark.createDataFrame([], "file long, start long, payload binary")
    else:
        bodies = pieces(spark, path, bodies=True).select("file", "start", "body")
        whole = wanted.where("whole").join(bodies, ["file", "start"])
        plain = whole.select("file", "start", F.substring("body", F.col("head").cast("int") + 1, F.col("length").cast("int")).alias("payload"))
        broken = wanted.where("not whole").select("file", "start", "head", "length")
        cut = bodies.join(records.where("whole").select("file", "start"), ["file", "start"], "left_anti")
        stored = keep(plain.union(_assembled(broken, cut)), "warc-payloads")
    stored = stored.select("file", "start", "payload", F.sha1("payload").alias("sha1"))
    rows = records.join(stored, ["file", "start"], "left")
    response = F.col("type") == "response"
    number = F.regexp_extract(F.col("page"), "^<urn:page:(-?[0-9]+)>$", 1)
    refers = F.regexp_extract(F.coalesce("refers", F.lit("")), "^<urn:page:(-?[0-9]+)>$", 1)
    out = rows.select(
        F.when(number != "", number).cast("long").alias("page_id"),
        F.when(response, F.col("length")).otherwise(F.col("stated_bytes")).alias("payload_bytes"),
        F.when(~response, F.col("stated")).when(F.col("sha1").isNull(), F.col("digest")).otherwise(_digest(F.col("sha1"))).alias("payload_digest"),
        F.col("type").alias("record_type"),
        F.when(refers != "", refers).cast("long").alias("refers_to"),
        "payload",
    )
    return out if payloads else out.drop("payload")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc-archive")
    write(table(spark, sf_dir, "pages"), path)
    return read(spark, path)


QUERY_SQL = """
WITH p AS (
    SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages
), d AS (
    SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS hex, max(page_id) OVER (PARTITION BY payload) AS keeper FROM p
), b AS (
    SELECT *, list_reduce([''] || list_transform(range(0, 160, 5), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 +
        list_sum(list_transform(range(5), lambda k: ((strpos('0123456789abcdef', substr(hex, 1 + (i + k) // 4, 1)) - 1) >> (3 - (i + k) % 4) & 1) << (4 - k)))::INT, 1)),
        lambda x, y: x || y) AS payload_digest FROM d
)
SELECT page_id, payload_bytes, payload_digest,
    CASE WHEN page_id < keeper THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN page_id < keeper THEN keeper END AS refers_to
FROM b
"""
