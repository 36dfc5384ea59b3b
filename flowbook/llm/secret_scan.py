"""Secret scans through a trigram inverted index.

Every rule's regular expression is turned into a Boolean query over the
lower-cased ASCII trigrams that any match must hold (``trigram_query``, from
the expression's syntax tree).  The index holds a posting (trigram, document)
for each trigram that some query names.  Postings are intersected and united
per document, which yields (document, rules) candidates; the documents are
joined with them and only a candidate's rules are run on its text.  A rule
whose expression has no mandatory trigram, such as a run of hex digits, scans
every text in full.

Postings stay rows (a trigram that a third of all documents hold is no list
anywhere) and are united per document by partial aggregation.

Defined results: null text is an empty text without spans; a repeated row gets
its own equal row; a null doc_id is kept; an empty table gives no rows.  Spans
count code points, the end is exclusive.  Other columns are neither read nor
returned.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from re import _constants as sre
from re import _parser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowbook.llm.common import keep, ship, table, text_md5

ship(__name__)


@dataclass(frozen=True)
class Rule:
    """Matches whose ``group`` has at least ``least`` characters."""

    kind: str
    pattern: str
    flags: int = 0
    group: int = 0
    least: int = 0


# Base kinds first, in their order.
BASE = ("assign", "access", "hex")
RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A, 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 0, 16),
    Rule("hex", r"[0-9a-f]{32,}"),
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    Rule("forge_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("cloud_key", r"AIza[A-Za-z0-9_-]{35}"),
)

#: A query is a set of clauses, all of which must hold; a clause is a set of
#: alternatives, each a set of trigrams.  No clause: scan fully.
Clause = frozenset
MOST_STRINGS = 64


def _clause(strings: Iterable[str]) -> Clause | None:
    found = set()
    for s in strings:
        if len(s) < 3:
            return None
        found.add(frozenset(s[i : i + 3] for i in range(len(s) - 2)))
    return Clause(a for a in found if not any(b < a for b in found)) or None


def _parts(tree) -> tuple[set[str] | None, set[Clause]]:
    """The strings that a tree can match, if they are few, else None; and the
    clauses that hold for every match."""
    clauses: set[Clause] = set()
    strings: set[str] = {""}
    whole = True

    def flush() -> None:
        nonlocal strings, whole
        clause = _clause(strings)
        if clause:
            clauses.add(clause)
        strings, whole = {""}, False

    def extend(more: set[str]) -> None:
        nonlocal strings
        if len(strings) * len(more) > MOST_STRINGS:
            flush()
        strings = {a + b for a in strings for b in more} if len(more) <= MOST_STRINGS else {""}

    for op, arg in tree:
        more: set[str] | None = None
        inner: set[Clause] = set()
        if op is sre.LITERAL and arg < 128:
            more = {chr(arg).lower()}
        elif op is sre.IN and all(o is sre.LITERAL and a < 128 for o, a in arg):
            more = {chr(a).lower() for _, a in arg}
        elif op is sre.SUBPATTERN:
            more, inner = _parts(arg[-1])
        elif op is sre.BRANCH:
            branches = [_parts(b) for b in arg[1]]
            if all(s is not None for s, _ in branches):
                more = set().union(*(s for s, _ in branches))
            else:  # a clause holds for all if some clause of each branch does
                each = [next(iter(c), None) if s is None else _clause(s) for s, c in branches]
                inner = {Clause().union(*each)} if all(each) else set()
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
            low, high, body = arg
            once, inside = _parts(body)
            if (low, high) == (0, 1) and once is not None:
                more = once | {""}
            elif low and once is not None and len(once) <= 4:
                extend(once)
                inner = inside
            elif low:
                inner = inside
        elif op is sre.AT:
            continue
        if more is not None and len(more) <= MOST_STRINGS:
            extend(more)
            clauses |= inner
        else:
            flush()
            clauses |= inner
    if whole:
        return strings, clauses
    flush()
    return None, clauses


def trigram_query(pattern: str, flags: int = 0) -> set[Clause]:
    """The clauses of an expression; empty if it has no mandatory trigram."""
    strings, clauses = _parts(_parser.parse(pattern, flags))
    last = _clause(strings) if strings is not None else None
    return clauses | ({last} if last else set())


def postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """doc_id, md5, trigram (its number): a row for each of ``trigrams`` that
    the ASCII-lower-cased text holds."""
    wanted = [t.encode() for t in trigrams]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, numbers = [], []
            for i, text in enumerate(batch["text"]):
                low = (text.as_py() or "").encode("utf-8", "surrogatepass").lower()
                held = [n for n, t in enumerate(wanted) if t in low]
                rows += [i] * len(held)
                numbers += held
            at = pa.array(rows, pa.int32())
            yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"].take(at), "md5": batch["md5"].take(at), "trigram": pa.array(numbers, pa.int32())})

    return docs.select("doc_id", "md5", "text").mapInArrow(run, "doc_id long, md5 string, trigram int")


def candidates(index: DataFrame, trigrams: list[str], rules: tuple[Rule, ...]) -> DataFrame:
    """doc_id, md5, rules (numbers): the documents whose postings satisfy the
    query of some indexed rule."""
    number = {t: i for i, t in enumerate(trigrams)}

    def has(t: str) -> Column:
        return F.array_contains("held", number[t])

    def both(columns: list[Column], op) -> Column:
        out = columns[0]
        for c in columns[1:]:
            out = op(out, c)
        return out

    hits = []
    for i, rule in enumerate(rules):
        if clauses := trigram_query(rule.pattern, rule.flags):
            ands = [both([both([has(t) for t in sorted(a)], Column.__and__) for a in c], Column.__or__) for c in clauses]
            hits.append(F.when(both(ands, Column.__and__), F.lit(i)))
    held = index.groupBy("doc_id", "md5").agg(F.collect_set("trigram").alias("held"))
    found = held.select("doc_id", "md5", F.array_compact(F.array(*hits)).alias("rules"))
    return found.where(F.size("rules") > 0)


def matches(rule: Rule, compiled: re.Pattern, text: str) -> list[tuple[int, int]]:
    return [m.span() for m in compiled.finditer(text) if len(m.group(rule.group)) >= rule.least]


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, spans (array of kind, start, end by start, then rule order); one
    row per row of ``docs``."""
    queries = [trigram_query(r.pattern, r.flags) for r in rules]
    trigrams = sorted({t for q in queries for clause in q for a in clause for t in a})
    full = [i for i, q in enumerate(queries) if not q]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_md5().alias("md5"))
    if trigrams:
        found = keep(candidates(postings(rows, trigrams), trigrams, rules), "secret-candidates")
        c = found.select(F.col("doc_id").alias("c_id"), F.col("md5").alias("c_md5"), "rules")
        rows = rows.join(c, rows.doc_id.eqNullSafe(F.col("c_id")) & (rows.md5 == F.col("c_md5")), "left")
        rows = rows.select("doc_id", "text", "rules")
    else:
        rows = rows.select("doc_id", "text", F.array().cast("array<int>").alias("rules"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = [re.compile(r.pattern, r.flags) for r in rules]
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            out = []
            for text, chosen in zip(batch["text"], batch["rules"]):
                text = text.as_py() or ""
                spans = [(a, n, b) for n in sorted([*full, *(chosen.as_py() or [])]) for a, b in matches(rules[n], compiled[n], text)]
                out.append([{"kind": rules[n].kind, "start": a, "end": b} for a, n, b in sorted(spans)])
            yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"], "spans": pa.array(out, kind)})

    return rows.mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:long,end:long>>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return found.select("doc_id", *map(count, BASE), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
