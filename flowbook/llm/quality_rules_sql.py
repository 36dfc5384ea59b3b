"""The SQL twin of the quality rules, for DuckDB."""

from flowbook.llm.quality_rules import CLASSES, COMMON, MAX_CLASS_DISTANCE, MAX_WORD_DISTANCE, MIN_CHARS, MIN_WORDS, VOCABULARY, WINDOW
from flowbook.llm.common import SPACES


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_LEFT = ",\n".join(
    f"l{i + 1} AS (SELECT *, regexp_replace(left{i}, {_text(p)}, '', 'g') AS left{i + 1} FROM l{i})" for i, p in enumerate(CLASSES.values())
)
_N = len(CLASSES)
_COUNTS = ", ".join(["length(t) - length(left0)", *[f"length(left{i}) - length(left{i + 1})" for i in range(_N)], f"length(left{_N})"])
_SYMBOL = list(CLASSES).index("symbol")


def _distance(counts: str, share: str) -> str:
    p, q = f"({counts}[i] / list_sum({counts}))", f"{share}[i]"
    terms = f"CASE WHEN {p} > 0 THEN {p} * log2(2 * {p} / ({p} + {q})) ELSE 0 END + CASE WHEN {q} > 0 THEN {q} * log2(2 * {q} / ({p} + {q})) ELSE 0 END"
    total = f"list_sum(list_transform(range(1, len({counts}) + 1), lambda i: {terms}))"
    return f"CASE WHEN list_sum({counts}) > 0 THEN sqrt(greatest(0.0, {total} / 2)) ELSE 1.0 END"


QUERY_SQL = f"""
WITH d AS MATERIALIZED (
    SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS t,
        list_filter(string_split_regex(coalesce(text, ''), '[{SPACES}]+'), lambda x: x <> '') AS words FROM documents
), l0 AS (SELECT *, array_to_string(words, '') AS left0 FROM d),
{_LEFT},
f AS MATERIALIZED (
    SELECT rid, doc_id, lang, length(t) AS size, len(words) AS n, length(left0) AS chars,
        length(left{_SYMBOL}) - length(left{_SYMBOL + 1}) AS symbols,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^{SPACES}]')) AS lines,
        [{_COUNTS}] AS classes,
        list_transform([{", ".join(map(_text, VOCABULARY))}], lambda v: len(list_filter(words, lambda x: x = v))) AS hits
    FROM l{_N}
), g AS MATERIALIZED (
    SELECT *, list_append(hits, n - list_sum(hits)::BIGINT) AS bins, len(lines) - len(list_distinct(lines)) AS dup_lines FROM f
), places AS (
    SELECT rid, words, unnest(range(1, len(words) - {WINDOW - 2})) AS i FROM d WHERE len(words) >= {WINDOW}
), twice AS (
    SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, words[i:i + {WINDOW - 1}]) AS c FROM places) WHERE c > 1
), covered AS (
    SELECT rid, count(DISTINCT i + k) AS repeat FROM twice, (SELECT unnest(range({WINDOW})) AS k) GROUP BY rid
), sums AS (
    SELECT lang, cell, sum(v)::BIGINT AS s FROM (
        SELECT lang, unnest(range(1, len(classes) + len(bins) + 1)) AS cell, unnest(list_concat(classes, bins)) AS v FROM g
        WHERE n >= 20 AND lang IN ({", ".join(map(_text, COMMON))})) GROUP BY lang, cell
), shares AS (
    SELECT lang AS ref, list(s / total ORDER BY cell) FILTER (cell <= {_N + 2}) AS c_share, list(s / total ORDER BY cell) FILTER (cell > {_N + 2}) AS b_share
    FROM (SELECT *, sum(s) OVER (PARTITION BY lang, cell <= {_N + 2}) AS total FROM sums) GROUP BY lang
), near AS (
    SELECT rid, ref, CASE WHEN n >= {MIN_WORDS} THEN {_distance("bins", "b_share")} ELSE 0.0 END AS w,
        CASE WHEN size >= {MIN_CHARS} THEN {_distance("classes", "c_share")} ELSE 0.0 END AS c FROM g, shares
), best AS (
    SELECT rid, arg_min(ref, (w, c, ref)) AS language, arg_min(c, (w, c, ref)) AS c, arg_min(w, (w, c, ref)) AS w,
        bool_or(c <= {MAX_CLASS_DISTANCE} AND w <= {MAX_WORD_DISTANCE}) AS fits FROM near GROUP BY rid
), judged AS (
    SELECT *, coalesce(repeat, 0) AS again, n < 20 OR 100 * coalesce(repeat, 0) > 30 * n AS failed
    FROM g LEFT JOIN covered USING (rid) LEFT JOIN best USING (rid)
)
SELECT doc_id, n AS n_words, chars AS word_chars, symbols AS n_symbols, dup_lines AS n_dup_lines, again AS n_repeat_words,
    failed AS base_failed, NOT failed AND coalesce(fits, true) AS kept, language, round(c, 6) AS class_distance, round(w, 6) AS word_distance
FROM judged
"""
