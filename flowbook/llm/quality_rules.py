"""Quality rules by distribution divergence, in DataFrame functions alone.

Each document gets two histograms: its characters over eight classes, and its
words over the common words of four languages (and "other").  A first pass
sums both by ``lang`` over all documents into language references (four rows
of fixed width, whole numbers); a second pass compares every document with
every reference by Jensen-Shannon distance (base 2, 0 to 1).  A document is
kept if it passes the base rules and some language is near enough in its
character classes and, where the text is long enough to say, in its common
words.  Short texts have wide histograms by chance alone, so the word distance
counts from ``MIN_WORDS`` words and the class distance from ``MIN_CHARS``
characters on.

Base rules: at least 20 words, and at most 30 % of the words in 8-word windows
that occur twice or more in the text (windows are compared as 64-bit hashes).

Defined results: null text is an empty text and fails (no words); repeated
rows get equal verdicts; a null or unlisted ``lang`` adds to no reference but
the document is judged like any other; a reference that no document feeds is
ignored, and with none at all only the base rules count.  An empty table gives
no rows.  Other columns are kept by ``keep_good`` and not returned by
``verdicts``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowbook.llm.common import SPACES, keep, table

# Common words of each language.
COMMON = {
    "en": ["the", "of", "and", "to", "a", "in", "is", "that", "for", "it", "with", "on"],
    "de": ["der", "die", "und", "das", "den", "ist", "nicht", "mit", "von", "ein", "sich", "auf"],
    "fr": ["le", "la", "et", "les", "des", "est", "une", "que", "pour", "dans", "du", "qui"],
    "es": ["de", "el", "que", "los", "las", "en", "y", "por", "con", "para", "del", "no"],
}
#: Character classes of the words, each counted in what the earlier ones left.
CLASSES = {
    "lower": "[a-z]+",
    "upper": "[A-Z]+",
    "symbol": "[#*$%&|<>]+",
    "digit": "[0-9]+",
    "mark": "[.,;:!?'\"()-]+",
    "letter": r"\p{L}+",
}
VOCABULARY = sorted({w for words in COMMON.values() for w in words})
WINDOW = 8
MIN_WORDS = 50
MIN_CHARS = 100
MAX_CLASS_DISTANCE = 0.2
MAX_WORD_DISTANCE = 0.28
P = "__quality_"


def _col(name: str) -> Column:
    return F.col(P + name)


def _with(df: DataFrame, **columns: Column) -> DataFrame:
    return df.withColumns({P + k: v for k, v in columns.items()})


def histograms(docs: DataFrame) -> DataFrame:
    """``docs`` with words, n, chars, symbols and the two histograms ``classes``
    (white space, the CLASSES, others) and ``bins`` (VOCABULARY, others)."""
    df = _with(docs, text=F.coalesce(F.col("text"), F.lit("")))
    df = _with(df, words=F.array_remove(F.split(F.regexp_replace(_col("text"), "[\\x09-\\x0D]", " "), " "), ""))
    df = _with(df, left0=F.array_join(_col("words"), ""), n=F.size(_col("words")).cast("long"))
    for i, pattern in enumerate(CLASSES.values()):
        df = _with(df, **{f"left{i + 1}": F.regexp_replace(_col(f"left{i}"), pattern, "")})
    left = [F.length(_col("text")), *[F.length(_col(f"left{i}")) for i in range(len(CLASSES) + 1)]]
    counts = [(a - b).cast("long") for a, b in zip(left, left[1:])] + [left[-1].cast("long")]
    symbols = counts[1 + list(CLASSES).index("symbol")]
    hits = F.filter(_col("words"), lambda w: w.isin(VOCABULARY))
    df = _with(df, classes=F.array(*counts), symbols=symbols, chars=left[1].cast("long"), hits=F.concat(F.lit(" "), F.array_join(hits, "  "), F.lit(" ")))
    each = [((F.length(_col("hits")) - F.length(F.replace(_col("hits"), F.lit(f" {w} "), F.lit("")))) / (len(w) + 2)).cast("long") for w in VOCABULARY]
    df = _with(df, each=F.array(*each))
    rest = _col("n") - F.aggregate(_col("each"), F.lit(0).cast("long"), lambda s, x: s + x)
    return _with(df, bins=F.concat(_col("each"), F.array(rest)))


def references(rows: DataFrame) -> dict[str, tuple[list[float], list[float]]]:
    """By language, the shares of character classes and of common words over
    all documents of 20 words or more, from rows of ``histograms`` with lang:
    at most four times 50 sums reach the driver."""
    # An outer explode, and the length in the sum: no filter is derived that
    # would be pushed below the histograms and repeat them.
    used = rows.where(F.col(P + "lang").isin(list(COMMON)))
    cells = used.select(P + "lang", P + "n", F.posexplode_outer(F.concat(_col("classes"), _col("bins"))).alias("cell", "count"))
    counted = F.sum(F.when(_col("n") >= 20, F.col("count"))).alias("sum")
    width, out = len(CLASSES) + 2, {}
    for row in cells.groupBy(P + "lang", "cell").agg(counted).where("sum is not null").collect():
        out.setdefault(row[0], {})[row[1]] = row[2]
    for lang, sums in out.items():
        counts = [sums[i] for i in range(len(sums))]
        classes, bins = counts[:width], counts[width:]
        out[lang] = ([x / sum(classes) for x in classes], [x / sum(bins) for x in bins])
    return dict(sorted(out.items()))


def _distance(counts: Column, share: list[float]) -> Column:
    """Jensen-Shannon distance between counts and a reference; 1 if there is nothing to compare."""
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda s, x: s + x)

    def term(x: Column, y: Column) -> Column:
        mine = F.when(x > 0, x * F.log2(2 * x / (x + y))).otherwise(0.0)
        return mine + F.when(y > 0, y * F.log2(2 * y / (x + y))).otherwise(0.0)

    p = F.transform(counts, lambda x: x / total)
    terms = F.zip_with(p, F.array(*map(F.lit, share)), term)
    divergence = F.aggregate(terms, F.lit(0.0), lambda s, x: s + x) / 2
    return F.when(total > 0, F.sqrt(F.greatest(F.lit(0.0), divergence))).otherwise(1.0)


def _base(df: DataFrame) -> DataFrame:
    """The base columns under reserved names, from words, text and symbols."""
    spaces = F.filter(F.split(_col("text"), "\n"), lambda x: x.rlike(f"[^{SPACES}]"))
    df = _with(df, hashes=F.transform(_col("words"), lambda w: F.xxhash64(w)), lines=spaces)
    starts = F.sequence(F.lit(0), _col("n").cast("int") - WINDOW)
    windows = F.transform(starts, lambda i: F.xxhash64(*[F.get(_col("hashes"), i + k) for k in range(WINDOW)]))
    df = _with(df, windows=F.when(_col("n") >= WINDOW, windows).otherwise(F.array().cast("array<long>")))
    pairs = F.sort_array(F.transform(_col("windows"), lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
    repeated = F.size(F.array_distinct(_col("windows"))) < F.size(_col("windows"))
    df = _with(df, sorted=F.when(repeated, pairs).otherwise(F.array().cast("array<struct<w:bigint,i:int>>")))

    def twice(x: Column, k: Column) -> Column:
        return (F.get(_col("sorted"), k - 1)["w"] == x["w"]) | (F.get(_col("sorted"), k + 1)["w"] == x["w"])

    df = _with(df, starts=F.array_sort(F.transform(F.filter(_col("sorted"), twice), lambda x: x["i"])))
    # Words that windows cover: each start adds the words after the last window's end.
    covered = F.aggregate(
        _col("starts"),
        F.struct(F.lit(0).alias("words"), F.lit(0).alias("end")),
        lambda s, i: F.struct((s["words"] + i + WINDOW - F.greatest(i, s["end"])).alias("words"), (i + WINDOW).alias("end")),
        lambda s: s["words"].cast("long"),
    )
    return _with(
        df,
        dup_lines=(F.size(_col("lines")) - F.size(F.array_distinct(_col("lines")))).cast("long"),
        repeat=covered,
    )


def features(docs: DataFrame) -> DataFrame:
    """``docs`` with every count that a verdict needs, under reserved names."""
    df = _base(_with(histograms(docs), size=F.length(_col("text"))))
    return _with(df, base_failed=(_col("n") < 20) | (100 * _col("repeat") > 30 * _col("n")))


def judged(df: DataFrame, shares: dict[str, tuple[list[float], list[float]]]) -> DataFrame:
    """Rows of ``features`` with language, distances and verdict."""
    if not shares:
        return _with(df, language=F.lit(None).cast("string"), class_distance=F.lit(None).cast("double"), word_distance=F.lit(None).cast("double"), kept=~_col("base_failed"))
    near = [
        F.struct(
            F.when(_col("n") >= MIN_WORDS, _distance(_col("bins"), bins)).otherwise(0.0).alias("w"),
            F.when(_col("size") >= MIN_CHARS, _distance(_col("classes"), classes)).otherwise(0.0).alias("c"),
            F.lit(lang).alias("lang"),
        )
        for lang, (classes, bins) in shares.items()
    ]
    df = _with(df, near=F.array(*near))
    df = _with(df, best=F.array_min(_col("near")))
    fits = F.exists(_col("near"), lambda x: (x["c"] <= MAX_CLASS_DISTANCE) & (x["w"] <= MAX_WORD_DISTANCE))
    return _with(df, language=_col("best")["lang"], class_distance=_col("best")["c"], word_distance=_col("best")["w"], kept=~_col("base_failed") & fits)


#: What a verdict needs of ``features``.
COUNTED = ("lang", "n", "size", "chars", "symbols", "dup_lines", "repeat", "base_failed", "classes", "bins")


def verdicts(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts and verdicts, and the nearest language with its
    distances; one row per row of ``docs``."""
    counted = features(docs.select("doc_id", "text", F.col("lang").alias(P + "lang")))
    counted = keep(counted.select("doc_id", *[P + x for x in COUNTED]), "quality-features")
    df = judged(counted, references(counted))
    return df.select(
        "doc_id",
        _col("n").alias("n_words"),
        _col("chars").alias("word_chars"),
        _col("symbols").alias("n_symbols"),
        _col("dup_lines").alias("n_dup_lines"),
        _col("repeat").alias("n_repeat_words"),
        _col("base_failed").alias("base_failed"),
        _col("kept").alias("kept"),
        _col("language").alias("language"),
        F.round(_col("class_distance"), 6).alias("class_distance"),
        F.round(_col("word_distance"), 6).alias("word_distance"),
    )


def keep_good(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows that the rules reject.  The rows are written
    with their counts once: the references and the verdicts read them there."""
    counted = features(_with(docs, lang=F.col("lang")))
    counted = keep(counted.select(*[F.col(f"`{c}`") for c in docs.columns], *[P + x for x in COUNTED]), "quality-rows")
    return judged(counted, references(counted)).where(_col("kept")).select(*[F.col(f"`{c}`") for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(table(spark, sf_dir, "documents"))
