"""Spelling variants against a comparison of all words."""

import random
import zlib
import re
from collections import Counter

import pytest

from flowbook.llm import spelling

SF = "/root/testdata/sf0.001"


def vocabulary(rows):
    found = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                found[run] += 1
    return {w: n for w, n in found.items() if n >= 2}


def edits(word, letters):
    out = {word[:i] + word[i + 1 :] for i in range(len(word))}
    for c in letters:
        out |= {word[:i] + c + word[i + 1 :] for i in range(len(word))} | {word[:i] + c + word[i:] for i in range(len(word) + 1)}
    return out - {word}


def expected(rows):
    n = vocabulary(rows)
    letters = {c for w in n for c in w}
    near = {w: [x for x in edits(w, letters) if x in n] for w in n}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out)


def collected(df):
    return sorted(tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in df.collect())


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    want = expected(rows)
    assert collected(spelling.query(spark, SF)) == want and any(w[1] for w in want)


@pytest.mark.parametrize("symbols", [1, 2, 6])
def test_any_alphabet_finds_all(spark, symbols):
    draw = random.Random(symbols)
    stems = ["".join(draw.choice("abcé") for _ in range(draw.randint(7, 9))) for _ in range(60)]
    rows = []
    for i in range(400):
        text = []
        for _ in range(30):
            w = draw.choice(stems[: 1 + int(draw.expovariate(0.1)) % 60])
            if draw.random() < 0.2:
                at = draw.randrange(len(w))
                w = draw.choice([w[:at] + w[at + 1 :], w[:at] + draw.choice("abcéÜ") + w[at:], w[:at] + draw.choice("abcé") + w[at + 1 :]])
            text.append(draw.choice([w, w.upper()]) if w.isascii() else w)
        rows.append((i, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert collected(spelling.variants(docs, symbols=symbols)) == expected(rows)


def test_chain_of_forms(spark):
    rows = [(i, w) for w, n in (("aaaaaaaa", 2), ("aaaaaaab", 25), ("aaaaaabb", 300), ("aaaaabbb", 3100)) for i in range(n)]
    # one long document, so that checksums delete no letter
    text = " ".join(w for _, w in rows)
    doc = next(i for i in range(100) if all(zlib.crc32(f"{i}:{w}".encode()) % 31 for w in set(text.split())))
    got = collected(spelling.variants(spark.createDataFrame([(doc, text)], "doc_id long, text string")))
    assert got == expected([(doc, text)]) and {g[2] for g in got} == {"aaaaabbb"}


def test_edges(spark):
    giant = "abcdefgh" * 4000
    rows = [(1, None, "x"), (2, "", "x"), (None, "letters letters", "x"), (4, giant + " " + giant, "x"), (4, giant + " " + giant, "x"), (5, f"{giant}a {giant}a {giant[1:]} {giant[1:]}", "x"), (6, "aaaaaaa aaaaaaa aaaaaaaa aaaaaaaa", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, word string")
    plain = [(i, t) for i, t, _ in rows]
    n = vocabulary(plain)
    got = {r.word: r for r in spelling.variants(docs).collect()}
    assert {w: r.n for w, r in got.items()} == n
    for w, r in got.items():
        assert r.n_near == sum(abs(len(w) - len(x)) <= 1 and w != x and one_edit(w, x) for x in n)
    assert spelling.variants(docs.limit(0)).count() == 0


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    i = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]
