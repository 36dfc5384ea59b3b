"""The queries against brute force, SQL, round trips and held-out labels."""

import hashlib
import random
import re
import timeit
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash

from flowbook.llm import decontaminate, line_dedup, packing, quality_rules, queries, secret_scan, simhash, toxicity

SF = "/root/testdata/sf0.001"
LABELLED = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def texts(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    return {r.doc_id: r.text or "" for r in rows}


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def test_op1_base_counts(spark, texts):
    for r in quality_rules.query(spark, SF).collect():
        t, w = texts[r.doc_id], words(texts[r.doc_id])
        windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
        n = Counter(windows)
        repeated = {j for i, x in enumerate(windows) if n[x] > 1 for j in range(i, i + 8)}
        lines = [x for x in t.split("\n") if words(x)]
        assert (r.n_words, r.word_chars, r.n_repeat_words) == (len(w), sum(map(len, w)), len(repeated))
        assert (r.n_symbols, r.n_dup_lines) == (sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)))
        assert r.base_failed == (len(w) < 20 or 100 * len(repeated) > 30 * len(w)) and not (r.base_failed and r.kept)


def test_op1_keeps_good_and_rejects_bad(spark):
    got = quality_rules.query(spark, LABELLED).join(spark.read.parquet(f"{LABELLED}/labels.parquet"), "doc_id").collect()
    good = [r.kept for r in got if r.quality == 1 and not r.base_failed]
    bad = [r.kept for r in got if r.quality == 0]
    assert np.mean(good) > 0.97 and np.mean(bad) < 0.35


def test_op2_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{SF}/pages.parquet')")
    want = con.execute(queries.SQL["op2_warc_boundary_chain"]).fetchall()
    got = queries.REGISTRY["op2_warc_boundary_chain"](spark, SF)
    assert got.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted(map(tuple, got.collect())) == sorted(want)


@pytest.mark.parametrize("name,label,least", [("op3_fourier_quality_classifier", "quality", 0.9), ("op7_compression_toxicity", "toxic", 0.7)])
def test_scores_on_held_out_labels(spark, name, label, least):
    rows = queries.REGISTRY[name](spark, LABELLED).join(spark.read.parquet(f"{LABELLED}/labels.parquet"), "doc_id").where("held_out").collect()
    one, zero = ([r.score for r in rows if r[label] == v] for v in (1, 0))
    wins = np.mean([(a > b) + 0.5 * (a == b) for a in one for b in zero])
    assert wins > least


def test_op7_short_and_rare_marks(spark):
    """Words of two and three bytes, and the words of a language with under 1 % of
    the toxic rows, mark toxic text too."""
    draw = random.Random(7)
    vocabulary = ["".join(draw.choice("aeioubcdfgh") for _ in range(draw.randint(2, 9))) for _ in range(2000)]
    rows = []
    for i in range(8000):
        kind = draw.choice([None] * 5 + ["zq", "xvw"] + ["wretch"] * 5) if i % 120 else "żółćny"
        text = [draw.choice(vocabulary) for _ in range(60)]
        for at in draw.sample(range(60), 3 if kind else 0):
            text[at] = kind
        rows.append((i, " ".join(text), int(kind is not None), kind))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int, kind string").repartition(4).cache()
    got = toxicity.scores(docs.select("doc_id", "text"), docs.select("doc_id", "toxic")).join(docs, "doc_id").where("held_out").collect()
    clean = [r.score for r in got if r.kind is None]
    for kind in ("zq", "xvw", "wretch", "żółćny"):
        assert np.mean([r.score > s for r in got if r.kind == kind for s in clean]) > 0.95, kind


def test_op4_sizes_and_slots(spark):
    rows = queries.REGISTRY["op4_kd_tree_sharding"](spark, LABELLED).collect()
    shards = defaultdict(list)
    for r in rows:
        shards[r.shard].append(r)
    total, largest = sum(r.size for r in rows), max(r.size for r in rows)
    assert sorted(shards) == list(range(40))
    assert all(abs(sum(r.size for r in v) - total / 40) < largest for v in shards.values())
    assert all(sorted(r.slot for r in v) == list(range(len(v))) for v in shards.values())


def brute_runs(docs, least):
    """Texts after deletion and the number of deleted lines, one by one."""
    lines = [t.split("\n") for _, t in docs]
    count = [[len(words(x)) for x in doc] for doc in lines]
    places, gone = defaultdict(list), [set() for _ in lines]
    for d, doc in enumerate(lines):
        for p, x in enumerate(doc):
            best = 0
            for e, q in places[x]:
                n = 0
                while p + n < len(doc) and q + n < len(lines[e]) and doc[p + n] == lines[e][q + n]:
                    n += 1
                best = max(best, n)
            if best and sum(count[d][p : p + best]) >= least:
                gone[d].update(range(p, p + best))
            places[x].append((d, p))
    return {docs[d][0]: ("\n".join(x for p, x in enumerate(doc) if p not in gone[d]), len(gone[d])) for d, doc in enumerate(lines)}


@pytest.mark.parametrize("parts", [1, 7])
def test_op5_brute_force(spark, parts):
    draw = random.Random(parts)
    alphabet = ["a b", "c", "d e f", "", "g h i j k", "l m", "zzz"]
    pool = [[draw.choice(alphabet) for _ in range(draw.randint(1, 14))] for _ in range(6)]
    docs = []
    for i in range(60):
        doc = []
        for _ in range(draw.randint(0, 4)):
            run = draw.choice(pool)
            a = draw.randint(0, len(run) - 1)
            doc += run[a : draw.randint(a, len(run))] if draw.random() < 0.6 else [draw.choice([*alphabet, f"u{draw.random()}"])]
        docs.append((i, "\n".join(doc)))
    docs += [(100 + i, docs[5][1]) for i in range(8)] + [(200, "\n".join(["c"] * 40)), (201, "")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    if parts > 1:  # the array's parts stay apart, so that their ends are joined
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = line_dedup.remove_repeats(frame, 6, counts=True).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert {r.doc_id: (r.text, r.removed_lines) for r in got} == brute_runs(docs, 6)


def test_op5_query(spark, texts):
    got = queries.REGISTRY["op5_suffix_array_line_dedup"](spark, SF).collect()
    assert {r.doc_id: (r.text, r.removed_lines) for r in got} == brute_runs(sorted(texts.items()), line_dedup.MIN_WORDS)


def test_op6_brute_force(spark, texts):
    kinds = [
        (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 8),
        (re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 16),
        (re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 32),
    ]
    rows = {r.doc_id: r for r in secret_scan.query(spark, SF).collect()}
    for i, t in texts.items():
        spans = sorted((m.start(), k, m.end()) for k, (p, ok) in enumerate(kinds) for m in p.finditer(t) if ok(m))
        joined = ",".join(f"{secret_scan.BASE[k]}:{a}:{b}" for a, k, b in spans)
        assert rows[i].base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert (rows[i].n_assign, rows[i].n_access, rows[i].n_hex) == tuple(sum(k == n for _, k, _ in spans) for n in range(3))


def test_op6_trigram_queries():
    strings = {"".join(sorted(a)) for r in secret_scan.RULES[1:2] for c in secret_scan.trigram_query(r.pattern) for a in c}
    assert strings == {"akikia"} and secret_scan.trigram_query("[0-9a-f]{32,}") == set()
    assert secret_scan.trigram_query("(abcd|x[0-9]+y)z") == set()
    assert secret_scan.trigram_query("foo[xy]") == {frozenset({frozenset({"foo", "oox"}), frozenset({"foo", "ooy"})})}


@pytest.mark.parametrize("limit", [simhash.PAIR_LIMIT, 1])
def test_op8_brute_force(spark, texts, limit, monkeypatch):
    monkeypatch.setattr(simhash, "PAIR_LIMIT", limit)  # 1: all postings by midpoints

    def bits(text):
        w = text.encode().lower().split()
        hashes = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    prints = {i: bits(t) for i, t in texts.items()}
    root = {i: i for i in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sorted(prints):
        for b in prints:
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.query(spark, SF).collect()}
    assert got == {i: (f"{prints[i]:016x}", find(i)) for i in prints}


def test_op8_large_group_of_near_copies(spark):
    prints = [0b1011 << 40 ^ (1 << i) ^ (1 << j) for i in range(0, 60, 2) for j in range(1, 61, 7)] + [5, 7 << 50]
    rows = spark.createDataFrame([(p,) for p in sorted(set(prints))], "fp long")
    got = {r.node: r.root for r in simhash.components(simhash.links(rows)).collect()}
    big = {p for p in prints if p not in (5, 7 << 50)}
    assert set(got) == big - {min(big)} and set(got.values()) == {min(big)}


def test_op9_round_trip(spark, texts):
    from tokenizers import Tokenizer

    known = Tokenizer.from_file(packing.VOCABULARY)
    texts = {**texts, -1: "a  b \n\n c<|endoftext|>d", -2: " x\ty ", -3: "x" * 5000, -4: ""}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(2)
    rows = packing.pack(docs).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for i, t in texts.items():
        ids, at = np.array([*known.encode(t, add_special_tokens=False).ids, 0], "<u4"), 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for s in sequences.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    used = [sum(r.length for r in s) for s in sequences.values()]
    assert sum(1024 - n for n in used if n & (n - 1)) / sum(used) < 0.02


def test_op9_cuts_are_optimal():
    draw = random.Random(3)
    for _ in range(200):
        bounds = np.cumsum([0, *[draw.randint(1, 9) for _ in range(draw.randint(1, 12))]])
        penalties = np.array([draw.randint(0, 3) for _ in bounds])
        padding = lambda n: 0 if n in (1, 2, 4, 8) else 12 - n
        least = {0: 0}
        for j in range(1, len(bounds)):
            least[j] = penalties[j] + min(least[i] + padding(bounds[j] - bounds[i]) for i in range(j) if bounds[j] - bounds[i] <= 12)
        cuts = [0, *packing.best_cuts(bounds, penalties, 12).tolist()]
        cost = sum(padding(bounds[b] - bounds[a]) + penalties[b] for a, b in zip(cuts, cuts[1:]))
        assert cost == least[len(bounds) - 1]


def test_op10_edited_copies(spark):
    draw = random.Random(4)
    vocabulary = ["".join(draw.choice("aeioubcdfgh") for _ in range(draw.randint(2, 9))) for _ in range(3000)]
    text = lambda n: [draw.choice(vocabulary) for _ in range(n)]
    items = [text(40) for _ in range(12)]
    docs = [(i, " ".join(text(300))) for i in range(40)]
    for i, item in enumerate(items):
        edited = [w if draw.random() > 0.15 else draw.choice(vocabulary) for w in item]
        docs.append((100 + i, " ".join(text(80)) + " " + ", ".join(edited).upper() + ". " + " ".join(text(80))))
    docs += [(200 + i, " ".join(items[0])) for i in range(60)]  # most of the corpus repeats one item
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    benchmark = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    found = {(r.doc_id, r.item_id): r for r in decontaminate.find(frame, benchmark).collect()}
    assert set(found) == {(100 + i, i) for i in range(12)} | {(200 + i, 0) for i in range(60)}
    assert all(abs(r.first_word - 80) <= 4 and abs(r.end_word - 120) <= 4 for (d, _), r in found.items() if d < 200)


def test_op10_against_unseeded_alignment(spark):
    """Short items, and long ones whose first half most documents hold."""
    draw = random.Random(8)
    vocabulary = ["".join(draw.choice("aeioubcdfgh") for _ in range(draw.randint(2, 6))) for _ in range(400)]
    text = lambda n: [draw.choice(vocabulary) for _ in range(n)]
    items = [text(n) for n in (1, 2, 3, 4, 5, 5, 5, 8, 8, 8, 16, 40, 40)]
    docs = [text(60) + items[11][:21] + text(20) for _ in range(40)] + [text(30) + items[12] + text(9)]
    for item in items:
        for rate in (0.2, 0.3, 0.4):
            for _ in range(6):
                docs.append(text(20) + [w if draw.random() > rate else "zz" for w in item] + text(20))
        docs.append(text(9) + ["zz" if i % 3 == 2 else w for i, w in enumerate(item)] + text(9))
        docs.append(text(9) + [w for v in item for w in (v, "zz")][:-1] + text(9))
    want = {(d, i): hit[0] for d, doc in enumerate(docs) for i, item in enumerate(items) if (hit := decontaminate.align(item, doc))}
    frame = spark.createDataFrame([(d, " ".join(w)) for d, w in enumerate(docs)], "doc_id long, text string")
    benchmark = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    assert {(r.doc_id, r.item_id): r.similarity for r in decontaminate.find(frame, benchmark).collect()} == want
    left = {r.doc_id for r in decontaminate.remove(frame, benchmark).collect()}
    assert left == set(range(len(docs))) - {d for d, _ in want}


def test_op10_words_of_every_character():
    chars = [chr(i) for i in range(0x3000) if not 0xD800 <= i < 0xE000]
    texts = ["a" + "b".join(chars[i : i + n]) + "Z" for n in (1, 64, 256) for i in range(0, len(chars), n)]
    for text in [None, "", "caf\u00e9_\u00b2x\u00a0y\x85z\x1cw", "\u0130 \u03a3", *texts]:
        assert decontaminate.words_of(text) == re.findall(r"[^\W_]+", (text or "").lower())


def test_op10_words_cost_less_than_matching():
    text = " ".join(f"caf\u00e9{i} word, other-{i}" for i in range(2000))
    least = lambda f: min(timeit.repeat(f, number=3, repeat=7))
    assert least(lambda: decontaminate.words_of(text)) < 0.75 * least(lambda: re.findall(r"[^\W_]+", text.lower()))


def test_op10_counts_drop_other_words(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "HELD_WORDS", 3)
    frame = spark.createDataFrame([(i, f"one two two other{i} more{i} last{i}") for i in range(50)] + [(None, None)], "doc_id long, text string")
    assert decontaminate._counts(frame, [(1, ["two", "one"]), (2, ["two", "never"])]) == {"one": 50, "two": 100}


def test_pipeline_stages(spark, texts):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, kept = docs.columns, set(texts)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF).cache()
        assert out.columns == names, name
        ids = [r.doc_id for r in out.select("doc_id").collect()]
        assert len(ids) == len(set(ids)) and set(ids) <= kept
        kept, docs = set(ids), out
    assert 0 < len(kept) < len(texts)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == kept
