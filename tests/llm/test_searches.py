"""Operators 11 to 13 on odd rows and against plain versions."""

import collections
import math
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from roadloom.llm import heap_search, pivot_simhash, variant_automata
from tests.llm import brute

CLASHES = ["key", "doc", "h", "fp", "word", "n", "form", "score", "item", "block", "rank", "terms", "id", "root"]


def clashing(df):
    return df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASHES) if c not in df.columns]).repartition(3)


# 11


def plain_words(docs):
    c = collections.Counter()
    for d, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = brute.lower(run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            c[run if h % 31 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    return {w: n for w, n in c.items() if len(w) >= 7 and n >= 2}


def plain_variants(words):
    near = {w: [v for v in words if v != w and brute.distance_one(v, w)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(((-words[v], v) for v in near[w]), default=(0, None))
        form[w] = best[1] if -best[0] >= 10 * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return sorted(out)


def variants_of(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


WORDS = {"aaaaaaa": 3, "aaaaaaaa": 40, "aaaaaaaaa": 500, "baaaaaaa": 2, "aaaabaaa": 50, "lettere": 2, "letteré": 20, "lettererr": 5, "letterer": 50, "xletterer": 500, "×÷ÿÀabc": 2, "×÷ÿÀabd": 20, "×÷ÿÀabe": 20}


@pytest.mark.parametrize("shard_rows", [3, 40_000])
def test_variants_with_ties_runs_and_parts(spark, shard_rows):
    """Few rows a shard: halves that many words share are cut into parts of both sides."""
    rng = np.random.default_rng(shard_rows)
    words = dict(WORDS)
    for _ in range(120):  # one half holds most of the words
        words["prefix" + "".join(rng.choice(list("abc"), rng.integers(1, 5)))] = int(rng.integers(2, 3000))
    df = spark.createDataFrame(list(words.items()), "word string, n long").repartition(3)
    assert variants_of(variant_automata.variants(df, shard_rows=shard_rows)) == plain_variants(words)


def test_words_are_counted_over_odd_rows(spark):
    long = " ".join(f"wording{'abcdefghij'[i % 10]}" for i in range(100_000)) + " " + "a" * 300_000
    docs = [(1, "Wording Wording wordinßg Éléphants"), (2, None), (3, ""), (None, "WORDING wording"), (4, long), (4, long), (5, "short words ЖЖЖЖЖЖЖЖ ЖЖЖЖЖЖЖЖ")]
    df = clashing(spark.createDataFrame(docs, "doc_id long, text string"))
    got = {r.word: r.n for r in variant_automata.counted(df).collect()}
    assert got == plain_words(docs) and max(map(len, got)) >= 299_999
    assert variants_of(variant_automata.variants(spark.createDataFrame(list(got.items()), "word string, n long")))[0][0] in got
    assert variant_automata.variants(variant_automata.counted(df.limit(0))).count() == 0


def test_automaton_is_minimal_and_numbers_words():
    words = sorted({a + b + c for a in ("pre", "re", "un") for b in ("do", "make", "set") for c in ("", "ing", "s")})
    a = variant_automata.Automaton(words)
    assert [a.number(a.root, w, 0) for w in words] == list(range(len(words))) and a.number(a.root, "prexing", 0) == -1
    ends = {w[k:] for w in words for k in range(len(w) + 1)}
    rights = {frozenset(e for e in ends if p + e in set(words)) for p in {w[:k] for w in words for k in range(len(w) + 1)}}
    assert len(a.edges) == len(rights)  # a node for each set of what may follow


def test_variants_query(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    words = plain_words(docs)
    near = collections.defaultdict(set)
    by_gap = collections.defaultdict(set)
    for w in words:
        for i in range(len(w)):
            if (v := w[:i] + w[i + 1 :]) in words:
                near[w].add(v)
                near[v].add(w)
            by_gap[w[:i], w[i + 1 :]].add(w)
    for group in by_gap.values():
        for w in group:
            near[w] |= group - {w}
    got = variants_of(variant_automata.op11_variant_automata(spark, sf))
    assert {r[0]: r[3] for r in got} == words and all(r[4] == len(near[r[0]]) for r in got)
    for w, form, _, n, _, form_n in got:
        best = min(((-words[v], v) for v in near[w]), default=(0, None))
        assert (form, form_n) == ((best[1], -best[0]) if -best[0] >= 10 * n else (None, None))


# 12


def plain_ranking(docs, items, k):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", brute.lower(t))
    counts = [(d, collections.Counter(cut(t))) for d, t in docs]
    counts = [(d, c) for d, c in counts if c]
    n_docs, tokens = len(counts), sum(sum(c.values()) for _, c in counts)
    df = collections.Counter(w for _, c in counts for w in c)
    out = []
    for i, t in items:
        found = []
        for d, c in counts:
            m = 100 - 50 + (50 * sum(c.values()) * n_docs) // tokens
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 20 * m)) for w in set(cut(t)) if c[w])
            if score > 0:
                found.append((-score, d is None, d or 0, d))
        out += [(i, rank, f[3], -f[0]) for rank, f in enumerate(sorted(found, key=lambda f: f[:3])[:k], 1)]
    return out


def ranked(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


@pytest.mark.parametrize("block,shard_bytes,block_terms", [(3, 2000, 4), (1024, 1 << 20, 1 << 16)])
def test_ranking_on_odd_rows(spark, monkeypatch, block, shard_bytes, block_terms):
    """Blocks of three postings, many shards and blocks of items; the same with the usual sizes."""
    monkeypatch.setattr(heap_search, "BLOCK", block)
    rng = np.random.default_rng(7)
    vocabulary = [f"w{i}" for i in range(40)] + ["été", "café", "99"]
    docs = [(int(i // 2 if i % 5 else i), " ".join(rng.choice(vocabulary, rng.integers(0, 60)))) for i in range(160)]
    docs += [(900, None), (901, ""), (902, "... !!"), (None, "w1 w2 w1"), (None, "w1 w2 w1"), (903, "W1 " * 30_000), (904, "w1 w2 w1"), (904, "w1 w2 w1")]
    items = [(1, "w1 W2 w1, café"), (2, None), (3, "nowhere"), (4, "w3"), (4, "w5-w6"), (4, "w3"), (None, "99 ÉTÉ été"), (5, " ".join(vocabulary))]
    shards = heap_search.build(clashing(spark.createDataFrame(docs, "doc long, text string")).select("doc", "text"), shard_bytes)
    got = ranked(heap_search.search(shards, clashing(spark.createDataFrame(items, "item_id long, text string")), k=7, block_terms=block_terms))
    assert got == sorted(plain_ranking(docs, list(dict.fromkeys(items)), 7), key=str)
    assert (shards.count() > 10) == (shard_bytes == 2000)


def test_ranking_of_nothing(spark):
    none = spark.createDataFrame([], "doc long, text string")
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert heap_search.search(heap_search.build(none), items).count() == 0
    some = heap_search.build(spark.createDataFrame([(1, "a"), (2, "!")], "doc long, text string"))
    assert heap_search.search(some, items.limit(0)).count() == 0
    assert heap_search.search(some, items).collect()[0].doc_id == 1


def test_packed_numbers():
    rng = np.random.default_rng(0)
    values = np.concatenate([[0, 127, 128, 16383, 16384, 1 << 40], rng.integers(0, 1 << 30, 500)])
    data, begins = heap_search.packed(values)
    assert heap_search.unpacked(data).tolist() == values.tolist() and begins[1] == 1 and begins[3] - begins[2] == 2
    assert heap_search.unpacked(data[begins[7] : begins[9]]).tolist() == values[7:9].tolist()


# 13


def plain_fingerprint(text, n=3):
    w = brute.words(text)
    grams = [" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] if len(w) >= n else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_classes(fps):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    order = sorted(root)
    for i, a in enumerate(order):
        for b in order[:i]:
            if (a ^ b).bit_count() <= 3:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {f: find(f) for f in root}


@pytest.mark.parametrize("piece", [1, 7, 40, 1 << 20])
def test_fingerprints_in_pieces(piece):
    for text in ("", " \n", "one", "one Two", "a b c", "Grüße aus der École x " * 9, " lead and trail \t", "\U0001f999 " * 5, "x" * 100):
        assert pivot_simhash.fingerprint(text.encode(), piece=piece) == plain_fingerprint(text)


def test_masks_leave_no_pair_out():
    rng = np.random.default_rng(3)
    assert len(pivot_simhash.COARSE) == 20 and all(len(f) == 10 for f in pivot_simhash.FINE)
    for _ in range(500):
        flips = sum(1 << int(b) for b in rng.choice(64, 3, replace=False))
        alike = [i for i, m in enumerate(pivot_simhash.COARSE) if not m & flips]
        assert alike and all(any(not f & flips for f in pivot_simhash.FINE[i]) for i in alike)


@pytest.mark.parametrize("large", [4, 64])
def test_components_of_clusters(spark, monkeypatch, large):
    """Chains and clusters whose members differ in a few bits, in few blocks and in many; small buckets are parted further too."""
    monkeypatch.setattr(pivot_simhash, "LARGE", large)
    rng = np.random.default_rng(large)
    fps = set(rng.integers(0, 1 << 63, 60).tolist())
    for spread in (2, 4, 5, 8):
        centre = int(rng.integers(0, 1 << 62)) * 2
        fps |= {centre ^ sum(1 << int(b) for b in rng.choice(64 if spread < 8 else 20, spread, replace=False)) for _ in range(120)}
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    got = {r.v % (1 << 64): r.root % (1 << 64) for r in pivot_simhash.components(spark.createDataFrame(signed, "fp long").repartition(3)).collect()}
    want = plain_classes(fps)
    groups = lambda roots: {frozenset(f for f in fps if roots.get(f, f) == r) for r in {roots.get(f, f) for f in fps}}
    assert groups(got) == groups(want)


def test_the_table_discards_only_far_pairs(spark):
    rng = np.random.default_rng(5)
    a = rng.integers(-(1 << 63), 1 << 63, 300)
    flips = [sum(1 << int(b) for b in rng.choice(63, int(rng.integers(0, 40)), replace=False)) for _ in a]
    rows = [(int(x), int(x) ^ f, f.bit_count()) for x, f in zip(a.tolist(), flips, strict=True)]
    df = spark.createDataFrame(rows, "x long, y long, d int")
    both = df.select("d", *[c.alias(f"{p}{n}") for p in "xy" for n, c in zip(("d0", "d1"), pivot_simhash.table_row(p), strict=True)])
    kept = both.select("d", pivot_simhash.within("x", "y").alias("kept")).collect()
    assert all(r.kept for r in kept if r.d <= 3) and sum(r.kept for r in kept if r.d >= 16) <= 5


def test_simhash_on_odd_rows(spark):
    base = " ".join(f"word{i}" for i in range(200))
    docs = [(5, base), (3, base), (3, base), (9, base + " more"), (None, base), (8, None), (7, ""), (6, " \t"), (1, "quite another text stands here"), (1, "a b c d e f"), (2, "x " * 700_000)]
    got = pivot_simhash.near_components(clashing(spark.createDataFrame(docs, "doc_id long, text string"))).collect()
    classes = plain_classes({plain_fingerprint(t) for _, t in docs})
    first = {}
    for d, t in docs:
        c = classes[plain_fingerprint(t)]
        first[c] = min(first.get(c, d), d, key=lambda x: (x is None, x or 0))
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got), key=str) == sorted(((d, f"{plain_fingerprint(t):016x}", first[classes[plain_fingerprint(t)]]) for d, t in docs), key=str)
    assert pivot_simhash.near_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_simhash_query(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    prints = {d: plain_fingerprint(t) for d, t in docs}
    classes = plain_classes(set(prints.values()))
    first = {}
    for d, f in prints.items():
        first[classes[f]] = min(first.get(classes[f], d), d)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in pivot_simhash.op13_pivot_simhash(spark, sf).collect()}
    assert got == {d: (f"{f:016x}", first[classes[f]]) for d, f in prints.items()}
