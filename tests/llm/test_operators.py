"""Operators on their edge cases, and the queries against plain versions on a small table."""

import collections
import copy
import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from roadloom.llm import attention_lm, catalogue, common, line_variants, metric_tree, pii_boosting, piece_bpe, ppm_language, prefix_groups, sentence_spans, suffix_decontamination, toxicity_pu
from tests.llm import brute

LONG = " ".join(f"word{i % 997}x{i % 31}." for i in range(30_000))
PASSAGE = "One sentence stands here with words. Another one follows it with yet more words! A third ends what is shared by them."
LINE = "This line is long enough to be looked at, twice"
ROWS = [
    (1, f"Start of one. {PASSAGE} End of one.\n{LINE}", "en", "a"),
    (2, f"Other start. {PASSAGE} Other end.\n{LINE}!", "en", None),
    (3, None, None, "a"),
    (4, "", "en", "a"),
    (5, LONG, "en", "a"),
    (5, LONG, "en", "a"),
    (6, "  \n\t ", None, None),
    (7, f"{LINE}\n{LINE}\nshort\nshort", "fr", "b"),
    (8, "mail a@b.c or +1 (826) 555-4081 190.137.223.204, card 4111 1111 1111 1111 4111-1111-1111-1111", "en", "a"),
    (9, "\U0001f999 é ñ 中 x@y.zé 1.2.3.4.5.6.7.8 300.1.2.3", "en", "a"),
    (10, "a b", "en", "a"),
]
#: Columns whose names the operators use inside.
CLASHES = ["key", "doc", "h", "score", "line", "place", "gone", "times", "base", "spans", "id", "grp", "cls", "row", "size", "later"]


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string")
    return df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASHES)]).repartition(3)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()


def once(rows):
    return sorted({(r[0], r[1]) for r in rows}, key=lambda r: r[0])


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


# 1


def test_toxicity_edges(spark, odd):
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(1, 9)] + [(None, 1), (2, None)], "doc_id long, toxic int")
    got = toxicity_pu.score(odd, toxicity_pu.train(odd, labels, classifiers=1)).collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r.score for r in got}
    assert by[3] == by[4] == by[6]
    assert toxicity_pu.score(empty(spark), toxicity_pu.train(empty(spark), labels)).count() == 0
    assert toxicity_pu.score(odd, toxicity_pu.train(odd, labels.where("toxic = 2"))).agg(F.max("score")).first()[0] < 1e-9


def test_nnpu_finds_what_only_positives_have():
    rng = np.random.default_rng(0)
    y = rng.random(6000) < 0.1
    x = (rng.random((6000, 6)) < 0.05).astype(np.float32)
    x[y, rng.integers(0, 3, y.sum())] = 1
    x[~y, :3] = 0
    pos = x[y][:200]
    w, b = toxicity_pu.fit_nnpu(pos, x, 0.1, 0)
    p = 1 / (1 + np.exp(-(x @ w + b)))
    assert (p[y] >= 0.7).mean() > 0.95 and (p[~y] >= 0.7).mean() < 0.01


def test_toxicity_scores_against_a_plain_version(spark, sf):
    """Each score from the words of its text, one by one: a word and its beginnings count once, whatever else is scored with it."""
    d, labels = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "labels"))
    model = toxicity_pu.train(d, labels, classifiers=2)
    number = {int(c): i for i, c in enumerate(model.chosen)}

    def plain(text):
        own = set()
        for w in re.findall(rb"[0-9A-Za-z\x80-\xff]+", (text or "").encode()):
            w = bytes(c + 32 if 65 <= c <= 90 else c for c in w)
            for size in (None, *toxicity_pu.BEGINNINGS):
                if size is None or len(w) > size:
                    part = np.frombuffer(w[:size], np.uint8)
                    h = common.hash_runs(part, np.array([0]), np.array([len(part)]))
                    h = h if size is None else common.mix(h + np.uint64(size))
                    own.add(number.get(int(h[0] % np.uint64(toxicity_pu.BUCKETS))))
        margin = model.biases + sum((model.weights[i] for i in own if i is not None), np.zeros(len(model.biases)))
        return float((1 / (1 + np.exp(-np.clip(margin, -60, 60)))).mean())

    rows = d.collect()
    got = {r.doc_id: r.score for r in toxicity_pu.score(d, model).collect()}
    assert len(model.chosen) > 0 and all(abs(got[r.doc_id] - plain(r.text)) < 1e-9 for r in rows)


def test_nnpu_turns_where_the_negative_risk_falls_below_zero():
    """On positives that look like nothing else the plain estimator explains them away without end; the non-negative one stops."""
    rng = np.random.default_rng(1)
    x = (rng.random((400, 40)) < 0.1).astype(np.float32)
    w, b = toxicity_pu.fit_nnpu(x[:40], x, 0.3, 0)
    z = lambda v: 4 / (1 + np.exp(np.clip(-(v @ w + b), -60, 60)))  # noqa: E731  the sigmoid loss of taking rows as negatives
    assert z(x).mean() - 0.3 * z(x[:40]).mean() > -0.2


def test_toxicity_of_long_texts_and_of_null_ids(spark, monkeypatch):
    """A text in pieces has the score that it has whole; rows with null or repeated ids are as likely in the sample as others."""
    words = [f"word{i % 700}" for i in range(90_000)]
    chosen = np.unique(np.concatenate([toxicity_pu.features(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w)]))[1] % np.uint64(toxicity_pu.BUCKETS) for w in words[:50]]))
    model = toxicity_pu.Classifiers(chosen.astype(np.int64), np.linspace(-1, 1, len(chosen))[:, None], np.zeros(1))
    rows = [(1, " ".join(words)), (2, " ".join(words[:700])), (None, " ".join(reversed(words)))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert len({round(r.score, 9) for r in toxicity_pu.score(df, model).collect()}) == 1
    n = 3000
    docs = spark.range(n).select(F.when(F.col("id") % 2 == 0, F.col("id")).alias("doc_id"), F.concat(F.lit("some text "), F.col("id")).alias("text"))
    drawn = []
    keep = toxicity_pu.cut
    monkeypatch.setattr(toxicity_pu, "cut", lambda df: drawn.append(keep(df)) or drawn[-1])
    labels = spark.createDataFrame([(2, 1), (4, 0)], "doc_id long, toxic int")
    toxicity_pu.train(docs, labels, unlabelled=600, classifiers=1)
    found = [r.text for r in drawn[0].where("positive = 0").collect()]
    assert 450 < len(found) < 750 and 0.35 < sum(int(t.split()[-1]) % 2 for t in found) / len(found) < 0.65


def test_toxicity_query_held_out(spark):
    folder = "/root/testdata/sf0.1"
    got = catalogue.QUERIES["op1_toxicity_pu"](spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("held_out")
    n = {(r.toxic, r.predicted): r["count"] for r in got.groupBy("toxic", "predicted").count().collect()}
    assert n[1, 1] / (n[1, 1] + n.get((1, 0), 0)) > 0.7
    assert n.get((0, 1), 0) / (n[0, 0] + n.get((0, 1), 0)) < 0.01


# 2


def test_contamination(spark, sf, odd, docs):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()] + [(900, "the of"), (901, ""), (902, None), (903, "the of")]
    table = spark.createDataFrame(items, "item_id long, text string")
    expected = brute.contamination([(r.doc_id, r.text) for r in docs], items)
    d = spark.read.parquet(f"{sf}/documents.parquet")
    for block in (10**6, 300):
        got = suffix_decontamination.contamination(d, table, block_words=block)
        assert sorted((r.doc_id, r.n_words, len(r.item_ids)) for r in got.collect()) == sorted((e[0], e[1], e[3]) for e in expected)
        kept = suffix_decontamination.decontaminate(d, table, block_words=block)
        assert kept.columns == d.columns and sorted(r.doc_id for r in kept.collect()) == sorted(e[0] for e in expected if not e[5])
    own = spark.createDataFrame([(1, "word0x0 word1x1 word2x2"), (2, PASSAGE.upper())], "item_id int, text string")
    got = {r.doc_id: r for r in suffix_decontamination.contamination(odd, own).collect()}
    assert got[5].item_ids == ["1"] and got[1].item_ids == ["2"] == got[2].item_ids and got[3].n_words == 0 and got[1].longest == len(PASSAGE.split())
    assert suffix_decontamination.contamination(empty(spark), own).count() == 0
    assert suffix_decontamination.contamination(odd, own.limit(0)).where("size(hits) > 0").count() == 0


def test_longest_match_of_each_text(spark):
    """Copies in one shard, and texts with different parts of one passage: each has its own longest match, by a plain version."""
    rng = np.random.default_rng(4)
    items = [(k, " ".join(f"v{x}" for x in rng.integers(0, 6, n))) for k, n in enumerate((12, 15, 30, 25))]
    texts = [items[0][1]] * 3 + [f"zz {items[2][1]} yy"] * 2 + [" ".join(t.split()[a:]) for _, t in items for a in range(3)] + [" ".join(f"v{x}" for x in rng.integers(0, 6, 60)) for _ in range(20)]

    def best(text):
        w = text.split()
        out = 0
        for _, t in items:
            v = t.split()
            for i in range(len(w) - 9):
                for j in range(len(v)):
                    n = 0
                    while i + n < len(w) and j + n < len(v) and w[i + n] == v[j + n]:
                        n += 1
                    out = max(out, n)
        return out

    table = spark.createDataFrame(items, "item_id int, text string")
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    results = []
    for parts in (1, 7):
        got = {r.doc_id: (r.longest, r.longest_item) for r in suffix_decontamination.contamination(df.repartition(parts), table).collect()}
        assert {i: n for i, (n, _) in got.items()} == {i: best(t) for i, t in enumerate(texts)}
        results.append(got)
    assert results[0] == results[1] and results[0][0] == results[0][1] == results[0][2] == (12, "0")


def test_items_without_an_id_hit(spark):
    """Their words count, their absence from the list is all that is missing; the pipeline's stage drops what they hit. Small blocks pass one after the other."""
    item = " ".join(f"leak{i}" for i in range(12))
    docs = spark.createDataFrame([(1, f"before {item} after"), (2, "nothing of that kind")], "doc_id long, text string")
    items = spark.createDataFrame([(None, item), (None, None), (5, "other words that stand nowhere"), (5, "nothing of")], "item_id long, text string")
    for block_words in (3, 1000):
        got = {r.doc_id: (sum(s.end - s.begin for s in r.hits), r.item_ids, r.longest) for r in suffix_decontamination.contamination(docs, items, block_words=block_words).collect()}
        assert got == {1: (12, [], 12), 2: (2, ["5"], 2)}
        assert suffix_decontamination.decontaminate(docs, items, block_words=block_words).count() == 0
    plan = suffix_decontamination.contamination(docs, items, block_words=3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1  # no workers of several blocks in one stage


def test_contamination_in_pieces(spark, monkeypatch):
    """Texts of many pieces hold what the whole holds, at the pieces' edges as well; matches and blocks don't depend on partitions."""
    monkeypatch.setattr(suffix_decontamination, "SHARD_BYTES", 200)
    rng = np.random.default_rng(8)
    word = lambda: f"v{rng.integers(0, 9)}"
    items = [(k, " ".join(word() for _ in range(n))) for k, n in enumerate((3, 10, 14, 30))] + [(9, "v1"), (10, None)]
    texts = [" ".join(word() for _ in range(n)) for n in (0, 5, 300, 900)] + [" ".join([*(word() for _ in range(150)), items[3][1], *(word() for _ in range(90))]) for _ in range(4)] + [None]
    df = spark.createDataFrame(list(enumerate(texts)), "row long, text string")
    table = spark.createDataFrame(items, "item_id int, text string")
    expected = {d: (n, k, hit) for d, n, hit, k, _, _ in brute.contamination(list(enumerate(texts)), items)}
    for parts, block in ((1, 10**6), (3, 20), (7, 20)):
        got = suffix_decontamination.contamination(df.repartition(parts), table, id_column="row", block_words=block).collect()
        assert {r["row"]: (r.n_words, len(r.item_ids), sum(h.end - h.begin for h in r.hits)) for r in got} == expected
        assert all(r.longest >= 30 for r in got if 4 <= r["row"] < 8)
        clean = suffix_decontamination.decontaminate(df.repartition(parts), table, block_words=block)
        assert sorted(r["row"] for r in clean.collect()) == [d for d, (_, _, hit) in sorted(expected.items()) if not hit]


def test_contamination_query(spark, sf, docs):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = catalogue.QUERIES["op2_suffix_decontamination"](spark, sf).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()
    assert sorted(map(tuple, got)) == sorted(brute.contamination([(r.doc_id, r.text) for r in docs], items))


# 3


def test_spans(spark, sf, odd, docs):
    expected = brute.repeated_spans(once([(r[0], r[1]) for r in ROWS]))
    got = sentence_spans.dedup_spans(odd).collect()
    assert len(got) == len(ROWS) and all(list(r.removed) == expected[r.doc_id] for r in got)
    by = {r.doc_id: r for r in got}
    assert PASSAGE in by[1].text and PASSAGE not in by[2].text and by[2].text.startswith("Other start. Other end.") and by[3].text is None and by[4].text == ""
    assert sentence_spans.dedup_spans(empty(spark)).count() == 0
    expected = brute.repeated_spans(sorted((r.doc_id, r.text) for r in docs))
    assert {r.doc_id: list(r.removed) for r in catalogue.QUERIES["op3_sentence_spans"](spark, sf).collect()} == expected


def test_every_sentence_of_a_repeated_run_goes(spark):
    """Against all runs of three sentences or more, and of two with 40 words, that stand earlier too."""
    rng = np.random.default_rng(5)
    sentence = lambda n, tag: " ".join([*(f"{tag}w{i}" for i in range(n - 1)), f"{tag}end."])
    passages = [[sentence(n, f"p{k}s{i}") for i, n in enumerate(sizes)] for k, sizes in enumerate([(25, 25, 12), (45, 38), (5, 6, 9), (5, 6, 8), (50,), (20, 19), (1, 1, 2), (3, 4, 30, 39, 2, 2), *[rng.integers(1, 45, 6) for _ in range(10)]])]
    rows = [(2 * k + copy, " ".join([sentence(7, f"a{k}c{copy}"), *p, sentence(8, f"b{k}c{copy}")])) for k, p in enumerate(passages) for copy in range(2)]
    rows += [(100 + 2 * k + copy, " ".join(p) + f" {k}.") for k, p in enumerate([[sentence(25, "x"), sentence(25, "y"), sentence(12, "z")]]) for copy in range(2)]
    first, expected = {}, {d: set() for d, _ in rows}
    for d, t in rows:
        s = brute.sentences(t)
        for i in range(len(s)):
            for j in range(i + 1, len(s) + 1):
                n = sum(map(len, s[i:j]))
                if j - i >= 3 or (j - i == 2 and n >= 40):
                    if first.setdefault(tuple(w for x in s[i:j] for w in x), (d, i)) != (d, i):
                        expected[d].update(range(i, j))
    got = {r.doc_id: set(r.removed) for r in sentence_spans.dedup_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == expected and got[1] == {1, 2, 3} and got[3] == {1, 2} and got[101] == {0, 1, 2, 3}


# 4


def test_pieces(spark, sf, odd):
    model = piece_bpe.default_model()
    import random

    r = random.Random(1)
    texts = ["".join(r.choice(" \n▁.,abcthe1\té\U0001f999\x00�-'中²") for _ in range(r.randrange(40))) for _ in range(3000)] + [" " * k + "a" + " " * k for k in range(40)] + ["a" * 3000]
    assert piece_bpe.differs_from_library(spark.createDataFrame([(t,) for t in texts], "text string"), model).count() == 0
    assert piece_bpe.differs_from_library(spark.read.parquet(f"{sf}/documents.parquet"), model).count() == 0
    got = {x.doc_id: x for x in piece_bpe.encode_pieces(odd, model).collect()}
    assert got[3].ids == [1, 2] == got[4].ids and got[3].decoded == "" and got[5].decoded == LONG and got[5].n_tokens == len(got[5].ids)
    assert got[9].ids_sha256 == hashlib.sha256(np.array(got[9].ids, "<u4").tobytes()).hexdigest()
    assert piece_bpe.encode_pieces(empty(spark), model).count() == 0
    assert catalogue.QUERIES["op4_piece_bpe"](spark, sf).where("n_tokens < 2").count() == 0


# 5


def test_components(spark, sf, odd, docs):
    words = [f"w{i}" for i in range(400)]
    chain = [(100 + i, " ".join([*words[8 * i :], *[f"c{i}x{k}" for k in range(8 * i)]])) for i in range(12)]
    rows = once([(r[0], r[1]) for r in ROWS]) + chain + [(90, "Same Words here"), (91, "same words HERE"), (92, "two words"), (93, "two words")]
    expected = brute.components(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in prefix_groups.similar_components(df).collect()} == expected
    got = prefix_groups.similar_components(odd).collect()
    assert len(got) == len(ROWS) and {r.doc_id: r.component_id for r in got} == {r[0]: r[0] for r in ROWS}
    assert prefix_groups.similar_components(empty(spark)).count() == 0
    loose = brute.components(rows, 5, 80)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in prefix_groups.similar_components(df, n=5, percent=80).collect()} == loose


def test_components_query(spark, sf, docs):
    got = catalogue.QUERIES["op5_prefix_groups"](spark, sf).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute.components([(r.doc_id, r.text) for r in docs])


def near_copies(seed, n, most, variants=1):
    """Texts of one base, or of several that share half of it, each with some words of its own."""
    rng = np.random.default_rng(seed)
    rows = []
    for d in range(n):
        w = [f"b{i}" if i < 60 else f"b{i}v{d % variants}" for i in range(120)]
        for k in rng.choice(120, rng.integers(0, most), replace=False):
            w[k] = f"e{d}x{k}" if rng.random() < 0.7 else f"e{k}"
        rows.append((d, " ".join(w[: rng.integers(110, 121)])))
    return rows


@pytest.mark.parametrize("long_list", [2, 10])
@pytest.mark.parametrize("percent,n", [(90, 3), (80, 5)])
def test_long_lists_are_met_by_their_differences(spark, monkeypatch, long_list, percent, n):
    """Lists of near copies that are not all alike, by their differences from a centre: no link is lost."""
    rows = near_copies(3, 70, 5)
    rows += [(100 + d, t) for d, t in near_copies(4, 60, 4, variants=3)] + [(300 + i, " ".join(f"b{k}" for k in range(i, i + 5))) for i in range(8)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(prefix_groups, "LONG_LIST", long_list)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in prefix_groups.similar_components(df, n=n, percent=percent).collect()}
    expected = brute.components(rows, n, percent)
    assert got == expected and len({c for _, c in expected.values()}) > 20


def test_counters_grow_with_the_texts(spark, monkeypatch):
    """An n-gram of all texts is told from those of one text, however many there are: its list is no prefix's."""
    monkeypatch.setattr(prefix_groups, "COUNTERS", 8)
    texts = ["all have this " + " ".join(f"d{i}w{k}" for k in range(30)) for i in range(400)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(400, None), (401, texts[7] + " end")], "doc_id long, text string")
    table = prefix_groups.count_table(df.select("text"), 3)
    data = np.frombuffer(texts[0].encode(), np.uint8)
    _, own = prefix_groups.shingle_sets(data, np.array([0, len(data)]), 3)
    _, common_one = prefix_groups.shingle_sets(data[:13], np.array([0, 13]), 3)
    seen = table[prefix_groups._counter(own, len(table))]
    assert len(own) == 31 and (seen >= table[prefix_groups._counter(common_one, len(table))]).sum() == 1
    got = {r.doc_id: r.component_id for r in prefix_groups.similar_components(df).collect()}
    assert got == {i: 7 if i == 401 else i for i in range(402)}


# 6


def test_lines(spark, odd):
    base = "The quick brown fox jumps over the lazy dog and runs"
    rows = [(1, base), (2, base[:10] + base[11:]), (3, base + "x"), (4, base.replace("quick", "quack")), (5, base.replace("quick", "quuick")), (6, base[:-2]), (7, "y" * 300 + base), (8, "y" * 150 + "z" + "y" * 149 + base), (9, base.upper()), (10, f"{base}\n\n{base[:20]}\n{base[:20]}")]
    rows = once([(r[0] + 100, r[1]) for r in ROWS]) + rows
    rows.sort()
    expected = brute.removed_lines(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: list(r.removed) for r in line_variants.dedup_lines(df).collect()} == expected
    got = line_variants.dedup_lines(odd, keep_columns=True)
    assert got.columns == odd.columns and got.count() == len(ROWS)
    by = {r.doc_id: r.text for r in got.collect()}
    assert by[3] is None and by[4] == "" and by[7] == "short" and by[2].endswith("Other end.") and by[5] == LONG
    assert line_variants.dedup_lines(empty(spark)).count() == 0


def test_lines_that_differ_in_one_place_and_long_lines(spark):
    """Groups of lines that differ in one character, insertions among them, and lines of many segments, against a plain version."""
    rng = np.random.default_rng(6)
    base = "Chapter 0 of the book that everyone here has read"
    texts = [base.replace("0", c) for c in "zxcvbnm123456789"] + [base.replace("0", "11"), base.replace("0", ""), base.replace("0", "1 "), "a\nb\na", " \n\n \t\nb"]
    long = "".join(rng.choice(list("abcdefgh "), 3000))
    texts += [long, long[:1200] + "Q" + long[1201:], long[:2999], long[:40] + long[41:], long + "x", long[:700] + long[702:], long[:1500] + "zz" + long[1500:]]
    order = rng.permutation(len(texts))
    rows = [(int(i), texts[k]) for i, k in enumerate(order)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r.doc_id: list(r.removed) for r in line_variants.dedup_lines(df).collect()} == brute.removed_lines(rows)


def test_no_python_in_native_plans(spark, sf):
    for name in ("op6_line_variants", "op10_pii_boosting"):
        plan = catalogue.QUERIES[name](spark, sf)._jdf.queryExecution().toString()
        assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))


# 7


def test_languages(spark, odd):
    trees = ppm_language.train(odd)
    got = {r.doc_id: r for r in ppm_language.predict(odd, trees).collect()}
    assert len(got) == len({r[0] for r in ROWS}) and got[3].lang_pred == got[4].lang_pred == got[6].lang_pred == "und" and got[7].lang_pred == "fr" and got[3].score == 0
    kept = ppm_language.keep_known(odd, trees)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} == {1, 2, 5, 7, 8, 9, 10}
    nothing = ppm_language.train(empty(spark))
    assert {r.lang_pred for r in ppm_language.predict(odd, nothing).collect()} == {"und"}
    assert ppm_language.predict(empty(spark), trees).count() == 0


def test_language_query_held_out(spark):
    folder = "/root/testdata/sf0.01"
    got = catalogue.QUERIES["op7_ppm_language"](spark, folder).join(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang"), "doc_id")
    assert got.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97


def test_the_language_sample_is_bounded(spark, monkeypatch):
    """Rows with null ids, or with one id, are drawn like others; rows that repeat whole are one. Each byte is a sequence of the tree."""
    text = F.concat(F.lit("some words "), F.lpad(F.col("id").cast("string"), 5, "0"))
    rows = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("en").alias("lang"), text.alias("text"))
    rows = rows.union(spark.range(3000).select(F.lit(7), F.lit("fr"), F.lit("toujours la"))).union(spark.range(3000).select(F.lit(7), F.lit("de"), text))
    learned = []
    tree = ppm_language.Tree
    monkeypatch.setattr(ppm_language, "Tree", lambda code, n, order: learned.append(int(n.sum())) or tree(code, n, order))
    assert ppm_language.train(rows, per_language=300).languages == ["de", "en", "fr"]
    assert 200 < learned[0] / 16 < 420 and 200 < learned[1] / 16 < 420 and learned[2] == 11
    assert ppm_language.train(rows, per_language=5000, most_languages=2).languages == ["de", "en"]


def test_code_lengths_against_dictionaries():
    rng = np.random.default_rng(0)
    texts = ["".join(rng.choice(list("abcAé中 \n7"), rng.integers(1, 60))) for _ in range(40)]
    for order in (0, 1, 3):
        batch = pa.RecordBatch.from_pydict({"text": texts[:20]})
        codes = np.concatenate([c for _, _, c, _ in ppm_language._codes(batch, 0, order)])
        code, n = np.unique(codes, return_counts=True)
        trees = ppm_language.Trees(["x"], [ppm_language.Tree(code, n, order)], order)
        test = pa.RecordBatch.from_pydict({"text": [*texts[20:], None, ""]})
        got = ppm_language.code_lengths(test, 0, trees)[:, 0]
        assert np.allclose(got, [*(brute.ppm_bits(texts[:20], t, order) for t in texts[20:]), 0, 0])
        # after any context the 256 bytes share one unit of probability
        p = 2.0 ** -trees.trees[0].bits((int(codes[5]) >> 8 << 8) | np.arange(256))
        assert p.sum() <= 1 + 1e-9


def test_long_texts_come_in_pieces(monkeypatch):
    """A text in many pieces has the bits of the whole, its bytes in the other languages as well."""
    text = " ".join(f"wörd{i % 37} {'x' * (i % 50)}" for i in range(400))
    batch = pa.RecordBatch.from_pydict({"text": ["short one", text, None, text[:77]]})
    whole = [c for _, _, c, _ in ppm_language._codes(batch, 0, 3)]
    monkeypatch.setattr(common.text_pieces, "__defaults__", (300,))
    pieces = [c for _, _, c, _ in ppm_language._codes(batch, 0, 3)]
    assert len(pieces) > 10 > len(whole) and (np.concatenate(pieces) == np.concatenate(whole)).all()


def test_languages_share_no_bound(spark):
    """Twice as many languages leave order, bytes and code lengths as they are."""
    rows = [(i, " ".join(f"{chr(97 + i % 8 * 3)}{chr(0x430 + i % 16)}{k % 7}" for k in range(30)), f"l{i % 16:02}") for i in range(160)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    half, whole = (ppm_language.train(x) for x in (df.where("lang < 'l08'"), df))
    batch = pa.RecordBatch.from_pydict({"text": [t for _, t, _ in rows]})
    assert len(whole.languages) == 16 and whole.order == half.order
    assert np.allclose(ppm_language.code_lengths(batch, 0, whole)[:, :8], ppm_language.code_lengths(batch, 0, half))


# 8


def test_language_model(spark, sf, odd, docs):
    got = {r.doc_id: r for r in catalogue.QUERIES["op8_attention_lm"](spark, sf).collect()}
    for d, (n, known, train, base) in brute.unigram([(r.doc_id, r.text) for r in docs]).items():
        r = got[d]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, train) and abs(r.base_score - base) < 1e-6 * abs(base) and r.score < 0
    out = attention_lm.score_texts(odd, F.lit(True), attention_lm.default_ranks(), head_words=5).collect()
    assert len(out) == len(ROWS) and {r.n_tokens for r in out if r.doc_id in (3, 4, 6)} == {1}
    assert len({(r.score, r.base_score) for r in out if r.doc_id == 5}) == 1
    assert attention_lm.score_texts(empty(spark), F.lit(True), attention_lm.default_ranks()).count() == 0
    assert {r.train_tokens for r in attention_lm.score_texts(odd, F.lit(False), attention_lm.default_ranks()).collect()} == {0}


def small_model(rng, ids=30, texts=20):
    seqs = [rng.integers(0, ids, n) for n in (1, 15, 16, 17, 60)] + [np.zeros(0, np.int64)]
    counts = np.zeros(attention_lm.PAD + 1)
    counts[: ids - 2] = rng.integers(1, 9, ids - 2)  # two ids have no count
    counts[ids] = 5
    return attention_lm.start([s[s < ids - 2] for s in seqs] * texts, counts, ids, passes=1), seqs


def plain_log10(m, s, end):
    """The model's score id by id, without batches: masked attention over the block of the id and the one before."""
    line, total, n = [end, *s.tolist()], 0.0, attention_lm.BLOCK
    for t, goal in enumerate([*s.tolist(), end]):
        first = (t // n - 1) * n
        seen = range(max(first, 0), t + 1)
        c = [int(m.compact[line[i]]) for i in seen]
        q = (m.query[c[-1]] + m.query_place[t % n]).astype(float)
        a = np.exp([q @ (m.key[x] + m.key_place[i - first]) + m.key_bias[x] for i, x in zip(seen, c, strict=True)])
        hidden = np.maximum(m.own[c[-1]] + (a / a.sum()) @ m.value[c], 0)
        g = int(m.compact[goal])
        z = np.exp(hidden @ m.class_out + m.class_bias)
        k = m.class_of[g]
        y = np.exp(m.within[m.bounds[k] : m.bounds[k + 1]] @ hidden + m.within_bias[m.bounds[k] : m.bounds[k + 1]])
        p = z[k] / z.sum() * y[m.place[g] - m.bounds[k]] / y.sum()
        total += np.log10(p) - (m.log_others / np.log(10) if g == m.other else 0)
    return total


def test_scores_against_a_plain_version():
    rng = np.random.default_rng(0)
    m, seqs = small_model(rng)
    together, alone = m.log10(seqs, 30), np.array([m.log10([s], 30)[0] for s in seqs])
    expected = [plain_log10(m, s, 30) for s in seqs]
    assert np.allclose(together, alone, rtol=1e-4) and np.allclose(together, expected, rtol=1e-4) and (together < 0).all()
    long = rng.integers(0, 30, 700)
    pieces = [(w, t) for w, t in attention_lm.windows(long, 30, 3)]
    whole = next(attention_lm.windows(long, 30, None))
    assert all((np.concatenate([p[k] for p in pieces]) == whole[k]).all() for k in (0, 1))
    # all ids together, those without a count too, have the probability 1
    h = attention_lm.forward(m, m.compact[whole[0][:1]])[-1][:1]
    every = m.compact[np.arange(31)]
    p = np.exp(m.log_p(np.repeat(h, 31, 0), every) - np.where(every == m.other, m.log_others, 0))
    assert abs(p.sum() - 1) < 1e-4


def test_gradients_by_finite_differences():
    rng = np.random.default_rng(1)
    m, seqs = small_model(rng, texts=4)
    for name in (*attention_lm.BY_ID, *attention_lm.DENSE):
        setattr(m, name, getattr(m, name).astype(np.float64))
    w, t = next(attention_lm.windows(seqs[4], 30, None))
    w, t = m.compact[w], np.where(t >= 0, m.compact[t], -1)
    _, g = attention_lm.gradients(m, w, t)
    for name in (*attention_lm.BY_ID, *attention_lm.DENSE):
        x = getattr(m, name)
        places = [np.unravel_index(i, x.shape) for i in np.argsort(-np.abs(g[name]).reshape(-1))[:3]] + [tuple(rng.integers(0, n) for n in x.shape) for _ in range(5)]
        for at in places:
            old, e = x[at], 1e-5
            x[at] = old + e
            up = attention_lm.gradients(m, w, t)[0]
            x[at] = old - e
            down = attention_lm.gradients(m, w, t)[0]
            x[at] = old
            assert abs((up - down) / (2 * e) - g[name][at]) < 1e-4 * max(1, abs(g[name][at])), name


def test_ids_of_words_are_those_of_the_text(spark, odd):
    """Texts word by word, in pieces and not, have the ids of the whole text."""
    vocabulary = attention_lm.Vocabulary(attention_lm.default_ranks())
    texts = [r[1] or "" for r in ROWS] + ["It's 1,000.50 €  ünï\u00a0x \u2003y\u00a0 z don'T", " a", "\u00a0 \u00a0b c"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc long, text string").select("doc", F.col("doc").alias("key"), "text", F.lit(True).alias("training"))
    head = spark.sparkContext.broadcast((np.zeros(0, np.uint64), np.zeros(0)))
    got = {r.doc: np.frombuffer(r.ids, "<u2").tolist() for r in attention_lm.encoded(rows, spark.sparkContext.broadcast(vocabulary), -7, head).collect()}
    encode = vocabulary.encoder()
    assert got == {i: encode(attention_lm.normal(t)) for i, t in enumerate(texts)}


def test_changes_of_tasks_are_averaged(spark):
    """Several tasks, each with its windows, change the model as the mean of what each does alone; nothing to learn changes nothing."""
    rng = np.random.default_rng(2)
    rows = [(int(rng.integers(0, 1 << 40)), rng.integers(0, 28, 200).astype("<u2").tobytes()) for _ in range(20)]
    ids = spark.createDataFrame(rows, "key long, ids binary")
    before, after, again = (small_model(np.random.default_rng(0))[0] for _ in range(3))
    attention_lm.go_on(after, ids, 30, share=1, task_windows=70)
    attention_lm.go_on(again, ids.repartition(3), 30, share=1, task_windows=70)
    assert np.allclose(after.own, again.own, atol=1e-6) and np.abs(after.own - before.own).max() > 1e-3
    test = [np.frombuffer(x, "<u2").astype(np.int64) for _, x in rows]
    assert after.log10(test, 30).sum() > before.log10(test, 30).sum()
    same = attention_lm.go_on(small_model(np.random.default_rng(0))[0], ids.limit(0), 30)
    assert (same.own == before.own).all()


def test_all_windows_are_learned_from(spark):
    """Every window of every training text moves the model: what one text alone holds is learned too, and the classes see all texts."""
    rows = [(k, np.tile(np.arange(14) + 14 * (k % 2), 40).astype("<u2").tobytes()) for k in range(12)]
    ids = spark.createDataFrame(rows, "key long, ids binary").repartition(3)
    m = small_model(np.random.default_rng(0))[0]
    before = copy.deepcopy(m)
    attention_lm.go_on(m, ids, 30, task_windows=50)
    seen = [np.frombuffer(x, "<u2").astype(np.int64) for _, x in rows[:2]]
    assert (m.log10(seen, 30) > before.log10(seen, 30) + 10).all()
    counts = attention_lm.ids_counted(ids, 30)
    compact, weight, marks = attention_lm.numbered(counts)
    plain = np.zeros(len(weight) * 256)
    for _, x in rows:
        line = compact[[30, *np.frombuffer(x, "<u2"), 30]]
        for a, b in zip(line[:-1], line[1:], strict=True):
            plain[b * 256 + marks[a]] += marks[a] >= 0
            plain[a * 256 + marks[b] + 128] += marks[b] >= 0
    assert (attention_lm.neighbours(ids, counts, 30) == plain).all()


def test_merged_ids_are_the_same_text_in_fewer(spark):
    """Merged pairs stand for the ids of the public vocabulary, in texts of whatever pieces; all ids together have the probability 1."""
    texts = ["Enchung stver der enchung enchungst", "der", "", None, "stverst der \u00dcchung  enchung\tder 1,000 enchung", "qqqqqq qqqqqq qqq"]
    words = attention_lm.normal(" ".join(t or "" for t in texts)).split()
    vocabulary, rounds = attention_lm.Vocabulary(attention_lm.default_ranks()), 4
    vocabulary.merge(words, np.ones(len(words)), 40, rounds)
    assert 0 < vocabulary.n_merges <= 40 and len(vocabulary.merges) <= rounds
    pairs = dict(enumerate([p for table in vocabulary.merges for p in table.tolist()], vocabulary.pad + 1))
    whole = lambda i: [*whole(pairs[i] >> 16), *whole(pairs[i] & 65535)] if i in pairs else [i]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc long, text string").select("doc", F.col("doc").alias("key"), F.coalesce("text", F.lit("")).alias("text"), F.lit(True).alias("training"))
    head = spark.sparkContext.broadcast((np.zeros(0, np.uint64), np.zeros(0)))
    got = {r.doc: np.frombuffer(r.ids, "<u2").tolist() for r in attention_lm.encoded(rows, spark.sparkContext.broadcast(vocabulary), -8, head).collect()}
    encode = vocabulary.encoder()
    assert {i: [k for x in ids for k in whole(x)] for i, ids in got.items()} == {i: encode(attention_lm.normal(t)) for i, t in enumerate(texts)}
    assert sum(map(len, got.values())) < sum(len(encode(attention_lm.normal(t))) for t in texts)
    counts = np.bincount(sum(got.values(), []), minlength=attention_lm.PAD + 1).astype(float)
    counts[vocabulary.end] = len(texts)
    m = attention_lm.start([np.array(x, np.int64) for x in got.values()], counts, vocabulary.end, passes=1, more=vocabulary.n_merges)
    every = m.compact[[i for i in range(vocabulary.pad + 1 + vocabulary.n_merges) if i != vocabulary.pad]]
    h = attention_lm.forward(m, m.compact[next(attention_lm.windows(np.array(got[0]), vocabulary.end, None))[0][:1]])[-1][:1]
    p = np.exp(m.log_p(np.repeat(h, len(every), 0), every).astype(float) - np.where(every == m.other, m.log_others, 0))
    assert abs(p.sum() - 1) < 1e-3
    nothing = attention_lm.Vocabulary(attention_lm.default_ranks())
    nothing.merge([], np.zeros(0))
    assert nothing.n_merges == 0


def test_merges_go_by_the_counts_of_all_training_texts():
    words = ["gamma", "alpha", "\u00e9t\u00e9", "beta"]
    data = np.frombuffer(" ".join(sorted(words)).encode(), np.uint8)
    h = common.hash_runs(data, *common.runs(data, np.array([0, len(data)]), common.NOT_SPACE))[:3]  # all but the last in the head
    order = np.argsort(h)
    got = attention_lm._head_words(["Beta \u00e9t\u00e9", "", "alpha  ALPHA", "gamma delta"], h[order], np.array([7, 8, 9])[order])
    assert dict(zip(got[0], got[1].tolist(), strict=True)) == dict(zip(sorted(words)[:3], [7, 8, 9], strict=True))
    assert attention_lm._head_words([], h[order], np.array([7, 8, 9]))[0] == []


def test_merges_are_learned_from_the_words_of_all_training_texts(spark, monkeypatch):
    """However small the start's sample is, each frequent word of every training text counts, and none of the other texts."""
    rows = [(i, f"word{'abcdefghij'[i % 10]}{'abcd'[i // 10]} Common word{'abcdefghij'[i % 10]}{'abcd'[i // 10]}") for i in range(40)] + [(40, None), (41, "heldout heldout")]
    docs, merged = spark.createDataFrame(rows, "doc_id long, text string").repartition(3), []
    monkeypatch.setattr(attention_lm.Vocabulary, "merge", lambda self, words, counts: merged.append(dict(zip(words, counts.tolist(), strict=True))))
    attention_lm.score_texts(docs, F.col("doc_id") < 41, attention_lm.default_ranks(), sample_texts=1)
    assert merged == [{"common": 40.0, **{f"word{a}{b}": 2.0 for a in "abcdefghij" for b in "abcd"}}]


def test_rows_of_an_id_are_added():
    rng = np.random.default_rng(4)
    for n, ids in ((0, 5), (1, 5), (3000, 7), (3000, 900)):
        at, g = np.minimum(rng.zipf(1.5, n), ids) - 1, rng.normal(size=(n, 3))
        plain = np.zeros((ids, 3))
        np.add.at(plain, at, g)
        rows, sums = attention_lm._by_id(at, g, ids)
        assert (rows == np.unique(at)).all() and np.allclose(sums, plain[rows])


def test_attention_beats_the_base_held_out(spark):
    got = catalogue.QUERIES["op8_attention_lm"](spark, "/root/testdata/sf0.1").where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b"), F.sum("n_tokens").alias("n")).first()
    assert got.s > got.b and got.s / got.n > -4.05


# 9


def test_top_k(spark, sf):
    rng = np.random.default_rng(1)
    vectors = [(i, rng.normal(size=6).tolist()) for i in range(400)] + [(400 + i, [0.5] * 6) for i in range(30)] + [(500, None), (501, [None] * 6), (502, [float("nan")] * 6), (None, [0.1] * 6), (503, [float("inf")] * 6), (504, [1.0])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").withColumn("id", F.lit(1)).withColumn("shard", F.lit(2))
    v = df.select("*", metric_tree.scaled("embedding").alias("v"))
    kept = {i: np.floor(256 * np.array(x)).astype(int) for i, x in vectors if i is not None and x is not None and all(c is not None and np.isfinite(c) for c in x)}
    expected = []
    for q in sorted(kept):
        if q % 20 == 0:
            best = sorted((-int(kept[q] @ x), i) for i, x in kept.items() if i != q and len(x) == len(kept[q]))[:5]
            expected += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    for shard, block in ((10**6, 10**6), (64, 7)):
        got = metric_tree.search(v, F.col("vec_id") % 20 == 0, shard_rows=shard, query_block=block)
        assert sorted(map(tuple, got.collect())) == expected
    assert metric_tree.search(v.limit(0), F.col("vec_id") % 20 == 0).count() == 0


# 10


def test_personal_data(spark, odd):
    texts = ["a@b.c@d.e f_x@g.h.i", "1.2.3.4.5.6.7.8 300.1.2.3.4 001.02.3.0004 1.2.3.99999999999999999999", "4111 1111 1111 1111", "+1+12345678901", "..@a.b-c.d_x@e.f", "1 " * 500, "a@" * 500, "x" * 3000 + "@y.z", None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii_boosting.personal_data(df).collect():
        assert [f"{x.kind}:{x.start}:{x.end}" for x in r.base] == brute.personal(texts[r.doc_id])
    got = {r.doc_id: r for r in pii_boosting.personal_data(odd).collect()}
    for i, text, *_ in ROWS:
        base = [f"{x.kind}:{x.start}:{x.end}" for x in got[i].base]
        assert base == brute.personal(text) and set(base) <= {f"{x.kind}:{x.start}:{x.end}" for x in got[i].spans}
    assert pii_boosting.personal_data(empty(spark)).count() == 0


def test_boosting_finds_neighbours(spark):
    rows = [(i, f"call +1 (2{i % 90 + 10}) 555-{1000 + i} or write, or 10.0.{i % 200}.7 there") for i in range(200)] + [(500, "é +1 (826) 555-4081 190.137.223.204 end")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    r = pii_boosting.personal_data(df).where("doc_id = 500").first()
    assert [(x.kind, x.start, x.end) for x in r.spans] == [("phone", 2, 19), ("ip", 20, 35)] and [x.kind for x in r.base] == ["ip"]
    assert pii_boosting.redact(df).where("doc_id = 500").first().text == "é [PHONE] [IP] end"


def test_trees_as_an_expression_and_as_a_walk(spark, sf):
    """The scores of added spans are what a walk through the trees gives, and no added span touches a base one or another."""
    d = spark.read.parquet(f"{sf}/documents.parquet")
    model = pii_boosting.fit(pii_boosting.forms(pii_boosting.base_spans(d.select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text")))))
    every = pii_boosting.base_spans(d.where("text is not null").select("doc_id", "text")).select("doc_id", *[pii_boosting.proposals(k).alias(f"p_{k}") for k in pii_boosting.WIDE]).collect()
    walked = {(r.doc_id, k, x.start, x.end): 1 / (1 + np.exp(-model.margin(x))) for r in every for k in pii_boosting.WIDE for x in r[f"p_{k}"]}
    assert walked
    for r in pii_boosting.personal_data(d, model=model).collect():
        base = {(x.kind, x.start, x.end) for x in r.base}
        added = [x for x in r.spans if (x.kind, x.start, x.end) not in base]
        for x in added:
            assert abs(walked[r.doc_id, x.kind, x.start, x.end] - x.score) < 1e-9 and x.score >= model.thresholds[x.kind]
            assert not any(y.start < x.end and x.start < y.end for y in [*r.base, *(z for z in added if z != x)])


def test_proposals_beyond_the_base(spark):
    """Forms that no base expression finds: a number without its plus, an address with spaces or words; but no date, price or serial."""
    rows = [(i, f"call +1 (2{i % 90 + 10}) 555-{1000 + i} or write to ann{i}@mail.example.com, on 2024-01-{i % 28 + 10}; 10.0.{i % 200}.7, 12.50 or {i} 000 000") for i in range(300)]
    tests = ["ring (826) 555-4081 x", "ring 1 (826) 555-4081 x", "bob [at] mail [dot] example.com!", "bob @ mail.example.org is it", "on 2024-01-30 at noon. Then", "serial 1704067200000 x", "look at home.There"]
    df = spark.createDataFrame(rows + [(1000 + i, t) for i, t in enumerate(tests)], "doc_id long, text string")
    got = {r.doc_id - 1000: [(x.kind, tests[r.doc_id - 1000][x.start : x.end]) for x in r.spans] for r in pii_boosting.personal_data(df).where("doc_id >= 1000").collect()}
    assert got == {0: [("phone", "(826) 555-4081")], 1: [("phone", "1 (826) 555-4081")], 2: [("email", "bob [at] mail [dot] example.com")], 3: [("email", "bob @ mail.example.org")], 4: [], 5: [], 6: []}


def test_running_sums_and_many_matches(spark):
    values = list(range(1, 400))
    df = spark.createDataFrame([(values, "ab1" * 5000), ([], "")], "v array<int>, t string")
    got = df.select(pii_boosting.running(F.col("v")).alias("r"), pii_boosting.found(F.col("t"), "[0-9]").alias("f")).collect()
    assert got[0].r == np.cumsum(values).tolist() and got[1].r == [] and got[1].f == []
    assert [(x.start, x.end) for x in got[0].f] == [(3 * i + 2, 3 * i + 3) for i in range(5000)]


def test_personal_query(spark, sf, docs):
    got = {r.doc_id: r for r in catalogue.QUERIES["op10_pii_boosting"](spark, sf).collect()}
    for r in docs:
        base = brute.personal(r.text)
        assert got[r.doc_id].base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert got[r.doc_id].n_card == sum(b.startswith("card") for b in base)
