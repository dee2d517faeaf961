"""The pipeline, stage by stage, against plain versions."""

import duckdb
from pyspark.sql import functions as F

import corpus_pipeline
from roadloom.llm import catalogue
from tests.llm import brute


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    known = corpus_pipeline.language_id(spark, docs, sf)
    assert known.columns == columns and known.count() == docs.where(r"text rlike '\\p{L}'").count()
    rows = sorted((r.doc_id, r.text) for r in known.collect())
    gone = brute.removed_lines(rows)
    lines = corpus_pipeline.line_dedup(spark, known, sf)
    assert lines.columns == columns
    got = sorted((r.doc_id, r.text, r.n_chars) for r in lines.collect())
    kept = [(d, "\n".join(x for p, x in enumerate(t.split("\n")) if p not in set(gone[d]))) for d, t in rows]
    assert [(d, t) for d, t, _ in got] == kept and all(n == len(t) for _, t, n in got)
    apart = corpus_pipeline.jaccard_join(spark, spark.createDataFrame(lines.collect(), lines.schema), sf)
    component = brute.components(kept, 5, 80)
    left = [(d, t) for d, t in kept if component[d][1] == d]
    assert apart.columns == columns and sorted((r.doc_id, r.text) for r in apart.collect()) == left
    clean = corpus_pipeline.decontamination(spark, apart, sf)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    ids = [e[0] for e in brute.contamination(left, items) if not e[5]]
    assert clean.columns == columns and sorted(r.doc_id for r in clean.collect()) == ids
    run = corpus_pipeline.run(spark, sf)
    assert sorted((r.doc_id, r.decoded) for r in run.select("doc_id", "decoded").collect()) == [(d, t) for d, t in left if d in set(ids)]


def test_near_copies_are_decided_by_row(spark):
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(30))
    rows = [(1, text(1)), (1, text(1)), (2, text(2)), (3, text(1)), (3, text(3)), (None, text(2)), (None, text(4)), (None, text(4)), (5, ""), (5, ""), (6, None), (7, text(7)), (7, text(7) + " more")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [(r.doc_id, r.text) for r in corpus_pipeline.jaccard_join(spark, df, "").collect()]
    sure = [(1, text(1)), (2, text(2)), (3, text(3)), (None, text(4)), (5, ""), (6, None)]
    assert sorted(map(str, (r for r in got if r[0] != 7))) == sorted(map(str, sure))
    assert len([r for r in got if r[0] == 7]) == 1


def test_a_stage_takes_an_empty_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        assert docs.count() == 0


def test_sql(spark, sf):
    c = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    for name, sql in catalogue.ORACLE_SQL.items():
        df = catalogue.QUERIES[name](spark, sf)
        cursor = c.execute(sql)
        names = [d[0] for d in cursor.description]
        assert sorted(names) == sorted(df.columns)
        assert sorted(map(tuple, df.select(*names).collect())) == sorted(cursor.fetchall()), name


def test_every_operator_has_a_query():
    assert [n.split("_")[0] for n in catalogue.QUERIES] == [f"op{i}" for i in range(1, 14)]


def test_stages_on_odd_rows(spark, sf):
    """Nulls in any column, empty and very long texts, rows that repeat, and columns with names that the operators use inside."""
    long = " ".join(f"word{i % 997}x{i % 31}." for i in range(40_000))
    line = "A line that stands in many documents, to the letter"
    rows = [
        (1, f"First text of all, in plain words.\n{line}", "en", "a", 3), (2, f"Second text, of other plain words.\n{line}", None, None, None), (None, "A text without an id, in plain words too.", "en", "a", 1), (None, None, None, None, None),
        (3, None, "en", "a", 0), (4, "", "en", "a", 0), (5, long, "en", "b", len(long)), (5, long, "en", "b", len(long)), (6, "1 2 3", "en", "a", 5), (7, f"{line}\n\n \n{line}", "en", "a", 9),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    for name in ("key", "doc", "h", "score", "gone", "later", "own", "cls", "line", "row", "place", "n", "word"):
        docs = docs.withColumn(name, F.lit("x"))
    docs = docs.repartition(3)
    seen = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, seen[-1], sf)
        assert out.columns == docs.columns and {r.key for r in out.collect()} <= {"x"}
        seen.append(out.checkpoint())
    texts = [sorted(str(r.text) for r in s.collect()) for s in seen]
    letters = [r[1] for r in rows if r[1] and any(c.isalpha() for c in r[1])]
    assert texts[1] == sorted(letters)
    # null ids come first: of the copied line the first one in the order of ids stays
    assert sorted(str(r.text).count(line) for r in seen[2].collect()) == [0] * 5 + [1]
    assert texts[3].count(long) == 1 and len(texts[3]) == len(set(texts[2]))
    assert texts[4] == texts[3]
    last = corpus_pipeline.STAGES[-1][1](spark, seen[-1], sf)
    assert sorted(r.decoded for r in last.collect()) == texts[4]
