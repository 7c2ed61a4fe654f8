"""The pipeline and the registered queries on whole small tables."""

import re
from collections import Counter

import duckdb
import pytest
import tiktoken
from test_operators import brute_components, water_fill

import corpus_pipeline
from docloom.llm import bpe, common, mixing, queries

SF = "/root/testdata/sf0.001"


def test_stages_keep_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, rows = docs.columns, docs.count()
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, SF)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
        if k < 3:
            assert 0 < docs.count() <= rows
    assert docs.count() > 0


def test_stages_equal_brute_force(spark):
    """Every stage's decisions on what its predecessor kept, recomputed in plain Python."""
    tables = [spark.read.parquet(f"{SF}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        # a few rows that only one stage should act on
        tables.append(common.cut(stage(spark, tables[-1], SF), "test-stage"))
    docs, good, exact, near, mixed, tokens = ([r.asDict() for r in t.collect()] for t in tables)
    scores = {r.doc_id: r.score for r in queries.op1_quality(spark, SF).collect()}
    ids = lambda rows: sorted(r["doc_id"] for r in rows)
    assert ids(good) == sorted(i for i, s in scores.items() if s >= 0.3) and len(good) < len(docs)
    first = {}
    for r in sorted(good, key=lambda r: r["doc_id"]):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or ""), r["doc_id"])
    assert ids(exact) == sorted(first.values()) and len(exact) < len(good)
    groups = brute_components([(r["doc_id"], r["text"]) for r in exact])
    assert ids(near) == sorted(i for i, (_, c) in groups.items() if i == c) and len(near) < len(exact)
    played = Counter(ids(mixed))
    assert set(played) <= set(ids(near)) and max(played.values()) <= mixing.MOST
    size = {r["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in near}
    source = {r["doc_id"]: r["source"] for r in near}
    want = water_fill({s: sum(size[i] for i in size if source[i] == s) for s in set(source.values())})
    for s, target in want.items():
        taken = sum(n * size[i] for i, n in played.items() if source[i] == s)
        assert abs(taken - target) <= 3 * max([size[i] for i in size if source[i] == s]) + 0.05 * target
    path, pattern = queries.tokenizer()
    enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    text = {r["doc_id"]: r["text"] or "" for r in docs}
    assert ids(tokens) == ids(mixed) and all(r["ids"] == enc.encode_ordinary(text[r["doc_id"]]) for r in tokens)
    assert ids([r.asDict() for r in corpus_pipeline.run(spark, SF).select("doc_id").collect()]) == ids(tokens)


def test_stages_on_odd_rows(spark):
    """Nulls, empty and repeated rows, clashing columns, and a table without rows go through every stage."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, k long, root string, plays int, digest string"
    rows = [(1, "good text of a few words here", "en", "a", 1), (1, "good text of a few words here", "en", "a", 1), (None, None, None, None, None), (2, "", "en", None, 0), (3, "x " * 50_000, "de", "b", 9), (None, "no id", None, "b", 2)]
    docs = spark.createDataFrame([(*r, 1, "clash", 2, "clash") for r in rows], schema)
    for table in (docs, docs.limit(0)):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES[1:]):
            before = table.count()
            table = common.cut(stage(spark, table, SF), "test-odd")
            assert table.columns == docs.columns or k == 3
            assert table.count() <= before * (3 if k == 2 else 1)


def test_pipeline_ends_with_token_ids(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(20)
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert len(rows) == 20 and all(len(r.ids) == r.n_tokens for r in rows) and any(r.n_tokens for r in rows)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cursor = con.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    want = sorted(str([round(x, 6) if isinstance(x, float) else x for x in r]) for r in cursor.fetchall())
    out = queries.queries()[name](spark, SF).select(columns)
    assert sorted(str([round(x, 6) if isinstance(x, float) else x for x in r]) for r in out.collect()) == want
