"""The neighbours' vote against one loop over all labelled vectors, held-out accuracy, and odd tables."""

import numpy as np
import pytest

from docloom.llm import common, quality, queries

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, y int, score string, predicted long"


def counts(texts):
    import pyarrow as pa

    return quality.term_counts(*common.utf8(pa.array(texts)))


@pytest.fixture(scope="module")
def model(spark):
    return queries.quality_model(spark, SF)


def test_votes_equal_brute_force(spark, model):
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").limit(200).collect()]
    c = counts(texts)
    got = model.score(c)
    for row, s in zip(c, got, strict=True):
        z = quality.weighted(row[None, :].copy(), model.idf)[0] @ model.v
        z = z / np.linalg.norm(z)
        near = sorted(((float(z @ v), float(y)) for v, y in zip(model.vectors, model.labels, strict=True)), reverse=True)[: quality.NEIGHBOURS]
        w = [max(0.0, min(1.0, a)) ** quality.POWER for a, _ in near]
        assert s == pytest.approx(sum(a * y for a, (_, y) in zip(w, near, strict=True)) / sum(w), abs=1e-3)


def test_held_out_accuracy(spark):
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = [r for r in queries.op1_quality(spark, SF).collect() if r.held_out and r.doc_id in truth]
    assert len(rows) > 50 and sum(r.predicted == truth[r.doc_id] for r in rows) >= 0.97 * len(rows)


def test_ties_repeats_and_empty_tables(spark, model):
    rows = [(1, "same words here.", "en", 1, "s", 0)] * 3 + [(None, None, None, None, None, None), (2, "", "en", 0, "", 1), (3, "word " * 300_000, "en", 0, "", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    out = [(r.doc_id, r.score, r.predicted) for r in quality.score(docs, model).collect()]
    assert len(out) == 6 and len({o for o in out if o[0] == 1}) == 1 and all(0 <= s <= 1 and p == (s >= 0.3) for _, s, p in out)
    assert quality.score(docs.limit(0), model).count() == 0 and quality.keep_good(docs.limit(0), model).count() == 0
    # equal texts with unlike labels: the vote of equal cosines is the share of label 1
    tie = spark.createDataFrame([(i, "same words here.", "en", 1, "s", 0) for i in range(4)], SCHEMA)
    labels = spark.createDataFrame([(0, 1), (1, 0), (2, 1), (3, 0), (3, None)], "doc_id long, quality int")
    assert {round(r.score, 6) for r in quality.score(tie, quality.fit(tie, labels)).collect()} == {0.5}
    nothing = quality.fit(docs.limit(0), labels)
    assert {r.score for r in quality.score(tie, nothing).collect()} == {0.5}
