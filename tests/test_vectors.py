"""The stored vector index against exact scores."""

import numpy as np

from docloom.operators import vectors as V


def data(spark, n=1500, d=16):
    rng = np.random.default_rng(4)
    centres = rng.normal(0, 1, (30, d))
    v = centres[rng.integers(30, size=n)] + rng.normal(0, 0.3, (n, d))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    rows = [(i, x.tolist(), d) for i, x in enumerate(v)] + [(5000 + i, [1.0, float(i)], 2) for i in range(4)] + [(9000, None, 16), (9001, [1.0, None], 2), (9002, [1.0], 16)]
    return v, spark.createDataFrame(rows, "id long, v array<double>, dim int").repartition(4)


def test_recall_and_reads(spark):
    v, df = data(spark)
    index = V.build(df)
    probes = V.calibrate(spark, index, 20, 0.97, 64)
    assert 1 <= probes < len(index.centres[16]) // 2
    asked = df.filter("id % 50 = 0 AND dim = 16 AND v IS NOT NULL").withColumnRenamed("id", "query_id")
    got = {}
    for r in V.search(index, asked, 20, probes, block=7).collect():
        got.setdefault(r.query_id, set()).add(r.id)
    hits = sum(len(set(np.argsort(-(v @ v[q]), kind="stable")[:20].tolist()) & ids) for q, ids in got.items())
    assert len(got) == 30 and hits >= 0.9 * 30 * 20
    read = V.vectors_read(index, asked, probes).collect()
    assert sum(r.read for r in read) < 0.5 * sum(r.rows for r in read)
    # all lists: exact
    every = {(r.query_id, r.id) for r in V.search(index, asked, 20, 10_000).collect()}
    assert every == {(q, i) for q in got for i in np.argsort(-(v @ v[q]), kind="stable")[:20].tolist()}
    # every vector that can be compared is in some list, and the index opens anew
    again = V.VectorIndex.load(spark, index.path)
    assert again.rows(spark).count() == 1504 and all((again.centres[d] == m).all() for d, m in index.centres.items())
    assert V.search(again, spark.createDataFrame([(1, [0.0, 1.0], 2), (2, [1.0] * 3, 3)], "query_id long, v array<double>, dim int"), 2, 9).count() == 2


def test_empty(spark):
    index = V.build(data(spark)[1].limit(0))
    assert index.centres == {} and V.search(index, spark.createDataFrame([(1, [0.0, 1.0], 2)], "query_id long, v array<double>, dim int"), 2, 9).count() == 0
