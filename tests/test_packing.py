"""Parallel packing against the plain fold, over block borders."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.operators import packing


def fold(sizes, most, target, rows):
    out, bundle, held, used = [], -1, 0, 0
    for n in sizes:
        n = max(1, n)
        if bundle < 0 or used + n > most or target is not None and used >= target or rows is not None and held >= rows:
            bundle, held, used = bundle + 1, 0, 0
        held, used = held + 1, used + n
        out.append(bundle)
    return out


@pytest.mark.parametrize(("most", "target", "most_rows", "block"), [(46, 36, None, 64), (200, None, 5, 16), (9, 9, None, 10), (30, None, None, 16_384)])
def test_pack(spark, most, target, most_rows, block):
    rng = np.random.default_rng(most)
    data = {g: [int(x) for x in rng.choice([1, 2, 3, 8, 20, 50, 300, 0], n)] for g, n in (("a", 900), ("b", 1), ("c", 70), (None, 130), ("", 64))}
    rows = [(g, i, n) for g, sizes in data.items() for i, n in enumerate(sizes)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(g if g is None else str(g), int(i), int(n)) for g, i, n in rows], "g string, i long, size int").repartition(5)
    out = packing.pack(df, "g", [F.col("i")], "size", most, target, most_rows, block=block if block > min(x for x in (most, target, most_rows) if x) else 64)
    got = {}
    for r in out.collect():
        got.setdefault(r.g, {})[r.i] = r.bundle
        assert r.at == r.i
    assert {g: [v[i] for i in range(len(v))] for g, v in got.items()} == {g: fold(s, most, target, most_rows) for g, s in data.items()}


def test_empty_and_limits(spark):
    none = spark.createDataFrame([], "g string, i long, size int")
    assert packing.pack(none, "g", [F.col("i")], "size", 10).count() == 0
    with pytest.raises(ValueError):
        packing.pack(none, "g", [F.col("i")], "size", 100, block=50)
