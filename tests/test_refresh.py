"""Touched partitions are replaced, others stay as files; what went and came is returned."""

import os

from docloom.operators import refresh


def test_refresh(spark, tmp_path):
    path, schema = str(tmp_path / "t"), "id long, v string, part string"
    frame = lambda rows: spark.createDataFrame(rows, schema)
    refresh.store(frame([(1, "a", "x"), (2, "b", "x"), (3, "c", "y"), (4, "d", "z")]), path, "part")
    before = set(os.listdir(f"{path}/part=y"))
    new = frame([(1, "a", "x"), (2, "changed", "x"), (5, "e", "w")])
    out = refresh.refresh(path, schema, "part", spark.createDataFrame([("x",), ("z",), ("w",), ("x",)], "part string"), lambda t: new, ["id", "v"])
    assert sorted(map(tuple, out.collect())) == [(2, "b", "gone"), (2, "changed", "new"), (4, "d", "gone"), (5, "e", "new")]
    assert sorted((r.id, r.v, r.part) for r in spark.read.schema(schema).parquet(path).collect()) == [(1, "a", "x"), (2, "changed", "x"), (3, "c", "y"), (5, "e", "w")]
    assert set(os.listdir(f"{path}/part=y")) == before and not os.path.exists(f"{path}/part=z")
