"""Streams with availableNow give what the batch form gives."""

from pyspark.sql import functions as F

from docloom.sources import carriers as C
from docloom.streaming import jobs, store

SF = "/root/testdata/sf0.001"


def feed(spark, tmp_path, frame, files=3):
    path = str(tmp_path / "in")
    frame.repartition(files).write.parquet(path)
    return spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(path)


def run(stream, name, tmp_path, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)


def events(spark):
    return C.runs(spark, SF).selectExpr("query_id", "failure_code", "kb", "user_id AS job", "status AS phase", "k", "timestamp_seconds(created_at) AS ts")


def test_failures_once(spark, tmp_path):
    e = events(spark)
    got = run(jobs.failures_once(feed(spark, tmp_path, e, 1), "60 days"), "failures", tmp_path)
    want = e.filter("failure_code <> ''").select("query_id", "failure_code").distinct()
    assert got.count() == want.count()


def test_job_versions(spark, tmp_path):
    e = events(spark)
    got = run(jobs.job_versions(feed(spark, tmp_path, e, 1).select("job", "phase", "k", "ts")), "versions", tmp_path)
    rows = sorted((r.job, r.ts, r.k, r.phase) for r in e.collect())
    want, last = 0, {}
    for job, _, k, phase in rows:
        now = (phase, k // 10)
        want += last.get(job) != now
        last[job] = now
    assert got.count() == want


def test_index_store(spark, tmp_path):
    """Random batches with deletions, late versions and repeats: the store reads as the plain dictionary, with few generations."""
    import random

    rnd = random.Random(3)
    s, want = store.Store(spark, str(tmp_path / "store"), "id", "version"), {}
    assert s.read() is None and s.generations() == []
    for batch in range(9):
        rows = [(i, rnd.randint(0, 20), f"t{batch}-{i}", rnd.random() < 0.3) for i in rnd.sample(range(60), 25)] + [(1, 5, "a", False), (1, 5, None, True), (1, 4, "c", False)] * (batch == 4)
        frame = spark.createDataFrame(rows, "id long, version int, text string, deleted boolean")
        s.apply(frame, batch, lambda x: x.withColumn("n", F.length("text")))
        if batch % 3 == 0:
            s.apply(frame, batch)  # repeated after a failure
        last = {}
        for i, v, text, gone in rows:
            if i not in last or (v, gone) > last[i][:2]:
                last[i] = (v, gone, text)
        for i, (v, gone, text) in last.items():
            if i not in want or v >= want[i][0]:
                want[i] = (v, gone, text)
        got = {r.id: (r.version, r.text, r.n) for r in s.read().collect()}
        assert got == {i: (v, text, len(text)) for i, (v, gone, text) in want.items() if not gone}
        assert len(s.generations()) <= store.FAN
    assert s.vacuum() and s.vacuum() == [] and s.read().count() == len(got)
    assert [g.low for g in s.generations()][0] == 0 and s.generations()[-1].high == 8


def test_settled_tombstones_go(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "FAN", 1)
    s = store.Store(spark, str(tmp_path / "store"), "id", "version")
    for batch in range(7):
        rows = [(i, batch, "x", batch % 2 == 1 and i < 5) for i in range(10)]
        s.apply(spark.createDataFrame(rows, "id long, version int, text string, deleted boolean"), batch, settled=batch)
    assert {r.id for r in s.read().collect()} == set(range(10))
    s.apply(spark.createDataFrame([(i, 9, None, True) for i in range(4)], "id long, version int, text string, deleted boolean"), 7, settled=100)
    s.apply(spark.createDataFrame([(50, 9, "y", False)], "id long, version int, text string, deleted boolean"), 8, settled=100)
    assert {r.id for r in s.read().collect()} == {*range(4, 10), 50} and [g.rows for g in s.generations()] == [7]
