"""Lanes: the stream over several runs from one checkpoint gives what whole histories give."""

from collections import Counter

from pyspark.sql import functions as F

from docloom.plans import pages
from docloom.streaming import lanes

SF = "/root/testdata/sf0.001"


def test_stream_restarts_where_it_stopped(spark, tmp_path):
    e = pages.lane_events(spark, SF).cache()
    bounds = e.agg(F.percentile_approx("at", [0.3, 0.6])).first()[0]
    given, out, checkpoint = (str(tmp_path / n) for n in ("given", "out", "checkpoint"))
    low = -1
    for high in [*bounds, 1 << 40]:
        e.filter((F.col("at") > low) & (F.col("at") <= high)).coalesce(2).write.mode("append").parquet(given)
        lanes.run_once(spark.readStream.schema(e.schema).parquet(given), out, checkpoint, 3, 20_000)  # a new query each time
        low = high
    got = Counter(map(tuple, spark.read.schema(lanes.OUT).parquet(out).collect()))
    want = Counter(map(tuple, lanes.replay(e, 3, 20_000, e.agg(F.max("at")).first()[0]).collect()))
    assert got == want
    codes = {(s, c) for *_, s, c, _ in got}
    assert {("queued", ""), ("error", "queue_full"), ("processing", ""), ("success", ""), ("error", "failed"), ("cancelled", ""), ("error", "stalled")} <= codes


def test_lane_by_hand():
    lane = lanes.Lane(2, 100)
    events = [(1, "submit", 0), (2, "submit", 1), (3, "submit", 2), (4, "take", 3), (5, "cancel", 4), (6, "cancel", 5), (7, "restart", 6), (8, "take", 7), (9, "submit", 8), (10, "finish", 107), (11, "take", 108), (12, "fail", 109), (13, "take", 110)]
    said = [c for job, action, at in events for c in lane.step(job, action, at)]
    assert said == [
        (1, 1, "queued", "", 0), (2, 1, "queued", "", 1), (3, 1, "error", "queue_full", 2), (1, 2, "processing", "", 3), (2, 2, "cancelled", "", 4), (1, 3, "cancelling", "", 5), (1, 4, "queued", "recovered", 6), (1, 5, "processing", "", 7),
        (9, 1, "queued", "", 8), (1, 6, "error", "stalled", 107), (9, 2, "processing", "", 108), (9, 3, "error", "failed", 109),
    ]
    full = lanes.Lane(1, 100, [(5, 1)], [(1, 2, 0), (2, 2, 0)])
    assert list(full.step(9, "restart", 1)) == [(1, 3, "error", "requeue_full", 1), (2, 3, "error", "requeue_full", 1)] and full.queue == [(5, 1)] and full.running == []
