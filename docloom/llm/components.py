"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import cut_alone, cut_at, remove


def components(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """id, component (smallest id reachable) for every id of ``edges`` (a, b: long; a repeated edge does no harm).

    Each round hangs neighbours under smaller ids until the edges are stars; the number of rounds grows with the
    logarithm of the longest path, and an unfinished labelling is an error. Edges never become more, so none are made
    distinct: only the minima of a round are shuffled, and the edges where a join isn't broadcast. A hub's edges are
    folded map-side (min), and the minima are written before the edges are joined with them, so that AQE can split a
    hub's edges. The minima that begin a round tell whether the edges are stars, and then are the labels. A round's
    tables are deleted when the next ones are written.
    """
    return cut_alone(lambda: _labels(edges, most_rounds), "cc-label")


def _labels(edges: DataFrame, most_rounds: int) -> DataFrame:
    spark = edges.sparkSession
    now, path = cut_at(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), "cc")
    for done in range(most_rounds + 1):
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # open: a node under another one that has more neighbours than that
        ends = both.groupBy("u").agg(F.min("v").alias("x"), F.max("v").alias("y"))
        low, low_at = cut_at(ends.select("u", F.least("x", "u").alias("m"), F.expr("x < u AND x <> y").alias("open")), "cc-low")
        if low.filter("open").isEmpty():
            return low.select(F.col("u").alias("id"), F.col("m").alias("component"))
        if done == most_rounds:
            break
        # large star: neighbours greater than u go under the smallest of u and its neighbours
        large, large_at = cut_at(now.join(low.select(F.col("u").alias("v"), "m"), "v").select("u", F.col("m").alias("v")), "cc-large")
        # small star: u and its smaller neighbours go under the smallest of them
        least, least_at = cut_at(large.groupBy("u").agg(F.min("v").alias("m")), "cc-low")
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        gone = [path, low_at, large_at, least_at]
        now, path = cut_at(small.union(least.select("u", F.col("m").alias("v"))), "cc")
        for at in gone:
            remove(spark, at)
    raise RuntimeError(f"components are not stable after {most_rounds} rounds")
