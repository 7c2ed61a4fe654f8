"""Tuning of the fact weight and the least confidence: components are scored once, each setting ranks them anew."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# fixed values: weights and confidences that are tried
WEIGHTS, CONFIDENCES = (0.10, 0.18, 0.26, 0.34), (0.55, 0.62, 0.70)


def settings(spark, weights: tuple[float, ...] = WEIGHTS, confidences: tuple[float, ...] = CONFIDENCES) -> DataFrame:
    """no, weight, confidence: every pair."""
    pairs = [(i, w, c) for i, (w, c) in enumerate((w, c) for w in weights for c in confidences)]
    if not pairs or any(not 0 <= x <= 1 for _, w, c in pairs for x in (w, c)):
        raise ValueError("weights and confidences lie between 0 and 1, one of each at least")
    return spark.createDataFrame(pairs, "no int, weight double, confidence double")


def ranks(base: DataFrame, facts: DataFrame, tried: DataFrame, used_weight: float, fact_limit: int = 20, top_k: int = 5) -> DataFrame:
    """no, query_id, id, rank: the best ``top_k`` of each question under each setting.

    base: query_id, id, score (with the facts of the lowest confidence at ``used_weight``), ontology (that score of the facts), own (found
    without facts), uploaded_at. facts: query_id, id, fact_id, score, confidence, status, of the lowest confidence; a setting takes the best
    ``fact_limit`` of a question among those that it allows.
    """
    allowed = facts.join(F.broadcast(tried), (facts["status"] == "published") | (facts["confidence"] >= tried["confidence"])).select("no", "query_id", "id", "fact_id", "score")
    best = F.row_number().over(W.partitionBy("no", "query_id").orderBy(F.desc("score"), F.desc("fact_id")))
    scores = allowed.withColumn("n", best).filter(F.col("n") <= fact_limit).groupBy("no", "query_id", "id").agg(F.max("score").alias("now"))
    rows = base.join(F.broadcast(tried.select("no", "weight"))).join(scores, ["no", "query_id", "id"], "left").na.fill(0.0, ["now"])  # a row for each setting, a dozen
    rows = rows.filter(F.col("own") | (F.col("now") > 0))
    score = F.round(F.col("score") - used_weight * F.col("ontology") + F.col("weight") * F.col("now"), 6)
    rank = F.row_number().over(W.partitionBy("no", "query_id").orderBy(F.desc("new"), F.desc("uploaded_at"), F.desc("id")))
    return rows.withColumn("new", score).withColumn("rank", rank).filter(F.col("rank") <= top_k).select("no", "query_id", "id", "rank")


def compare(ranked: DataFrame, expected: DataFrame, tried: DataFrame) -> DataFrame:
    """no, weight, confidence, recall_at_1, recall_at_3, mrr, best: metrics of each setting over the questions with an answer (query_id, expected: ids).

    best: the highest recall among three, then reciprocal rank; of equals the lowest weight, then the highest confidence.
    """
    asked = expected.filter(F.size("expected") > 0)
    hit = ranked.join(asked, "query_id").filter(F.array_contains("expected", F.col("id"))).groupBy("no", "query_id").agg(F.min("rank").alias("rank"))
    n = asked.agg(F.greatest(F.count(F.lit(1)), F.lit(1)).alias("n"))
    sums = hit.groupBy("no").agg(F.count_if(F.col("rank") == 1).alias("r1"), F.count_if(F.col("rank") <= 3).alias("r3"), F.sum(1 / F.col("rank")).alias("rr"))
    rate = lambda c: F.round(F.coalesce(F.col(c), F.lit(0)) / F.col("n"), 6)
    out = tried.join(sums, "no", "left").join(F.broadcast(n)).select("no", "weight", "confidence", rate("r1").alias("recall_at_1"), rate("r3").alias("recall_at_3"), rate("rr").alias("mrr"))
    first = F.row_number().over(W.orderBy(F.desc("recall_at_3"), F.desc("mrr"), "weight", F.desc("confidence")))  # a row for each setting
    return out.withColumn("best", first == 1)
