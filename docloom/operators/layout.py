"""Page layout: pairing of two columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def pair_columns(left: DataFrame, right: DataFrame, page: str, tolerance: float) -> DataFrame:
    """page, lid, rid: each left term takes the right lines from its height up to the next term's, both less a tolerance.

    An as-of join: both columns are sorted together by height and the last left term so far is carried along, so no pair is tried twice.
    """
    w = W.partitionBy(page).orderBy("h", "side", "n").rowsBetween(W.unboundedPreceding, 0)
    rows = left.select(page, (F.col("y") - tolerance).alias("h"), F.lit(0).alias("side"), F.col("lid").alias("n")).unionByName(right.select(page, F.col("y").alias("h"), F.lit(1).alias("side"), F.col("rid").alias("n")))
    carried = F.last(F.when(F.col("side") == 0, F.col("n")), ignorenulls=True).over(w)
    return rows.withColumn("lid", carried).filter("side = 1 AND lid IS NOT NULL").select(page, "lid", F.col("n").alias("rid"))
