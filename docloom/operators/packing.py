"""Greedy packing of ordered rows into bundles, in parallel within a group.

A bundle takes rows in order until a limit; the next one starts after it, so where a bundle starts depends on all rows
before. But where it ends depends on its first row alone. So every row gets its position and the sum before it (from
sums of range partitions), rows go in blocks of positions with a few rows of the next block, each block works out
where a chain that enters at any of its first rows leaves it, these few rows per block are chained by pointer
doubling, and a second pass through the blocks follows the one chain that begins at the group's first row. No task holds a group.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.tables import cut

#: Rows of a block.
BLOCK = 16_384


def positions(rows: DataFrame, group: str, order: list[Column], size: str) -> DataFrame:
    """rows with at (position in the group from 0) and before (sum of size of the rows before it). order: a total order within a group."""
    spark = rows.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = cut(rows.repartitionByRange(parts, F.col(group), *order).sortWithinPartitions(F.col(group), *order).withColumn("__part", F.spark_partition_id()), "pack-sorted")
    sums = dealt.groupBy(group, "__part").agg(F.count(F.lit(1)).alias("__rows"), F.sum(size).alias("__size"))
    earlier = W.partitionBy(group).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)  # a row for each partition
    sums = sums.select(F.col(group).alias("__g"), F.col("__part").alias("__p"), *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(c) for c in ("__rows", "__size")])
    own = W.partitionBy(group, "__part").orderBy(*order)
    out = dealt.withColumn("__i", F.row_number().over(own) - 1).withColumn("__s", F.coalesce(F.sum(size).over(own.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    out = out.join(F.broadcast(sums), F.col(group).eqNullSafe(F.col("__g")) & (F.col("__part") == F.col("__p")))  # partitions and groups, not rows
    return out.withColumn("at", (F.col("__i") + F.col("__rows")).cast("long")).withColumn("before", (F.col("__s") + F.col("__size")).cast("long")).select(*rows.columns, "at", "before")


def next_starts(before: np.ndarray, size: np.ndarray, most: int, target: int | None, rows: int | None) -> np.ndarray:
    """For each row the row at which the next bundle starts if one starts here: after ``rows`` rows, once the sum reaches ``target``, or before it exceeds ``most``."""
    ends = np.append(before, before[-1] + size[-1])
    at = np.arange(len(before))
    out = np.maximum(np.searchsorted(ends, before + most, "right") - 1, at + 1)
    if target is not None:
        out = np.minimum(out, np.searchsorted(ends, before + target, "left"))
    if rows is not None:
        out = np.minimum(out, at + rows)
    return np.minimum(out, len(before))


def pack(rows: DataFrame, group: str, order: list[Column], size: str, most: int, target: int | None = None, most_rows: int | None = None, block: int = BLOCK) -> DataFrame:
    """rows with bundle (from 0 in each group). Rows of a size below 1 count as 1; a row larger than ``most`` is a bundle of its own."""
    reach = min(x for x in (most, target, most_rows) if x is not None)  # a bundle has at most so many rows
    if block <= reach:
        raise ValueError("a block must hold more rows than a bundle")
    kept = rows.columns
    at = cut(positions(rows.withColumn("__n", F.greatest(F.col(size), F.lit(1)).cast("long")), group, order, "__n"), "pack-positions")
    name = F.when(F.col(group).isNull(), "").otherwise(F.concat(F.lit("="), F.col(group).cast("string")))
    slim = at.select(name.alias("g"), "at", "before", F.col("__n").alias("n"))
    slim = slim.withColumn("block", F.explode(F.when((F.col("at") % block < reach) & (F.col("at") >= block), F.array(F.floor(F.col("at") / block), F.floor(F.col("at") / block) - 1)).otherwise(F.array(F.floor(F.col("at") / block)))))

    def chain(pdf: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray, int]:
        pdf = pdf.sort_values("at")
        to = next_starts(pdf["before"].to_numpy(), pdf["n"].to_numpy(), most, target, most_rows)
        return pdf, to, int((pdf["at"] // block == pdf["block"]).sum())

    def exits(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, out, own = chain(pdf)
        while (inside := np.flatnonzero(out < own)).size:  # doubles the steps of each chain
            out[inside] = out[out[inside]]
        first = int(pdf["at"].iloc[0])
        entries = min(reach, own)
        return pd.DataFrame({"g": pdf["g"].iloc[0], "at": np.arange(entries) + first, "to": out[:entries] + first})

    held = slim.repartition("g", "block")
    edges = cut(held.groupBy("g", "block").applyInPandas(exits, "g string, at long, to long"), "pack-edges")
    reached = edges.filter("at = 0").select("g", "at")
    edges = cut(edges.join(edges.select("g", F.col("at").alias("to")), ["g", "to"], "left_semi"), "pack-edges")  # those that lead to a block
    while not edges.isEmpty():
        reached = cut(reached.unionByName(reached.join(edges, ["g", "at"]).select("g", F.col("to").alias("at"))), "pack-reached")
        # twice as far
        edges = cut(edges.join(edges.select("g", F.col("at").alias("to"), F.col("to").alias("far")), ["g", "to"]).select("g", "at", F.col("far").alias("to")), "pack-edges")
    entries = reached.select("g", F.floor(F.col("at") / block).alias("block"), F.col("at").alias("entry"))

    def starts(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, to, own = chain(pdf)
        first = int(pdf["at"].iloc[0])
        marks, i = np.zeros(own, np.int64), int(pdf["entry"].iloc[0]) - first
        while i < own:
            marks[i] = 1
            i = int(to[i])
        return pd.DataFrame({"g": pdf["g"].iloc[0], "block": pdf["block"].iloc[0], "at": pdf["at"].to_numpy()[:own], "nth": np.cumsum(marks)})

    found = held.join(entries, ["g", "block"]).select("g", "block", "at", "before", "n", "entry")
    found = cut(found.groupBy("g", "block").applyInPandas(starts, "g string, block long, at long, nth long"), "pack-starts")
    counts = found.groupBy("g", "block").agg(F.max("nth").alias("c"))
    counts = counts.select("g", "block", F.coalesce(F.sum("c").over(W.partitionBy("g").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("c"))  # a row for each block
    found = found.join(counts, ["g", "block"]).select(F.col("g").alias("__g"), F.col("at").alias("__at"), (F.col("c") + F.col("nth") - 1).alias("bundle"))
    return at.join(found, (name == F.col("__g")) & (F.col("at") == F.col("__at"))).select(*kept, "at", "bundle")
