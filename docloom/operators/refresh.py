"""Derived tables that are made anew group by group: only the partitions that a change touches are written, and what went and came is returned."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators import ingest
from docloom.tables import cut


def _drop(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def store(rows: DataFrame, path: str, part: str) -> None:
    """The table at path, a folder for each value of part; a large one is dealt over several tasks."""
    rows.hint("rebalance", part).write.mode("overwrite").partitionBy(part).parquet(path)


def refresh(path: str, schema: str, part: str, touched: DataFrame, make: Callable[[DataFrame], DataFrame], key: list[str]) -> DataFrame:
    """Replace the touched partitions (distinct values in column part) of the table at path by what make(touched) gives; others aren't read or written.

    Result: key and change ('gone' or 'new') of the rows that differ. make gives rows of the schema for the touched values only; a touched value
    without rows loses its partition. The old rows are cut before anything is written, so a run that fails in between can be repeated.
    """
    spark = touched.sparkSession
    touched = cut(touched.distinct(), "refresh-touched")
    old = cut(spark.read.schema(schema).parquet(path).join(F.broadcast(touched), part).select(*key), "refresh-old")
    new = cut(make(touched), "refresh-new")
    new.hint("rebalance", part).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(part).parquet(path)
    for r in touched.join(new.select(part), part, "left_anti").toLocalIterator():  # values, not rows
        _drop(spark, f"{path}/{part}={r[0]}")
    gone = old.join(new.select(*key), key, "left_anti").withColumn("change", F.lit("gone"))
    return gone.unionByName(new.select(*key).join(old, key, "left_anti").withColumn("change", F.lit("new")))


#: Columns of stored bundles.
BUNDLES = "bundle int, ids array<long>, tokens int, grp string"


def bundles(rows: DataFrame, grp: Column, size: Column) -> DataFrame:
    """Bundles of each group of raw rows (id, text, doc_role, uploaded_at, is_normalized): one of equal texts, newest first, packed."""
    fresh = ingest.dedupe_newest(rows.filter("is_normalized = 0")).withColumn("grp", grp).withColumn("n", size)
    return ingest.pack_bundles(fresh, "grp").select("bundle", "ids", "tokens", "grp")


#: Columns of stored facts.
FACTS = "row_no long, subject string, predicate string, object_value string, block long"
BLOCK = 64


def block_of(c: str) -> Column:
    return F.floor(F.col(c) / BLOCK).cast("long")


def facts(rows: DataFrame) -> DataFrame:
    """Facts of rows (row_no, text) with their block."""
    return ingest.extract_facts(rows, "row_no").select("row_no", "subject", "predicate", "object_value", block_of("row_no").alias("block"))
