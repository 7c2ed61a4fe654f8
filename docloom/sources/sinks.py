"""Writers: keyed upsert, Markdown export, evaluation reports, rotation of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Rows of both, the highest version of each key."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(F.col(version).desc()))
    return old.unionByName(new, allowMissingColumns=True).withColumn("__n", rank).filter("__n = 1").drop("__n")


def scalar(c: Column) -> Column:
    """A value of front matter: one line without colons."""
    return F.trim(F.replace(F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit("\n"), F.lit(" ")), F.lit(":"), F.lit("-")))


def markdown(front: dict[str, Column], title: Column, body: Column, sources: Column, claims: Column) -> Column:
    """A page: front matter, title, body, and where there are any its sources and claims."""
    head = F.concat_ws("\n", F.lit("---"), *[F.concat(F.lit(f"{k}: "), scalar(v)) for k, v in front.items()], F.lit("---"))
    listed = lambda name, xs, mark: F.when(F.size(xs) > 0, F.concat(F.lit(f"\n\n## {name}\n"), F.array_join(F.transform(xs, lambda x: F.concat(F.lit(mark), F.trim(x))), "\n"))).otherwise("")
    return F.concat(F.trim(F.concat(head, F.lit("\n\n# "), title, F.lit("\n\n"), F.trim(body), listed("Sources", sources, "- 근거: "), listed("Claims", claims, "- "))), F.lit("\n"))


def write_markdown(pages: DataFrame, path: str) -> None:
    """One text for each page (columns slug, text) in a folder of its own; one row each, so a text is one file."""
    pages.select("slug", "text").repartition("slug").write.mode("overwrite").partitionBy("slug").option("lineSep", "\x00").text(path)


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """slug, text of written pages."""
    return spark.read.text(path, wholetext=True).select(F.col("slug").cast("string").alias("slug"), F.rtrim(F.col("value"), F.lit("\x00")).alias("text"))


def write_report(metrics: DataFrame, path: str) -> None:
    """summary.json and summary.md of a one-row metric table, as text tables of one file each."""
    names = sorted(metrics.columns)
    value = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    lines = F.array(F.lit("| metric | value |"), F.lit("|---|---|"), *[F.concat(F.lit(f"| {c} | "), value(c), F.lit(" |")) for c in names])
    metrics.select(F.to_json(F.struct(*names), {"ignoreNullFields": "false"}).alias("value")).coalesce(1).write.mode("overwrite").text(f"{path}/summary.json")
    metrics.select(F.explode(lines).alias("value")).coalesce(1).write.mode("overwrite").text(f"{path}/summary.md")


def rotate(spark: SparkSession, path: str, max_bytes: int, backups: int) -> bool:
    """path (a file or a written table) becomes path.1, path.1 becomes path.2 and so on, if it is large enough; the oldest goes."""
    at = lambda name: spark._jvm.org.apache.hadoop.fs.Path(name)
    files = at(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(at(path)) or files.getContentSummary(at(path)).getLength() < max(1, max_bytes):
        return False
    files.delete(at(f"{path}.{max(1, backups)}"), True)
    for k in range(max(1, backups) - 1, 0, -1):
        if files.exists(at(f"{path}.{k}")):
            files.rename(at(f"{path}.{k}"), at(f"{path}.{k + 1}"))
    return files.rename(at(path), at(f"{path}.1"))
