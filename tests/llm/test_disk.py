"""What queries leave on disk: tables cut on the way, shuffle files, bloom filters."""

from pathlib import Path

from pyspark.sql import functions as F

import corpus_pipeline
from docloom.llm import common, exact_dedup, near_dedup
from docloom.llm.components import components

SF = "/root/testdata/sf0.001"


def tables(spark) -> dict[str, int]:
    """Bytes of each table that stands in the shared folder."""
    root = Path(common._folder(spark).removeprefix("file:"))
    return {p.name: sum(f.stat().st_size for f in p.iterdir()) for p in root.iterdir()} if root.exists() else {}


def kinds(spark, before: dict[str, int]) -> list[str]:
    return sorted(name.rpartition("-")[0] for name in tables(spark).keys() - before.keys())


def test_rounds_of_components_are_deleted(spark):
    before = tables(spark)
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    label = {r.id: r.component for r in components(edges).collect()}
    assert label == {i: 0 for i in range(41)} | {100: 100, 101: 100}
    assert kinds(spark, before) == ["cc-label"]


def test_stages_leave_their_verdicts_only(spark):
    docs, left = spark.read.parquet(f"{SF}/documents.parquet"), {1: ["lsm-twins", "lsm-verdicts"], 2: ["near-twins", "near-verdicts"], 3: ["mix-plays"]}
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        before = tables(spark)
        docs = stage(spark, docs, SF)
        assert kinds(spark, before) == left.get(k, kinds(spark, before))
        docs = common.cut(docs, "test-left")
        assert docs.count() > 0


def test_pipeline_keeps_the_last_stage_only(spark):
    before = tables(spark)
    out = corpus_pipeline.run(spark, SF)
    assert kinds(spark, before) == ["stage-3"]
    assert out.count() > 0


def test_near_dedup_query_reads_what_it_keeps(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = tables(spark)
    out = near_dedup.near_dedup(docs)
    assert not {"near-texts", "near-likely", "cc", "cc-low", "cc-large"} & set(kinds(spark, before))
    assert out.count() == docs.count()


def test_filters_of_runs_follow_their_rows(spark):
    """Each file's filter took a megabyte, whatever the number of its rows."""
    before = tables(spark)
    docs = spark.range(400).selectExpr("id AS doc_id", "CAST(id AS STRING) AS text").repartition(20)
    assert exact_dedup.flush_runs(docs).count() == 400
    (name,) = tables(spark).keys() - before.keys()
    files = [f for f in Path(common._folder(spark).removeprefix("file:"), name).iterdir() if f.suffix == ".parquet"]
    assert len(files) >= 20 and sum(f.stat().st_size for f in files) < 20 * 10_000


def test_shuffle_files_go_with_the_query(spark):
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    before = list_shuffles(disk)
    common.cut(spark.range(10_000).repartition(7, "id").groupBy((F.col("id") % 100).alias("k")).count(), "test-shuffle")
    assert list_shuffles(disk) <= before
    assert spark.conf.get(common.SHUFFLES_GO, "false") == "false"


def list_shuffles(disk) -> set[str]:
    """Shuffle files of this application."""
    return {f.name for d in disk.localDirs() for f in Path(d.getPath()).rglob("shuffle_*")}
