"""Tables cut to the shared folder."""

from __future__ import annotations

import tempfile
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``); where the session names none, a temporary one in local mode only."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if "dir" not in _own:
        _own["dir"] = tempfile.mkdtemp(prefix="docloom-shared-")
    return _own["dir"]


def folder(spark: SparkSession, label: str) -> str:
    """A new folder for a table of this application."""
    return f"{shared_dir(spark)}/docloom-{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: a cut of lineage that outlives executors, made once for all its readers."""
    spark = df.sparkSession
    path = folder(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def together(*steps):
    """The results of independent steps, whose jobs run side by side."""
    with ThreadPoolExecutor(len(steps)) as pool:
        return [f.result() for f in [pool.submit(s) for s in steps]]


_kept: dict[tuple, object] = {}


def version(*frames: DataFrame) -> str:
    """A digest of the files that the frames read: their names, lengths and times of change."""
    import hashlib

    spark = frames[0].sparkSession
    conf, hadoop = spark._jsc.hadoopConfiguration(), spark._jvm.org.apache.hadoop.fs.Path
    found = []
    for name in sorted({f for frame in frames for f in frame.inputFiles()}):
        path = hadoop(name)
        status = path.getFileSystem(conf).getFileStatus(path)
        found.append(f"{name} {status.getLen()} {status.getModificationTime()}")
    return hashlib.sha256("\n".join(found).encode()).hexdigest()


def stored(label: str, frames: list[DataFrame], make):
    """What ``make`` builds from the frames (tables that it has cut): made once for each version of their files in an application, then shared."""
    key = (frames[0].sparkSession.sparkContext.applicationId, label, version(*frames))
    if key not in _kept:
        _kept[key] = make()
    return _kept[key]


def forget() -> None:
    """Let everything be made anew."""
    _kept.clear()
