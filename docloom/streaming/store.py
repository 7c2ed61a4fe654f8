"""A keyed store that a stream keeps up to date: generations of changes, tombstones, a manifest and compaction.

Each micro-batch becomes one generation, sorted by ranges of the key: the newest version of every changed row, or a tombstone where it was
deleted. The manifest names the generations that count, newest last; it is replaced as a whole, so a reader sees the store before or
after a change. When more than ``FAN`` generations count, neighbouring ones of similar size are merged by key ranges until few are left, so a
reader always merges few. A tombstone stays, as a late older version would bring its row back; once the oldest generation is
among the merged ones, tombstones of versions that are ``settled`` (no older change can arrive) go for good. A batch that is repeated after a failure writes the same
generation again. ``vacuum`` deletes what no manifest names.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most generations that count after a change.
FAN = 4
GONE = "__gone"


@dataclass(frozen=True)
class Generation:
    name: str
    low: int  # first and last batch whose changes it holds
    high: int
    rows: int


class Store:
    """The store in a folder that all executors share; rows are told apart by ``key``, of one key's the highest ``version`` counts, then the last batch."""

    def __init__(self, spark: SparkSession, folder: str, key: str, version: str):
        self.spark, self.folder, self.key, self.version = spark, folder, key, version
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _manifests(self) -> list[int]:
        at = self._path(f"{self.folder}/manifest")
        return sorted(int(f.getPath().getName()) for f in self._files.listStatus(at) if f.getPath().getName().isdigit()) if self._files.exists(at) else []

    def generations(self) -> list[Generation]:
        """Those that count, oldest first."""
        numbers = self._manifests()
        if not numbers:
            return []
        text = self.spark.read.text(f"{self.folder}/manifest/{numbers[-1]}", wholetext=True).first()[0]
        return [Generation(**g) for g in json.loads(text)]

    def _publish(self, live: list[Generation]) -> None:
        number = max(self._manifests(), default=-1) + 1
        hidden, shown = (self._path(f"{self.folder}/manifest/{n}") for n in (f"_{number}", str(number)))
        out = self._files.create(hidden, True)
        out.write(bytearray(json.dumps([vars(g) for g in live]).encode()))
        out.close()
        if not self._files.rename(hidden, shown):
            raise RuntimeError(f"manifest {number} is there already: two writers")

    def _read(self, generations: list[Generation]) -> DataFrame:
        rows = None
        for g in generations:
            part = self.spark.read.parquet(f"{self.folder}/{g.name}").withColumn("__at", F.lit(g.high))
            rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
        return rows

    def _newest(self, rows: DataFrame) -> DataFrame:
        columns = [c for c in rows.columns if c != "__at"]
        return rows.groupBy(self.key).agg(F.max_by(F.struct(*columns), F.struct(self.version, "__at")).alias("x")).select("x.*")

    def _write(self, rows: DataFrame, name: str) -> int:
        rows.repartitionByRange(F.col(self.key)).sortWithinPartitions(self.key).write.mode("overwrite").option("compression", "zstd").parquet(f"{self.folder}/{name}")
        return self.spark.read.parquet(f"{self.folder}/{name}").count()

    def apply(self, changes: DataFrame, batch: int, build: Callable[[DataFrame], DataFrame] = lambda x: x, deleted: str = "deleted", settled=None) -> None:
        """One batch of changes: rows with key, version and the boolean column ``deleted``; what stays is built (deleted rows aren't) and stored."""
        live = self.generations()
        if any(g.low <= batch <= g.high for g in live):
            return  # a repeated batch whose generation counts already
        # of several changes of a key in one batch the newest; at one version the deletion
        order = F.struct(self.version, F.col(deleted).cast("int").alias("d"))
        last = changes.groupBy(self.key).agg(F.max_by(F.struct(*changes.columns), order).alias("x")).select("x.*")
        built = build(last.filter(~F.col(deleted)).drop(deleted)).withColumn(GONE, F.lit(False))
        gone = last.filter(deleted).select(self.key, self.version, F.lit(True).alias(GONE))
        name = f"generation-{batch}"
        count = self._write(built.unionByName(gone, allowMissingColumns=True), name)
        self._publish([*live, Generation(name, batch, batch, count)])
        self.compact(settled)

    def compact(self, settled=None) -> None:
        """Merge neighbours until at most FAN generations count: of all neighbouring pairs the one with the fewest rows, so work per row stays logarithmic.

        settled: tombstones below this version may go.
        """
        live = self.generations()
        while len(live) > FAN:
            i = min(range(len(live) - 1), key=lambda j: live[j].rows + live[j + 1].rows)
            a, b = live[i : i + 2]
            rows = self._newest(self._read([a, b]))
            if i == 0 and settled is not None:  # nothing older that a tombstone hides
                rows = rows.filter(~(F.col(GONE) & (F.col(self.version) < settled)))
            name = f"generation-{a.low}-{b.high}"
            live[i : i + 2] = [Generation(name, a.low, b.high, self._write(rows, name))]
            self._publish(live)

    def read(self) -> DataFrame | None:
        """The newest version of every row that is not deleted; None before the first batch."""
        live = self.generations()
        return self._newest(self._read(live)).filter(~F.col(GONE)).drop(GONE) if live else None

    def vacuum(self) -> list[str]:
        """Delete generations that don't count any more and old manifests; readers that began before must have ended."""
        live, numbers, out = {g.name for g in self.generations()}, self._manifests(), []
        for f in self._files.listStatus(self._path(self.folder)):
            name = f.getPath().getName()
            if name.startswith("generation-") and name not in live:
                self._files.delete(f.getPath(), True)
                out.append(name)
        for n in numbers[:-1]:
            self._files.delete(self._path(f"{self.folder}/manifest/{n}"), False)
        return sorted(out)


def maintain(stream: DataFrame, store: Store, checkpoint: str, build: Callable[[DataFrame], DataFrame] = lambda x: x):
    """Keep the store up to date from a stream of changes; returns the query, which ends when it has read what has arrived."""
    return stream.writeStream.foreachBatch(lambda batch, number: store.apply(batch, number, build)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
