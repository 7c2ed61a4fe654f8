"""A stored approximate index of vectors: inverted lists around centres, probed by blocks of queries.

Centres are fitted on a sample of bounded size; every vector then goes to the list of its nearest centre, and lists
are stored as partitions of a table, so a probe reads the files of its lists only. How many lists a query needs is measured:
``calibrate`` asks some of the vectors themselves, answers them exactly, and takes the number of lists that hold the wanted share of the
true neighbours. Scores are exact dot products of all vectors in the probed lists; ``retrieval.dense_blocks`` is the exact path.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.operators.retrieval import dense_blocks
from docloom.tables import cut, folder

#: Most vectors that centres are fitted on, most lists of a dimension, and rounds of the fit.
SAMPLE, LISTS, ROUNDS = 16_384, 4096, 8
#: Queries of a block.
BLOCK = 4096


def _matrix(col: pa.Array, n: int) -> np.ndarray:
    return np.asarray(col.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(n, -1)


def fit_centres(sample: np.ndarray, lists: int) -> np.ndarray:
    """Unit centres by spherical k-means, begun at rows spread over the sample; a centre without rows keeps its place."""
    centres = sample[np.linspace(0, len(sample) - 1, min(lists, len(sample))).astype(int)].copy()
    for _ in range(ROUNDS):
        near = (sample @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, sample)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norms > 0, sums / np.where(norms > 0, norms, 1), centres)
    return centres


@dataclass(frozen=True)
class VectorIndex:
    path: str  # vectors by list: id, v, dim, list
    centres: dict[int, np.ndarray]  # of each dimension

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema("id long, v array<double>, dim int, list int").parquet(self.path)

    def save(self, spark: SparkSession) -> None:
        """Store the centres beside the lists, so that ``load`` opens the index in another session."""
        rows = [(d, i, c.tolist()) for d, m in self.centres.items() for i, c in enumerate(m)]
        spark.createDataFrame(rows, "dim int, list int, centre array<double>").write.mode("overwrite").parquet(f"{self.path}-centres")

    @staticmethod
    def load(spark: SparkSession, path: str) -> VectorIndex:
        found: dict[int, list] = {}
        for r in spark.read.parquet(f"{path}-centres").orderBy("dim", "list").collect():  # at most LISTS for each dimension
            found.setdefault(r.dim, []).append(r.centre)
        return VectorIndex(path, {d: np.array(m) for d, m in found.items()})


def build(vectors: DataFrame, path: str | None = None, lists: int | None = None) -> VectorIndex:
    """Index of vectors (id, v, dim). Lists: the square root of the number of vectors of a dimension, within LISTS, unless given."""
    spark = vectors.sparkSession
    path = path or folder(spark, "vector-lists")
    clean = vectors.select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v"), F.col("dim").cast("int").alias("dim"))
    clean = clean.filter((F.col("dim") > 0) & (F.size("v") == F.col("dim")) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x)))
    counts = {r.dim: r["count"] for r in clean.groupBy("dim").count().collect()}
    pick = F.row_number().over(W.partitionBy("dim").orderBy(F.xxhash64("id"), "id"))
    share = {d: min(1.0, 1.5 * SAMPLE / n) for d, n in counts.items()}
    centres = {}
    for d, n in counts.items():
        # rows of the lowest hashes: first a share of about one and a half samples, so that the sort is small
        held = clean.filter((F.col("dim") == d) & (F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(share[d] * (1 << 30)) + 1)).withColumn("n", pick).filter(F.col("n") <= SAMPLE)
        sample = np.array([r.v for r in held.orderBy("n").collect()])
        centres[d] = fit_centres(sample, lists or min(LISTS, max(1, round(n**0.5)))) if len(sample) else np.zeros((1, d))
    given = spark.sparkContext.broadcast(centres)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            dims = t.column(2).to_numpy(zero_copy_only=False)
            for d in np.unique(dims).tolist():
                at = pa.array(np.flatnonzero(dims == d))
                part = t.take(at)
                near = (_matrix(part.column(1), len(at)) @ given.value[d].T).argmax(1)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(near, pa.int32())], ["id", "v", "dim", "list"])

    out = clean.mapInArrow(assign, "id long, v array<double>, dim int, list int")
    out.hint("rebalance", "dim", "list").write.mode("overwrite").partitionBy("dim", "list").parquet(path)
    index = VectorIndex(path, centres)
    index.save(spark)
    return index


def ranked_lists(queries: DataFrame, index: VectorIndex, most: int | None = None) -> DataFrame:
    """query_id, dim, list, pos: the lists of a query's dimension, nearest first (pos from 0), at most ``most``."""
    given = queries.sparkSession.sparkContext.broadcast(index.centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            dims = t.column(2).to_numpy(zero_copy_only=False)
            for d in np.unique(dims).tolist():
                if d not in given.value:
                    continue
                at = np.flatnonzero(dims == d)
                order = np.argsort(-(_matrix(t.column(1).take(pa.array(at)), len(at)) @ given.value[d].T), axis=1, kind="stable")[:, :most]
                ids = t.column(0).to_numpy(zero_copy_only=False)[at]
                n = order.shape[1]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, n), pa.int64()), pa.array(np.full(order.size, d), pa.int32()), pa.array(order.reshape(-1), pa.int32()), pa.array(np.tile(np.arange(n), len(at)), pa.int32())], ["query_id", "dim", "list", "pos"])

    rows = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("v").cast("array<double>").alias("v"), F.col("dim").cast("int").alias("dim"))
    return rows.mapInArrow(run, "query_id long, dim int, list int, pos int")


def calibrate(spark: SparkSession, index: VectorIndex, limit: int, recall: float = 0.95, queries: int = 256) -> int:
    """The number of lists that hold ``recall`` of the true ``limit`` neighbours of some of its vectors (a fixed number of them, by hash)."""
    vectors = index.rows(spark)
    asked = cut(vectors.orderBy(F.xxhash64("id"), "id").limit(queries).select(F.col("id").alias("query_id"), "v", "dim"), "vector-asked")
    true = dense_blocks(asked, vectors, limit).select("query_id", "id")
    homes = true.join(vectors.select("id", "dim", "list"), "id")
    pos = homes.join(ranked_lists(asked, index), ["query_id", "dim", "list"])
    need = pos.agg(F.expr(f"percentile_disc({recall}) WITHIN GROUP (ORDER BY pos)").alias("p")).first().p
    return 1 if need is None else int(need) + 1


def search(index: VectorIndex, queries: DataFrame, limit: int, probes: int, block: int = BLOCK) -> DataFrame:
    """query_id, id, semantic: the best ``limit`` rows in the ``probes`` nearest lists of each query (query_id, v, dim)."""
    spark = queries.sparkSession
    asked = cut(queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("v").cast("array<double>").alias("v"), F.col("dim").cast("int").alias("dim")), "vector-queries")
    lists = cut(ranked_lists(asked, index, probes).groupBy("query_id", "dim").agg(F.collect_list("list").alias("lists")), "vector-probes")
    blocks = -(-asked.count() // block)
    out = None
    for no in range(blocks):
        held = asked.join(lists, ["query_id", "dim"]).filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == no).collect()  # about one block
        probed: dict[tuple[int, int], tuple[list, list]] = {}
        for r in held:
            for x in r.lists:
                names, vs = probed.setdefault((r.dim, x), ([], []))
                names.append(r.query_id)
                vs.append(r.v)
        given = spark.sparkContext.broadcast({k: (np.array(names), np.array(vs)) for k, (names, vs) in probed.items()})

        def run(batches: Iterator[pa.RecordBatch], given=given) -> Iterator[pa.RecordBatch]:
            for t in batches:
                ids, dims, homes = (t.column(i).to_numpy(zero_copy_only=False) for i in (0, 2, 3))
                for d, x in sorted(set(zip(dims.tolist(), homes.tolist(), strict=True))):
                    if (d, x) not in given.value:
                        continue
                    names, q = given.value[d, x]
                    at = np.flatnonzero((dims == d) & (homes == x))
                    scores = _matrix(t.column(1).take(pa.array(at)), len(at)) @ q.T
                    k = min(limit, len(at))
                    floor = np.partition(scores, len(at) - k, axis=0)[len(at) - k]  # ties at the limit are cut by the window below
                    row, col = np.nonzero(scores >= floor[None, :] - 1e-9)
                    yield pa.RecordBatch.from_arrays([pa.array(names[col], pa.int64()), pa.array(ids[at][row], pa.int64()), pa.array(scores[row, col])], ["query_id", "id", "semantic"])

        wanted: dict[int, list[int]] = {}
        for d, x in probed:
            wanted.setdefault(d, []).append(x)
        keep = F.lit(False)
        for d, xs in wanted.items():  # files of other lists aren't read
            keep = keep | (F.col("dim") == d) & F.col("list").isin(xs)
        part = index.rows(spark).filter(keep).mapInArrow(run, "query_id long, id long, semantic double")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], "query_id long, id long, semantic double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.round("semantic", 9).desc(), F.col("id")))
    return out.withColumn("rank", rank).filter(F.col("rank") <= limit).drop("rank")


def vectors_read(index: VectorIndex, queries: DataFrame, probes: int) -> DataFrame:
    """query_id, read, rows: vectors in the probed lists of each query, and all of its dimension."""
    sizes = cut(index.rows(queries.sparkSession).groupBy("dim", "list").count(), "vector-sizes")
    found = ranked_lists(queries, index, probes).join(sizes, ["dim", "list"], "left").groupBy("query_id", "dim").agg(F.coalesce(F.sum("count"), F.lit(0)).alias("read"))
    return found.join(sizes.groupBy("dim").agg(F.sum("count").alias("rows")), "dim").select("query_id", "read", "rows")
