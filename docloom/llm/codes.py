"""Vector code compression: product codes whose codebooks are refined by a delta-maintained Lloyd iteration.

Components become integers, vectors are cut into equal parts, and each part position has a codebook. The table of
vectors carries the assignment of its parts; a round writes it anew with the assignment to the current codebooks.
Of that table only parts whose assignment has changed give rows: one that adds the part to its new entry and one that
takes it from its old entry. Their sums per entry (aggregated before the shuffle) are added to running integer sums
and counts, which give the next codebooks exactly. Per round the driver holds one codebook's numbers, whose size
depends on the width of a vector and the number of entries, not on the number of vectors. A table that has been
replaced is deleted.

Cases: vectors that are null, or hold null or non-finite components, are dropped; so are vectors of another width than
the first kept one (smallest vec_id, then smallest vector), and those whose width is not a positive multiple of the
number of parts. Components beyond 32,768 in size count as that, so that sums of squares stay in 64 bits. Null
vec_ids come after all others. Rows, not ids, are vectors: repeated rows count each. With fewer vectors than entries
the codebooks have as many entries as there are vectors. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import cut, cut_at, remove, small_batches, tidy

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Largest component in size, as an integer.
MOST = 1 << 27


def integer_vectors(vectors: DataFrame, parts: int = PARTS) -> DataFrame:
    """vec_id, label, v (array of int) of the vectors that can be coded, of any width."""
    e = F.col("embedding")
    x = lambda c: c.cast("double")
    whole = F.forall(e, lambda c: c.isNotNull() & ~F.isnan(x(c)) & (F.abs(x(c)) < float("inf")))
    ints = F.transform(e, lambda c: F.floor(F.greatest(F.least(x(c) * SCALE, F.lit(float(MOST))), F.lit(-float(MOST)))).cast("int"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label"), e.alias("embedding"))
    return rows.filter(e.isNotNull() & (F.size(e) > 0) & (F.size(e) % parts == 0) & whole).select("vec_id", "label", ints.alias("v"))


def _assign(books: list[np.ndarray]):
    """Codes of every part by the nearest entry, the lowest of equally near ones; and the sum of their squared distances."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = sum(b.shape[1] for b in books)
        for b in batches:
            v = np.asarray(b.column("v").flatten()).reshape(len(b), width).astype(np.int64)
            codes, error, at = np.empty((len(b), len(books)), np.int8), np.zeros(len(b), np.int64), 0
            for p, book in enumerate(books):
                x = v[:, at : at + book.shape[1]]
                far = np.zeros((len(b), len(book)), np.int64)
                for i in range(book.shape[1]):
                    far += np.square(x[:, i : i + 1] - book[:, i])
                codes[:, p] = near = far.argmin(1)
                error += far[np.arange(len(b)), near]
                at += book.shape[1]
            off = pa.array(np.arange(len(b) + 1) * len(books), pa.int32())
            listed = pa.ListArray.from_arrays(off, pa.array(codes.reshape(-1)))
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), b.column("v"), b.column("code"), listed, pa.array(error)], ["vec_id", "label", "v", "was", "code", "error"])

    return run


def deltas(rows: DataFrame, size: int) -> DataFrame:
    """part, entry, count, sums: what the changed assignments of rows (v, was, code) add to the running sums; size: components of a part."""
    both = F.arrays_zip(F.col("code").alias("now"), F.coalesce("was", F.transform("code", lambda _: F.lit(None).cast("byte"))).alias("was"))
    moved = rows.filter(~F.col("code").eqNullSafe(F.col("was"))).select("v", F.posexplode(both).alias("part", "c")).filter(~F.col("c.now").eqNullSafe(F.col("c.was")))
    signed = F.array(F.struct(F.col("c.now").alias("entry"), F.lit(1).alias("sign")), F.struct(F.col("c.was").alias("entry"), F.lit(-1).alias("sign")))
    moved = moved.select("part", F.slice("v", F.col("part") * size + 1, size).alias("x"), F.explode(signed).alias("d")).filter("d.entry IS NOT NULL")
    sums = [F.sum(F.col("x")[i].cast("long") * F.col("d.sign")).alias(f"s{i}") for i in range(size)]
    return moved.groupBy("part", F.col("d.entry").alias("entry")).agg(F.sum("d.sign").alias("count"), *sums)


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 for every vector that can be coded."""
    spark = vectors.sparkSession
    small_batches(spark)
    kept = integer_vectors(vectors, parts)
    label = kept.schema["label"].dataType.simpleString()
    order = [F.asc_nulls_last("vec_id"), F.col("v")]
    first = kept.orderBy(*order).first()
    if first is None:
        return kept.select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    width, size = len(first.v), len(first.v) // parts
    kept = kept.filter(F.size("v") == width)
    start = np.array([r.v for r in kept.orderBy(*order).limit(entries).collect()], np.int64)
    books = [start[:, p * size : (p + 1) * size].copy() for p in range(parts)]
    sums = np.zeros((parts, len(start), size + 1), object)  # Python's integers: counts and sums of any size
    now, path = cut_at(kept.withColumn("code", F.lit(None).cast("array<byte>")), "codes-vectors")
    schema = f"vec_id long, label {label}, v array<int>, was array<byte>, code array<byte>, error long"
    for _ in range(rounds):
        then = path
        now, path = cut_at(now.select("vec_id", "label", "v", "code").mapInArrow(tidy(_assign(books)), schema), "codes-round")
        remove(spark, then)
        for r in deltas(now, size).collect():  # at most parts * entries rows
            sums[r.part, r.entry] += np.array([r["count"], *(r[f"s{i}"] for i in range(size))], object)
        for p, book in enumerate(books):
            for e in range(len(book)):
                if count := sums[p, e, 0]:
                    book[e] = [s // count for s in sums[p, e, 1:]]
    digest = hashlib.sha256(",".join(str(int(x)) for book in books for x in book.reshape(-1)).encode()).hexdigest()
    last = now.select("vec_id", "label", "v", "code").mapInArrow(tidy(_assign(books)), schema)
    last = cut(last.select("vec_id", "label", F.array_join(F.transform("code", lambda c: F.lower(F.lpad(F.hex(c.cast("long")), 2, "0"))), "").alias("code"), "error"), "codes-last")
    remove(spark, path)
    totals = cut(last.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).cast("long").alias("label_error")).withColumnRenamed("label", "__label"), "codes-labels")
    out = last.join(totals, F.col("label").eqNullSafe(F.col("__label")))
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def oracle(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """DuckDB SQL of ``compress`` over embeddings: every round assigns all parts and averages them anew."""
    steps = [
        f"""v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS k, vec_id, label,
      list_transform(embedding, lambda x: floor(x::DOUBLE * {SCALE})::BIGINT) AS e FROM embeddings
      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS MATERIALIZED (SELECT k, p, list_slice(e, p * (len(e) // {parts}) + 1, (p + 1) * (len(e) // {parts})) AS x FROM v, range({parts}) AS r(p)),
b0 AS MATERIALIZED (SELECT p, k - 1 AS c, x AS y FROM x WHERE k <= {entries})"""
    ]
    nearest = """a{i} AS MATERIALIZED (SELECT k, x.p, any_value(x.x) AS x, min((d, c)) AS best FROM (
      SELECT k, x.p, x.x, c, list_sum(list_transform(list_zip(x.x, y), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
      FROM x JOIN b{i} USING (p)) AS x GROUP BY k, x.p)"""
    for i in range(rounds):
        steps.append(nearest.format(i=i))
        steps.append(
            f"""m{i} AS (SELECT p, c, j, sum(z)::BIGINT AS s, count(*) AS n FROM (
      SELECT p, best[2] AS c, unnest(x) AS z, generate_subscripts(x, 1) AS j FROM a{i}) GROUP BY p, c, j),
b{i + 1} AS MATERIALIZED (SELECT b.p, b.c, coalesce(m.y, b.y) AS y FROM b{i} AS b LEFT JOIN (
      SELECT p, c, list((s - ((s % n) + n) % n) // n ORDER BY j) AS y FROM m{i} GROUP BY p, c) AS m ON b.p = m.p AND b.c = m.c)"""
        )
    steps.append(nearest.format(i=rounds))
    steps.append(f"""h AS (SELECT sha256(string_agg(z, ',' ORDER BY p, c)) AS digest FROM (SELECT p, c, array_to_string(y, ',') AS z FROM b{rounds})),
o AS (SELECT k, string_agg(printf('%02x', best[2]), '' ORDER BY p) AS code, sum(best[1])::BIGINT AS error FROM a{rounds} GROUP BY k)""")
    return "WITH " + ",\n".join(steps) + "\nSELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, digest AS codebooks_sha256 FROM o JOIN v USING (k), h"


ORACLE = oracle()
