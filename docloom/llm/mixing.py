"""Mixing sources to target weights by a low-discrepancy schedule [native: DataFrame functions only].

Documents of a source lie, shuffled by a digest of their id, end to end on a token axis that is cut into
blocks of equal length. A schedule of slots is drawn from the golden-ratio sequence: slot i has the point
frac(i * phi), which the cumulative target shares map to a source. Slots are ranked within their source
(prefix counts of slot ranges, then ranks inside a range, so that no task holds a whole source); the slot
of rank r plays block r modulo the number of blocks. A document is taken as often as the blocks it
overlaps are played, word by word. A source with less than LEAST_PARTS blocks in its size or target has
shorter blocks and is drawn, with its like, in a schedule of slots of their own length, so that a short
last block and rounding to whole slots stay small beside its own target in a table of any size.

Cases: a null text has size 0 and is taken 0 times; null is a source of its own, sorted last; equal rows
are rows of their own with plays of their own, as are rows that share an id or have none (these are shuffled by a
hash of the row); a table without words has targets of 0; an empty table gives an empty result; other columns stay
untouched in ``mixed_rows`` and are ignored by ``mix``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.llm.common import WORD, cut, cut_alone, one_of_each

#: Words of a block at full size, and the least number of slots below that.
BLOCK = 512
LEAST_SLOTS = 20_000
#: A source's size and target have at least so many blocks (or blocks of one word).
LEAST_PARTS = 128
#: A document is taken at most so often.
MOST = 3
WEIGHTS = (5, 2, 1)
#: Ranges of the shuffled axis, at least; each (source, range) is ordered on its own and has about so many rows at most.
RANGES, RANGE_ROWS = 256, 100_000
#: Slots of one range of the schedule.
SLOT_RANGE = 4096
PHI = 0.6180339887498949
#: Points times sources that are compared one by one.
MOST_PAIRS = 1_000_000_000


def words_of(text: str = "text") -> Column:
    """Number of words; null is 0."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size, target for (source, size) rows: shares by weight under the cap of ``most`` times the size.

    Water filling in closed form: sources in order of cap / weight; with the first k at their caps the rest
    share what is left at the level (total - caps) / weights; the first k whose level the next cap bears holds, and it has the highest such level.
    """
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(by_name) - 1, len(weights)) + 1).cast("int"))
    s = s.withColumn("weight", w).withColumn("cap", F.col("source_size") * float(most))
    order = W.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    everything = W.partitionBy()
    s = s.withColumn("before", F.coalesce(F.sum("cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
    s = s.withColumn("after", F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing)))
    s = s.withColumn("level", (F.sum(F.col("source_size").cast("double")).over(everything) - F.col("before")) / F.col("after"))
    s = s.withColumn("level", F.max(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))).over(everything))
    return s.select("source", F.coalesce("source_size", F.lit(0)).alias("source_size"), F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.lit(0.0))).alias("target"))


def schedule(spark: SparkSession, plan: DataFrame, slots: int) -> DataFrame:
    """slot, source_no, rank: the source of every slot and the rank of the slot within that source."""
    points = spark.range(slots).select(F.col("id").alias("slot"), (F.col("id") * F.lit(PHI) - F.floor(F.col("id") * F.lit(PHI))).alias("u"))
    drawn = points.join(F.broadcast(plan.select("source_no", "lo", "hi")), (F.col("u") >= F.col("lo")) & (F.col("u") < F.col("hi"))) if plan.count() * slots <= MOST_PAIRS else _by_cell(points, plan)
    drawn = drawn.select("slot", "source_no", F.floor(F.col("slot") / SLOT_RANGE).alias("part"))
    before = drawn.groupBy("source_no", "part").count().withColumn("before", F.coalesce(F.sum("count").over(W.partitionBy("source_no").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    inner = F.row_number().over(W.partitionBy("source_no", "part").orderBy("slot")) - 1
    return drawn.withColumn("inner", inner).join(before.select("source_no", "part", "before"), ["source_no", "part"]).select("slot", "source_no", (F.col("before") + F.col("inner")).alias("rank"))


def _by_cell(points: DataFrame, plan: DataFrame, cells: int = 65_536) -> DataFrame:
    """The same join for very many sources: intervals listed under the cells of [0, 1) that they touch."""
    spans = plan.filter("hi > lo").select("source_no", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") * cells), F.least(F.floor(F.col("hi") * cells), F.lit(cells - 1)))).alias("cell"))
    return points.withColumn("cell", F.floor(F.col("u") * cells)).join(spans, "cell").filter("u >= lo AND u < hi")


def _fine_plan(plan: DataFrame) -> DataFrame:
    """source_no, lo, hi, all for sources with blocks of their own: intervals as wide as the slots each wants, and the slots of all."""
    by_no = W.orderBy("source_no")
    p = plan.withColumn("want", F.col("target") * F.col("blocks") / F.col("source_size"))
    p = p.withColumn("all", F.sum("want").over(W.partitionBy())).withColumn("hi", F.sum("want").over(by_no.rowsBetween(W.unboundedPreceding, 0)) / F.col("all"))
    p = p.withColumn("last", F.lead("source_no").over(by_no).isNull()).withColumn("lo", F.coalesce(F.lag("hi").over(by_no), F.lit(0.0)))
    return p.select("source_no", "lo", F.when(F.col("last"), 1.0).otherwise(F.col("hi")).alias("hi"), "all")


def _row_hash(docs: DataFrame) -> Column:
    """Hash of the whole row."""
    kinds = dict(docs.dtypes)
    return F.xxhash64(*[F.to_json(f"`{c}`") if "map<" in kinds[c] else F.col(f"`{c}`") for c in docs.columns])


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, block: int = BLOCK) -> DataFrame:
    """doc_id, size, source_size, target, taken, plays (times that the block at its middle is played), row (hash of the row) for every row."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", "source", words_of().alias("size"), _row_hash(docs).alias("row"))
    # a null id has no digest of its own: its row has
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("row "), F.col("row").cast("string"))))
    rows = cut(rows.withColumn("key", key), "mix-sizes")
    plan = targets(rows.select("source", "size"), weights, most)
    total, count = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    ranges = max(RANGES, count // RANGE_ROWS)
    length = max(1, min(block, total // LEAST_SLOTS))
    # a number for each source, so that null joins; and its interval of [0, 1)
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    plan = plan.withColumn("source_no", F.row_number().over(by_name)).withColumn("hi", F.sum("target").over(by_name.rowsBetween(W.unboundedPreceding, 0)) / max(float(total), 1.0))
    last = F.row_number().over(W.orderBy(F.col("source").desc_nulls_first())) == 1
    plan = plan.withColumn("lo", F.coalesce(F.lag("hi").over(by_name), F.lit(0.0))).withColumn("hi", F.when(last, 1.0).otherwise(F.col("hi")))
    own = F.floor(F.least(F.col("source_size").cast("double"), F.col("target")) / LEAST_PARTS)
    plan = plan.withColumn("length", F.greatest(F.lit(1), F.least(F.lit(length), own)).cast("long"))
    plan = cut(plan.withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("source_size") / F.col("length")))), "mix-plan")

    part = F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * ranges / F.lit(float(1 << 32)))
    placed = rows.join(plan, rows["source"].eqNullSafe(plan["source"])).drop("source").withColumn("part", part)
    offsets = placed.groupBy("source_no", "part").agg(F.sum("size").alias("words"))
    offsets = offsets.select("source_no", "part", F.coalesce(F.sum("words").over(W.partitionBy("source_no").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("offset"))
    inner = W.partitionBy("source_no", "part").orderBy("key", "doc_id", "size", "row")
    placed = placed.withColumn("ends", F.sum("size").over(inner.rowsBetween(W.unboundedPreceding, 0))).join(offsets, ["source_no", "part"])
    placed = placed.withColumn("begin", F.col("offset") + F.col("ends") - F.col("size")).withColumn("end", F.col("begin") + F.col("size"))
    placed = placed.select("doc_id", "size", "row", "source_size", "target", "source_no", "length", "begin", "end")

    # slots play blocks in turn; a slot beyond ``most`` rounds is void
    slots = -(-total // length)
    fine = F.col("length") < length
    drawn = schedule(spark, plan, slots).join(plan.filter(~fine).select("source_no", "blocks"), "source_no")
    short = _fine_plan(plan.filter(fine & (F.col("source_size") > 0)))
    wanted = short.agg(F.max("all")).first()[0]
    if wanted:
        drawn = drawn.unionByName(schedule(spark, short, math.ceil(wanted)).join(plan.select("source_no", "blocks"), "source_no"))
    played = drawn.filter(F.col("rank") < F.col("blocks") * most)
    times = played.groupBy("source_no", F.pmod("rank", "blocks").alias("block")).agg(F.count(F.lit(1)).alias("times"))
    pieces = placed.filter("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("begin") / F.col("length")), F.floor((F.col("end") - 1) / F.col("length")))))
    inside = F.least("end", (F.col("block") + 1) * F.col("length")) - F.greatest("begin", F.col("block") * F.col("length"))
    middle = F.floor((F.col("begin") + F.col("end") - 1) / 2)
    holds = F.floor(middle / F.col("length")) == F.col("block")
    taken = pieces.join(times, ["source_no", "block"], "left").groupBy("source_no", "begin", "doc_id", "size", "row", "source_size", "target").agg(
        F.sum(inside * F.coalesce("times", F.lit(0))).alias("taken"), F.max(F.when(holds, F.coalesce("times", F.lit(0)))).alias("plays")
    )
    out = ["doc_id", "size", "source_size", "target", "taken", "plays", "row"]
    none = placed.filter("size = 0").withColumns({"taken": F.lit(0).cast("long"), "plays": F.lit(0).cast("long")})
    return taken.select(out).unionByName(none.select(out))


def plays(docs: DataFrame) -> DataFrame:
    """docs with the column plays; rows that are equal in all columns become one, with the plays of all."""
    by_row = lambda: mix(docs).groupBy(F.col("row").alias("__row")).agg(F.sum("plays").alias("__plays"), F.count(F.lit(1)).alias("__rows"))
    found = cut_alone(lambda: by_row().filter("__plays > 0"), "mix-plays")
    rows = docs.withColumn("__hash", _row_hash(docs))
    once, equal = found.filter("__rows = 1"), found.filter("__rows > 1")
    out = rows.join(once, F.col("__hash") == F.col("__row")).select(*docs.columns, F.col("__plays").alias("plays"))
    if equal.isEmpty():
        return out
    several = rows.join(equal, F.col("__hash") == F.col("__row"))
    return out.unionByName(one_of_each(several, ["__hash"], [*docs.columns, "__plays"]).withColumnRenamed("__plays", "plays"))


def mixed_rows(docs: DataFrame) -> DataFrame:
    """The mix as rows: each document as often as the block at its middle word is played, with the columns of docs."""
    return plays(docs.withColumnRenamed("plays", "__own")).withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("plays").cast("int")))).drop("plays").withColumnRenamed("__own", "plays").select(docs.columns)


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '')) AS k FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, ([5.0, 2.0, 1.0])[((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3) + 1]::DOUBLE AS weight,
              source_size * 3.0::DOUBLE AS cap FROM s0),
s2 AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS before,
              sum(weight) OVER (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS after,
              sum(source_size::DOUBLE) OVER () AS total FROM s1),
s3 AS (SELECT *, (total - before) / after AS lev FROM s2),
s4 AS (SELECT *, max(CASE WHEN lev * weight <= cap THEN lev END) OVER () AS level FROM s3),
s5 AS (SELECT source, source_size, total, least(cap, coalesce(level * weight, 0.0)) AS target,
              greatest(1, least(512, total::BIGINT // 20000)) AS length FROM s4),
s6 AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS source_no,
              sum(target) OVER (ORDER BY source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / greatest(total, 1.0) AS h,
              row_number() OVER (ORDER BY source DESC NULLS FIRST) = 1 AS is_last FROM s5),
plan AS (SELECT *, coalesce(lag(h) OVER (ORDER BY source_no), 0.0) AS lo, CASE WHEN is_last THEN 1.0 ELSE h END AS hi,
              greatest(1, ceil(source_size / length))::BIGINT AS blocks FROM s6),
slots AS (SELECT i, i * 0.6180339887498949::DOUBLE - floor(i * 0.6180339887498949::DOUBLE) AS u
          FROM range((SELECT ceil(max(total) / max(length))::BIGINT FROM plan)) t(i)),
drawn AS (SELECT i, source_no, blocks, row_number() OVER (PARTITION BY source_no ORDER BY i) - 1 AS r
          FROM slots JOIN plan ON u >= lo AND u < hi),
times AS (SELECT source_no, r % blocks AS block, count(*) AS times FROM drawn WHERE r < 3 * blocks GROUP BY ALL),
placed AS (SELECT doc_id, size, p.*, sum(size) OVER (PARTITION BY source_no ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS e
           FROM d JOIN plan p ON d.source IS NOT DISTINCT FROM p.source),
pieces AS (SELECT *, e - size AS b, unnest(range((e - size) // length, (e - 1) // length + 1)) AS block FROM placed WHERE size > 0)
SELECT doc_id, size, source_size, target,
       sum((least(e, (block + 1) * length) - greatest(b, block * length)) * coalesce(times, 0))::BIGINT AS taken
FROM pieces LEFT JOIN times USING (source_no, block) GROUP BY doc_id, size, source_size, target, source_no, b
UNION ALL SELECT doc_id, size, source_size, target, 0 FROM placed WHERE size = 0
"""
