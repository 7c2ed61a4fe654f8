"""Exact dedup by a log-structured merge index [native: DataFrame functions only].

Each scan task is a memtable: it maps its rows to (digest, doc_id) and flushes a run sorted by digest into a
Parquet table whose files carry bloom filters and min/max statistics on the digest. A batch's runs are merged into
a level: one entry per digest with the smallest identifier and the number of rows (equal digests of a task are
folded before they move). An index is a list of levels; a batch is looked up in every level through a filter of its
digests, so that entries that can't match don't move, and when there are more than FAN levels compaction merges
them into one. Digests with more than one row are hits; only hits have their texts read again, through a filter of
their ids, and their bytes are compared before they count as copies.

Cases: a null text counts as empty; a null doc_id is never preferred as the row that stays unless all
rows of the group have null ids; repeated rows of one doc_id share its verdict, and a doc_id with several texts has
a verdict for each; ``drop_copies`` leaves exactly one row of each group, also where ids repeat or are null; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import SPACE, cut, cut_alone, maybe_in, one_of_each

#: Levels that an index may have before they are merged.
FAN = 4
#: Filters as large as a file's digests need (by default each file's takes a megabyte): candidates halve from that down to half a kilobyte.
BLOOM = {"parquet.bloom.filter.enabled#digest": "true", "parquet.bloom.filter.adaptive.enabled": "true", "parquet.bloom.filter.candidates.number#digest": "12"}


def normalised(text: str = "text") -> Column:
    """Null becomes '', each run of white space one space."""
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), SPACE, " ")


def flush_runs(docs: DataFrame) -> DataFrame:
    """One row per document with its digest, written as runs sorted by it; each file keeps its range and a bloom filter."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2(normalised(), 256)).alias("digest"))
    return cut(rows.sortWithinPartitions("digest"), "lsm-run", BLOOM)


class Index:
    """Levels of (digest, keep_id, size), sorted by digest; older levels first."""

    def __init__(self):
        self.levels: list[DataFrame] = []

    def add(self, runs: DataFrame) -> None:
        """Merge a batch's runs into a new level; too many levels are merged into one."""
        self.levels.append(merge(runs.select("digest", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("size"))))
        if len(self.levels) > FAN:
            self.levels = [merge(_all(self.levels))]

    def lookup(self, runs: DataFrame) -> DataFrame:
        """digest, keep_id, group_size over all levels for the digests of runs."""
        if len(self.levels) == 1:  # the level of the runs themselves
            found = self.levels[0]
        else:
            slot = F.xxhash64("digest")
            wanted = runs.select("digest").distinct().withColumn("slot", slot)
            found = merge(_all([maybe_in(x.withColumn("slot", slot), wanted, "slot").drop("slot").join(wanted.select("digest"), "digest") for x in self.levels]))
        return found.select("digest", "keep_id", F.col("size").alias("group_size"))


def _all(levels: list[DataFrame]) -> DataFrame:
    out = levels[0]
    for x in levels[1:]:
        out = out.unionByName(x)
    return out


def merge(entries: DataFrame) -> DataFrame:
    """One entry for each digest: smallest identifier, all rows; written sorted, with filters."""
    return cut(entries.groupBy("digest").agg(F.min("keep_id").alias("keep_id"), F.sum("size").alias("size")).sortWithinPartitions("digest"), "lsm-level", BLOOM)


def unequal(docs: DataFrame, hits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Digests whose rows differ in bytes (none, unless SHA-256 collides), and the digested texts of all hits.

    min(text) = max(text) within a digest proves that all its texts are equal byte by byte; the partial
    aggregation compares copies inside each task, so a huge group sends one row per task.
    """
    ids = hits.select("doc_id").distinct()
    texts = maybe_in(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")), ids, "doc_id").join(ids, "doc_id")
    hashed = texts.select("doc_id", normalised().alias("body")).withColumn("digest", F.unhex(F.sha2("body", 256)))
    odd = hashed.groupBy("digest").agg(F.min("body").alias("a"), F.max("body").alias("b")).filter("a <> b").select("digest")
    return cut(odd, "lsm-collide"), hashed


def exact_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of docs."""
    runs, index = flush_runs(docs), Index()
    index.add(runs)
    found = runs.join(index.lookup(runs), "digest")
    odd, hashed = unequal(docs, found.filter("group_size > 1 AND doc_id IS NOT NULL"))
    keep, size = F.col("keep_id"), F.col("group_size")
    if not odd.isEmpty():  # rows of colliding digests are grouped anew by their whole text
        split = hashed.join(odd, "digest")
        texts = split.groupBy("digest", "body").agg(F.min("doc_id").alias("own_keep"), F.count(F.lit(1)).alias("own_size"))
        own = split.join(texts, ["digest", "body"]).select("digest", "doc_id", "own_keep", "own_size").distinct()
        found = found.join(own, ["digest", "doc_id"], "left")
        keep, size = F.coalesce("own_keep", "keep_id"), F.coalesce("own_size", "group_size")
    return found.select("doc_id", keep.alias("keep_id"), size.alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def drop_copies(docs: DataFrame) -> DataFrame:
    """One row of each group of equal texts: the one with the smallest doc_id."""
    found = cut_alone(lambda: exact_dedup(docs), "lsm-verdicts")
    rows = docs.withColumn("__digest", F.sha2(normalised(), 256))
    ids = lambda t: t.select(F.col("text_sha256").alias("__gd"), F.col("doc_id").alias("__gid"))
    same = lambda t: (rows["__digest"] == t["__gd"]) & rows["doc_id"].cast("long").eqNullSafe(t["__gid"])
    gone = ids(found.filter("NOT kept")).distinct()
    # several rows under the id that stays
    twins = cut(ids(found.filter("kept AND group_size > 1")).groupBy("__gd", "__gid").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").drop("c"), "lsm-twins")
    if twins.isEmpty():
        return rows.join(gone, same(gone), "left_anti").select(docs.columns)
    others = gone.unionByName(twins)
    single = rows.join(others, same(others), "left_anti")
    return single.select(docs.columns).unionByName(one_of_each(rows.join(twins, same(twins)), ["__gd"], docs.columns))


ORACLE = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, sha256(body) AS text_sha256
FROM t WINDOW w AS (PARTITION BY body)
"""
