"""Ranked lexical search, impact-ordered and score at a time.

One pass over the whole texts leaves, per document, its number of terms and the frequencies of the terms that the
items ask for (written once); document counts and frequencies follow from that table. A second pass goes through it
in blocks of documents. In a block every posting has its exact impact, and postings of equal term and impact stand
together, highest first. For each item the segments of its terms are added to accumulators in descending order of
what they contribute. Before each step the remaining bound is the sum of each term's next contribution: a document
not seen yet can't score more. Accumulation stops only when that bound is below the k-th best score that is already
certain (of this block, or of earlier blocks of the task); the documents that can still reach it then get their
complete scores from their own postings. A task hands on its best k per item, and Spark ranks those.

Items are asked in blocks of bounded size (``ITEMS`` rows, ``ITEM_BYTES`` of text); each block is one scan.

Cases: null texts and texts without a term count neither in N nor in L and are never found; an item without terms
has no rows. Rows, not ids, are documents and items: repeated rows are ranked each on their own, a repeated item
is answered once per row. Equal scores go by ascending doc_id, null last. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import cut, small_batches, tidy, windows

TOP = 20
#: Most items and bytes of their texts that one scan answers.
ITEMS, ITEM_BYTES = 4096, 1 << 22
#: Most postings and documents of a block.
POSTINGS, DOCS = 1_000_000, 65_536
_GAP = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")
_PLAIN = bytes(32 if _GAP.match(bytes([b])) else b + 32 if 65 <= b <= 90 else b for b in range(256))


def terms(raw: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in windows: runs of ASCII letters, digits and all other characters beyond ASCII, A-Z lower-cased."""
    for part in windows(raw, _GAP):
        yield part.translate(_PLAIN).split()


def _postings(vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.value
        for b in batches:
            keep, lengths, off, ids, tfs = [], [], [0], [], []
            for i, text in enumerate(b.column(1).cast(pa.large_binary())):
                found: Counter = Counter()
                for part in terms(text.as_py() or b""):
                    found.update(part)
                if found:
                    keep.append(i)
                    lengths.append(found.total())
                    hits = found.keys() & known.keys()
                    ids += [known[t] for t in hits]
                    tfs += [found[t] for t in hits]
                    off.append(len(ids))
            lists = [pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(v, t)) for v, t in ((ids, pa.int32()), (tfs, pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep, pa.int64())), pa.array(lengths, pa.int64()), *lists], ["doc_id", "n", "terms", "tfs"])

    return run


class _Block:
    """Postings of a block of documents: by term in descending impact, and by document."""

    def __init__(self, n: np.ndarray, count: np.ndarray, term: np.ndarray, tf: np.ndarray, weight: np.ndarray, docs: int, length: int):
        m = 75 + (25 * n * docs) // length
        doc = np.repeat(np.arange(len(n)), count)
        self.first, self.count, self.term = np.cumsum(count) - count, count, term
        self.impact = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[doc]))
        order = np.lexsort((-self.impact, term))
        self.falling, self.doc = -self.impact[order], doc[order]
        self.start = np.searchsorted(term[order], np.arange(len(weight) + 1))
        self.acc = np.zeros(len(n), np.int64)
        self.times = np.zeros(len(weight), np.int64)

    def best(self, ids: np.ndarray, times: np.ndarray, k: int, certain: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents of the block that may be among the best k, with complete scores; certain: a k-th score that k documents are known to reach."""
        at, end = self.start[ids].copy(), self.start[ids + 1]
        self.acc[:] = 0

        def heads() -> np.ndarray:
            return np.where(at < end, -times * self.falling[np.minimum(at, len(self.falling) - 1)], 0)

        ahead = heads() if len(self.falling) else np.zeros(len(ids), np.int64)
        rest, kth = int(ahead.sum()), max(certain, 1)
        while rest and rest >= kth:
            level = max(1, int(ahead.max()) * 3 // 4)
            for j in np.flatnonzero(ahead >= level).tolist():
                lo, hi = int(at[j]), int(end[j])
                to = lo + int(np.searchsorted(self.falling[lo:hi], level // -int(times[j]), "right"))
                self.acc[self.doc[lo:to]] -= times[j] * self.falling[lo:to]
                at[j] = to
            ahead = heads()
            rest = int(ahead.sum())
            if len(self.acc) >= k:
                kth = max(kth, int(np.partition(self.acc, len(self.acc) - k)[len(self.acc) - k]))
        found = np.flatnonzero((self.acc > 0) & (self.acc + rest >= kth))
        count = self.count[found]
        inside = np.repeat(self.first[found] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        self.times[ids] = times
        score = np.zeros(len(found), np.int64)
        np.add.at(score, np.repeat(np.arange(len(found)), count), self.times[self.term[inside]] * self.impact[inside])
        self.times[ids] = 0
        return found, score


def _ranked(asked, weights, docs: int, length: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, items = weights.value, asked.value
        none = np.zeros(0, np.int64)
        tops = [(none, none, np.zeros(0, bool))] * len(items)
        held: list[tuple] = []

        def add() -> None:
            ids, missing, n, count, term, tf = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            block = _Block(n, count, term, tf, weight, docs, length)
            for i, (which, times) in enumerate(items):
                certain = int(tops[i][0][-1]) if len(tops[i][0]) == k else 0
                found, score = block.best(which, times, k, certain)
                if len(found):
                    score, near, null = (np.concatenate(x) for x in zip(tops[i], (score, ids[found], missing[found]), strict=True))
                    first = np.lexsort((near, null, -score))[:k]
                    tops[i] = score[first], near[first], null[first]

        size = 0
        for b in batches:
            lists, tfs = b.column(2), b.column(3)
            off = np.asarray(lists.offsets)
            flat = [np.asarray(x.values)[off[0] : off[-1]].astype(np.int64) for x in (lists, tfs)]
            held.append((np.asarray(b.column(0).fill_null(0)), np.asarray(b.column(0).is_null()), np.asarray(b.column(1)), np.diff(off).astype(np.int64), *flat))
            size += max(len(flat[0]), len(b) * POSTINGS // DOCS)
            if size >= POSTINGS:
                add()
                size = 0
        if held:
            add()
        which = np.repeat(np.arange(len(items)), [len(t[0]) for t in tops])
        score, near, null = (np.concatenate(x) if tops else none for x in zip(*tops, strict=True)) if tops else (none, none, none)
        yield pa.RecordBatch.from_arrays([pa.array(which, pa.int64()), pa.array(near, pa.int64(), mask=null.astype(bool)), pa.array(score, pa.int64())], ["item", "doc_id", "score"])

    return run


def _answer(docs: DataFrame, block: list, k: int) -> DataFrame | None:
    """item (position in block), doc_id, score: the best k of every task."""
    spark = docs.sparkSession
    small_batches(spark)
    bags = [Counter(t for part in terms((text or "").encode()) for t in part) for _, text in block]
    vocabulary = {t: i for i, t in enumerate(dict.fromkeys(t for bag in bags for t in bag))}
    if not vocabulary:
        return None
    sc = spark.sparkContext
    known = sc.broadcast(vocabulary)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    postings = cut(rows.mapInArrow(tidy(_postings(known)), "doc_id long, n long, terms array<int>, tfs array<long>"), "lexical-postings")
    total = postings.agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("length")).first()
    if not total.docs:
        return None
    weight = F.floor(1000 * F.log((F.lit(2 * total.docs + 2).cast("double")) / (2 * F.count(F.lit(1)) + 1).cast("double")))
    weights = np.zeros(len(vocabulary), np.int64)
    for r in postings.select(F.explode("terms").alias("t")).groupBy("t").agg(weight.cast("long").alias("w")).collect():  # at most the block's terms
        weights[r.t] = r.w
    asked = [(np.array([vocabulary[t] for t in bag], np.int64), np.array(list(bag.values()), np.int64)) for bag in bags]
    run = _ranked(sc.broadcast(asked), sc.broadcast(weights), total.docs, total.length, k)
    return postings.mapInArrow(tidy(run), "item long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, top_k: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score: for every row of items (item_id, text) its top_k documents with a score above 0."""
    spark = docs.sparkSession
    found, block, size = [], [], 0

    def flush() -> None:
        nonlocal block, size
        if block and (part := _answer(docs, block, top_k)) is not None:
            names = spark.createDataFrame([(i, r[0]) for i, r in enumerate(block)], "item long, item_id long")
            mine = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
            part = part.withColumn("rank", F.row_number().over(mine)).filter(F.col("rank") <= top_k)
            part = part.join(F.broadcast(names), "item")  # at most ITEMS rows
            found.append(cut(part.select("item_id", "rank", "doc_id", "score"), "lexical-top"))
        block, size = [], 0

    for r in items.select(F.col("item_id").cast("long"), "text").toLocalIterator():
        block.append(r)
        size += len(r[1] or "")
        if len(block) >= ITEMS or size >= ITEM_BYTES:
            flush()
    flush()
    if not found:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return reduce(DataFrame.unionByName, found)


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id,
                  regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS toks
           FROM documents),
q AS (SELECT row_number() OVER () AS i, item_id,
             unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
      FROM benchmark),
n AS (SELECT k, doc_id, len(toks)::BIGINT AS n FROM d WHERE len(toks) > 0),
total AS (SELECT count(*)::BIGINT AS big_n, sum(n)::BIGINT AS l FROM n),
p AS (SELECT k, term, count(*)::BIGINT AS tf FROM (SELECT k, unnest(toks) AS term FROM d) GROUP BY k, term),
w AS (SELECT term, floor(1000 * ln((2 * big_n + 2) / (2 * df + 1)))::BIGINT AS w
      FROM (SELECT term, count(*)::BIGINT AS df FROM p GROUP BY term), total),
imp AS (SELECT p.k, p.term, n.doc_id, w.w * ((1000000000 * p.tf) // (1000 * p.tf + 12 * (75 + (25 * n.n * total.big_n) // total.l))) AS impact
        FROM p JOIN n USING (k) JOIN w USING (term), total),
s AS (SELECT q.i, q.item_id, imp.k, imp.doc_id, sum(imp.impact)::BIGINT AS score FROM q JOIN imp USING (term) GROUP BY ALL),
r AS (SELECT item_id, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id, k)::INTEGER AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 20
"""
