"""Quality classifier by nearest-neighbour voting in a latent-semantic space.

Terms of a text are trigrams of character classes (which catch markup, shouting, symbols and tables in any
language), hashed trigrams of its lower-case bytes, and binned figures of repetition. The term vectors (log
frequency times inverse frequency, unit length) of a bounded sample of labelled documents are decomposed by
a truncated SVD; a document's latent vector is its projection. The labelled vectors are broadcast (at most
SAMPLE rows of RANK numbers) and every document is compared with all of them by blocked matrix products;
the NEIGHBOURS nearest vote for their labels with a power of the cosine as weight.

Cases: null and empty texts have no terms and get the weighted share of label 1 in the sample; labels
without a document or a value are ignored; a document labelled twice counts as 1 if its mean label is at
least one half; without any labels every score is 0.5; texts of any length count as a whole; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import _LOWER, cut, slices, small_batches, tidy, utf8, words

#: Most labelled documents of each label in the sample that the classifier is fitted on, by hash order.
SAMPLE = 1500
RANK = 48
NEIGHBOURS = 15
#: Weight of a neighbour: its cosine to this power.
POWER = 8
THRESHOLD = 0.3
_HASHED = 512
_BINS = 8
# classes: lower, upper, digit, blank, newline, symbol, exclamation, stop, comma, quote and hyphen, bracket, other
_CLASS = np.full(256, 11, np.int64)
for _k, _chars in enumerate(("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n\r\x0b\x0c", "#$%&*@^~|_=+<>\\/", "!", ".?", ",;:", "'\"-`", "()[]{}")):
    _CLASS[[ord(c) for c in _chars]] = _k
_CLASS[128:] = 0
_N = 12
DIM = _N**3 + _HASHED + 3 * _BINS


def term_counts(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Term frequencies of each row: class trigrams, hashed byte trigrams, binned repetition figures."""
    n = len(off) - 1
    lo, hi = int(off[0]), int(off[-1])
    out = np.zeros((n, DIM), np.float32)
    step = 1 << 21
    for a in range(lo, hi, step):  # windows bound the memory of very long texts
        b = min(hi, a + step + 2)
        part = data[a:b]
        row = np.repeat(np.arange(n), np.diff(np.clip(off, a, b)))
        if len(part) < 3:
            continue
        whole = row[:-2] == row[2:]
        c = _CLASS[part]
        out[:, : _N**3] += np.bincount((row[:-2] * _N**3 + c[:-2] * _N * _N + c[1:-1] * _N + c[2:])[whole], minlength=n * _N**3).reshape(n, -1)
        p = _LOWER[part].astype(np.uint32)
        t = (p[:-2] * np.uint32(0x9E3779B1) + p[1:-1] * np.uint32(0x85EBCA6B) + p[2:] * np.uint32(0xC2B2AE35)) >> np.uint32(23)
        out[:, _N**3 : _N**3 + _HASHED] += np.bincount((row[:-2] * _HASHED + t)[whole], minlength=n * _HASHED).reshape(n, -1)
    row, h = words(data, off)
    count = np.bincount(row, minlength=n)
    slot = (h >> np.uint64(52)).astype(np.int64)
    seen = np.zeros((n, 4096), bool)
    seen[row, slot] = True
    kinds = seen.sum(axis=1) / np.clip(4096 * (1 - np.exp(-count / 4096)), 1, None)
    again = np.zeros(n)
    if len(h) > 1:
        again += np.bincount(row[1:], weights=(h[1:] == h[:-1]) & (row[1:] == row[:-1]), minlength=n)
    length = np.diff(off) / np.clip(count, 1, None)
    some = np.flatnonzero(count)
    for k, x in enumerate((kinds, again / np.clip(count, 1, None), np.clip(length / 16, 0, 1))):
        at = np.clip((x * _BINS).astype(int), 0, _BINS - 1)
        out[some, _N**3 + _HASHED + k * _BINS + at[some]] = 1
    return out


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Log frequencies times idf; each of the three families has a length of its own share."""
    x = np.log1p(counts) * idf
    for a, b, share in ((0, _N**3, 1.0), (_N**3, _N**3 + _HASHED, 0.4), (_N**3 + _HASHED, DIM, 0.7)):
        x[:, a:b] *= share / np.maximum(np.linalg.norm(x[:, a:b], axis=1, keepdims=True), 1e-9)
    return x


class Model:
    """Inverse frequencies, projection and labelled latent vectors."""

    def __init__(self, counts: np.ndarray, labels: np.ndarray):
        self.labels = labels.astype(np.float32)
        self.prior = float(self.labels.mean()) if len(labels) else 0.5
        self.idf = np.log((1 + len(counts)) / (1 + (counts > 0).sum(axis=0))).astype(np.float32) + np.float32(0.1)
        x = weighted(counts, self.idf)
        rank = min(RANK, *x.shape) if len(x) else 0
        if not rank:
            self.v, self.vectors = np.zeros((DIM, 1), np.float32), np.zeros((0, 1), np.float32)
            return
        # randomised range finder with fixed seed, then an exact SVD of the small matrix
        q = np.random.default_rng(5).standard_normal((x.shape[1], rank + 8)).astype(np.float32)
        for _ in range(4):
            q, _r = np.linalg.qr(x.T @ (x @ q))
        _u, _s, vt = np.linalg.svd(x @ q, full_matrices=False)
        self.v = (q @ vt[:rank].T).astype(np.float32)
        self.vectors = self.unit(x @ self.v)

    @staticmethod
    def unit(z: np.ndarray) -> np.ndarray:
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)

    def score(self, counts: np.ndarray) -> np.ndarray:
        if not len(self.vectors):
            return np.full(len(counts), self.prior)
        z = self.unit(weighted(counts, self.idf) @ self.v)
        cos = z @ self.vectors.T
        k = min(NEIGHBOURS, cos.shape[1])
        near = np.argpartition(-cos, k - 1, axis=1)[:, :k]
        w = np.clip(np.take_along_axis(cos, near, axis=1), 0, 1).astype(float) ** POWER
        y = self.labels[near]
        total = w.sum(axis=1)
        s = np.where(total > 1e-12, (w * y).sum(axis=1) / np.maximum(total, 1e-12), self.prior)
        return np.where(counts.any(axis=1), np.clip(s, 0, 1), self.prior)


def sample(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """doc_id, y, text of at most ``most`` labelled documents of each label."""
    y = labels.filter("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.when(F.avg("quality") >= 0.5, 1).otherwise(0).alias("y"))
    y = y.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    parts = [y.filter(F.col("y") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for k in (0, 1)]
    chosen = cut(parts[0].unionByName(parts[1]), "quality-sample")
    # at most 2 * most rows of two numbers: small whatever the input
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"])


def fit(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Model:
    """Fit on a bounded sample; its term vectors (not its texts) come to the driver."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            data, off = utf8(t.column(2))
            for lo, hi in slices(off, 1 << 20):
                c = term_counts(data, off[lo : hi + 1])
                yield pa.RecordBatch.from_arrays([t.column(0).slice(lo, hi - lo), t.column(1).slice(lo, hi - lo), pa.array([np.minimum(r, 65504).astype(np.float16).tobytes() for r in c], pa.binary())], ["doc_id", "y", "c"])

    rows = sorted(sample(docs, labels, most).selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "y", "text").mapInArrow(tidy(run), "doc_id long, y int, c binary").collect())
    counts = np.frombuffer(b"".join(bytes(r.c) for r in rows), np.float16).reshape(-1, DIM).astype(np.float32)
    return Model(counts, np.array([r.y for r in rows]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted for every row."""
    small_batches(docs.sparkSession)
    given = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = given.value
        for t in batches:
            data, off = utf8(t.column(1))
            for lo, hi in slices(off, 1 << 20):
                s = np.concatenate([m.score(term_counts(data, off[k : min(k + 512, hi) + 1])) for k in range(lo, hi, 512)])
                yield pa.RecordBatch.from_arrays([t.column(0).slice(lo, hi - lo), pa.array(s, pa.float64()), pa.array((s >= THRESHOLD).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "text").mapInArrow(tidy(run), "doc_id long, score double, predicted int")


def keep_good(docs: DataFrame, model: Model) -> DataFrame:
    """docs without the rows that the classifier rejects."""
    small_batches(docs.sparkSession)
    given = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = given.value
        for t in batches:
            data, off = utf8(t.column(at))
            s = [m.score(term_counts(data, off[k : min(k + 512, hi) + 1])) for lo, hi in slices(off, 1 << 20) for k in range(lo, hi, 512)]
            if s:
                yield t.filter(pa.array(np.concatenate(s) >= THRESHOLD))

    return docs.mapInArrow(tidy(run), docs.schema)
