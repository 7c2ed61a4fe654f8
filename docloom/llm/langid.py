"""Language identification by string kernels.

The kernel of two strings is the number of letter n-grams (n = 1 to 4, blended) present in both, divided by the
geometric mean of their own numbers. Presence of n-grams fills up as a string grows, so a text is the set of its
windows of WINDOW characters: its kernel with a string is the mean over its windows, weighted by their letters, and
keeps its contrast in texts of any length. Windows of a bounded sample of labelled texts are drawn per language;
some of them are the landmarks of a Nyström approximation, on whose features one kernel ridge regression per
language (one versus rest) is fitted. Every window is scored by batched matrix products: presence matrix times
landmark matrix, times the folded regression weights; a text's score is the mean of its windows'.

Presence is kept in SLOTS hashed places; a window holds some 2,000 different n-grams, so about one in eight is filled.

Cases: a text that is null or without a letter gets ``und`` and score 0; case is folded and anything that
isn't a letter separates; texts of any length count as a whole; if no labelled text exists all are ``und``; a
tie goes to the language that sorts first; more than SAMPLE languages are refused; equal texts get equal results;
repeated rows of the sample count once; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.llm.common import cut, small_batches, tidy

#: Labelled texts drawn of each language (by hash order), how many windows of them are landmarks, and windows drawn of a text.
PER_LANGUAGE, LANDMARKS, PER_TEXT = 300, 32, 3
#: Labelled texts drawn in all, and landmarks in all: with very many languages each gets fewer.
SAMPLE, MOST_LANDMARKS = 6_000, 2_048
RIDGE = 1e-2
NGRAMS = (1, 2, 3, 4)
SLOTS = 1 << 14
WINDOW = 2048
#: Windows scored at once.
BATCH = 256
_MUL = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35), np.uint32(0x27D4EB2F))


def _letters() -> np.ndarray:
    """For each code point the lower-case letter, or 32."""
    t = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        s = chr(c)
        if s.isalpha():
            low = s.lower()
            t[c] = ord(low) if len(low) == 1 else c
    return t


_TABLE: list[np.ndarray] = []


def windows(text: str) -> list[str]:
    """The text in pieces of WINDOW characters; each takes along what the last n-grams of the one before need."""
    return [text[max(0, k - max(NGRAMS) + 1) : k + WINDOW] for k in range(0, len(text), WINDOW)]


def presence(parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """0/1 matrix of the hashed n-grams that each string holds, and the letters of each; n-grams don't span more than one gap."""
    if not _TABLE:
        _TABLE.append(_letters())
    out = np.zeros((len(parts), SLOTS), bool)
    p = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)
    row = np.repeat(np.arange(len(parts)), [len(s) for s in parts])
    if not len(p):
        return out, np.zeros(len(parts))
    p = _TABLE[0][p]
    keep = (p != 32) | np.append(True, (p[:-1] != 32) | (row[1:] != row[:-1]))  # one blank for a run
    p, row = p[keep], row[keep]
    for n in NGRAMS:
        if len(p) < n:
            break
        m = len(p) - n + 1
        h = np.full(m, n * 0x632BE5AB & 0xFFFFFFFF, np.uint32)
        for k in range(n):
            h = (h ^ p[k : k + m]) * _MUL[k]
            h ^= h >> np.uint32(15)
        ok = row[:m] == row[n - 1 :]
        if n == 1:
            ok &= p != 32
        out[row[:m][ok], (h & np.uint32(SLOTS - 1))[ok]] = True
    letters = np.bincount(row, weights=p != 32, minlength=len(parts))
    out[letters == 0] = False
    return out, letters


class Model:
    """Landmarks and folded regression weights."""

    def __init__(self, x: np.ndarray, langs: list[str]):
        self.langs = sorted(set(langs))
        y = np.array([self.langs.index(s) for s in langs], int)
        most = max(1, min(LANDMARKS, MOST_LANDMARKS // max(1, len(self.langs))))
        pick = np.array([i for k in range(len(self.langs)) for i in np.flatnonzero(y == k)[:most]], int)
        self.marks = x[pick].astype(np.float32)
        self.own = np.sqrt(np.maximum(self.marks.sum(axis=1), 1))
        if not len(pick):
            self.beta = np.zeros((0, 0), np.float32)
            return
        k_mm = self.kernel(x[pick]).astype(float)
        values, vectors = np.linalg.eigh(k_mm)
        root = vectors / np.sqrt(np.maximum(values, 1e-6))  # features of a string: kernel row times this
        z = np.concatenate([self.kernel(x[k : k + BATCH]) for k in range(0, len(x), BATCH)]).astype(float) @ root
        # rows of a language weigh alike in sum
        w = np.array([1.0 / (y == k).sum() for k in range(len(self.langs))])[y][:, None]
        target = np.where(y[:, None] == np.arange(len(self.langs))[None, :], 1.0, 0.0)
        fit = np.linalg.solve(z.T @ (w * z) + RIDGE * np.eye(z.shape[1]), z.T @ (w * target))
        self.beta = (root @ fit).astype(np.float32)

    def kernel(self, x: np.ndarray) -> np.ndarray:
        """Normalised presence kernel of rows with the landmarks."""
        f = x.astype(np.float32)
        return (f @ self.marks.T) / np.sqrt(np.maximum(f.sum(axis=1), 1))[:, None] / self.own[None, :]

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text: the mean over its windows, weighted by letters."""
        if not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts))
        total, letters = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts))
        rows: list[int] = []
        parts: list[str] = []

        def flush() -> None:
            x, n = presence(parts)
            np.add.at(total, rows, (self.kernel(x) @ self.beta) * n[:, None])
            np.add.at(letters, rows, n)
            rows.clear()
            parts.clear()

        for i, t in enumerate(texts):
            for part in windows(t):
                rows.append(i)
                parts.append(part)
                if len(parts) >= BATCH:
                    flush()
        flush()
        s = total / np.maximum(letters, 1)[:, None]
        best = s.argmax(axis=1)
        return [self.langs[b] if n else "und" for b, n in zip(best.tolist(), letters.tolist(), strict=True)], np.where(letters > 0, np.clip(s.max(axis=1), 0, 1), 0.0).astype(float)


def sample(docs: DataFrame, per_language: int = PER_LANGUAGE, most: int = SAMPLE) -> DataFrame:
    """doc_id, lang of at most ``per_language`` labelled rows of each language, and ``most`` in all."""
    ids = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "lang", F.xxhash64("doc_id").alias("h"))
    # parts of a language are cut to size first, so that a language of all rows is no single task
    part = F.row_number().over(W.partitionBy("lang", F.pmod("h", F.lit(64))).orderBy("h", "doc_id"))
    ids = cut(ids.withColumn("turn", part).filter(F.col("turn") <= per_language).select("doc_id", "lang", "h").distinct(), "langid-parts")
    kinds = ids.agg(F.count_distinct("lang")).first()[0]
    if kinds > most:
        raise ValueError(f"{kinds} languages, at most {most} can be learned")
    each = min(per_language, most // max(1, kinds))
    first = F.row_number().over(W.partitionBy("lang").orderBy("h", "doc_id"))
    return cut(ids.withColumn("turn", first).filter(F.col("turn") <= each).select("doc_id", "lang"), "langid-sample")


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """Fit on (doc_id, text, lang) rows; of each language a bounded number of texts is drawn, of each text PER_TEXT windows at most."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            rows = []
            for doc_id, lang, text in zip(*(c.to_pylist() for c in t.columns), strict=True):
                parts = windows(text or "")
                x, letters = presence(parts[:: -(-len(parts) // PER_TEXT)] if parts else [])
                rows += [(doc_id, k, lang, np.packbits(r).tobytes()) for k, (r, n) in enumerate(zip(x, letters, strict=True)) if n]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.string(), pa.binary()), strict=True)], ["doc_id", "k", "lang", "x"])

    # at most SAMPLE pairs of an id and a language: small whatever the input
    texts = docs.join(F.broadcast(sample(docs, per_language)), ["doc_id", "lang"], "left_semi").selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "lang", "text")
    rows = sorted(set(map(tuple, texts.mapInArrow(tidy(run), "doc_id long, k int, lang string, x binary").distinct().collect())))
    order = sorted(rows, key=lambda r: (r[1], r[0]))  # landmarks come from first windows
    x = np.array([np.unpackbits(np.frombuffer(bytes(r[3]), np.uint8)) for r in order], bool).reshape(len(order), SLOTS)
    return Model(x, [r[2] for r in order])


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score for every row."""
    small_batches(docs.sparkSession)
    given = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            for lo in range(0, t.num_rows, 512):
                part = t.slice(lo, 512)
                langs, s = given.value.predict([x or "" for x in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(langs, pa.string()), pa.array(s, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "text").mapInArrow(tidy(run), "doc_id long, lang_pred string, score double")
