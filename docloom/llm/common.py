"""Helpers that the corpus operators share: tables cut to the shared folder, and text as byte arrays."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextvars import ContextVar
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts: U+0020 and U+0009 to U+000D.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
#: Most rows and bytes of one Arrow batch.
ARROW_ROWS = 2048
ARROW_BYTES = "8m"
_own: dict[str, str] = {}
#: Folders of the tables cut since the innermost ``cut_alone`` began.
_made: ContextVar[list[str] | None] = ContextVar("made", default=None)
#: Shuffle files go when the query that wrote them ends, instead of when the driver happens to collect its garbage.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


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


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/docloom-{spark.sparkContext.applicationId}"


def clear(spark: SparkSession) -> None:
    """Delete every table that this application has cut; results that still read them must have been written before."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame, label: str, options: dict[str, str] | None = None) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: a cut of lineage that outlives executors."""
    return cut_at(df, label, options)[0]


def cut_at(df: DataFrame, label: str, options: dict[str, str] | None = None) -> tuple[DataFrame, str]:
    """As ``cut``, with the folder of the table."""
    spark = df.sparkSession
    path = f"{_folder(spark)}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(SHUFFLES_GO, "false")
    spark.conf.set(SHUFFLES_GO, "true")  # the table is what later reads need
    try:
        df.write.options(compression="zstd", **options or {}).parquet(path)
    finally:
        spark.conf.set(SHUFFLES_GO, before)
    if (made := _made.get()) is not None:
        made.append(path)
    return spark.read.schema(df.schema).parquet(path), path


def cut_alone(make: Callable[[], DataFrame], label: str) -> DataFrame:
    """As ``cut`` of make(), with all tables deleted that make() has cut on the way: nothing else may read them."""
    return cut_alone_at(make, label)[0]


def cut_alone_at(make: Callable[[], DataFrame], label: str) -> tuple[DataFrame, str]:
    """As ``cut_alone``, with the folder of the table."""
    made: list[str] = []
    token = _made.set(made)
    try:
        df = make()
    finally:
        _made.reset(token)
    out = cut_at(df, label)
    for path in made:
        remove(df.sparkSession, path)
    return out


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table that ``cut_at`` wrote and nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that workers need no installation of it."""
    if _own.get("shipped") != spark.sparkContext.applicationId:
        root = Path(__file__).resolve().parent.parent
        path = Path(tempfile.mkdtemp(prefix="docloom-code-")) / f"{root.name}.zip"
        with zipfile.ZipFile(path, "w") as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f"{root.name}/{f.relative_to(root)}")
        spark.sparkContext.addPyFile(str(path))
        _own["shipped"] = spark.sparkContext.applicationId


def small_batches(spark: SparkSession) -> None:
    """Whole texts can be long: a bound on the bytes of an Arrow batch bounds a Python worker's memory."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)


def tidy(run):
    """A mapInArrow function that gives memory back when its task ends: workers are reused, and what one holds counts against its executor."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # not every C library has it
                ctypes.CDLL(None).malloc_trim(0)

    return wrapped


#: Bits of the filter of ``maybe_in``, and bits of one of its bitmaps.
FILTER_BITS, BITMAP = 1 << 22, 32_768


def maybe_in(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """rows whose key (a long column of both) may be among keys: a join after it finds the same rows, but moves fewer.

    A bitmap of fixed size (half a megabyte, whatever the number of keys) is broadcast; a full one only lets more rows through.
    """
    bit = F.pmod(F.xxhash64(key), F.lit(FILTER_BITS))
    bits = keys.select(F.floor(bit / BITMAP).alias("__map"), F.pmod(bit, F.lit(BITMAP)).alias("__at")).groupBy("__map").agg(F.bitmap_construct_agg("__at").alias("__bits"))
    at = F.pmod(bit, F.lit(BITMAP))
    byte = F.conv(F.hex(F.col("__bits").substr((F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    hit = F.floor(byte / F.pow(F.lit(2), F.pmod(at, F.lit(8)))).cast("int") % 2 == 1
    return rows.withColumn("__map", F.floor(bit / BITMAP)).join(F.broadcast(bits), "__map").filter(hit).select(rows.columns)


def row_key(docs: DataFrame) -> Column:
    """Hash of doc_id and text: tells rows apart that share an id, or have none."""
    return F.xxhash64(F.col("doc_id").cast("long"), "text")


def one_of_each(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """One row for each value of ``keys`` (null is a value), the same at every run: the one whose columns hash lowest."""
    whole = F.struct(*[F.col(f"`{c}`") for c in columns])
    first = F.min_by(whole, F.xxhash64(F.to_json(whole)))
    return rows.groupBy(*keys).agg(first.alias("__row")).select(*[F.col(f"__row.`{c}`").alias(c) for c in columns])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(col: str, n: int):
    """crc32 of the id as text, modulo n; null ids count as the text ''."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % n


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than rows) of a string column; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col.cast(pa.large_string()), "")
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    data = np.frombuffer(col.buffers()[2], np.uint8) if len(col) and col.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data, off


def slices(off: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes each, single longer rows alone."""
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + most, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def windows(raw: bytes, gap: re.Pattern, most: int = 1 << 22) -> Iterator[bytes]:
    """raw in parts of about ``most`` bytes, cut where ``gap`` (a pattern of one byte) matches, so that no word is cut."""
    lo = 0
    while len(raw) - lo > most and (m := gap.search(raw, lo + most)):
        yield raw[lo : m.start()]
        lo = m.start()
    yield raw[lo:] if lo else raw


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (invertible)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def stream(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random odd 64-bit numbers."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


_R = stream(4096, 7)
_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _words(data: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each word of data; first marks bytes at which a text begins."""
    global _R
    solid = ~_BLANK[data]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1] | first[1:]
    at = np.flatnonzero(solid)
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    heads = np.flatnonzero(begins[at])
    lengths = np.diff(np.append(heads, len(at)))
    if (longest := int(lengths.max())) > len(_R):
        _R = stream(2 * longest, 7)
    inside = np.arange(len(at)) - np.repeat(heads, lengths)
    terms = (data[at].astype(np.uint64) + np.uint64(1)) * _R[inside]
    return at[heads], mix(np.add.reduceat(terms, heads) + lengths.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def words(data: np.ndarray, off: np.ndarray, lower: bool = True, window: int = 1 << 21) -> tuple[np.ndarray, np.ndarray]:
    """Row number and hash of each word in rows bounded by off; long rows go through in windows cut at white space."""
    base, end = int(off[0]), int(off[-1])
    rows, hashes, lo = [], [], base
    marks = np.unique(off[:-1])
    while lo < end:
        hi = min(end, lo + window)
        if hi < end:
            gap = np.flatnonzero(_BLANK[data[lo:hi]])
            while not len(gap) and hi < end:
                more = min(end, hi + window)
                gap = np.flatnonzero(_BLANK[data[hi:more]]) + (hi - lo)
                hi = more
            hi = lo + int(gap[-1]) + 1 if len(gap) else end
        part = data[lo:hi]
        first = np.zeros(len(part) + 1, bool)
        inner = marks[(marks >= lo) & (marks < hi)] - lo
        first[inner] = True
        starts, h = _words(_LOWER[part] if lower else part, first[:-1])
        rows.append(np.searchsorted(off, starts + lo, "right") - 1)
        hashes.append(h)
        lo = hi
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(rows), np.concatenate(hashes)
