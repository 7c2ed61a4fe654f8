"""WARC fixity audit with Merkle trees.

Pages become WARC records, dealt by a digest of their id (where it is null, of the record) to archive files of
bounded length; in a file the records stand in id order at known offsets. ``read_archive`` reads such files, plain or
compressed record by record, back into records with their offsets. Each record's bytes are hashed; every FAN neighbouring digests and
their offset range are hashed into a node, level by level, to one root per file. Two replicas are compared by
root; of unequal nodes only the children are looked at, down to the records, so intact branches are never read
below the node that proves them.

Cases: null url and html count as empty, a null id as an empty id; pages that are equal in all columns are
records of their own and stand next to each other (a file of one page repeated without end is as long as its
repetitions); an empty table gives an empty result; a record or node that only one replica has is a mismatch; other
columns are ignored. Trees are as high as the longest file needs. The reader raises ValueError for a broken head or
a record cut short.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.llm.common import cut

#: Children of a node, and the mean number of records in a file.
FAN, FILE_RECORDS = 16, 1024
#: Date that records made of pages carry.
DATE = "2024-01-01T00:00:00Z"


def records(pages: DataFrame, files: int) -> DataFrame:
    """file, position, page_id, offset, length, body: the WARC records of pages in file order."""
    page_id = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    url, html = F.coalesce("url", F.lit("")), F.coalesce("html", F.lit(""))
    head = F.concat(
        F.lit(f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Date: {DATE}\r\nWARC-Record-ID: <urn:page:"), page_id, F.lit(">\r\nWARC-Target-URI: "), url,
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(html).cast("string"), F.lit("\r\n\r\n"),
    )
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.encode(F.concat(head, html, F.lit("\r\n\r\n")), "utf-8").alias("body"))
    rows = rows.withColumn("hex", F.sha2("body", 256)).withColumn("length", F.octet_length("body").cast("long"))
    number = F.conv(F.substring(F.md5(F.coalesce(F.col("page_id").cast("string"), F.col("hex"))), 1, 8), 16, 10).cast("long")
    return rows.select(F.pmod(number, F.lit(files)).alias("file"), "page_id", "length", F.unhex("hex").alias("digest"), "body")


def leaves(rows: DataFrame) -> DataFrame:
    """file, position, page_id, begin, end, digest of each record; bodies are hashed before the shuffle and don't move."""
    order = W.partitionBy("file").orderBy("page_id", "digest")
    rows = rows.select("file", "page_id", "length", "digest").withColumn("position", F.row_number().over(order) - 1)
    end = F.sum("length").over(order.rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn("end", end).select("file", "position", "page_id", (F.col("end") - F.col("length")).alias("begin"), "end", "digest")


def node_digest(begin: Column, end: Column, content: Column) -> Column:
    """Digest of an offset range and what lies in it."""
    return F.unhex(F.sha2(F.concat(begin.cast("string").cast("binary"), F.lit(b"-"), end.cast("string").cast("binary"), F.lit(b":"), content), 256))


def height(*replicas: DataFrame) -> int:
    """Levels that the longest file needs over its records."""
    longest = max((r.agg(F.max("position")).first()[0] or 0) for r in replicas) + 1
    levels = 1
    while FAN**levels < longest:
        levels += 1
    return levels


def tree(rows: DataFrame, levels: int) -> list[DataFrame]:
    """Levels of nodes (file, position, begin, end, digest), records first, roots last."""
    level = rows.select("file", "position", "begin", "end", node_digest(F.col("begin"), F.col("end"), F.col("digest")).alias("digest"))
    out = [level]
    for _ in range(levels):
        groups = level.groupBy("file", F.floor(F.col("position") / FAN).alias("position")).agg(
            F.min("begin").alias("begin"), F.max("end").alias("end"), F.sort_array(F.collect_list(F.struct("position", "digest"))).alias("kids")
        )
        joined = F.aggregate("kids", F.lit(b""), lambda a, x: F.concat(a, x["digest"]))
        level = cut(groups.select("file", "position", "begin", "end", node_digest(F.col("begin"), F.col("end"), joined).alias("digest")), "warc-nodes")
        out.append(level)
    return out


def descend(a: list[DataFrame], b: list[DataFrame]) -> tuple[DataFrame, list[DataFrame]]:
    """Records (file, position) under mismatching nodes only, and the mismatching nodes of each level from the roots down."""
    suspects, trail = None, []
    for x, y in zip(reversed(a), reversed(b), strict=True):
        one = lambda t, k: t.select("file", "position", F.col("digest").alias(k))
        x, y = one(x, "da"), one(y, "db")
        if suspects is not None:
            x, y = (t.withColumn("up", F.floor(F.col("position") / FAN)).join(suspects, ["file", "up"], "left_semi").drop("up") for t in (x, y))
        odd = x.join(y, ["file", "position"], "full").filter(~F.col("da").eqNullSafe(F.col("db"))).select("file", "position")
        trail.append(odd)
        suspects = odd.select("file", F.col("position").alias("up"))
    return odd, trail


def audit(left: DataFrame, right: DataFrame) -> DataFrame:
    """file, position, page_id, begin, end, root_equal, intact, digest_a, digest_b for every record of both replicas.

    left and right have the columns of ``records``; corruption is found by descending, not by comparing all records.
    """
    x, y = cut(leaves(left), "warc-a"), cut(leaves(right), "warc-b")
    levels = height(x, y)
    a, b = tree(x, levels), tree(y, levels)
    odd, trail = descend(a, b)
    odd = odd.withColumn("odd", F.lit(True))
    both = x.join(y.select("file", "position", F.col("page_id").alias("page_b"), F.col("begin").alias("begin_b"), F.col("end").alias("end_b"), F.col("digest").alias("digest_b")), ["file", "position"], "full")
    bad_files = trail[0].select("file").distinct().withColumn("bad", F.lit(True))
    out = both.join(odd, ["file", "position"], "left").join(bad_files, "file", "left")
    return out.select(
        "file", "position", F.coalesce("page_id", "page_b").alias("page_id"), F.coalesce("begin", "begin_b").alias("begin"), F.coalesce("end", "end_b").alias("end"),
        F.col("bad").isNull().alias("root_equal"), F.col("odd").isNull().alias("intact"), F.lower(F.hex("digest")).alias("digest_a"), F.lower(F.hex("digest_b")).alias("digest_b"),
    )


def worn(rows: DataFrame, every: int) -> DataFrame:
    """A replica in which one byte in the middle of every record whose id hash is a multiple of ``every`` has changed to '#' (or '*')."""
    hit = F.pmod(F.conv(F.substring(F.md5(F.concat(F.lit("wear"), F.coalesce(F.col("page_id").cast("string"), F.lit("")))), 1, 8), 16, 10).cast("long"), F.lit(every)) == 0
    half = F.floor(F.col("length") / 2).cast("int")
    # substring and concat work on the bytes
    byte = F.expr("substring(body, CAST(floor(length / 2) AS INT) + 1, 1)")
    put = F.when(byte == F.lit(b"#"), F.lit(b"*")).otherwise(F.lit(b"#"))
    changed = F.concat(F.col("body").substr(F.lit(1), half), put, F.expr("substring(body, CAST(floor(length / 2) AS INT) + 2)"))
    rows = rows.withColumn("body", F.when(hit, changed).otherwise(F.col("body")))
    return rows.withColumn("digest", F.unhex(F.sha2("body", 256)))


def audit_pages(pages: DataFrame, every: int = 97) -> DataFrame:
    """The audit of the archive of pages against a replica with planted wear."""
    files = max(1, -(-pages.count() // FILE_RECORDS))
    rows = records(pages, files)
    return audit(rows, worn(rows, every))


def parse_records(data: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """Offset, length, head fields (lower-case names) and block of each record in the bytes of a plain archive."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        head = data[at:end].decode("utf-8", "replace").split("\r\n")
        if end < 0 or not head[0].startswith("WARC/"):
            raise ValueError(f"no record at {at}")
        fields: dict[str, str] = {}
        name = ""
        for line in head[1:]:
            if line[:1] in " \t" and name:  # a folded line
                fields[name] += " " + line.strip()
            else:
                name, _, value = line.partition(":")
                name = name.strip().lower()
                fields[name] = value.strip()
        size = int(fields.get("content-length", "-1"))
        after = end + 4 + size
        if size < 0 or data[after : after + 4] != b"\r\n\r\n":
            raise ValueError(f"broken record at {at}")
        yield at, after + 4 - at, fields, data[end + 4 : after]
        at = after + 4


def _members(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """Offset, length and content of the members of a compressed archive; a plain one is a single member."""
    if data[:2] != b"\x1f\x8b":
        yield 0, len(data), data
        return
    at = 0
    while at < len(data):
        z = zlib.decompressobj(31)
        plain = z.decompress(data[at:]) + z.flush()
        if not z.eof:
            raise ValueError(f"broken member at {at}")
        yield at, len(data) - at - len(z.unused_data), plain
        at = len(data) - len(z.unused_data)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """path, position, begin, end, digest, type, date, record_id, target_uri, block of every record of the files under path.

    Offsets are those of the stored bytes: of the member in a file compressed record by record.
    """
    names = ["path", "position", "begin", "end", "digest", "type", "date", "record_id", "target_uri", "block"]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], schema=kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            for file, data in zip(t.column(0).to_pylist(), t.column(1).to_pylist(), strict=True):
                n, rows = 0, []
                for begin, length, plain in _members(data):
                    single = plain is not data
                    for at, size, head, block in parse_records(plain):
                        start, stop = (begin, begin + length) if single else (at, at + size)
                        field = [head.get(k) for k in ("warc-type", "warc-date", "warc-record-id", "warc-target-uri")]
                        rows.append((file, n, start, stop, hashlib.sha256(plain[at : at + size]).digest(), *field, block))
                        n += 1
                    if len(rows) >= 256:
                        yield batch(rows)
                        rows = []
                if rows:
                    yield batch(rows)

    text, number = pa.string(), pa.int64()
    kinds = pa.schema(list(zip(names, (text, number, number, number, pa.binary(), text, text, text, text, pa.binary()), strict=True)))
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "path string, position long, begin long, end long, digest binary, type string, date string, record_id string, target_uri string, block binary")


ORACLE = r"""
WITH p AS (
  SELECT page_id::BIGINT AS page_id, encode('WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10)
      || 'WARC-Date: 2024-01-01T00:00:00Z' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:'
      || coalesce(page_id::VARCHAR, '') || '>' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10)
      || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || octet_length(encode(coalesce(html, '')))::VARCHAR
      || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10)) AS body,
    ('0x' || substr(md5('wear' || coalesce(page_id::VARCHAR, '')), 1, 8))::BIGINT % 97 = 0 AS hit FROM pages),
h AS (SELECT *, ('0x' || substr(md5(coalesce(page_id::VARCHAR, sha256(body))), 1, 8))::BIGINT % greatest(1, ceil((SELECT count(*) FROM pages) / 1024.0)::BIGINT) AS file,
    octet_length(body) AS length, hex(body) AS x, octet_length(body) // 2 AS half FROM p),
w AS (SELECT *, CASE WHEN hit THEN substr(x, 1, 2 * half) || CASE WHEN substr(x, 2 * half + 1, 2) = '23' THEN '2A' ELSE '23' END || substr(x, 2 * half + 3) ELSE x END AS y FROM h),
d AS (SELECT *, sha256(unhex(x)) AS digest_a, sha256(unhex(y)) AS digest_b FROM w),
r AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY page_id, digest_a) - 1 AS position,
             sum(length) OVER (PARTITION BY file ORDER BY page_id, digest_a ROWS UNBOUNDED PRECEDING) AS e FROM d)
SELECT file, position, page_id, (e - length)::BIGINT AS "begin", e::BIGINT AS "end", bool_and(digest_a = digest_b) OVER (PARTITION BY file) AS root_equal,
       digest_a = digest_b AS intact, digest_a, digest_b FROM r
"""
