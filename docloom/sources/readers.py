"""Readers: text files with unknown encoding, JSON lines, evaluation cases, XML word-processor archives, spreadsheets."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from docloom.functions import text as T

# fixed values: levels of numbered headings (any other is of level 4) and of paragraph styles, and kinds of paragraphs
HEADING = r"^제\s*\d+\s*(장|절|조|항)"
LEVELS = {"장": 1, "절": 2, "조": 3, "항": 4}
PLAIN_LEVEL, DEEPEST = 4, 6
STYLE = re.compile(r"(?:heading|제목|개요)\s*([1-6])?", re.IGNORECASE)
KINDS = (("exception", "(다만|제외|예외|불구하고)"), ("condition", "(경우|때|요건|조건|한하여)"), ("definition", "(이란|란\\s|이라 함은|정의한다)"))
# fixed values: encodings in the order they are tried
ENCODINGS = ("utf-8-sig", "utf-8", "cp949", "euc-kr")
BATCH = 16


def decode(raw: bytes) -> tuple[str, str]:
    """Text and the first encoding that fits; else UTF-8 with replacements."""
    for e in ENCODINGS:
        try:
            return raw.decode(e), e
        except UnicodeDecodeError:
            continue
    return raw.decode("utf-8", "replace"), "replace"


def parse_texts(files: DataFrame) -> DataFrame:
    """path, text, encoding of files (path, content)."""
    files.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "16m")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            found = [decode(bytes(c)) for c in pdf["content"]]
            yield pd.DataFrame({"path": pdf["path"], "text": [t for t, _ in found], "encoding": [e for _, e in found]})

    return files.select("path", "content").mapInPandas(run, "path string, text string, encoding string")


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """path, text, encoding of every file under path."""
    return parse_texts(spark.read.format("binaryFile").load(path))


def parse_lines(lines: DataFrame, schema: str) -> DataFrame:
    """Lines (value) of JSON as the schema's columns and ``bad`` (the line, where it holds no object); an array of objects gives a row each."""
    body = F.trim("value")
    one = F.from_json(body, f"{schema}, __bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"})
    many = F.from_json(body, f"array<struct<{schema}>>", {"mode": "PERMISSIVE"})
    names = list(StructType.fromDDL(schema).names)
    row = lambda s, bad: F.struct(*[s[n].alias(n) for n in names], bad.alias("bad"))
    none = F.lit(None).cast("string")
    parsed = lines.filter(body != "").select(body.alias("value"), one.alias("one"), F.when(body.startswith("["), many).alias("many"))
    broken = F.when(~F.col("value").startswith("{") | F.col("one.__bad").isNotNull(), F.col("value"))
    items = F.when(F.col("many").isNotNull(), F.transform("many", lambda x: row(x, none))).otherwise(F.array(row(F.col("one"), broken)))
    return parsed.select(F.explode(items).alias("r")).select("r.*")


def read_jsonl(spark: SparkSession, path: str, schema: str, order: str, limit: int) -> tuple[DataFrame, DataFrame]:
    """The newest ``limit`` rows, and the malformed lines; every line is parsed by the same expression."""
    rows = parse_lines(spark.read.text(path), schema)
    return rows.filter("bad IS NULL").drop("bad").orderBy(F.col(order).desc()).limit(limit), rows.filter("bad IS NOT NULL").select(F.col("bad").alias("value"))


def parse_cases(lines: DataFrame, schema: str) -> DataFrame:
    """Evaluation cases of lines (value) without blank and comment lines; ``fault`` names a missing field or a repeated id."""
    rows = parse_lines(lines.filter(~F.trim("value").startswith("#")), schema)
    twice = F.count("*").over(W.partitionBy("id")) > 1
    fault = F.when(F.col("bad").isNotNull(), "not an object").when(F.col("id").isNull() | F.col("query").isNull(), "a case needs id and query").when(twice, "duplicate case id")
    return rows.withColumn("fault", fault).drop("bad")


def read_cases(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Evaluation cases of a JSON-lines file; the first faulty one is an error."""
    cases = parse_cases(spark.read.text(path), schema)
    if (wrong := cases.filter("fault IS NOT NULL").first()) is not None:
        raise ValueError(f"{wrong['fault']}: {wrong['id']}")
    return cases.drop("fault")


def _local(e) -> str:
    return e.tag.rsplit("}", 1)[-1]


def _styles(z: zipfile.ZipFile) -> dict[str, int]:
    """Heading level of each paragraph style of the document's header part (by id) that names one."""
    out = {}
    for name in z.namelist():
        if re.search(r"(^|/)header\.xml$", name):
            for e in ElementTree.fromstring(z.read(name)).iter():
                if _local(e) == "style" and (m := next((m for k in ("name", "engName") if (m := STYLE.search(e.get(k, "")))), None)):
                    out[e.get("id", "")] = int(m[1] or 1)
    return out


def archive_records(raw: bytes) -> list[tuple[int, int, str, str, int, int, int, int]]:
    """section, order, kind ('paragraph' or 'cell'), text, table, row, cell, heading level of the style (0 for none) of the section parts of a zipped XML document."""
    out = []
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        names = sorted((n for n in z.namelist() if re.search(r"section\d+\.xml$", n)), key=lambda n: int(re.search(r"(\d+)\.xml$", n)[1]))
        styles = _styles(z)
        for k, name in enumerate(names):
            tables = 0
            words = lambda e: " ".join("".join(x.itertext()) for x in e.iter() if _local(x) == "t").strip()

            def walk(e, k=k) -> None:
                nonlocal tables
                if _local(e) == "tbl":
                    tables += 1
                    for i, tr in enumerate([x for x in e.iter() if _local(x) == "tr"], 1):
                        for j, tc in enumerate([x for x in tr if _local(x) == "tc"], 1):
                            if body := words(tc):
                                out.append((k, len(out), "cell", body, tables, i, j, 0))
                    return
                if _local(e) == "p" and not any(_local(x) == "tbl" for x in e.iter()):
                    if body := words(e):
                        out.append((k, len(out), "paragraph", body, 0, 0, 0, styles.get(e.get("styleIDRef", ""), 0)))
                    return
                for x in e:
                    walk(x)

            walk(ElementTree.fromstring(z.read(name)))
    return out


def heading_paths(rows: DataFrame, part: list[str], order: str, level: Column, text: str = "text") -> DataFrame:
    """rows with heading_path: the headings that hold at each row, outermost first. level: 1 to 6 of a heading, null of other rows.

    A heading of level n takes away what stands from the n-th place on and comes after the rest, so its place is the smaller of its level and
    one more than the place of the heading before: the running minimum of level less number, plus its own number. The n-th heading of a path is
    the last one at place n.
    """
    so_far = W.partitionBy(*part).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("__level", level).withColumn("__no", F.count("__level").over(so_far))
    rows = rows.withColumn("__least", F.min(F.col("__level") - F.col("__no")).over(so_far))
    place = F.least(F.col("__no"), F.col("__least") + F.col("__no"))
    rows = rows.withColumn("__place", F.when(F.col("__level").isNotNull(), place))
    here = F.last("__place", ignorenulls=True).over(so_far)
    at = [F.last(F.when(F.col("__place") == n, F.col(text)), ignorenulls=True).over(so_far) for n in range(1, DEEPEST + 1)]
    path = F.slice(F.array(*at), F.lit(1), F.coalesce(here, F.lit(0)).cast("int"))
    return rows.withColumn("heading_path", path).drop("__level", "__no", "__least", "__place")


def parse_archives(files: DataFrame) -> DataFrame:
    """Records of zipped XML documents (path, content) with heading (the last section line before), heading_path, source ('style', 'regex' or '') and sort."""
    files.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "16m")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = [(p, *r) for p, c in zip(pdf["path"], pdf["content"], strict=True) for r in archive_records(bytes(c))]
            yield pd.DataFrame(rows, columns=["path", "section", "seq", "kind", "text", "table_no", "row_no", "cell_no", "style_level"])

    rows = files.select("path", "content").mapInPandas(run, "path string, section int, seq int, kind string, text string, table_no int, row_no int, cell_no int, style_level int")
    styled, lined = F.col("style_level") > 0, T.is_section("text")
    numbered = F.coalesce(*[F.when(F.regexp_extract("text", HEADING, 1) == k, v) for k, v in LEVELS.items()], F.lit(PLAIN_LEVEL))
    level = F.when(styled, F.col("style_level")).when(lined, numbered)
    rows = heading_paths(rows, ["path", "section"], "seq", level)
    w = W.partitionBy("path", "section").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    heading = F.last(F.when(styled | lined, F.col("text")), ignorenulls=True).over(w)
    sort = F.when(styled | lined, "heading").when(F.col("kind") == "cell", "table_row")
    for name, pattern in KINDS:
        sort = sort.when(F.col("text").rlike(pattern), name)
    source = F.when(styled, "style").when(lined, "regex").otherwise("")
    return rows.withColumns({"heading": F.coalesce(heading, F.lit("")), "source": source, "sort": sort.otherwise("body")}).drop("style_level")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Records of every archive under path."""
    return parse_archives(spark.read.format("binaryFile").load(path))


def sheet_tables(cells: DataFrame, key: list[str]) -> DataFrame:
    """Rows of the tables of sheets: blank rows part tables, the first row with two filled cells is the header, titles stand above it.

    cells: key columns, row, col, value. Result: key, island, row, title, headers, values (by header column).
    """
    rows = cells.withColumn("value", T.collapse("value")).filter("value <> ''").groupBy(*key, "row").agg(F.array_sort(F.collect_list(F.struct("col", "value"))).alias("cells"))
    w = W.partitionBy(*key).orderBy("row")
    rows = rows.withColumn("island", F.col("row") - F.row_number().over(w))
    island = W.partitionBy(*key, "island")
    head = F.min(F.when(F.size("cells") >= 2, F.col("row"))).over(island)
    rows = rows.withColumn("head", head)
    rows = rows.withColumn("headers", F.max(F.when(F.col("row") == F.col("head"), F.col("cells"))).over(island))
    title = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("row") < F.col("head"), F.struct("row", F.col("cells")[0]["value"].alias("t")))).over(island)), lambda x: x["t"]), " > ")
    rows = rows.withColumn("title", title).filter(F.col("row") > F.col("head"))
    at = lambda h: F.coalesce(F.get(F.filter("cells", lambda c: c["col"] == h["col"]), F.lit(0))["value"], F.lit(""))
    return rows.select(*key, "island", "row", "title", F.transform("headers", lambda h: h["value"]).alias("headers"), F.transform("headers", at).alias("values"))


def row_text(number, headers, values):
    """``Row n: header=value | …`` of the filled cells."""
    pairs = F.filter(F.zip_with(headers, values, lambda h, v: F.when(v != "", F.concat(h, F.lit("="), v))), lambda x: x.isNotNull())
    return F.concat(F.lit("Row "), number.cast("string"), F.lit(": "), F.array_join(pairs, " | "))
