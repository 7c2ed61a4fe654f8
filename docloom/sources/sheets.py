"""Spreadsheets by the standard library: a workbook is a zip of XML parts."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from posixpath import join, normpath
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators.ingest import row_fact

MAX_SHEETS, MAX_ROWS, MAX_COLS = 20, 50_000, 200
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
_DATES = {*range(14, 23), *range(45, 48)}
CELLS = "path string, sheet string, row int, col int, raw string, value string, error string"


def _local(e: ElementTree.Element) -> str:
    return e.tag.rsplit("}", 1)[-1]


def _all(e: ElementTree.Element, name: str) -> list[ElementTree.Element]:
    return [x for x in e.iter() if _local(x) == name]


def _words(e: ElementTree.Element) -> str:
    """The runs of a string; phonetic hints don't count."""
    hints = {id(t) for p in _all(e, "rPh") for t in p.iter()}
    return "".join(t.text or "" for t in _all(e, "t") if id(t) not in hints)


def _place(ref: str) -> tuple[int, int]:
    letters, digits = re.fullmatch(r"\$?([A-Za-z]+)\$?(\d+)", ref).groups()
    col = 0
    for c in letters.upper():
        col = col * 26 + ord(c) - 64
    return int(digits), col


def _number(raw: str, dated: bool) -> str:
    x = float(raw)
    if dated:
        return str(datetime(1899, 12, 30) + timedelta(seconds=round(x * 86400)))
    return str(int(x)) if x == int(x) and abs(x) < 1e15 else str(x)


class Book:
    """A workbook: names and parts of its sheets, shared strings and the styles that mean dates."""

    def __init__(self, raw: bytes) -> None:
        self.zip = zipfile.ZipFile(io.BytesIO(raw))
        self.names = set(self.zip.namelist())
        targets = {k: t for k, (t, _) in self.relations("xl/workbook.xml").items()}
        sheets = _all(self.xml("xl/workbook.xml"), "sheet")
        self.sheets = [(s.get("name"), targets[s.get(_REL)]) for s in sheets]
        self.strings = [_words(x) for x in _all(self.xml("xl/sharedStrings.xml"), "si")] if "xl/sharedStrings.xml" in self.names else []
        self.dated = self._date_styles()

    def xml(self, part: str) -> ElementTree.Element:
        return ElementTree.fromstring(self.zip.read(part))

    def relations(self, part: str) -> dict[str, tuple[str, str]]:
        """Target part and kind by relation id."""
        folder, name = part.rsplit("/", 1)
        rels = f"{folder}/_rels/{name}.rels"
        if rels not in self.names:
            return {}
        place = lambda t: t[1:] if t.startswith("/") else normpath(join(folder, t))
        return {r.get("Id"): (place(r.get("Target")), r.get("Type", "").rsplit("/", 1)[-1]) for r in _all(self.xml(rels), "Relationship") if r.get("TargetMode") != "External"}

    def _date_styles(self) -> set[int]:
        if "xl/styles.xml" not in self.names:
            return set()
        styles = self.xml("xl/styles.xml")
        plain = lambda code: re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", code)
        own = {int(f.get("numFmtId")) for f in _all(styles, "numFmt") if re.search("[ymdhs]", plain(f.get("formatCode", "")), re.IGNORECASE)}
        xfs = next((x for x in styles if _local(x) == "cellXfs"), [])
        return {i for i, x in enumerate(xfs) if int(x.get("numFmtId", 0)) in _DATES | own}

    def value(self, c: ElementTree.Element) -> str:
        kind = c.get("t", "n")
        if kind == "inlineStr":
            return _words(c)
        raw = next((x.text or "" for x in c if _local(x) == "v"), "")
        if raw == "":
            return ""
        if kind == "s":
            return self.strings[int(raw)]
        if kind == "b":
            return "True" if raw == "1" else "False"
        return _number(raw, int(c.get("s", 0)) in self.dated) if kind == "n" else raw

    def notes(self, part: str) -> dict[tuple[int, int], str]:
        found = [t for t, kind in self.relations(part).values() if kind == "comments"]
        return {_place(c.get("ref")): " ".join(_words(c).split()) for t in found if t in self.names for c in _all(self.xml(t), "comment")}

    def cells(self, part: str, merged: bool = True, notes: bool = True) -> dict[tuple[int, int], tuple[str, str]]:
        """Own and shown text by row and column: in the latter a merged range repeats its first cell, and a note stands behind its value."""
        root, own, row = self.xml(part), {}, 0
        for r in _all(root, "row"):
            row, col = int(r.get("r", row + 1)), 0
            for c in (x for x in r if _local(x) == "c"):
                row, col = _place(c.get("r")) if c.get("r") else (row, col + 1)
                if v := " ".join(self.value(c).split()):
                    own[row, col] = v
        spans = [[_place(p) for p in m.get("ref").split(":")] for m in _all(root, "mergeCell")]
        corners = [*own, *(s[-1] for s in spans)]
        if (rows := max((r for r, _ in corners), default=0)) > MAX_ROWS:
            raise ValueError(f"too many rows: {rows} > {MAX_ROWS}")
        if (cols := max((c for _, c in corners), default=0)) > MAX_COLS:
            raise ValueError(f"too many columns: {cols} > {MAX_COLS}")
        out = dict(own)
        for (r0, c0), *rest in spans if merged else []:
            r1, c1 = rest[-1] if rest else (r0, c0)
            for at in ((r, c) for r in range(r0, r1 + 1) for c in range(c0, c1 + 1)):
                if at != (r0, c0):
                    own.pop(at, None)
                out[at] = own.get((r0, c0), "")
        for at, note in self.notes(part).items() if notes else []:
            if note:
                out[at] = f"{out.get(at, '')} [주석:{note}]".strip()
        return {at: (own.get(at, ""), v) for at, v in out.items() if v}


def sheet_cells(raw: bytes) -> list[tuple[str, int, int, str, str]]:
    """sheet, row, column, own and shown text of a workbook's filled cells; too many sheets, rows or columns are an error."""
    book = Book(raw)
    if len(book.sheets) > MAX_SHEETS:
        raise ValueError(f"too many sheets: {len(book.sheets)} > {MAX_SHEETS}")
    return [(name, r, c, *v) for name, part in book.sheets for (r, c), v in sorted(book.cells(part).items())]


def parse_sheets(files: DataFrame) -> DataFrame:
    """Cells (path, sheet, row, col, raw, value) of workbooks (path, content). A workbook that can't be read is one row with its error."""
    files.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "16m")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    rows = [(path, *c, None) for c in sheet_cells(bytes(content))]
                except (ValueError, KeyError, AttributeError, IndexError, OverflowError, zipfile.BadZipFile, ElementTree.ParseError) as e:
                    rows = [(path, None, None, None, None, None, f"{type(e).__name__}: {e}")]
                out = pd.DataFrame(rows, columns=["path", "sheet", "row", "col", "raw", "value", "error"])
                yield out.astype({"row": "Int32", "col": "Int32"})

    return files.select("path", "content").mapInPandas(run, CELLS)


def read_sheets(spark: SparkSession, path: str) -> DataFrame:
    """Cells of every workbook under path."""
    return parse_sheets(spark.read.format("binaryFile").load(path))


def sheet_rows(cells: DataFrame) -> DataFrame:
    """path, sheet, row, columns, row_text, fact_text of the rows below each sheet's header.

    The header is the first of five rows with enough filled cells (two, and 30 % of the columns), else the first; a nameless column
    is called by its letters. A sheet is bounded by MAX_ROWS and MAX_COLS, so its window is too.
    """
    item = F.struct("col", "raw", "value")
    rows = cells.filter("error IS NULL").groupBy("path", "sheet", "row").agg(F.array_sort(F.collect_list(item)).alias("cells"), F.max("col").alias("last"), F.count_if(F.col("raw") != "").alias("own"))
    sheet = W.partitionBy("path", "sheet")
    rows = rows.withColumn("last", F.max("last").over(sheet))
    fit = (F.col("row") <= 5) & (F.col("own") >= F.greatest(F.lit(2), F.floor(F.col("last") * 0.3)))
    rows = rows.withColumn("head", F.coalesce(F.min(F.when(fit, F.col("row"))).over(sheet), F.lit(1)))
    rows = rows.withColumn("names", F.max(F.when(F.col("row") == F.col("head"), F.col("cells"))).over(sheet)).filter(F.col("row") > F.col("head"))
    table = lambda c, field: F.map_from_entries(F.transform(c, lambda x: F.struct(x["col"], x[field])))
    filled = F.when(F.col("names").isNull(), F.create_map().cast("map<int,string>")).otherwise(table(F.col("names"), "raw"))
    at = F.sequence(F.lit(1), F.col("last"))
    rows = rows.withColumn("filled", filled).withColumn("texts", table(F.col("cells"), "value"))
    name = lambda k: F.coalesce(F.nullif(F.try_element_at("filled", k), F.lit("")), F.concat(F.lit("Col"), T.column_letters(k)))
    rows = rows.withColumn("columns", F.transform(at, name)).withColumn("values", F.transform(at, lambda k: F.coalesce(F.try_element_at("texts", k), F.lit(""))))
    serial = F.array_join(F.zip_with("columns", "values", lambda c, v: F.concat(c, F.lit("="), v)), " | ")
    return rows.select("path", "sheet", "row", "columns", F.concat(F.lit("Row "), F.col("row").cast("string"), F.lit(": "), serial).alias("row_text"), row_fact(F.col("columns"), F.col("values")).alias("fact_text"))


def workbook(sheets: list[tuple[str, list[list[str]]]]) -> bytes:
    """A minimal workbook of texts, for tests and round trips."""
    from xml.sax.saxutils import escape, quoteattr

    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    cell = lambda v: f'<c t="inlineStr"><is><t xml:space="preserve">{escape(v)}</t></is></c>' if v else "<c/>"
    row = lambda n, vs: f'<row r="{n}">{"".join(map(cell, vs))}</row>'
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        tags = "".join(f'<sheet name={quoteattr(name)} sheetId="{k}" r:id="r{k}"/>' for k, (name, _) in enumerate(sheets, 1))
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="{rel}"><sheets>{tags}</sheets></workbook>')
        links = "".join(f'<Relationship Id="r{k}" Type="{rel}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in range(1, len(sheets) + 1))
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{links}</Relationships>')
        for k, (_, rows) in enumerate(sheets, 1):
            z.writestr(f"xl/worksheets/sheet{k}.xml", f"<worksheet {ns}><sheetData>{''.join(row(n, vs) for n, vs in enumerate(rows, 1))}</sheetData></worksheet>")
    return buffer.getvalue()
