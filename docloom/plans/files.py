"""Queries of the readers and of table hints: files are made from the tables, read back and stated in SQL."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators import tables as H
from docloom.plans.registry import query
from docloom.sources import carriers as C
from docloom.sources import readers, sheets

BLOCK = 100
FILES = "files AS (SELECT s_suppkey // 100 AS block, row_number() OVER (PARTITION BY s_suppkey // 100 ORDER BY s_suppkey) AS n, s_name, s_nationkey FROM supplier)"


def _blocks(spark, sf, build):
    """One file (path, content) for each hundred suppliers."""
    rows = C.read(spark, sf, "supplier").select((F.col("s_suppkey") / BLOCK).cast("long").alias("block"), "s_suppkey", "s_name", F.col("s_nationkey").cast("string").alias("nation"))
    make = lambda pdf: pd.DataFrame({"path": [str(pdf["block"].iloc[0])], "content": [build(pdf.sort_values("s_suppkey"))]})
    return rows.groupBy("block").applyInPandas(make, "path string, content binary")


def _book(pdf: pd.DataFrame) -> bytes:
    return sheets.workbook([("a", [["품목", "nation", ""], *([n, k, ""] for n, k in zip(pdf["s_name"], pdf["nation"], strict=True))]), ("empty", [])])


def _archive(pdf: pd.DataFrame) -> bytes:
    cell = lambda v: f"<tc><p><t>{escape(v)}</t></p></tc>"
    rows = "".join(f"<tr>{cell(n)}{cell(k)}</tr>" for n, k in [("품목", "단가"), *zip(pdf["s_name"], pdf["nation"], strict=True)])
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("Contents/section0.xml", f"<s><p><t>1 Block {pdf['block'].iloc[0]}</t></p><p><t>suppliers</t></p><tbl>{rows}</tbl></s>")
    return buffer.getvalue()


@query("scan_xlsx", """SELECT block::VARCHAR AS path, 'a' AS sheet, (n + 1)::INT AS "row", ['품목', 'nation'] AS columns, 'Row ' || (n + 1) || ': 품목=' || s_name || ' | nation=' || s_nationkey AS row_text,
  '표의미: kind=table_row | subject=' || s_name || ' | aliases=' || s_name || ' | 품목=' || s_name || ' | nation=' || s_nationkey AS fact_text FROM files""", (FILES,))  # fmt: skip
def scan_xlsx(spark, sf):
    """Workbooks of a hundred suppliers each."""
    return sheets.sheet_rows(sheets.parse_sheets(_blocks(spark, sf, _book)))


@query("scan_hwpx", """SELECT block::VARCHAR AS path, 0 AS section, s AS seq, kind, text, t AS table_no, r::INT AS row_no, c AS cell_no, '1 Block ' || block AS heading FROM (
  SELECT DISTINCT block, 0 AS s, 'paragraph' AS kind, '1 Block ' || block AS text, 0 AS t, 0 AS r, 0 AS c FROM files UNION ALL SELECT DISTINCT block, 1, 'paragraph', 'suppliers', 0, 0, 0 FROM files
  UNION ALL SELECT DISTINCT block, 2, 'cell', '품목', 1, 1, 1 FROM files UNION ALL SELECT DISTINCT block, 3, 'cell', '단가', 1, 1, 2 FROM files
  UNION ALL SELECT block, 2 + 2 * n, 'cell', s_name, 1, n + 1, 1 FROM files UNION ALL SELECT block, 3 + 2 * n, 'cell', s_nationkey::VARCHAR, 1, n + 1, 2 FROM files)""", (FILES,))  # fmt: skip
def scan_hwpx(spark, sf):
    """Archives of a hundred suppliers each."""
    return readers.parse_archives(_blocks(spark, sf, _archive)).select("path", "section", "seq", "kind", "text", "table_no", "row_no", "cell_no", "heading")


def _outline(pdf: pd.DataFrame) -> bytes:
    """Chapters by region of the nation's number, sections and articles by rule, some of them by style only, a body paragraph under each."""
    parts = []
    for i, (name, nation) in enumerate(zip(pdf["s_name"], map(int, pdf["nation"]), strict=True)):
        kind = nation % 6
        title = [f"제{i + 1}장 {name}", f"제 {i + 1} 절 {name}", f"제{i + 1}조 {name}", f"{i + 1}.2 {name}", name, f"제{i + 1}항 {name}"][kind]
        parts.append(f'<p styleIDRef="{"7" if kind == 4 else "0"}"><t>{escape(title)}</t></p><p><t>{"다만 " if nation % 2 else ""}text of {escape(name)}</t></p>')
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("Contents/header.xml", '<head><styles><style id="0" name="바탕글"/><style id="7" name="개요 2"/></styles></head>')
        z.writestr("Contents/section0.xml", f"<s>{''.join(parts)}</s>")
    return buffer.getvalue()


# one step for each heading: what stands from its level on goes, and it comes after the rest
STACK = """titled AS (SELECT block, n, s_name, s_nationkey % 2 AS odd, (['제' || n || '장 ' || s_name, '제 ' || n || ' 절 ' || s_name, '제' || n || '조 ' || s_name, n || '.2 ' || s_name, s_name, '제' || n || '항 ' || s_name])[s_nationkey % 6 + 1] AS title,
  ([1, 2, 3, 4, 2, 4])[s_nationkey % 6 + 1] AS level, CASE WHEN s_nationkey % 6 = 4 THEN 'style' ELSE 'regex' END AS source FROM files),
stack AS (SELECT block, n, [title] AS path FROM titled WHERE n = 1 UNION ALL SELECT t.block, t.n, list_append(s.path[1:t.level - 1], t.title) FROM stack s JOIN titled t ON t.block = s.block AND t.n = s.n + 1)"""


@query("scan_hwpx_outline", """SELECT t.block::VARCHAR AS path, (2 * t.n - 2 + k)::INT AS seq, CASE k WHEN 0 THEN t.title ELSE CASE WHEN odd = 1 THEN '다만 ' ELSE '' END || 'text of ' || s_name END AS text, t.title AS heading, s.path AS heading_path,
  CASE k WHEN 0 THEN source ELSE '' END AS source, CASE WHEN k = 0 THEN 'heading' WHEN odd = 1 THEN 'exception' ELSE 'body' END AS sort FROM titled t JOIN stack s USING (block, n), range(2) AS r(k)""", (FILES, STACK), recursive=True)  # fmt: skip
def scan_hwpx_outline(spark, sf):
    """Archives whose headings have levels, by number or by style: the path of headings at each paragraph."""
    return readers.parse_archives(_blocks(spark, sf, _outline)).select("path", "seq", "text", "heading", "heading_path", "source", "sort")


@query("hwpx_hints", """SELECT block::VARCHAR AS path, (n + 1)::INT AS row_no, ['표행요약: 품목=' || s_name || ' | 단가=' || s_nationkey || '천원',
  '표의미: kind=table_row | subject=' || s_name || ' | aliases=' || s_name || ' | 품목=' || s_name || ' | 단가=' || s_nationkey || '천원'] AS hints FROM files
  UNION ALL SELECT DISTINCT block::VARCHAR, 1, ['표헤더: 품목 | 단가'] FROM files""", (FILES,))  # fmt: skip
def hwpx_hints(spark, sf):
    """Hints of the tables in the archives of suppliers."""
    cells = readers.parse_archives(_blocks(spark, sf, _archive)).filter("kind = 'cell'")
    return H.grid_hints(cells, ["path", "section", "table_no"]).select("path", "row_no", "hints")


@query("scan_txt_encoding", r"""SELECT doc_id, CASE doc_id % 3 WHEN 2 THEN 'replace' ELSE 'utf-8-sig' END AS encoding, sha256(coalesce(text, '') || CASE doc_id % 3 WHEN 2 THEN '�' ELSE '' END) AS text_sha256 FROM documents""")
def scan_txt_encoding(spark, sf):
    """Every text as a file: plain, with a byte order mark, or with a byte that no encoding has."""
    raw = F.encode(T.text("text"), "UTF-8")
    content = F.when(F.col("doc_id") % 3 == 0, raw).when(F.col("doc_id") % 3 == 1, F.concat(F.unhex(F.lit("EFBBBF")), raw)).otherwise(F.concat(raw, F.unhex(F.lit("FF"))))
    files = C.read(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("path"), content.alias("content"))
    return readers.parse_texts(files).select(F.col("path").cast("long").alias("doc_id"), "encoding", F.sha2("text", 256).alias("text_sha256"))


@query("scan_jsonl", """SELECT conv_id, turn, role, sha256(text) AS text_sha256, NULL AS bad FROM conversations WHERE (conv_id + turn) % 10 <> 0
  UNION ALL SELECT NULL, NULL, NULL, NULL, 'cut ' || conv_id || ' ' || turn FROM conversations WHERE (conv_id + turn) % 10 = 0""")  # fmt: skip
def scan_jsonl(spark, sf):
    """Conversation turns as lines of JSON: every tenth is broken, half of the others are arrays."""
    c = C.read(spark, sf, "conversations")
    body = F.to_json(F.struct("conv_id", "turn", "role", "text"))
    k = F.col("conv_id") + F.col("turn")
    line = F.when(k % 10 == 0, F.concat_ws(" ", F.lit("cut"), "conv_id", "turn")).when(k % 2 == 0, F.concat(F.lit("["), body, F.lit("]"))).otherwise(body)
    return readers.parse_lines(c.select(line.alias("value")), "conv_id long, turn long, role string, text string").select("conv_id", "turn", "role", F.sha2("text", 256).alias("text_sha256"), "bad")


@query("scan_eval_cases", """SELECT id, md5(query) AS query_md5, CASE WHEN query IS NULL THEN 'a case needs id and query' WHEN count(*) OVER (PARTITION BY id) > 1 THEN 'duplicate case id' END AS fault
  FROM (SELECT item_id // 2 * 2 + CASE WHEN item_id % 10 = 1 THEN 0 ELSE item_id % 2 END AS id, CASE WHEN item_id % 7 <> 3 THEN text END AS query FROM benchmark)""")  # fmt: skip
def scan_eval_cases(spark, sf):
    """Benchmark items as case lines, with a comment before each: some ids repeat, some queries are missing."""
    i = F.col("item_id")
    b = C.read(spark, sf, "benchmark").select((F.floor(i / 2) * 2 + F.when(i % 10 == 1, 0).otherwise(i % 2)).alias("id"), F.when(i % 7 != 3, F.col("text")).alias("query"))
    lines = b.select(F.explode(F.array(F.lit("# a case"), F.lit(" "), F.to_json(F.struct("id", "query")))).alias("value"))
    return readers.parse_cases(lines, "id long, query string").select("id", F.md5("query").alias("query_md5"), "fault")


LINE = """po AS (SELECT o_custkey AS page, o_orderkey AS line_no, left(o_orderpriority, 1) AS p, 'grade' || o_orderstatus AS grade, o_orderkey || '원' AS price, (o_orderkey % 100) || '%' AS share FROM orders),
pt AS (SELECT *, p NOT IN ('1', '2') AS is_row, CASE p WHEN '1' THEN '품목 지급단가 비율' WHEN '2' THEN 'note without figures' ELSE grade || ' ' || price || ' ' || share END AS line,
  count(*) FILTER (p = '2') OVER (PARTITION BY page ORDER BY line_no) AS stretch FROM po),
pl AS (SELECT *, count(*) FILTER (p = '1') OVER (PARTITION BY page, stretch ORDER BY line_no) > 0 AS headed FROM pt),
hints AS (SELECT page, '표헤더: ' || line AS hint FROM pl WHERE p = '1' UNION SELECT page, '표행: ' || line FROM pl WHERE is_row UNION SELECT page, '표값: ' || price FROM pl WHERE is_row UNION SELECT page, '표값: ' || share FROM pl WHERE is_row
  UNION SELECT page, unnest(['표행: 품목 지급단가 비율 | ' || line, '표행요약: 품목 지급단가 비율 | ' || line,
    '표의미: kind=table_row | subject=' || grade || ' | aliases=' || grade || ' | 품목=' || grade || ' | 지급단가=' || price || ' | 비율=' || share]) FROM pl WHERE is_row AND headed)"""


def _order_pages(spark, sf):
    """A customer's orders as lines of a page: headers, notes and table rows by priority."""
    o = C.read(spark, sf, "orders")
    p = F.substring("o_orderpriority", 1, 1)
    key = F.col("o_orderkey")
    row = F.concat(F.lit("grade"), "o_orderstatus", F.lit(" "), key.cast("string"), F.lit("원 "), (key % 100).cast("string"), F.lit("%"))
    return o.select(F.col("o_custkey").alias("page"), key.alias("line_no"), F.when(p == "1", "품목 지급단가 비율").when(p == "2", "note without figures").otherwise(row).alias("text"))


@query("table_hints", "SELECT page, hint FROM hints", (LINE,))
def table_hints(spark, sf):
    return H.table_hints(_order_pages(spark, sf), "page").select("page", F.explode("hints").alias("hint"))


@query("table_ocr_decide", """SELECT page, CASE WHEN NOT bool_or(p <> '2') THEN false WHEN bool_or(is_row AND headed) THEN 2 * count(*) FILTER (is_row) >= 4 OR count(*) >= 3
  ELSE count(*) <= 2 AND 2 * count(*) FILTER (is_row) >= 3 OR 2 * count(*) FILTER (is_row) >= 10 END AS needs_ocr FROM pl GROUP BY page""", (LINE,))  # fmt: skip
def table_ocr_decide(spark, sf):
    return H.table_hints(_order_pages(spark, sf), "page").select("page", "needs_ocr")


def _block(c: str) -> str:
    return rf"array_to_string(list_filter(list_transform(string_split_regex({c}, '\r\n|\r|\n'), lambda l: trim(regexp_replace(l, '\s+', ' ', 'g'))), lambda l: l <> ''), chr(10))"


@query("ocr_collect_text", f"""SELECT id, list_filter(CASE WHEN h = b THEN [h] ELSE [h, b] END || CASE WHEN section IN (h, b) THEN [] ELSE [section] END, lambda x: x <> '') AS texts
  FROM (SELECT id, section, {_block('heading')} AS h, {_block('text')} AS b FROM chunks)""", (C.CHUNKS,))  # fmt: skip
def ocr_collect_text(spark, sf):
    """Heading, whole text and section of every row, nested in a payload with scores and repeats."""
    inner = F.array(F.struct(F.col("text").alias("markdown"), F.array(F.lit(0.5)).alias("scores"), F.lit("skipped").alias("bbox")))
    payload = F.to_json(F.struct(F.array("heading", "heading").alias("rec_texts"), inner.alias("parts"), F.struct(F.col("section").alias("note"), F.lit(3).alias("page")).alias("meta")))
    return C.chunks(spark, sf).select("id", H.payload_texts(payload).alias("texts"))
