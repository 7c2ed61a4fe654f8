"""Queries of the ingest operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators import ingest as I
from docloom.plans.registry import query
from docloom.sources import carriers as C

SECTION = r"^(#{1,6}\s+.+|(?:\d+(?:\.\d+){0,3}|[가-힣A-Za-z]\))\s+.+|제\s*\d+\s*(장|절|항|조).+)$"
LINES = r"""raw AS (SELECT doc_id, unnest(string_split_regex(coalesce(text, ''), '\r\n|\r|\n')) AS raw, unnest(range(len(string_split_regex(coalesce(text, ''), '\r\n|\r|\n')))) + 1 AS line_no FROM documents),
marked AS (SELECT doc_id, line_no, CASE WHEN line_no % 9 = 0 THEN '## ' || raw WHEN line_no % 11 = 0 THEN 'Page ' || line_no::VARCHAR || ' of 99' ELSE raw END AS raw FROM raw),
norm AS (SELECT doc_id, line_no, trim(regexp_replace(raw, '\s+', ' ', 'g')) AS text FROM marked),
flagged AS (SELECT *, regexp_full_match(text, '#{1,6}\s+.+|(?:\d+(?:\.\d+){0,3}|[가-힣A-Za-z]\))\s+.+|제\s*\d+\s*(장|절|항|조).+') AS is_section,
  text = '' OR regexp_full_match(text, '(?i)page\s*\d+\s*(of\s*\d+)?') OR regexp_full_match(text, '\d+\s*/\s*\d+') OR regexp_full_match(text, '[-_=]{3,}') AS chrome FROM norm),
lines AS (SELECT doc_id, line_no::INT AS line_no, text, is_section FROM flagged WHERE text <> '' AND (is_section OR NOT chrome))"""


def _marked(spark, sf):
    """Documents in which every ninth line is a heading and every eleventh a page line."""
    d = C.read(spark, sf, "documents")
    line = lambda x, i: F.when((i + 1) % 9 == 0, F.concat(F.lit("## "), x)).when((i + 1) % 11 == 0, F.concat(F.lit("Page "), (i + 1).cast("string"), F.lit(" of 99"))).otherwise(x)
    return d.select("doc_id", F.array_join(F.transform(F.split(T.text("text"), "\r\n|\r|\n"), line), "\n").alias("text"))


def _lines(spark, sf):
    return I.lines(_marked(spark, sf), "doc_id")


@query("scan_txt", "SELECT doc_id, line_no, is_section, md5(text) AS text_md5 FROM lines", (LINES,))
def scan_txt(spark, sf):
    return _lines(spark, sf).select("doc_id", "line_no", "is_section", F.md5("text").alias("text_md5"))


@query("is_section_line", "SELECT doc_id, line_no, text FROM lines WHERE is_section", (LINES,))
def is_section_line(spark, sf):
    return _lines(spark, sf).filter("is_section").select("doc_id", "line_no", "text")


@query("is_header_footer", "SELECT doc_id, line_no::INT AS line_no, text FROM flagged WHERE chrome AND text <> ''", (LINES,))
def is_header_footer(spark, sf):
    raw = _marked(spark, sf).select("doc_id", F.posexplode(F.split(T.text("text"), "\r\n|\r|\n")).alias("at", "raw"))
    rows = raw.select("doc_id", (F.col("at") + 1).alias("line_no"), T.collapse("raw").alias("text"))
    return rows.filter((F.col("text") != "") & T.is_page_line("text"))


@query("win_prev_section", """SELECT doc_id, line_no, coalesce(last_value(CASE WHEN is_section THEN text END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no
  ROWS BETWEEN 36 PRECEDING AND 1 PRECEDING), '') AS prev_section FROM lines""", (LINES,))  # fmt: skip
def win_prev_section(spark, sf):
    return I.previous_section(_lines(spark, sf), "doc_id").select("doc_id", "line_no", "prev_section")


@query("chunk_tokens", "SELECT id, CASE WHEN text = '' THEN 0 ELSE greatest(1, floor(len(regexp_extract_all(text, '[0-9A-Za-zㄱ-ㆎ가-힣]+')) * 1.08::DOUBLE)) END::INT AS tokens FROM chunks", (C.CHUNKS,))
def chunk_tokens(spark, sf):
    return C.chunks(spark, sf).select("id", T.chunk_tokens("text").alias("tokens"))


@query("token_estimators", r"""SELECT id, greatest(1, floor(len(regexp_extract_all(text, '[0-9A-Za-z_]+')) * 1.05::DOUBLE))::INT AS packing,
  greatest(1, floor(len(regexp_extract_all(text, '[A-Za-z0-9_]+')) * 1.1::DOUBLE + len(regexp_extract_all(text, '[가-힣]')) * 0.65::DOUBLE + len(regexp_extract_all(text, '[^\p{L}\p{N}\p{M}_\s가-힣]')) * 0.3::DOUBLE))::INT AS mixed_floor,
  greatest(1, ceil(len(regexp_extract_all(text, '[A-Za-z0-9_]+')) * 1.1::DOUBLE + len(regexp_extract_all(text, '[가-힣]')) * 0.65::DOUBLE + len(regexp_extract_all(text, '[^\p{L}\p{N}\p{M}_\s가-힣]')) * 0.3::DOUBLE))::INT AS mixed_ceil,
  greatest(1, len(list_filter(string_split_regex(trim(text), '\s+'), lambda w: w <> '')), ceil(length(text) / 4))::INT AS server FROM chunks""", (C.CHUNKS,))  # fmt: skip
def token_estimators(spark, sf):
    return C.chunks(spark, sf).select("id", T.packing_tokens("text").alias("packing"), T.mixed_tokens("text", False).alias("mixed_floor"), T.mixed_tokens("text").alias("mixed_ceil"), T.server_tokens("text").alias("server"))


PREVIOUS = """prev AS (SELECT *, coalesce(last_value(CASE WHEN is_section THEN text END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 36 PRECEDING AND 1 PRECEDING), '') AS hint,
  greatest(1, floor(len(regexp_extract_all(text, '[0-9A-Za-zㄱ-ㆎ가-힣]+')) * 1.08::DOUBLE))::BIGINT AS n FROM lines),
sized AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS i, coalesce(sum(n) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before, count(*) OVER (PARTITION BY doc_id) AS total FROM prev)"""
# where a window that starts at a line ends, where the next one starts, and the chain of windows
CHUNKED = """ends AS (SELECT a.doc_id, a.i AS s, coalesce(min(b.i) FILTER (b.before - a.before >= 620 OR b.before + b.n - a.before > 780), any_value(a.total) + 1) AS e, any_value(a.total) AS total
  FROM sized a LEFT JOIN sized b ON b.doc_id = a.doc_id AND b.i > a.i AND b.i <= a.i + 620 GROUP BY a.doc_id, a.i),
nexts AS MATERIALIZED (SELECT x.doc_id, x.s, x.e, x.total, CASE WHEN x.e > x.total THEN NULL ELSE coalesce(max(j.i) FILTER (j.i > x.s AND y.before - j.before >= 117), x.e) END AS nxt
  FROM ends x LEFT JOIN sized y ON y.doc_id = x.doc_id AND y.i = x.e LEFT JOIN sized j ON j.doc_id = x.doc_id AND j.i > x.s AND j.i < x.e GROUP BY x.doc_id, x.s, x.e, x.total),
walk AS (SELECT doc_id, 1 AS chunk_no, s, e, nxt FROM nexts WHERE s = 1 UNION ALL SELECT n.doc_id, w.chunk_no + 1, n.s, n.e, n.nxt FROM walk w JOIN nexts n ON n.doc_id = w.doc_id AND n.s = w.nxt)"""


@query("chunk_txt", """SELECT doc_id, chunk_no, min(l.line_no)::INT AS line_start, max(l.line_no)::INT AS line_end, sum(n)::INT AS tokens, min_by(hint, i) AS section,
  md5(CASE WHEN min_by(hint, i) <> '' AND NOT bool_or(is_section) THEN '[Section: ' || min_by(hint, i) || ']' || chr(10) ELSE '' END || string_agg(text, chr(10) ORDER BY i)) AS text_md5
  FROM walk w JOIN sized l USING (doc_id) WHERE l.i >= w.s AND l.i < w.e GROUP BY doc_id, chunk_no""", (LINES, PREVIOUS, CHUNKED), recursive=True)  # fmt: skip
def chunk_txt(spark, sf):
    return I.chunk_lines(_lines(spark, sf), "doc_id").select("doc_id", "chunk_no", "line_start", "line_end", "tokens", "section", F.md5("text").alias("text_md5"))


# one step for each line of a text, then a short tail joins the part before
PARTS = """steps AS (SELECT doc_id, line_no, n, i, 1 AS part, n AS used FROM sized WHERE i = 1
  UNION ALL SELECT l.doc_id, l.line_no, l.n, l.i, CASE WHEN used + l.n > 2800 OR l.is_section AND used >= 2200 THEN part + 1 ELSE part END, CASE WHEN used + l.n > 2800 OR l.is_section AND used >= 2200 THEN l.n ELSE used + l.n END
  FROM steps s JOIN sized l ON l.doc_id = s.doc_id AND l.i = s.i + 1),
parts AS (SELECT doc_id, part, min(line_no) AS a, max(line_no) AS b, sum(n) AS tokens, max(part) OVER (PARTITION BY doc_id) AS last FROM steps GROUP BY doc_id, part),
joined AS (SELECT doc_id, CASE WHEN part = last AND part > 1 AND tokens < 315 THEN part - 1 ELSE part END AS part, a, b, tokens FROM parts)"""


@query("split_txt_docs", "SELECT doc_id, part::INT AS part, min(a)::INT AS line_start, max(b)::INT AS line_end, sum(tokens)::INT AS tokens FROM joined GROUP BY doc_id, part", (LINES, PREVIOUS, PARTS), recursive=True)
def split_txt_docs(spark, sf):
    return I.split_parts(_lines(spark, sf), "doc_id")


@query("embed_text", """SELECT id, CASE WHEN length(full_text) <= 2400 THEN full_text ELSE rtrim(substr(full_text, 1, 2397)) || '...' END AS embedding_text FROM (
  SELECT id, 'source=' || source_path || ' | role=' || doc_role || ' | path=' || section || ' > ' || kb_id || chr(10) ||
    CASE WHEN length(b) <= 1800 THEN b ELSE rtrim(substr(b, 1, 1797)) || '...' END AS full_text
  FROM (SELECT *, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS b FROM chunks))""".replace("\\\\", "\\"), (C.CHUNKS,))  # fmt: skip
def embed_text(spark, sf):
    c = C.chunks(spark, sf)
    return c.select("id", I.embedding_text(F.col("text"), F.col("source_path"), F.col("doc_role"), F.array("section", "kb_id"), F.lit("body")).alias("embedding_text"))


@query("hpath", "SELECT DISTINCT source_path, doc_role, [source_path, doc_role, section] AS path FROM chunks", (C.CHUNKS,))
def hpath(spark, sf):
    c = C.chunks(spark, sf)
    return c.select("source_path", "doc_role", I.heading_path(F.concat_ws(" > ", "source_path", "doc_role", "source_path", "section")).alias("path")).distinct()


@query("chunk_structure", """SELECT parent_key, min(id) AS line_start, max(id) AS line_end, md5(string_agg(t, ' | ' ORDER BY id) FILTER (t <> '')) AS text_md5
  FROM (SELECT parent_key, id, trim(text) AS t FROM chunks) GROUP BY parent_key""", (C.CHUNKS,))  # fmt: skip
def chunk_structure(spark, sf):
    cells = C.chunks(spark, sf).select("parent_key", F.col("id").alias("cell_no"), F.col("id").alias("line_start"), F.col("id").alias("line_end"), "text")
    return I.merge_table_rows(cells).select("parent_key", "line_start", "line_end", F.md5("text").alias("text_md5"))


@query("pdf_text_ok", r"SELECT id, length(trim(text)) >= 80 AND length(regexp_replace(text, '\s+', '', 'g')) / greatest(length(text), 1) >= 0.4 AS ok FROM chunks", (C.CHUNKS,))
def pdf_text_ok(spark, sf):
    return C.chunks(spark, sf).select("id", I.page_text_ok("text").alias("ok"))


PAGES = """pg AS (SELECT source_path, id // 40 AS page_no, (id % 3)::INT AS attempt, CASE WHEN id % 2 = 0 THEN 'text' ELSE 'ocr' END AS parser, CASE WHEN id % 5 = 0 THEN '' ELSE text END AS text, id FROM chunks),
first_pages AS (SELECT * FROM pg WHERE trim(text) <> '' QUALIFY row_number() OVER (PARTITION BY source_path, page_no ORDER BY attempt, id) = 1)"""


def _pages(spark, sf):
    c = C.chunks(spark, sf)
    attempt = F.struct((F.col("id") % 3).alias("a"), F.col("id"))
    return c.select("source_path", F.floor(F.col("id") / 40).alias("page_no"), attempt.alias("attempt"), F.when(F.col("id") % 2 == 0, "text").otherwise("ocr").alias("parser"), F.when(F.col("id") % 5 == 0, "").otherwise(F.col("text")).alias("text"), "id")


@query("pdf_page_merge", "SELECT source_path, page_no, parser, id FROM first_pages", (C.CHUNKS, PAGES))
def pdf_page_merge(spark, sf):
    return I.merge_pages(_pages(spark, sf), "source_path")[0].select("source_path", "page_no", "parser", "id")


@query("agg_pdf_pages", """SELECT source_path, count_if(parser = 'text')::BIGINT AS text_pages, count_if(parser = 'ocr')::BIGINT AS ocr_pages, count(*) AS pages,
  CASE WHEN count_if(parser = 'text') > 0 AND count_if(parser = 'ocr') > 0 THEN 'hybrid' WHEN count_if(parser = 'ocr') > 0 THEN 'ocr' ELSE 'text' END AS parser FROM first_pages GROUP BY source_path""", (C.CHUNKS, PAGES))  # fmt: skip
def agg_pdf_pages(spark, sf):
    return I.merge_pages(_pages(spark, sf), "source_path")[1]


@query("compact_pdf", r"""SELECT id, len(ls)::INT AS n, length(text)::INT AS before, coalesce(list_sum(list_transform(ls, lambda x: length(x))), 0)::INT AS after FROM (
  SELECT id, text, list_distinct(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))),
    lambda x: length(x) >= 4 AND NOT regexp_full_match(x, '(?i)page\s*\d+\s*(of\s*\d+)?') AND NOT regexp_full_match(x, '\d+\s*/\s*\d+') AND NOT regexp_full_match(x, '[-_=]{3,}'))) AS ls FROM chunks)""", (C.CHUNKS,))  # fmt: skip
def compact_pdf(spark, sf):
    c = C.chunks(spark, sf).select("id", "text", I.compact_lines("text").alias("ls"))
    return c.select("id", F.size("ls").alias("n"), F.length("text").alias("before"), F.aggregate("ls", F.lit(0), lambda a, x: a + F.length(x)).alias("after"))


FACTS = """fact_lines AS (SELECT row_no, '표의미: kind=table_row | subject=' || "values"[1] || ' | aliases=' || "values"[1] || ' | 품목=' || "values"[1] || ' | brand=' || "values"[2] || ' | type=' || "values"[3] || ' | size=' || "values"[4] AS fact FROM fact_rows)"""


@query("row_fact", "SELECT row_no, fact FROM fact_lines", (C.FACT_ROWS, FACTS))
def row_fact(spark, sf):
    return C.fact_rows(spark, sf).select("row_no", I.row_fact(F.col("headers"), F.col("values")).alias("fact"))


@query("fact_extract", """SELECT row_no, "values"[1] AS subject, unnest(['품목', 'brand', 'type', 'size']) AS predicate, unnest("values") AS object_value, 'table_row' AS fact_kind, 0.78::DOUBLE AS confidence FROM fact_rows""", (C.FACT_ROWS,))
def fact_extract(spark, sf):
    lines = C.fact_rows(spark, sf).select("row_no", I.row_fact(F.col("headers"), F.col("values")).alias("text"))
    return I.extract_facts(lines, "row_no").select("row_no", "subject", "predicate", "object_value", "fact_kind", "confidence")


@query("set_dedupe_text", r"""SELECT id, doc_role FROM chunks QUALIFY row_number() OVER (PARTITION BY doc_role, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) ORDER BY uploaded_at DESC, id DESC) = 1""", (C.CHUNKS,))
def set_dedupe_text(spark, sf):
    return I.dedupe_newest(C.chunks(spark, sf)).select("id", "doc_role")


BUNDLES = r"""fresh AS (SELECT * FROM chunks WHERE source_type IN ('txt', 'pdf') AND is_normalized = 0 QUALIFY row_number() OVER (PARTITION BY doc_role, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) ORDER BY uploaded_at DESC, id DESC) = 1),
ordered AS MATERIALIZED (SELECT source_path, id, CASE WHEN text = '' THEN 0 ELSE greatest(1, floor(len(regexp_extract_all(text, '[0-9A-Za-z_]+')) * 1.05::DOUBLE)) END::BIGINT AS n, row_number() OVER (PARTITION BY source_path ORDER BY uploaded_at DESC, id DESC) AS rn FROM fresh),
steps AS (SELECT source_path, id, n, rn, 1 AS bundle, n AS used FROM ordered WHERE rn = 1
  UNION ALL SELECT o.source_path, o.id, o.n, o.rn, CASE WHEN used >= 360 OR used + o.n > 460 THEN bundle + 1 ELSE bundle END, CASE WHEN used >= 360 OR used + o.n > 460 THEN o.n ELSE used + o.n END
  FROM steps s JOIN ordered o ON o.source_path = s.source_path AND o.rn = s.rn + 1)"""


@query("norm_txt", "SELECT source_path, bundle, list(id ORDER BY rn) AS ids, sum(n)::INT AS tokens FROM steps GROUP BY source_path, bundle", (C.CHUNKS, BUNDLES), recursive=True)
def norm_txt(spark, sf):
    rows = I.dedupe_newest(C.chunks(spark, sf).filter("source_type IN ('txt', 'pdf') AND is_normalized = 0")).withColumn("n", T.packing_tokens("text"))
    # bundles are packed within a source, so that no task holds a whole role
    return I.pack_bundles(rows, "source_path")


@query("win_cluster_cells", """SELECT source_path, x, sum(jump) OVER (PARTITION BY source_path ORDER BY x) AS island FROM (
  SELECT source_path, x, CASE WHEN x - lag(x) OVER (PARTITION BY source_path ORDER BY x) <= 20000 THEN 0 ELSE 1 END AS jump FROM (SELECT source_path, id * 7919 % 1000003 AS x FROM chunks))""", (C.CHUNKS,))  # fmt: skip
def win_cluster_cells(spark, sf):
    cells = C.chunks(spark, sf).select("source_path", (F.col("id") * 7919 % 1000003).alias("x"))
    return I.islands(cells, ["source_path"], "x", 20_000)


@query("canonical_rows", "SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY line_no))::INT AS reading_order, CASE WHEN is_section THEN 'heading' ELSE 'paragraph' END AS block_type, line_no FROM lines", (LINES,))
def canonical_rows(spark, sf):
    from pyspark.sql import Window as W

    order = F.row_number().over(W.partitionBy("doc_id").orderBy("line_no"))
    return _lines(spark, sf).select("doc_id", order.alias("reading_order"), F.when(F.col("is_section"), "heading").otherwise("paragraph").alias("block_type"), "line_no")
