"""Queries of pages, OCR lines, definitions, sheets and ingest statistics."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators import ingest as I
from docloom.operators import pages as G
from docloom.plans import ingest as IP
from docloom.plans.registry import query
from docloom.sources import carriers as C

OK = r"length(trim(text)) >= 80 AND length(regexp_replace(text, '\s+', '', 'g')) / greatest(length(text), 1) >= 0.4"


@query("scan_pdf", rf"""SELECT id, mode, CASE WHEN mode = 'text_only' THEN 'text' WHEN mode = 'ocr_only' THEN 'ocr' WHEN mode = 'hybrid' AND {OK} THEN 'text' WHEN trim(ocr) <> '' THEN 'ocr' ELSE 'text' END AS parser,
  length(CASE WHEN mode = 'text_only' THEN text WHEN mode = 'ocr_only' THEN ocr WHEN mode = 'hybrid' AND {OK} THEN text WHEN trim(ocr) <> '' THEN ocr ELSE text END)::INT AS chars
  FROM (SELECT id, text, CASE WHEN id % 3 = 0 THEN '' ELSE 'ocr ' || text END AS ocr, unnest(['text_only', 'ocr_only', 'ocr_first', 'hybrid']) AS mode FROM chunks)""", (C.CHUNKS,))  # fmt: skip
def scan_pdf(spark, sf):
    """Every row as a page with a text layer and, for two thirds, OCR text, in all modes."""
    p = C.chunks(spark, sf).select("id", "text", F.when(F.col("id") % 3 == 0, "").otherwise(F.concat(F.lit("ocr "), "text")).alias("ocr"))
    p = p.withColumn("mode", F.explode(F.array(*map(F.lit, G.MODES)))).withColumn("page", G.page_source("text", "ocr", F.col("mode")))
    return p.select("id", "mode", "page.parser", F.length("page.text").alias("chars"))


LAY = r"lay AS (SELECT id, list_filter(string_split_regex(trim(text), '\s+'), lambda w: w <> '') AS ws FROM chunks)"


@query("ocr_fast_lines", """SELECT id, n::INT AS n, ws[n] AS text, CASE WHEN n % 3 = 0 THEN 1.0 ELSE n % 10 / 10.0 END::DOUBLE AS score, CASE WHEN n % 2 = 0 THEN 2.0 * n ELSE 0.0 END::DOUBLE AS x1,
  CASE WHEN n % 2 = 0 THEN 3.0 * n + 5 ELSE greatest(40, length(ws[n]) * 12) / 2.0 END::DOUBLE AS cx, CASE WHEN n % 2 = 0 THEN n + 4.0 ELSE 20.0 * (n - 1) + 8 END::DOUBLE AS cy, CASE WHEN n % 2 = 0 THEN 8.0 ELSE 16.0 END::DOUBLE AS height
  FROM (SELECT id, ws, unnest(range(1, len(ws) + 1)) AS n FROM lay)""", (C.CHUNKS, LAY))  # fmt: skip
def ocr_fast_lines(spark, sf):
    """The words of every row as an OCR payload: each third without a score, each second without a box."""
    w = F.filter(F.split(T.collapse("text"), " "), lambda x: x != "")
    n = lambda i: i + 1
    none = F.lit(None).cast("double")
    score = F.transform(w, lambda x, i: F.when(n(i) % 3 == 0, none).otherwise(n(i) % 10 / 10.0))
    box = F.transform(w, lambda x, i: F.when(n(i) % 2 == 0, F.array(*[c.cast("double") for c in (4 * n(i) + 10, n(i) + 8, 2 * n(i), n(i))])))
    payload = F.to_json(F.struct(w.alias("rec_texts"), score.alias("rec_scores"), box.alias("rec_boxes")))
    rows = C.chunks(spark, sf).select("id", F.posexplode(G.ocr_lines(payload)).alias("at", "line"))
    return rows.select("id", (F.col("at") + 1).alias("n"), "line.text", "line.score", "line.x1", "line.cx", "line.cy", "line.height")


@query("ocr_lazy_hints", """SELECT id, CASE WHEN t THEN ['OCR후보: 표형 페이지 | 페이지 ' || p || ' | 숫자 표 단가 금액 합계 지급 기준월 OCR 필요', 'OCR후보: 표형 페이지 | 페이지 ' || p || ' | 표 원문 재확인 필요', '표값: ' || section]
  ELSE ['OCR후보: 텍스트 부족 페이지 | 페이지 ' || p || ' | 이미지 스캔 표 숫자 단가 금액 확인', 'OCR후보: 텍스트 부족 페이지 | 페이지 ' || p || ' | 원문 확인 필요', '표값: ' || section] END AS hints
  FROM (SELECT id, section, contains(text, '|') AS t, (id % 40 + 1)::VARCHAR AS p FROM chunks)""", (C.CHUNKS,))  # fmt: skip
def ocr_lazy_hints(spark, sf):
    hints = F.array(F.concat(F.lit("표값:  "), "section"), F.lit("other line"), F.concat(F.lit("표값: "), "section"))
    return C.chunks(spark, sf).select("id", G.lazy_hints(F.col("id") % 40 + 1, F.col("text").contains("|"), hints).alias("hints"))


CHROME = r"(t = '' OR lower(t) IN ('header', 'footer', 'image', 'text', 'paragraph_title', 'statistics korea') OR regexp_matches(lower(t), '^https?://') OR regexp_full_match(t, '[·ㆍ∙.\-–—_ ]{3,}') OR starts_with(lower(t), 'imgs/') OR regexp_matches(lower(t), '\.(jpg|jpeg|png|gif|webp)($|[^a-z0-9_])') OR starts_with(t, '표의미:'))"
CODE = r"regexp_matches(t, '^([①-⑳㉑-㊿]|\(?[0-9]{1,2}\)?[.)]?|[가-힣A-Za-z]\))\s*.+')"
DEF = rf"""dl AS (SELECT doc_id, line_no, CASE line_no % 5 WHEN 1 THEN trim(substr(text, 1, 9)) WHEN 3 THEN (line_no % 20 + 1)::VARCHAR || ') ' || text ELSE text || ' 설명' END AS t FROM lines),
dp AS (SELECT *, {CHROME} AS chrome, {CODE} AS code0 FROM dl),
dm AS (SELECT *, t <> '' AND length(t) <= 12 AND NOT chrome AND NOT code0 AND NOT regexp_matches(t, '[.!?。]$') AND regexp_matches(t, '[A-Za-z가-힣]') AS head FROM dp)"""


def _def_lines(spark, sf):
    n = F.col("line_no")
    text = F.when(n % 5 == 1, F.trim(F.substring("text", 1, 9))).when(n % 5 == 3, F.concat((n % 20 + 1).cast("string"), F.lit(") "), "text")).otherwise(F.concat("text", F.lit(" 설명")))
    return IP._lines(spark, sf).select("doc_id", "line_no", text.alias("text"))


@query("def_predicates", "SELECT doc_id, line_no, chrome, head, code0 AS code FROM dm", (IP.LINES, DEF))
def def_predicates(spark, sf):
    return _def_lines(spark, sf).select("doc_id", "line_no", G.chrome("text").alias("chrome"), G.is_heading("text").alias("head"), G.is_code("text").alias("code"))


@query("def_facts", """SELECT doc_id, block_no, subject, body FROM (SELECT doc_id, block AS block_no, max(CASE WHEN head THEN t WHEN code THEN CASE WHEN h <> '' THEN h || ' > ' || t ELSE t END END) AS subject,
    coalesce(string_agg(t, ' ' ORDER BY line_no) FILTER (NOT head AND NOT code), '') AS body FROM (
      SELECT *, sum((head OR code)::INT) OVER w AS block, coalesce(last_value(CASE WHEN head THEN t END IGNORE NULLS) OVER w, '') AS h FROM (SELECT *, code0 AND NOT head AS code FROM dm WHERE NOT chrome) WINDOW w AS (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING))
    WHERE block > 0 GROUP BY doc_id, block)
  WHERE (contains(subject, '>') OR length(replace(subject, ' ', '')) > 1) AND regexp_matches(subject, '[가-힣A-Za-z①-⑳㉑-㊿]') AND length(body) >= 8 AND regexp_matches(body, '[가-힣]')""", (IP.LINES, DEF))  # fmt: skip
def def_facts(spark, sf):
    return G.definitions(_def_lines(spark, sf))


DEFAULT_STATS = {"k": 0, "pages": 0, "ratio": 0.0, "parser": "text", "ocr": False}


@query("pdf_stats_normalize", "SELECT run_id, coalesce(k, 0)::BIGINT AS k, 0::BIGINT AS pages, CASE WHEN run_id % 2 = 0 THEN latency ELSE 0.0 END AS ratio, CASE WHEN run_id % 3 = 0 THEN status ELSE 'text' END AS parser, run_id % 5 = 0 AS ocr FROM runs", (C.RUNS,))
def pdf_stats_normalize(spark, sf):
    """Statistics of which some are absent and one can't be read."""
    i = F.col("run_id")
    stats = F.to_json(F.struct("k", F.lit("many").alias("pages"), F.when(i % 2 == 0, F.col("latency")).alias("ratio"), F.when(i % 3 == 0, F.col("status")).alias("parser"), F.when(i % 5 == 0, True).alias("ocr")))
    return C.runs(spark, sf).withColumn("stats", stats).select("run_id", *G.normalize_stats(F.col("stats"), DEFAULT_STATS))


@query("chunk_rows", """SELECT "values"[2] AS sheet, row_no AS row, row_no AS row_end, 'Sheet:' || "values"[2] AS section, md5('[Sheet: ' || "values"[2] || ']' || chr(10) || '[Columns: 품목|brand|type|size]' || chr(10) || array_to_string("values", ' | ') || CASE WHEN row_no % 2 = 0 THEN chr(10) || 'fact ' || "values"[1] ELSE '' END) AS text_md5 FROM fact_rows""", (C.FACT_ROWS,))
def chunk_rows(spark, sf):
    rows = C.fact_rows(spark, sf).select(F.col("values")[1].alias("sheet"), F.col("row_no").alias("row"), F.col("headers").alias("columns"), F.array_join("values", " | ").alias("row_text"), F.when(F.col("row_no") % 2 == 0, F.concat(F.lit("fact "), F.col("values")[0])).otherwise("").alias("fact_text"))
    return G.row_chunks(rows).withColumn("text_md5", F.md5("text")).drop("text")


@query("chunk_rows_grouped", """WITH r AS (SELECT "values"[2] AS sheet, row_no, row_number() OVER (PARTITION BY "values"[2] ORDER BY row_no) AS i, count(*) OVER (PARTITION BY "values"[2]) AS n,
    greatest(1, floor(len(regexp_extract_all(array_to_string("values", ' | '), '[0-9A-Za-zㄱ-ㆎ가-힣]+')) * 1.08::DOUBLE)) AS t FROM fact_rows),
c AS (SELECT *, sum(t) OVER (PARTITION BY sheet ORDER BY i) AS run FROM r),
stop AS (SELECT a.sheet, a.i AS first, min(CASE WHEN b.i - a.i + 1 >= 10 AND b.run - a.run + a.t >= 620 THEN b.i WHEN b.i - a.i >= 10 AND b.run - a.run + a.t > 780 THEN b.i - 1 WHEN b.i - a.i = 29 OR b.i = b.n THEN b.i END) AS last, any_value(a.n) AS n
  FROM c a JOIN c b ON a.sheet = b.sheet AND b.i BETWEEN a.i AND a.i + 29 GROUP BY a.sheet, a.i),
w AS (SELECT sheet, first, last, n FROM stop WHERE first = 1 UNION ALL SELECT s.sheet, s.first, s.last, s.n FROM w JOIN stop s ON s.sheet = w.sheet AND s.first = greatest(w.first + 1, w.last - 2) WHERE w.last < w.n)
SELECT w.sheet, a.row_no AS row, b.row_no AS row_end, w.last - w.first + 1 AS rows FROM w JOIN r a ON a.sheet = w.sheet AND a.i = w.first JOIN r b ON b.sheet = w.sheet AND b.i = w.last""", (C.FACT_ROWS,), recursive=True)  # fmt: skip
def chunk_rows_grouped(spark, sf):
    rows = C.fact_rows(spark, sf).select(F.col("values")[1].alias("sheet"), F.col("row_no").alias("row"), F.array_join("values", " | ").alias("row_text"))
    return G.grouped_row_chunks(rows)


@query("xlsx_qa", """SELECT row_no, "values"[3] AS question, CASE WHEN row_no % 2 = 0 THEN "values"[1] ELSE "values"[2] END AS answer FROM fact_rows""", (C.FACT_ROWS,))
def xlsx_qa(spark, sf):
    """Rows with a question column; every second one also has an answer column, the others go by place."""
    v = F.col("values")
    full = F.map_from_arrays(F.array(F.lit("no"), F.lit("Que stion"), F.lit("답변")), F.array(F.lit(""), v[2], v[0]))
    bare = F.map_from_arrays(F.array(F.lit("no"), F.lit("질문"), F.lit("size")), F.array(F.lit(""), v[2], v[1]))
    pair = G.qa_pair(F.when(F.col("row_no") % 2 == 0, full).otherwise(bare))
    return C.fact_rows(spark, sf).select("row_no", pair.alias("p")).select("row_no", "p.question", "p.answer")


@query("structure_normalize", r"""SELECT id, CASE WHEN section = 's0' THEN 'body' ELSE 'table' END AS chunk_kind, [source_path, section] AS heading_path, md5(CASE WHEN length(f) <= 2400 THEN f ELSE rtrim(substr(f, 1, 2397)) || '...' END) AS embedding_md5 FROM (
  SELECT id, section, source_path, 'source=' || source_path || ' | role=' || doc_role || ' | path=' || source_path || ' > ' || section || CASE WHEN section = 's0' THEN '' ELSE ' | kind=table' END || chr(10) || CASE WHEN length(b) <= 1800 THEN b ELSE rtrim(substr(b, 1, 1797)) || '...' END AS f
  FROM (SELECT *, trim(regexp_replace(text, '\s+', ' ', 'g')) AS b FROM chunks))""", (C.CHUNKS,))  # fmt: skip
def structure_normalize(spark, sf):
    """Rows of which some lack their kind, with a heading path that repeats a step."""
    kind = F.when(F.col("section") == "s0", "").otherwise("table")
    rows = C.chunks(spark, sf).withColumn("chunk_kind", F.coalesce(F.nullif(kind, F.lit("")), F.lit("body"))).withColumn("heading_path", I.heading_path(F.concat_ws(" > ", "source_path", "section", "source_path")))
    return rows.select("id", "chunk_kind", "heading_path", F.md5(I.embedding_text(F.col("text"), F.col("source_path"), F.col("doc_role"), F.col("heading_path"), F.col("chunk_kind"))).alias("embedding_md5"))


@query("chunk_text_compat", "SELECT source_path, greatest(240, floor(w * 10 / 2.2))::INT AS max_tokens, greatest(120, floor(280 / 2.2))::INT AS min_tokens FROM (SELECT source_path, count(*) AS w FROM chunks GROUP BY source_path)", (C.CHUNKS,))
def chunk_text_compat(spark, sf):
    """Token sizes for chunks of ten characters per row of a source."""
    p = G.text_params()
    rows = C.chunks(spark, sf).groupBy("source_path").agg(F.count("*").alias("w"))
    return rows.select("source_path", F.greatest(F.lit(240), F.floor(F.col("w") * 10 / 2.2)).cast("int").alias("max_tokens"), F.lit(p["min_tokens"]).alias("min_tokens"))


# a tenth of the rows arrives after the bundles have been stored: only the sources that get some of them are made anew
RENEWED = r"""late AS (SELECT DISTINCT source_path FROM chunks WHERE id % 10 = 4 AND is_normalized = 0 AND source_type = 'pdf' AND doc_role = 'guide'),
present AS (SELECT *, source_path IN (SELECT source_path FROM late) AS touched FROM chunks WHERE is_normalized = 0 AND (id % 10 <> 4 OR source_path IN (SELECT source_path FROM late))),
fresh AS (SELECT * FROM present QUALIFY row_number() OVER (PARTITION BY touched, doc_role, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) ORDER BY uploaded_at DESC, id DESC) = 1),
ordered AS MATERIALIZED (SELECT source_path, id, CASE WHEN text = '' THEN 0 ELSE greatest(1, floor(len(regexp_extract_all(text, '[0-9A-Za-z_]+')) * 1.05::DOUBLE)) END::BIGINT AS n, row_number() OVER (PARTITION BY source_path ORDER BY uploaded_at DESC, id DESC) AS rn FROM fresh),
steps AS (SELECT source_path, id, n, rn, 1 AS bundle, n AS used FROM ordered WHERE rn = 1
  UNION ALL SELECT o.source_path, o.id, o.n, o.rn, CASE WHEN used >= 360 OR used + o.n > 460 THEN bundle + 1 ELSE bundle END, CASE WHEN used >= 360 OR used + o.n > 460 THEN o.n ELSE used + o.n END
  FROM steps s JOIN ordered o ON o.source_path = s.source_path AND o.rn = s.rn + 1)"""


@query("norm_refresh", "SELECT source_path AS grp, bundle, list(id ORDER BY rn) AS ids, sum(n)::INT AS tokens FROM steps GROUP BY source_path, bundle", (C.CHUNKS, RENEWED), recursive=True)
def norm_refresh(spark, sf):
    """Stored bundles of all sources after late rows have come: the touched sources are made anew from all their rows."""
    from docloom.functions import text as T
    from docloom.operators import refresh as N
    from docloom.tables import folder

    c = C.chunks(spark, sf).filter("is_normalized = 0")
    path, size = folder(spark, "bundles"), T.packing_tokens("text")
    N.store(N.bundles(c.filter("id % 10 <> 4"), F.col("source_path"), size), path, "grp")
    late = c.filter("id % 10 = 4 AND source_type = 'pdf' AND doc_role = 'guide'").select(F.col("source_path").alias("grp"))
    make = lambda touched: N.bundles(c.join(F.broadcast(touched), F.col("source_path") == F.col("grp")).drop("grp"), F.col("source_path"), size)
    N.refresh(path, N.BUNDLES, "grp", late, make, ["grp", "ids"])
    return spark.read.schema(N.BUNDLES).parquet(path).select("grp", "bundle", "ids", "tokens")


# eight places in a lane; a job may run for six hours
ROOM, STALL = 8, 21_600
LANE_EVENTS = """lane_events AS (SELECT (['upload-fast', 'upload-pdf', 'ocr', 'ontology'])[user_id % 4 + 1] AS kind, kb AS space, run_id AS event_id, created_at AS at_,
  CASE WHEN status IN ('view', 'click') THEN 'submit' WHEN status = 'purchase' THEN 'take' WHEN status = 'signup' THEN 'finish' WHEN k < 60 THEN 'fail' WHEN k < 95 THEN 'cancel' ELSE 'restart' END AS action FROM runs)"""
# one step for each event of a lane: its queue, its running jobs and what it says
LANES = """numbered AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY kind, space ORDER BY at_, event_id) AS n FROM lane_events),
fold AS (SELECT kind, space, 0::BIGINT AS n, []::STRUCT(j BIGINT, v INT)[] AS q, []::STRUCT(j BIGINT, v INT, s BIGINT)[] AS r, []::STRUCT(job BIGINT, version INT, status VARCHAR, code VARCHAR, at_ BIGINT)[] AS said FROM (SELECT DISTINCT kind, space FROM lane_events)
  UNION ALL SELECT kind, space, n,
    CASE WHEN action = 'submit' AND len(q) < 8 THEN list_append(q, {j: event_id, v: 1}) WHEN action = 'take' THEN q[2:] WHEN action = 'cancel' THEN q[:len(q) - 1]
         WHEN action = 'restart' THEN list_concat(list_transform(alive[:8 - len(q)], lambda x: {j: x.j, v: x.v + 1}), q) ELSE q END,
    CASE WHEN action = 'take' AND len(q) > 0 THEN list_append(alive, {j: q[1].j, v: q[1].v + 1, s: at_}) WHEN action IN ('finish', 'fail') THEN alive[2:]
         WHEN action = 'cancel' AND len(q) = 0 AND len(alive) > 0 THEN list_append(alive[:len(alive) - 1], {j: alive[-1].j, v: alive[-1].v + 1, s: alive[-1].s}) WHEN action = 'restart' THEN [] ELSE alive END,
    list_concat(list_transform(list_filter(r, lambda x: x.s + 21600 <= at_), lambda x: {job: x.j, version: x.v + 1, status: 'error', code: 'stalled', at_: x.s + 21600}),
      CASE WHEN action = 'submit' THEN [{job: event_id, version: 1, status: CASE WHEN len(q) < 8 THEN 'queued' ELSE 'error' END, code: CASE WHEN len(q) < 8 THEN '' ELSE 'queue_full' END, at_: at_}]
           WHEN action = 'take' AND len(q) > 0 THEN [{job: q[1].j, version: q[1].v + 1, status: 'processing', code: '', at_: at_}]
           WHEN action IN ('finish', 'fail') AND len(alive) > 0 THEN [{job: alive[1].j, version: alive[1].v + 1, status: CASE WHEN action = 'finish' THEN 'success' ELSE 'error' END, code: CASE WHEN action = 'finish' THEN '' ELSE 'failed' END, at_: at_}]
           WHEN action = 'cancel' AND len(q) > 0 THEN [{job: q[-1].j, version: q[-1].v + 1, status: 'cancelled', code: '', at_: at_}]
           WHEN action = 'cancel' AND len(alive) > 0 THEN [{job: alive[-1].j, version: alive[-1].v + 1, status: 'cancelling', code: '', at_: at_}]
           WHEN action = 'restart' THEN list_transform(alive, lambda x, i: {job: x.j, version: x.v + 1, status: CASE WHEN i <= 8 - len(q) THEN 'queued' ELSE 'error' END, code: CASE WHEN i <= 8 - len(q) THEN 'recovered' ELSE 'requeue_full' END, at_: at_})
           ELSE [] END)
  FROM (SELECT e.*, f.q, f.r, list_filter(f.r, lambda x: x.s + 21600 > e.at_) AS alive FROM fold f JOIN numbered e ON e.kind = f.kind AND e.space = f.space AND e.n = f.n + 1)),
ends AS (SELECT kind, space, arg_max(r, n) AS r FROM fold GROUP BY kind, space),
changes AS (SELECT kind, space, unnest(said) AS x FROM fold UNION ALL SELECT kind, space, {job: x.j, version: x.v + 1, status: 'error', code: 'stalled', at_: x.s + 21600} FROM (SELECT kind, space, unnest(r) AS x FROM ends) WHERE x.s + 21600 <= (SELECT max(at_) FROM lane_events))"""


def lane_events(spark, sf):
    """Runs as events of lanes: kinds of jobs by user, spaces by knowledge base."""
    r = C.runs(spark, sf)
    kind = F.element_at(F.array(*map(F.lit, ("upload-fast", "upload-pdf", "ocr", "ontology"))), (F.col("user_id") % 4 + 1).cast("int"))
    status, k = F.col("status"), F.col("k")
    action = F.when(status.isin("view", "click"), "submit").when(status == "purchase", "take").when(status == "signup", "finish").when(k < 60, "fail").when(k < 95, "cancel").otherwise("restart")
    return r.select(kind.alias("kind"), F.col("kb").alias("space"), F.col("run_id").alias("event_id"), action.alias("action"), F.col("created_at").alias("at"))


@query("st_queue_lanes", "SELECT kind, space, x.job AS job, x.version AS version, x.status AS status, x.code AS code FROM changes", (C.RUNS, LANE_EVENTS, LANES), recursive=True)
def st_queue_lanes(spark, sf):
    """Every public change of every job in bounded lanes, out of the stream: all events have arrived, and the stream runs until it has read them."""
    from docloom.streaming import lanes
    from docloom.tables import folder

    given, out = folder(spark, "lane-events"), folder(spark, "lane-changes")
    e = lane_events(spark, sf)
    e.write.parquet(given)
    lanes.run_once(spark.readStream.schema(e.schema).parquet(given), out, folder(spark, "lane-checkpoint"), ROOM, STALL)
    return spark.read.schema(lanes.OUT).parquet(out).drop("at")


@query("jobs_by_kind", "SELECT kind, x.status AS status, x.code AS code, count(*) AS n, count(DISTINCT x.job) AS jobs FROM changes GROUP BY ALL", (C.RUNS, LANE_EVENTS, LANES), recursive=True)
def jobs_by_kind(spark, sf):
    """Changes of the jobs of each kind (uploads, OCR, fact rebuilds), from whole histories."""
    from docloom.streaming import lanes

    e = lane_events(spark, sf)
    until = e.agg(F.max("at")).first()[0] or 0
    return lanes.replay(e, ROOM, STALL, until).groupBy("kind", "status", "code").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("job").alias("jobs"))


# five batches: all rows, edits, deletions, late edits of rows that are older than what is stored, deleted rows that come back
CHANGES = """changes AS (SELECT doc_id AS id, 1 AS version, text, false AS deleted, 0 AS batch FROM documents UNION ALL SELECT doc_id, 3, 'edited ' || text, false, 1 FROM documents WHERE doc_id % 7 = 0
  UNION ALL SELECT doc_id, 4, NULL, true, 2 FROM documents WHERE doc_id % 10 = 3 UNION ALL SELECT doc_id, 2, 'late ' || text, false, 3 FROM documents WHERE doc_id % 14 = 0 OR doc_id % 11 = 1
  UNION ALL SELECT doc_id, 5, 'again ' || text, false, 4 FROM documents WHERE doc_id % 20 = 3 UNION ALL SELECT doc_id, 6, NULL, true, 5 FROM documents WHERE doc_id % 40 = 3)"""


def changes(spark, sf, batch):
    """One batch of changes of the documents."""
    d = C.read(spark, sf, "documents")
    i, text = F.col("doc_id"), F.col("text")
    when, version, body = [
        (F.lit(True), 1, text), (i % 7 == 0, 3, F.concat(F.lit("edited "), text)), (i % 10 == 3, 4, None), ((i % 14 == 0) | (i % 11 == 1), 2, F.concat(F.lit("late "), text)),
        (i % 20 == 3, 5, F.concat(F.lit("again "), text)), (i % 40 == 3, 6, None),
    ][batch]
    return d.filter(when).select(i.alias("id"), F.lit(version).alias("version"), (body if body is not None else F.lit(None).cast("string")).alias("text"), F.lit(body is None).alias("deleted"))


@query("st_incremental_index", r"SELECT id, version, md5(text) AS text_md5, len(list_distinct(list_transform(regexp_extract_all(text, '[0-9A-Za-zㄱ-ㆎ가-힣]+'), lambda x: lower(x))))::INT AS tokens FROM (SELECT * FROM changes QUALIFY row_number() OVER (PARTITION BY id ORDER BY version DESC, batch DESC) = 1) WHERE NOT deleted", (CHANGES,))
def st_incremental_index(spark, sf):
    """The index of a corpus that six batches of a stream have changed: edits, deletions, late and repeated versions."""
    from docloom.functions import text as T
    from docloom.streaming.store import Store, maintain
    from docloom.tables import folder

    given, checkpoint, store = folder(spark, "index-changes"), folder(spark, "index-checkpoint"), Store(spark, folder(spark, "index-store"), "id", "version")
    build = lambda rows: rows.select("id", "version", F.md5("text").alias("text_md5"), F.size(F.array_distinct(F.transform(T.extract_all("text", T.TOKEN), lambda t: F.lower(t)))).alias("tokens"))
    for batch in range(6):
        rows = changes(spark, sf, batch)
        rows.write.mode("append").parquet(given)
        maintain(spark.readStream.schema(rows.schema).parquet(given), store, checkpoint, build).awaitTermination()  # a new query each time, from its checkpoint
    return store.read().select("id", "version", "text_md5", "tokens")


@query("st_recovery", "SELECT user_id, arg_max(run_id, created_at * 1000000 + run_id) AS run_id FROM runs GROUP BY user_id HAVING arg_max(status, created_at * 1000000 + run_id) NOT IN ('purchase', 'error')", (C.RUNS,))
def st_recovery(spark, sf):
    """Last state of each job; those that had not come to an end are queued again."""
    last = C.runs(spark, sf).groupBy("user_id").agg(F.max_by(F.struct("run_id", "status"), F.struct("created_at", "run_id")).alias("x"))
    return last.filter(~F.col("x.status").isin("purchase", "error")).select("user_id", "x.run_id")


@query("join_session_user", "SELECT o_orderkey AS session_id, c_custkey AS user_id FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderdate > (SELECT max(o_orderdate) FROM orders) - INTERVAL 365 DAY AND c_acctbal >= 0")
def join_session_user(spark, sf):
    """Orders as sessions that end a year after they begin, customers as users that are active while in credit."""
    o, c = C.read(spark, sf, "orders"), C.read(spark, sf, "customer")
    now = F.broadcast(o.agg(F.max("o_orderdate").alias("now")))  # one row
    live = o.join(now).filter(F.col("o_orderdate") > F.col("now") - F.expr("INTERVAL 365 DAYS"))
    return live.join(c.filter("c_acctbal >= 0"), o["o_custkey"] == c["c_custkey"]).select(F.col("o_orderkey").alias("session_id"), F.col("c_custkey").alias("user_id"))


@query("history_clear", "SELECT session_id, seq FROM messages WHERE session_id NOT IN (SELECT session_id FROM messages WHERE role = 'system')", (C.MESSAGES,))
def history_clear(spark, sf):
    """Messages that stay when sessions with a system message are cleared."""
    m = C.messages(spark, sf)
    return m.join(m.filter("role = 'system'").select("session_id").distinct(), "session_id", "left_anti").select("session_id", "seq")


@query("history_toggle", "SELECT session_id, arg_max(role, seq) = 'assistant' AS enabled, max(seq) AS updated_at FROM messages GROUP BY session_id", (C.MESSAGES,))
def history_toggle(spark, sf):
    """A session's flag as its last message sets it."""
    return C.messages(spark, sf).groupBy("session_id").agg((F.max_by("role", "seq") == "assistant").alias("enabled"), F.max("seq").alias("updated_at"))


@query("wiki_resolve", "SELECT answer_id, flag, CASE WHEN status = 'published' THEN 'resolved' ELSE 'open' END AS state, CASE WHEN status = 'published' THEN updated_at + 60 ELSE updated_at END AS updated_at FROM (SELECT *, unnest(flags) AS flag FROM answers)", (C.ANSWERS,))
def wiki_resolve(spark, sf):
    """Findings of saved answers; those of published answers are resolved a minute later."""
    f = C.answers(spark, sf).select("answer_id", F.explode("flags").alias("flag"), "status", "updated_at")
    done = f.filter("status = 'published'").select("answer_id", "flag", (F.col("updated_at") + 60).alias("at"))
    out = f.join(done, ["answer_id", "flag"], "left")
    return out.select("answer_id", "flag", F.when(F.col("at").isNotNull(), "resolved").otherwise("open").alias("state"), F.coalesce("at", "updated_at").alias("updated_at"))


@query("wiki_review_chunks", """WITH raw AS (SELECT id, source_path, uploaded_at FROM chunks WHERE is_normalized = 0),
log AS (SELECT source_path, list(id ORDER BY uploaded_at DESC, id DESC)[1:8] AS ids FROM raw GROUP BY source_path)
SELECT answer_id, CASE WHEN r.id IS NOT NULL THEN [r.id] ELSE coalesce(ids, []) END AS ids FROM answers a LEFT JOIN raw r ON r.id = a.chunk_id LEFT JOIN log l ON l.source_path = a.source_path""", (C.CHUNKS, C.ANSWERS))  # fmt: skip
def wiki_review_chunks(spark, sf):
    """The cited raw row of each answer, else the first eight raw rows of its source's newest log."""
    raw = C.chunks(spark, sf).filter("is_normalized = 0").select("id", "source_path", "uploaded_at")
    place = F.row_number().over(W.partitionBy("source_path").orderBy(F.desc("uploaded_at"), F.desc("id")))
    log = raw.withColumn("place", place).filter("place <= 8").groupBy("source_path").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "id"))), lambda x: x["id"]).alias("logged"))
    a = C.answers(spark, sf).join(raw.select(F.col("id").alias("chunk_id"), F.lit(True).alias("cited")), "chunk_id", "left").join(log, "source_path", "left")
    return a.select("answer_id", F.when(F.col("cited"), F.array("chunk_id")).otherwise(F.coalesce("logged", F.array().cast("array<bigint>"))).alias("ids"))


@query("wiki_answer_page", """SELECT answer_id, 'claims/' || question_key || '-' || answer_id::VARCHAR AS slug, CASE WHEN length(t) > 80 THEN rtrim(substr(t, 1, 80)) || '...' ELSE t END AS title, md5('질문: ' || t || chr(10) || chr(10) || '답변:' || chr(10) || trim(answer)) AS body_md5, 1 AS claims, (CASE WHEN chunk_id > 0 THEN 1 ELSE 0 END)::INT AS sources
  FROM (SELECT *, trim(source_path || ' ' || question_key || ' ' || repeat('about ', (answer_id % 20)::INT)) AS t FROM answers)""", (C.ANSWERS,))  # fmt: skip
def wiki_answer_page(spark, sf):
    """A page with one claim for each saved answer."""
    title = F.trim(F.concat("source_path", F.lit(" "), "question_key", F.lit(" "), F.repeat(F.lit("about "), (F.col("answer_id") % 20).cast("int"))))
    a = C.answers(spark, sf).withColumn("t", title)
    body = F.concat(F.lit("질문: "), "t", F.lit("\n\n답변:\n"), F.trim("answer"))
    short = F.when(F.length("t") > 80, F.concat(F.rtrim(F.substring("t", 1, 80)), F.lit("..."))).otherwise(F.col("t"))
    return a.select("answer_id", F.concat(F.lit("claims/"), T.slug(F.concat_ws("-", "question_key", F.col("answer_id").cast("string")))).alias("slug"), short.alias("title"), F.md5(body).alias("body_md5"), F.lit(1).alias("claims"), (F.col("chunk_id") > 0).cast("int").alias("sources"))


# rows of every third block change: their sizes grow, some go
CHANGED = """edited AS (SELECT row_no, "values"[1] AS subject, "values"[2] AS brand, "values"[3] AS kind, CASE WHEN row_no // 64 % 3 = 1 THEN ("values"[4]::INT + 1)::VARCHAR ELSE "values"[4] END AS size FROM fact_rows WHERE NOT (row_no // 64 % 3 = 1 AND row_no % 7 = 0))"""


@query("facts_rebuild", """SELECT row_no, subject, unnest(['품목', 'brand', 'type', 'size']) AS predicate, unnest([subject, brand, kind, size]) AS object_value FROM edited""", (C.FACT_ROWS, CHANGED))
def facts_rebuild(spark, sf):
    """Stored facts of all rows after some rows have changed or gone: the blocks that hold one are extracted anew."""
    from docloom.operators import refresh as N
    from docloom.tables import folder

    r = C.fact_rows(spark, sf)
    n, v = F.col("row_no"), F.col("values")
    touched = F.floor(n / 64) % 3 == 1
    line = lambda rows: rows.select("row_no", I.row_fact(F.col("headers"), F.col("values")).alias("text"))
    path = folder(spark, "facts")
    N.store(N.facts(line(r)), path, "block")
    grown = F.when(touched, F.array(v[0], v[1], v[2], (v[3].cast("int") + 1).cast("string"))).otherwise(v)
    now = r.filter(~(touched & (n % 7 == 0))).withColumn("values", grown)
    blocks = r.filter(touched).select(N.block_of("row_no").alias("block"))
    make = lambda t: N.facts(line(now.join(F.broadcast(t), N.block_of("row_no") == F.col("block")).drop("block")))
    N.refresh(path, N.FACTS, "block", blocks, make, ["row_no", "predicate", "object_value"])
    return spark.read.schema(N.FACTS).parquet(path).select("row_no", "subject", "predicate", "object_value")
