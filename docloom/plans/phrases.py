"""Queries of the rules over texts: whole messages, rows, lines and columns of the tables, some with a phrase of the rule's language added.

The SQL states each rule itself (its hints as lists, its patterns), not the values it should give. Phrases are added because
the invented texts have none of the hints; the text around them counts too.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators import answers as A
from docloom.operators import evaluate as V
from docloom.operators import gates as G
from docloom.operators import graph
from docloom.operators import ingest as I
from docloom.operators import ops as O
from docloom.operators import rules as R
from docloom.plans import retrieval as P
from docloom.plans.ingest import LINES, _lines
from docloom.plans.registry import query
from docloom.sources import carriers as C

COMPACT = r"lower(regexp_replace(s, '\s+', '', 'g'))"
SINGLE = r"trim(regexp_replace(s, '\s+', ' ', 'g'))"
KEY = r"""regexp_replace(lower(@), '[\s·ㆍ/\\,()\[\]{}<>「」『』''"`_-]+', '', 'g')"""
ANY, NUMERIC = P._any, P.numeric_sql("s")


def items(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def pick(n: Column, values) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))


def first_of(x: str) -> str:
    """SQL: a list's distinct values in order."""
    return f"list_filter({x}, lambda z, i: list_position({x}, z) = i)"


def spoken(name, phrases, rule, sql, column="value"):
    """A rule over all messages (s), each with one of the phrases."""
    cte = f"said AS (SELECT session_id, seq, coalesce(text, '') || ' ' || ({items(phrases)})[(session_id + seq) % {len(phrases)} + 1] AS s FROM messages)"

    @query(name, f"SELECT session_id, seq, {sql} AS {column} FROM said", (C.MESSAGES, cte))
    def run(spark, sf):
        s = F.concat(T.text("text"), F.lit(" "), pick(F.col("session_id") + F.col("seq"), phrases))
        return C.messages(spark, sf).select("session_id", "seq", s.alias("s")).select("session_id", "seq", rule(F.col("s")).alias(column))


def intent_sql(s: str) -> str:
    """SQL of the role that a question asks for."""
    low, v = f"lower(trim({s}))", COMPACT.replace("(s,", f"({s},")
    hits = lambda words: f"len(list_filter({items(words)}, lambda w: contains({low}, w) OR contains({v}, replace(w, ' ', ''))))"
    c = f"({hits(R.CASE_HINTS)} + regexp_matches({low}, '했는데|인데|라면|이면|할 때|경우')::INT)"
    g = f"({hits(R.GUIDE_HINTS)} + regexp_matches({low}, '정의|원칙|기준|규정')::INT)"
    return f"CASE WHEN {c} >= 2 AND {g} = 0 THEN 'casebook' WHEN {g} >= 2 AND {c} = 0 THEN 'guide' WHEN {c} >= {g} + 2 THEN 'casebook' WHEN {g} >= {c} + 2 THEN 'guide' ELSE 'mixed' END"


def rules_sql(rules, default):
    """SQL of ordered rules: the first whose words all stand in the text."""
    cases = " ".join(f"WHEN {' OR '.join('(' + ' AND '.join(f'contains(lower(s), {chr(39)}{w}{chr(39)})' for w in words) + ')' for words in groups)} THEN '{code}'" for groups, code in rules)
    return f"CASE WHEN trim(s) = '' THEN '{default}' {cases} ELSE '{default}' END"


ASKED = ("지급 단가는 얼마", "품목 종류가 뭐야", "회의 3월 10일", "절차 설명", "답례품", "", "10월말", "100%", "안녕하세요", "세금 문의")
ROLES = ("지침 원칙 기준", "사례 faq 예시", "지침 사례", "", "조사했는데 이런 경우 사례", "정의 규정")
spoken("numeric_query", ASKED, R.numeric_question, NUMERIC)
spoken("general_fallback_allowed", ASKED, lambda c: R.general_answer_allowed(c, F.lit(False)), f"NOT {NUMERIC} AND NOT {ANY(R.RISK_HINTS, COMPACT)}")
spoken("intent_role", ROLES, R.role_intent, intent_sql("s"))
spoken("intent_det", ("전체 요약", "정의가 뭐야", "방법 알려줘", "차이 비교", "", "정리 방법"), R.question_intent, "CASE " + " ".join(f"WHEN {ANY(words, SINGLE)} THEN '{name}'" for name, words in R.INTENTS) + f" WHEN {SINGLE} <> '' THEN 'fact' ELSE 'mixed' END")
NUMBERS = r"list_transform(regexp_extract_all(s, '(?:^|[^0-9])([0-9]{1,3})\s*번', 1)[1:3], lambda n: [n || '번', n || '.', n || ' 항목', n || ' 단계', '제' || n || '항', 'section ' || n, 'result ' || n])"
spoken("variant_expand", ("3번 항목", "", "12번 그리고 7 번, 3번 또 99번", "5 번 5번"), lambda c: F.md5(G.expand_number_refs(c)), f"md5(CASE WHEN len({NUMBERS}) > 0 THEN s || ' ' || array_to_string({first_of(f'flatten({NUMBERS})')}, ' ') ELSE s END)")
PARTS = f"list_concat([{SINGLE}], regexp_extract_all({SINGLE}, '[0-9A-Za-z가-힣_.%/()·ㆍ-]{{2,}}'))"
spoken("variant_det_expand", ("a  bb cc bb", "", "지급(단가) 3.5%"), lambda c: F.md5(R.expansion(c)), f"md5(CASE WHEN {SINGLE} = '' THEN '' ELSE array_to_string(({first_of(PARTS)})[1:12], ' ') END)")
LISTED = r"list_filter(list_transform(string_split(replace(s, '. ', ' || '), '||'), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '' AND x <> '-')"
spoken("helper_items", ("|| a || - ||  c  d || a", "", "||-||", "end"), lambda c: F.md5(F.array_join(R.helper_items(F.replace(c, F.lit(". "), F.lit(" || "))), ",")), f"md5(array_to_string(({first_of(LISTED)})[1:4], ','))")
spoken("doc_renumber", ("see [DOC 1] and [DOC 12].", "", "[DOC x] [DOC 2]", "[DOC 3][DOC 4]"), lambda c: F.md5(R.renumber(c, 5)), r"""md5(array_to_string(list_concat((string_split(s, '[DOC '))[1:1],
  list_transform((string_split(s, '[DOC '))[2:], lambda x: CASE WHEN regexp_matches(x, '^[0-9]+\]') THEN (regexp_extract(x, '^([0-9]+)\]', 1)::INT + 4)::VARCHAR || regexp_replace(x, '^[0-9]+', '') ELSE x END)), '[DOC '))""")
spoken("classify_failure", tuple(" and ".join(words) for groups, _ in O.FAILURES for words in groups) + ("",), lambda c: O.by_rules(c, O.FAILURES, "runtime_error"), rules_sql(O.FAILURES, "runtime_error"), "code")
spoken("classify_ocr_failure", tuple(" and ".join(words) for groups, _ in O.OCR_FAILURES for words in groups) + ("",), lambda c: O.by_rules(c, O.OCR_FAILURES, ""), rules_sql(O.OCR_FAILURES, ""), "reason")
TOKENS = "list_filter(list_transform(regexp_extract_all(s, '[0-9A-Za-zㄱ-ㆎ가-힣]+'), lambda x: lower(x)), lambda x: length(x) >= 2)"
ALIASES = " ".join(f"WHEN '{k}' THEN list_concat(['{k}'], {items(v)})" for k, v in graph.QUERY_ALIASES.items())
spoken("fact_alias_expand", ("얼마", "답례품 얼마", "농어가경제조사", ""), lambda c: graph.expand_aliases(T.tokens(c)), f"flatten(list_transform({TOKENS}, lambda t: CASE t {ALIASES} ELSE [t] END))", "tokens")


@query("role_plan", f"SELECT query_id, CASE role WHEN 'mixed' THEN ['all'] ELSE [role, 'all'] END AS plan FROM (SELECT query_id, {intent_sql('s')} AS role FROM (SELECT query_id, query || ' ' || ({items(ROLES)})[query_id % {len(ROLES)} + 1] AS s FROM questions))", (C.QUESTIONS,))
def role_plan(spark, sf):
    """Which roles to try for each question, by what it asks for."""
    s = F.concat("query", F.lit(" "), pick(F.col("query_id"), ROLES))
    return C.questions(spark, sf).select("query_id", R.role_plan(R.role_intent(s)).alias("plan"))


NAMES = ("사례집.hwpx", "Guide.pdf", ".xlsx", ".txt", ".hwpx", "-규정.xlsx", " Q&A.txt")


@query("infer_role_upload", f"SELECT id, CASE WHEN {ANY(R.CASE_NAMES, 'lower(trim(s))')} THEN 'casebook' WHEN {ANY(R.GUIDE_NAMES, 'lower(trim(s))')} THEN 'guide' WHEN s LIKE '%.xlsx' THEN 'casebook' WHEN s LIKE '%.txt' OR s LIKE '%.pdf' THEN 'guide' ELSE 'unknown' END AS value FROM (SELECT id, source_path || ({items(NAMES)})[id % {len(NAMES)} + 1] AS s FROM chunks)", (C.CHUNKS,))
def infer_role_upload(spark, sf):
    """Roles of files by name and kind, a file for each row."""
    c = C.chunks(spark, sf).select("id", F.concat("source_path", pick(F.col("id"), NAMES)).alias("s"))
    return c.select("id", R.upload_role(F.col("s"), F.regexp_extract("s", r"(\.[a-z]+)$", 1)).alias("value"))


MARKED = ("", "Guide/a", "a 사례집", "Q&A", "지침서")


@query("record_role", f"SELECT id, CASE WHEN {ANY(('사례집', 'casebook', 'q&a'), 'lower(s)')} THEN 'casebook' WHEN {ANY(('지침서', 'guide'), 'lower(s)')} THEN 'guide' ELSE '' END AS value FROM (SELECT id, source_path || ' ' || doc_role || ({items(MARKED)})[id % {len(MARKED)} + 1] AS s FROM chunks)", (C.CHUNKS,))
def record_role(spark, sf):
    s = F.lower(F.concat("source_path", F.lit(" "), "doc_role", pick(F.col("id"), MARKED)))
    return C.chunks(spark, sf).select("id", F.when(T.any_in(s, ("사례집", "casebook", "q&a")), "casebook").when(T.any_in(s, ("지침서", "guide")), "guide").otherwise("").alias("value"))


MODELS = ("multilingual-e5", "Qwen3-Embedding", "jina-embeddings-v5", "other")


@query("task_prefix", f"""SELECT id, md5(CASE WHEN contains(m, 'jina') AND contains(m, 'embeddings-v5') THEN v WHEN contains(m, 'qwen') AND contains(m, 'embedding') THEN CASE task WHEN 'query' THEN 'Instruct: find' || chr(10) || 'Query: ' || v ELSE v END
  WHEN contains(m, 'e5') THEN task || ': ' || v ELSE v END) AS value FROM (SELECT id, trim(text) AS v, lower(({items(MODELS)})[id % 4 + 1]) AS m, CASE WHEN id % 8 < 4 THEN 'query' ELSE 'passage' END AS task FROM chunks)""", (C.CHUNKS,))  # fmt: skip
def task_prefix(spark, sf):
    """What is sent to each family of embedding models, for queries and passages."""
    task = F.when(F.col("id") % 8 < 4, "query").otherwise("passage")
    return C.chunks(spark, sf).select("id", F.md5(R.task_prefix(pick(F.col("id"), MODELS), task, "text", "find")).alias("value"))


# rows that are placeholders of pages, in part or as a whole
WEAK = "weak AS (SELECT id, source_type, section, CASE id % 5 WHEN 1 THEN 'OCR후보: ' || text WHEN 2 THEN 'OCR후보: page ' || id::VARCHAR || chr(10) || ' OCR후보: ' || section WHEN 3 THEN 'OCR후보: 표값: ' || text WHEN 4 THEN 'OCR후보: ' || substr(text, 1, 20 + id % 400) || chr(10) || 'more' ELSE text END AS s FROM chunks)"
IS_WEAK = f"(contains(s, 'OCR후보:') AND NOT {ANY(R.TABLE_MARKS, 's')} AND (length(trim(s)) <= 240 OR len(list_filter(string_split(trim(s), chr(10)), lambda x: trim(x) <> '' AND NOT starts_with(trim(x), 'OCR후보:'))) = 0))"


def _weak(spark, sf):
    i, text = F.col("id"), F.col("text")
    mark = F.lit("OCR후보: ")
    s = (
        F.when(i % 5 == 1, F.concat(mark, text)).when(i % 5 == 2, F.concat(F.lit("OCR후보: page "), i.cast("string"), F.lit("\n OCR후보: "), "section")).when(i % 5 == 3, F.concat(mark, F.lit("표값: "), text))
        .when(i % 5 == 4, F.concat(mark, F.substring(text, F.lit(1), (i % 400 + 20).cast("int")), F.lit("\nmore"))).otherwise(text)
    )
    return C.chunks(spark, sf).select("id", "source_type", "section", s.alias("s"))


@query("weak_ocr_hint", f"SELECT id, {IS_WEAK} AS value FROM weak", (C.CHUNKS, WEAK))
def weak_ocr_hint(spark, sf):
    return _weak(spark, sf).select("id", G.weak_hint("s").alias("value"))


@query("sc_weak_ocr", f"SELECT id, CASE WHEN NOT {IS_WEAK} THEN 0.0 WHEN length(s) % 100 / 1000.0 <= 0.001 THEN 0.08 WHEN length(s) % 100 / 1000.0 <= 0.03 THEN 0.04 ELSE 0.0 END::DOUBLE AS penalty FROM weak", (C.CHUNKS, WEAK))
def sc_weak_ocr(spark, sf):
    """What placeholders lose, by the best of their other scores (here from the length of the text)."""
    from docloom.operators.retrieval import weak_penalty

    return _weak(spark, sf).select("id", weak_penalty(G.weak_hint("s"), F.length("s") % 100 / 1000.0).alias("penalty"))


@query("lazy_ocr_needed", f"SELECT id, source_type = 'pdf' AND id % 3 > 0 AND ({IS_WEAK} OR {ANY(R.TABLE_MARKS, 's')}) AS needed FROM weak", (C.CHUNKS, WEAK))
def lazy_ocr_needed(spark, sf):
    """Pages that are read again when a question meets them: of a paged file, with a known page, weak or of a table."""
    page = R.page_of(F.lit(0), F.when(F.col("id") % 3 > 0, F.concat(F.lit("PDF page "), (F.col("id") % 3).cast("string"))).otherwise(F.col("section")))
    return _weak(spark, sf).select("id", ((F.col("source_type") == "pdf") & (page > 0) & (G.weak_hint("s") | T.any_in(F.col("s"), R.TABLE_MARKS))).alias("needed"))


@query("location_label", "SELECT id, CASE WHEN n > 2 THEN '라인 ' || (n // 2)::VARCHAR || '-' || n::VARCHAR WHEN doc_role = 'guide' THEN section ELSE '위치 정보 없음' END AS label FROM (SELECT *, len(string_split(text, chr(10))) AS n FROM chunks)", (C.CHUNKS,))
def location_label(spark, sf):
    """The second half of the lines of a text, else its section."""
    n = F.size(F.split("text", "\n"))
    return C.chunks(spark, sf).select("id", R.location(F.when(n > 2, F.floor(n / 2)).otherwise(0), n, F.when(F.col("doc_role") == "guide", F.col("section")).otherwise("")).alias("label"))


CHROME = "(['Header', 'http://x.example/', '----', 'Ⅲ', 'imgs/', '표의미: ', ' photo.png', '', '', ''])[(doc_id + line_no) % 10 + 1]"


@query("page_chrome_filter", rf"""SELECT doc_id, line_no, v = '' OR low IN ({', '.join(f"'{w}'" for w in R.PAGE_WORDS)}) OR regexp_matches(low, '^https?://') OR regexp_full_match(v, '[·ㆍ∙.\-–—_ ]{{3,}}') OR starts_with(low, 'imgs/') OR regexp_matches(low, '\.(jpg|jpeg|png|gif|webp)\b')
    OR starts_with(low, '표의미:') OR regexp_full_match(lower(regexp_replace(s, '\s+', '', 'g')), '[ⅰ-ⅹ]+') AS value
  FROM (SELECT *, trim(regexp_replace(s, '\s+', ' ', 'g')) AS v, lower(trim(regexp_replace(s, '\s+', ' ', 'g'))) AS low FROM (SELECT doc_id, line_no, CASE (doc_id + line_no) % 10 WHEN 0 THEN 'Header' WHEN 2 THEN '----' WHEN 3 THEN 'Ⅲ' WHEN 6 THEN text || ' photo.png' ELSE {CHROME} || text END AS s FROM lines))""", (LINES,))  # fmt: skip
def page_chrome_filter(spark, sf):
    """Which lines of the documents, some turned into page chrome, would be left out."""
    n = F.col("doc_id") + F.col("line_no")
    marks = ("Header", "http://x.example/", "----", "Ⅲ", "imgs/", "표의미: ", " photo.png", "", "", "")
    s = F.when(n % 10 == 0, "Header").when(n % 10 == 2, "----").when(n % 10 == 3, "Ⅲ").when(n % 10 == 6, F.concat("text", F.lit(" photo.png"))).otherwise(F.concat(pick(n, marks), F.col("text")))
    return _lines(spark, sf).select("doc_id", "line_no", R.chrome_line(s).alias("value"))


@query("ocr_retry_plan", """SELECT run_id, coalesce(CASE WHEN k % 4 <= 0 THEN NULL WHEN mode = 'parallel_gpu' AND reason IN ('gpu_oom', 'gpu_timeout') THEN 'single_gpu' WHEN mode = 'parallel_gpu' AND reason IN ('gpu_init_fail', 'gpu_fail') THEN 'cpu'
  WHEN mode = 'single_gpu' AND reason IN ('gpu_oom', 'gpu_timeout', 'gpu_init_fail', 'gpu_fail') THEN 'cpu' END, 'stop') AS value FROM (SELECT run_id, k, (['parallel_gpu', 'single_gpu', 'cpu'])[user_id % 3 + 1] AS mode,
  CASE status WHEN 'view' THEN 'gpu_oom' WHEN 'click' THEN 'gpu_timeout' WHEN 'purchase' THEN 'gpu_init_fail' WHEN 'signup' THEN 'gpu_fail' ELSE 'other' END AS reason FROM runs)""", (C.RUNS,))  # fmt: skip
def ocr_retry_plan(spark, sf):
    """How each failed run would be tried again, by its mode, reason and the tries that are left."""
    reason = F.col("status")
    for name, code in (("view", "gpu_oom"), ("click", "gpu_timeout"), ("purchase", "gpu_init_fail"), ("signup", "gpu_fail"), ("error", "other")):
        reason = F.when(F.col("status") == name, code).otherwise(reason)
    return C.runs(spark, sf).select("run_id", F.coalesce(R.retry_mode(pick(F.col("user_id"), ("parallel_gpu", "single_gpu", "cpu")), reason, F.col("k") % 4, cpu=True), F.lit("stop")).alias("value"))


STAGES = ("embed_chunks", "Store_Chunks", " read_text", "sync_derived", "embed_concepts", "refresh_index")


@query("stage_failure_default", f"SELECT run_id, CASE WHEN NOT latency > 10 THEN 'upload_ingest_fail' WHEN s IN ('embed_chunks', 'embed_concepts', 'sync_derived_concept_embedding') THEN 'upload_embedding_fail' WHEN s IN ('store_chunks', 'refresh_index', 'sync_derived') THEN 'upload_index_fail' ELSE 'upload_ingest_fail' END AS value FROM (SELECT run_id, latency, lower(trim(({items(STAGES)})[k % 6 + 1])) AS s FROM runs)", (C.RUNS,))
def stage_failure_default(spark, sf):
    return C.runs(spark, sf).select("run_id", R.stage_failure(pick(F.col("k"), STAGES), F.col("latency") > 10).alias("value"))


@query("page_stats_from_message", r"SELECT run_id, CASE WHEN regexp_matches(s, '\((\d+)\s*/\s*(\d+)\)') THEN regexp_extract(s, '\((\d+)\s*/\s*(\d+)\)', 1)::INT END AS current_page, CASE WHEN regexp_matches(s, '\((\d+)\s*/\s*(\d+)\)') THEN greatest(regexp_extract(s, '\((\d+)\s*/\s*(\d+)\)', 1)::INT, regexp_extract(s, '\((\d+)\s*/\s*(\d+)\)', 2)::INT) END AS total_pages FROM (SELECT run_id, status || CASE WHEN k % 5 = 0 THEN ' none ' || k::VARCHAR ELSE ' OCR (' || k::VARCHAR || ' / ' || (user_id % 100)::VARCHAR || ')' END AS s FROM runs)", (C.RUNS,))
def page_stats_from_message(spark, sf):
    k = F.col("k").cast("string")
    s = F.concat("status", F.when(F.col("k") % 5 == 0, F.concat(F.lit(" none "), k)).otherwise(F.concat(F.lit(" OCR ("), k, F.lit(" / "), (F.col("user_id") % 100).cast("string"), F.lit(")"))))
    r = C.runs(spark, sf).select("run_id", R.progress_pages(s).alias("p"))
    return r.select("run_id", "p.current_page", "p.total_pages")


@query("pdf_page_of_row", "SELECT run_id, CASE WHEN k % 3 > 0 THEN k % 3 WHEN status = 'view' THEN 0 ELSE greatest(1, user_id % 50) END::INT AS value FROM runs", (C.RUNS,))
def pdf_page_of_row(spark, sf):
    """The page column, else the page that the section names."""
    section = F.when(F.col("status") == "view", "a section").otherwise(F.concat(F.lit("x PDF page  "), (F.col("user_id") % 50).cast("string"), F.lit(" y")))
    return C.runs(spark, sf).select("run_id", R.page_of(F.col("k") % 3, section).cast("int").alias("value"))


LINE = "line AS (SELECT l_orderkey, l_linenumber, CASE l_linenumber % 3 WHEN 0 THEN 's/tbl[' || l_linenumber || ']/tr[' || l_suppkey || ']/tc[' || l_partkey || ']' WHEN 1 THEN 'TABLE[' || l_partkey || ']/p/row[' || l_linenumber || ']' ELSE 'p[' || l_suppkey || ']/cell[x]' END AS s FROM lineitem)"


@query("hwpx_path", r"SELECT l_orderkey, l_linenumber, coalesce(try_cast(regexp_extract(lower(s), '(?:tbl|table)\[(\d+)\]', 1) AS INT), 0) AS table_no, coalesce(try_cast(regexp_extract(lower(s), '(?:tr|row)\[(\d+)\]', 1) AS INT), 0) AS row_no, coalesce(try_cast(regexp_extract(lower(s), '(?:tc|cell)\[(\d+)\]', 1) AS INT), 0) AS cell_no FROM line", (LINE,))
def hwpx_path(spark, sf):
    """Places in tables out of paths, a path for each line item."""
    n = {c: F.col(f"l_{c}").cast("string") for c in ("linenumber", "suppkey", "partkey")}
    kind = F.col("l_linenumber") % 3
    s = F.when(kind == 0, F.concat(F.lit("s/tbl["), n["linenumber"], F.lit("]/tr["), n["suppkey"], F.lit("]/tc["), n["partkey"], F.lit("]"))).when(kind == 1, F.concat(F.lit("TABLE["), n["partkey"], F.lit("]/p/row["), n["linenumber"], F.lit("]"))).otherwise(F.concat(F.lit("p["), n["suppkey"], F.lit("]/cell[x]")))
    p = C.read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", R.table_path(s).alias("p"))
    return p.select("l_orderkey", "l_linenumber", F.col("p.table").alias("table_no"), F.col("p.row").alias("row_no"), F.col("p.cell").alias("cell_no"))


PRICES = "priced AS (SELECT row_no, \"values\"[1] AS name, \"values\"[4] AS size, CASE row_no % 6 WHEN 0 THEN \"values\"[4] WHEN 1 THEN (row_no * 37 % 2000)::VARCHAR WHEN 2 THEN '1,' || \"values\"[4] WHEN 3 THEN ' ' || \"values\"[4] || '.5' WHEN 4 THEN \"values\"[4] || '원' ELSE \"values\"[1] END AS s FROM fact_rows)"


def _prices(spark, sf):
    n, size = F.col("row_no"), F.col("values")[3]
    s = F.when(n % 6 == 0, size).when(n % 6 == 1, (n * 37 % 2000).cast("string")).when(n % 6 == 2, F.concat(F.lit("1,"), size)).when(n % 6 == 3, F.concat(F.lit(" "), size, F.lit(".5"))).when(n % 6 == 4, F.concat(size, F.lit("원"))).otherwise(F.col("values")[0])
    return C.fact_rows(spark, sf).select("row_no", F.col("values")[0].alias("name"), size.alias("size"), s.alias("s"))


@query("price_like", r"SELECT row_no, coalesce(regexp_full_match(replace(trim(s), ',', ''), '\d[\d,]*(?:\.\d+)?') AND try_cast(replace(trim(s), ',', '') AS DOUBLE) > 0 AND try_cast(replace(trim(s), ',', '') AS DOUBLE) <= 500, false) AS value FROM priced", (C.FACT_ROWS, PRICES))
def price_like(spark, sf):
    return _prices(spark, sf).select("row_no", F.coalesce(R.thousand_won("s"), F.lit(False)).alias("value"))


HEADERS = ("지급단가", "brand", "수수료(율)", "size")


@query("fact_format_value", rf"SELECT row_no, CASE WHEN regexp_matches(h, '(단가|금액|비용|가격|수수료|요금)') AND regexp_full_match(s, '\d[\d,]*(?:\.\d+)?') AND NOT contains(r, '천원') AND NOT contains(r, '만원') AND NOT contains(s, '원') THEN s || '천원' ELSE s END AS value FROM (SELECT *, ({items(HEADERS)})[row_no % 4 + 1] AS h, name || ' ' || s || CASE WHEN row_no % 7 = 0 THEN ' 만원' ELSE '' END AS r FROM priced)", (C.FACT_ROWS, PRICES))
def fact_format_value(spark, sf):
    row = F.concat("name", F.lit(" "), "s", F.when(F.col("row_no") % 7 == 0, " 만원").otherwise(""))
    return _prices(spark, sf).select("row_no", I.format_value(pick(F.col("row_no"), HEADERS), F.col("s"), row).alias("value"))


NAMED = "named AS (SELECT row_no, CASE row_no % 3 WHEN 0 THEN \"values\"[1] || '(' || \"values\"[2] || ')' WHEN 1 THEN \"values\"[1] || '·' || \"values\"[3] ELSE \"values\"[1] END AS v FROM fact_rows)"


@query("name_aliases", rf"""SELECT row_no, list_filter(a, lambda x, i: list_position(list_transform(a, lambda y: lower(y)), lower(x)) = i) AS aliases FROM (SELECT row_no, list_filter(list_concat([v, trim(regexp_extract(v, '^(.+?)\((.+?)\)$', 1)), trim(regexp_extract(v, '^(.+?)\((.+?)\)$', 2))],
  CASE WHEN len(p) >= 2 THEN [regexp_replace(v, '[·ㆍ/]', '', 'g'), p[-1]] ELSE [] END), lambda x: length({KEY.replace('@', 'x')}) >= 2) AS a FROM (SELECT *, list_filter(string_split_regex(v, '[·ㆍ/]'), lambda x: x <> '') AS p FROM named))""", (C.FACT_ROWS, NAMED))  # fmt: skip
def name_aliases(spark, sf):
    """Names of parts with a brand in parentheses or joined with a type, and what else they go by."""
    n, v = F.col("row_no"), F.col("values")
    name = F.when(n % 3 == 0, F.concat(v[0], F.lit("("), v[1], F.lit(")"))).when(n % 3 == 1, F.concat(v[0], F.lit("·"), v[2])).otherwise(v[0])
    return C.fact_rows(spark, sf).select("row_no", I.name_aliases(name).alias("aliases"))


MATCHED = "asked AS (SELECT row_no, \"values\"[1] AS name, CASE row_no % 4 WHEN 0 THEN 'what of ' || upper(replace(\"values\"[1], ' ', '-')) WHEN 1 THEN 'the ' || \"values\"[2] || ' ' || split_part(\"values\"[1], ' ', 1) WHEN 2 THEN \"values\"[2] || '(' || \"values\"[3] || ')' ELSE lead(\"values\"[1]) OVER (ORDER BY row_no) || ' or so' END AS q, [\"values\"[2]] AS aliases FROM fact_rows)"


@query("fact_matches_query", f"SELECT row_no, len(list_filter(list_concat([name], CASE WHEN row_no % 3 = 0 THEN aliases ELSE [] END), lambda x: length({KEY.replace('@', 'x')}) >= 3 AND contains({KEY.replace('@', 'coalesce(q, chr(32))')}, {KEY.replace('@', 'x')}))) > 0 AS ok FROM asked", (C.FACT_ROWS, MATCHED))
def fact_matches_query(spark, sf):
    """Is a part or one of its aliases meant? Questions name the part, its first word, its brand, or the next part."""
    n, v = F.col("row_no"), F.col("values")
    nxt = C.fact_rows(spark, sf).select((F.col("row_no") - 1).alias("row_no"), F.col("values")[0].alias("next"))  # numbers have no gaps
    q = F.when(n % 4 == 0, F.concat(F.lit("what of "), F.upper(F.replace(v[0], F.lit(" "), F.lit("-"))))).when(n % 4 == 1, F.concat(F.lit("the "), v[1], F.lit(" "), F.split(v[0], " ")[0])).when(n % 4 == 2, F.concat(v[1], F.lit("("), v[2], F.lit(")"))).otherwise(F.concat("next", F.lit(" or so")))
    rows = C.fact_rows(spark, sf).join(nxt, "row_no", "left")
    return rows.select("row_no", R.fact_matches(v[0], F.when(n % 3 == 0, F.array(v[1])).otherwise(F.array().cast("array<string>")), q).alias("ok"))


@query("fact_llm_accept", r"""SELECT row_no, CASE WHEN confidence >= 0.5 AND quote <> '' AND contains(lower(regexp_replace(chunk, '\s+', '', 'g')), lower(regexp_replace(quote, '\s+', '', 'g'))) THEN CASE WHEN least(confidence, 0.95) >= 0.62 THEN 'active' ELSE 'needs_review' END END AS status
  FROM (SELECT row_no, "values"[4]::DOUBLE / 50 AS confidence, CASE row_no % 5 WHEN 0 THEN "values"[3] WHEN 1 THEN '' ELSE replace(upper("values"[1]), ' ', '  ') END AS quote, 'x ' || "values"[1] || chr(10) || CASE WHEN row_no % 10 = 0 THEN "values"[3] ELSE "values"[2] END AS chunk FROM fact_rows)""", (C.FACT_ROWS,))  # fmt: skip
def fact_llm_accept(spark, sf):
    """Proposed facts: the size gives the confidence, the quote is the name, the type or nothing."""
    n, v = F.col("row_no"), F.col("values")
    quote = F.when(n % 5 == 0, v[2]).when(n % 5 == 1, "").otherwise(F.replace(F.upper(v[0]), F.lit(" "), F.lit("  ")))
    chunk = F.concat(F.lit("x "), v[0], F.lit("\n"), F.when(n % 10 == 0, v[2]).otherwise(v[1]))
    return C.fact_rows(spark, sf).select("row_no", R.accept_fact(quote, chunk, v[3].cast("double") / 50).alias("status"))


@query("set_subset", r"SELECT row_no, len(list_filter(regexp_extract_all(a, '\d+명'), lambda x: NOT list_contains(list_transform(regexp_extract_all(e, '\d+\s*(?:명|건)'), lambda y: replace(y, ' ', '')), x))) = 0 AS grounded FROM (SELECT row_no, \"values\"[4] || '명' AS a, '모두 ' || (CASE row_no % 3 WHEN 0 THEN \"values\"[4]::BIGINT WHEN 1 THEN \"values\"[4]::BIGINT + 1 ELSE row_no % 50 + 1 END)::VARCHAR || ' 명, 3건' AS e FROM fact_rows)".replace('\\"', '"'), (C.FACT_ROWS,))
def set_subset(spark, sf):
    """Do all figures of an answer stand in its evidence?"""
    n, size = F.col("row_no"), F.col("values")[3]
    count = F.when(n % 3 == 0, size.cast("long")).when(n % 3 == 1, size.cast("long") + 1).otherwise(n % 50 + 1)
    answer, evidence = A.numeric_signatures(F.concat(size, F.lit("명"))), A.numeric_signatures(F.concat(F.lit("모두 "), count.cast("string"), F.lit(" 명, 3건")))
    return C.fact_rows(spark, sf).select("row_no", A.grounded(answer, evidence).alias("grounded"))


@query("eval_answer_correct", rf"""SELECT run_id, CASE WHEN k % 3 > 0 THEN contains({COMPACT}, k::VARCHAR || 'won') ELSE user_id % 2 = 0 AND {ANY(V.ABSTAIN, COMPACT)} END AS correct FROM (SELECT run_id, k, user_id,
  CASE status WHEN 'view' THEN 'It is  ' || k::VARCHAR || ' WON' WHEN 'click' THEN 'no idea ' || k::VARCHAR WHEN 'purchase' THEN '문서에 없습니다' ELSE (user_id % 100)::VARCHAR || 'won' END AS s FROM runs)""", (C.RUNS,))  # fmt: skip
def eval_answer_correct(spark, sf):
    k, user, status = F.col("k").cast("string"), F.col("user_id"), F.col("status")
    answer = F.when(status == "view", F.concat(F.lit("It is  "), k, F.lit(" WON"))).when(status == "click", F.concat(F.lit("no idea "), k)).when(status == "purchase", "문서에 없습니다").otherwise(F.concat((user % 100).cast("string"), F.lit("won")))
    refs = F.when(user % 2 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("r")))
    return C.runs(spark, sf).select("run_id", V.answer_correct(F.col("k") % 3 > 0, answer, F.array(F.concat(k, F.lit("won"))), refs).alias("correct"))


ANCHOR = r"regexp_matches(s, '(?i)(^|\n)\s*#{0,6}\s*' || n || '\s*[\.\)]') OR regexp_matches(s, '(?i)\b' || n || '\s*번') OR regexp_matches(s, '(?i)제\s*' || n || '\s*(장|절|항|조)') OR regexp_matches(s, '(?i)\b' || n || '\s*단계') OR regexp_matches(s, '(?i)\bresult\s*' || n || '\b') OR regexp_matches(s, '\[' || n || '\]')"


@query("number_ref_guard", f"""SELECT query_id, id, (row_number() OVER (PARTITION BY query_id ORDER BY anchored DESC, rank))::INT AS rank FROM (SELECT *, {ANCHOR} AS anchored FROM (
  SELECT query_id, id, rank, (query_id % 5 + 1)::VARCHAR AS n, text || chr(10) || CASE id % 3 WHEN 0 THEN ' ' || (id % 5 + 1)::VARCHAR || ') item' WHEN 1 THEN 'see [' || (id % 4 + 1)::VARCHAR || ']' ELSE '제 ' || (id % 7)::VARCHAR || ' 조' END AS s FROM res))""", P.RANKED24)  # fmt: skip
def number_ref_guard(spark, sf):
    """Questions that cite a number, rows that end with an item, a reference or an article: those with the number come first."""
    i = F.col("id")
    tail = F.when(i % 3 == 0, F.concat(F.lit(" "), (i % 5 + 1).cast("string"), F.lit(") item"))).when(i % 3 == 1, F.concat(F.lit("see ["), (i % 4 + 1).cast("string"), F.lit("]"))).otherwise(F.concat(F.lit("제 "), (i % 7).cast("string"), F.lit(" 조")))
    r = P.results(spark, sf).withColumn("query", F.concat((F.col("query_id") % 5 + 1).cast("string"), F.lit("번 알려줘 "))).withColumn("text", F.concat("text", F.lit("\n"), tail))
    return G.number_guard(r, 24).select("query_id", "id", "rank")


@query("citation_repair", r"""SELECT query_id, CASE WHEN strong = 0 OR regexp_matches(a, '\[DOC\s+\d+\]') THEN a ELSE a || chr(10) || chr(10) || '근거: ' || array_to_string(list_transform((list_concat(list_filter(pref, lambda x: list_contains(docs, x)), list_filter(docs, lambda x: NOT list_contains(pref, x))))[1:2], lambda n: '[DOC ' || n::VARCHAR || ']'), ', ') END AS answer FROM (
  SELECT query_id, trim(any_value(query)) || CASE query_id % 3 WHEN 1 THEN ' [DOC 4]' ELSE '' END AS a, list(rank::INT ORDER BY rank) AS docs, coalesce(list(rank::INT ORDER BY rank) FILTER (is_normalized = 1), []) AS pref, count_if(lexical >= 0.3) AS strong FROM res WHERE rank <= 6 GROUP BY query_id)""", P.RANKED24)  # fmt: skip
def citation_repair(spark, sf):
    """Answers without a reference get two, derived rows first, if some row shares a third of the question's words."""
    r = P.results(spark, sf).filter("rank <= 6").withColumn("rank", F.col("rank").cast("int"))
    g = r.groupBy("query_id", "query").agg(F.array_sort(F.collect_list("rank")).alias("docs"), F.array_sort(F.collect_list(F.when(F.col("is_normalized") == 1, F.col("rank")))).alias("pref"), F.count_if(F.col("lexical") >= 0.3).alias("strong"))
    answer = F.concat(F.trim("query"), F.when(F.col("query_id") % 3 == 1, " [DOC 4]").otherwise(""))
    return g.select("query_id", R.repair_citation(answer, F.col("docs"), F.col("pref"), F.col("strong"), F.lit(False)).alias("answer"))
