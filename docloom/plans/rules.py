"""Queries of the small rules."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators import gates as G
from docloom.operators import rules as R
from docloom.plans import graph as GP
from docloom.plans import retrieval as P
from docloom.plans.registry import query
from docloom.sources import carriers as C

CH, RN, QS = (C.CHUNKS,), (C.RUNS,), (C.QUESTIONS,)


@query("ocr_fast_quality", "SELECT run_id, k * 3 >= 80 AND latency >= 0.72 AND 0.2 <= 0.35 AND (k % 10) / 10.0 >= 0.45 AS ok FROM runs", RN)
def ocr_fast_quality(spark, sf):
    return C.runs(spark, sf).select("run_id", R.fast_page_ok(F.col("k") * 3, F.col("latency"), F.lit(0.2), (F.col("k") % 10) / 10.0).alias("ok"))


@query("ocr_fast_doc_stats", "SELECT kb, round(avg(latency), 6) AS score, round(avg((k % 10) / 10.0), 6) AS pair_ratio, count_if(k < 20) AS fallback_pages FROM runs GROUP BY kb", RN)
def ocr_fast_doc_stats(spark, sf):
    return C.runs(spark, sf).groupBy("kb").agg(F.round(F.avg("latency"), 6).alias("score"), F.round(F.avg((F.col("k") % 10) / 10.0), 6).alias("pair_ratio"), F.count_if(F.col("k") < 20).alias("fallback_pages"))


@query("ocr_runtime_summary", "SELECT kb, round(count(*) / (sum(k) / 10.0::DOUBLE) * 60.0::DOUBLE, 3) AS per_minute, count(*) >= 200 AND sum(k) / 10.0 <= 300 AS target_met FROM runs GROUP BY kb", RN)
def ocr_runtime_summary(spark, sf):
    t = C.runs(spark, sf).groupBy("kb").agg(F.count("*").alias("pages"), (F.sum("k") / 10.0).alias("seconds"))
    return t.select("kb", *R.ocr_rates(F.col("pages"), F.col("seconds")))


@query("topk_grounded", """SELECT query_id, id FROM (SELECT r.*, round(score * 0.05::DOUBLE + CASE WHEN len(q) > 0 THEN least(0.35::DOUBLE, len(list_intersect(q, t)) / len(q) * 0.35::DOUBLE) ELSE 0.0 END - is_normalized * 0.04::DOUBLE, 6) AS grounded FROM (
    SELECT *, list_distinct(list_filter(list_transform(regexp_extract_all(query, '[0-9A-Za-z가-힣]+'), lambda x: lower(x)), lambda x: length(x) >= 2)) AS q,
      list_distinct(list_filter(list_transform(regexp_extract_all(text, '[0-9A-Za-z가-힣]+'), lambda x: lower(x)), lambda x: length(x) >= 2)) AS t FROM res) r)
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY grounded DESC, score DESC, rank) <= 5""", P.RANKED24)  # fmt: skip
def topk_grounded(spark, sf):
    return G.rerank_grounded(P.results(spark, sf)).filter("rank <= 5").select("query_id", "id")


@query("topk_fts", "SELECT query_id, id, rank::INT AS rank FROM fts WHERE rank <= 8", P.CHAIN[:6])
def topk_fts(spark, sf):
    from docloom.operators import retrieval as X

    return X.bm25(X.with_keywords(C.questions(spark, sf)), P.index(spark, sf), 8)


@query("join_query_candidates", "SELECT query_id, id, min(pri)::INT AS generator FROM (SELECT query_id, id, 3 AS pri FROM fts UNION ALL SELECT query_id, id, 4 FROM sub) GROUP BY ALL", P.CHAIN[:8])
def join_query_candidates(spark, sf):
    a = P.gen_fts(spark, sf).select("query_id", "id", F.lit(3).alias("pri"))
    return a.unionByName(P.gen_substring(spark, sf).withColumn("pri", F.lit(4))).groupBy("query_id", "id").agg(F.min("pri").alias("generator"))


@query("join_dense", "SELECT query_id, id, round(list_dot_product(v::DOUBLE[], qv::DOUBLE[]), 6) AS semantic FROM cand JOIN vectors USING (id) JOIN qv USING (query_id) WHERE dim = qdim", P.CHAIN[:10])
def join_dense(spark, sf):
    from docloom.operators import retrieval as X

    found = P.set_candidate_union(spark, sf)
    return X.dense_pairs(P.query_vectors(spark, sf), C.vectors(spark, sf), found).select("query_id", "id", F.round("semantic", 6).alias("semantic"))


@query("topk_concepts", "SELECT id, term FROM (SELECT id, term, n FROM cterms) WHERE n <= 2", (C.CHUNKS, GP.CT))
def topk_concepts(spark, sf):
    return GP.concept_terms(spark, sf).filter("n <= 2").select("id", "term")


@query("set_token_ops", "SELECT query_id, id, len(list_intersect(kw, tokens))::INT AS common, len(kw)::INT - len(list_intersect(kw, tokens))::INT AS missing FROM res JOIN kw k USING (query_id) JOIN toks t USING (id) WHERE rank <= 3", P.RANKED24)
def set_token_ops(spark, sf):
    kw, tk = T.keywords("query"), T.tokens("text")
    return P.results(spark, sf).filter("rank <= 3").select("query_id", "id", F.size(F.array_intersect(kw, tk)).alias("common"), F.size(F.array_except(kw, tk)).alias("missing"))


@query("win_seen_dedupe", "SELECT session_id, list(role ORDER BY first) AS roles FROM (SELECT session_id, role, min(seq) AS first FROM messages GROUP BY ALL) GROUP BY session_id", (C.MESSAGES,))
def win_seen_dedupe(spark, sf):
    g = C.messages(spark, sf).groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("seq", "role"))).alias("r"))
    return g.select("session_id", F.array_distinct(F.transform("r", lambda x: x["role"])).alias("roles"))


@query("sc_normalized", "SELECT id, CASE WHEN is_normalized = 1 THEN 0.04::DOUBLE ELSE 0.0::DOUBLE END AS penalty FROM chunks", CH)
def sc_normalized(spark, sf):
    return C.chunks(spark, sf).select("id", F.when(F.col("is_normalized") == 1, 0.04).otherwise(0.0).alias("penalty"))


@query("seeded_sufficient", "SELECT query_id, count(*) > 0 AND max(CASE WHEN rank = 1 THEN score END) >= 0.5 AS ok FROM res GROUP BY query_id", P.RANKED24)
def seeded_sufficient(spark, sf):
    g = P.results(spark, sf).groupBy("query_id").agg(F.count_if(~G.weak_hint("text")).alias("strong"), F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("top1"))
    return g.select("query_id", ((F.col("strong") > 0) & (F.col("top1") >= 0.5)).alias("ok"))


@query("meta_block", "SELECT query_id, 'results=' || count(*)::VARCHAR || ' sources=' || count(DISTINCT source_path)::VARCHAR || ' normalized=' || count_if(is_normalized = 1)::VARCHAR AS meta FROM res GROUP BY query_id", P.RANKED24)
def meta_block(spark, sf):
    g = P.results(spark, sf).groupBy("query_id").agg(F.count("*").alias("n"), F.count_distinct("source_path").alias("s"), F.count_if(F.col("is_normalized") == 1).alias("m"))
    return g.select("query_id", F.format_string("results=%d sources=%d normalized=%d", "n", "s", "m").alias("meta"))


@query("embed_truncate", r"SELECT id, CASE WHEN n <= 384 THEN length(text) ELSE greatest(1, floor(length(text) * 384 / n)) END::INT AS chars FROM (SELECT id, text, greatest(1, len(list_filter(string_split_regex(trim(text), '\s+'), lambda w: w <> '')), ceil(length(text) / 4)) AS n FROM chunks)", CH)
def embed_truncate(spark, sf):
    return C.chunks(spark, sf).select("id", F.length(R.truncate_to_tokens("text", 384)).alias("chars"))


@query("fact_choose_subject", "SELECT row_no, \"values\"[1] AS subject FROM fact_rows", (C.FACT_ROWS,))
def fact_choose_subject(spark, sf):
    from docloom.operators import ingest as I

    fact = I.parse_fact(I.row_fact(F.col("headers"), F.col("values")))
    return C.fact_rows(spark, sf).select("row_no", I.fact_value(fact, "subject").alias("subject"))


@query("cache_key", r"SELECT query_id, lower(trim(regexp_replace(query, '\s+', ' ', 'g'))) || '|5|casebook,guide' AS key FROM questions", QS)
def cache_key(spark, sf):
    return C.questions(spark, sf).select("query_id", R.cache_key("query", F.lit(5), F.array(F.lit("guide"), F.lit("casebook"), F.lit("guide"))).alias("key"))


# every saved answer gets a status; what it says about its row's facts counts once for each answer and status
STATUS = """updates AS (SELECT answer_id, chunk_id, CASE reused WHEN 0 THEN 'needs_review' WHEN 1 THEN 'published' WHEN 2 THEN 'reported' ELSE status END AS new FROM answers),
signals AS (SELECT f.fact_id, 'saved_answer_status:' || u.answer_id || ':' || u.new AS feedback_key, CASE WHEN u.new = 'published' THEN 'publish' ELSE 'report' END AS signal FROM updates u JOIN facts f USING (chunk_id)),
moved AS (SELECT fact_id, count(*) AS said, sum(CASE signal WHEN 'publish' THEN 0.08::DOUBLE ELSE -0.08::DOUBLE END) AS delta, arg_max(signal, feedback_key) AS last FROM signals GROUP BY fact_id)"""


@query("wiki_status", "SELECT fact_id, CASE last WHEN 'publish' THEN 'published' WHEN 'report' THEN 'needs_review' ELSE status END AS status, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, confidence + coalesce(delta, 0))), 6) AS confidence FROM facts LEFT JOIN moved USING (fact_id)", (C.HIERARCHY, C.ANSWERS, STATUS))
def wiki_status(spark, sf):
    """New statuses of all saved answers ('' asks for review) and what they do to the facts of their rows."""
    from docloom.operators import answers, graph

    a, f = C.answers(spark, sf), C.hierarchy(spark, sf)
    wanted = F.when(F.col("reused") == 0, " ").when(F.col("reused") == 1, "published").when(F.col("reused") == 2, "reported").otherwise(F.col("status"))
    signals = answers.status_signals(a.select("answer_id", "chunk_id", wanted.alias("status")), f.select("fact_id", "chunk_id"))
    facts, _, _ = graph.apply_feedback(f, f.limit(0).select("fact_id", F.lit("").alias("feedback_key")), signals)
    return facts.select("fact_id", "status", F.round("confidence", 6).alias("confidence"))


# claims are the lines of an answer; every second one has been stored before
CLAIMS = r"""lines AS (SELECT answer_id, unnest(string_split(answer, chr(10))) AS claim, unnest(range(len(string_split(answer, chr(10))))) AS no FROM answers),
claims AS (SELECT answer_id, no, lower(trim(regexp_replace(claim, '\s+', ' ', 'g'))) AS key FROM lines)"""


@query("wiki_compile_persist", "SELECT answer_id, md5(key) AS key_md5, CASE WHEN bool_or(no % 2 = 0) THEN 'published' ELSE 'needs_review' END AS status FROM claims WHERE key <> '' GROUP BY answer_id, key", (C.ANSWERS, CLAIMS))
def wiki_compile_persist(spark, sf):
    """Claims of all saved answers, stored by their natural key: those that are there stay as they are."""
    from docloom.operators import answers

    lines = C.answers(spark, sf).select("answer_id", F.posexplode(F.split("answer", "\n")).alias("no", "claim"))
    lines = lines.select("answer_id", "no", F.lower(T.collapse("claim")).alias("key")).filter("key <> ''")
    old = answers.insert_absent(lines.limit(0).select("answer_id", "key", F.lit("").alias("status")), lines.filter("no % 2 = 0").select("answer_id", "key", F.lit("published").alias("status")), ["answer_id", "key"])
    out = answers.insert_absent(old, lines.select("answer_id", "key", F.lit("needs_review").alias("status")), ["answer_id", "key"])
    return out.select("answer_id", F.md5("key").alias("key_md5"), "status")


@query("st_retention", "SELECT user_id, count(*) AS kept FROM (SELECT * FROM runs WHERE created_at >= 1704500000 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, run_id DESC) <= 20) GROUP BY user_id", RN)
def st_retention(spark, sf):
    from docloom.operators import ops

    rows = ops.newest(C.runs(spark, sf).filter("created_at >= 1704500000"), ["user_id"], [F.desc("created_at"), F.desc("run_id")], 20)
    return rows.groupBy("user_id").agg(F.count("*").alias("kept"))


@query("norm_xlsx", "SELECT doc_role, k AS question, list(id ORDER BY uploaded_at DESC, id DESC)[1:3] AS answers, greatest(0, count(*) - 3) AS additional FROM (SELECT *, section || ':' || source_path AS k FROM chunks WHERE source_type = 'xlsx') GROUP BY ALL", CH)
def norm_xlsx(spark, sf):
    c = C.chunks(spark, sf).filter("source_type = 'xlsx'").withColumn("question", F.concat_ws(":", "section", "source_path"))
    n = F.row_number().over(W.partitionBy("doc_role", "question").orderBy(F.desc("uploaded_at"), F.desc("id")))
    g = c.withColumn("n", n).groupBy("doc_role", "question").agg(F.array_sort(F.collect_list(F.when(F.col("n") <= 3, F.struct("n", "id")))).alias("r"), F.count("*").alias("k"))
    return g.select("doc_role", "question", F.transform("r", lambda x: x["id"]).alias("answers"), F.greatest(F.lit(0), F.col("k") - 3).alias("additional"))


@query("scan_xlsx_structure", "SELECT kb_id, r + 1 AS row, id FROM (SELECT kb_id, id, row_number() OVER (PARTITION BY kb_id ORDER BY id) AS r FROM chunks)", CH)
def scan_xlsx_structure(spark, sf):
    """Each knowledge base as a sheet: a header row, then a row for each chunk."""
    from docloom.sources.readers import sheet_tables

    c = C.chunks(spark, sf).withColumn("row", F.row_number().over(W.partitionBy("kb_id").orderBy("id")) + 1)
    cell = lambda rows, row, col, value: rows.select("kb_id", row.alias("row"), F.lit(col).alias("col"), value.alias("value"))
    heads = c.select("kb_id").distinct()
    cells = cell(c, F.col("row"), 1, F.col("id").cast("string")).unionByName(cell(c, F.col("row"), 2, F.col("source_path"))).unionByName(cell(heads, F.lit(1), 1, F.lit("id"))).unionByName(cell(heads, F.lit(1), 2, F.lit("source")))
    t = sheet_tables(cells, ["kb_id"])
    return t.select("kb_id", F.col("row").cast("long").alias("row"), F.col("values")[0].cast("long").alias("id"))
