"""Queries of second-stage ranking and gates, over the hybrid ranking."""

from __future__ import annotations

import re

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators import gates as G
from docloom.plans import retrieval as P
from docloom.plans.registry import query
from docloom.sources import carriers as C

RES = P.RANKED24


def _sql_list(words):
    return ", ".join(f"'{w}'" for w in words)


GT = """gt AS (SELECT query_id, query, list_filter(list_transform(regexp_extract_all(query, '[0-9A-Za-z가-힣]+'), lambda x: lower(x)), lambda x: length(x) >= 2 AND NOT regexp_full_match(x, '[0-9]+')) AS g FROM questions),
terms AS (SELECT query_id, list_filter(g, lambda x, i: list_position(g, x) = i)[1:6] AS terms FROM gt),
hit AS (SELECT r.*, terms, list_filter(terms, lambda t: contains(lower(regexp_replace(section || chr(10) || source_path || chr(10) || text, '\\s+', '', 'g')), t)) AS hits FROM res r JOIN terms USING (query_id)),
gated AS (SELECT * FROM (SELECT *, max(CASE WHEN len(hits) > 0 AND is_normalized = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY query_id) AS raw FROM hit)
  WHERE len(terms) = 0 OR len(hits) > 0 AND (is_normalized = 0 OR raw = 1))""".replace("\\\\", "\\")


@query("term_extract_critical", "SELECT query_id, terms FROM terms", (C.QUESTIONS, GT.split(",\nhit AS")[0]))
def term_extract_critical(spark, sf):
    return C.questions(spark, sf).select("query_id", G.critical_terms("query").alias("terms"))


@query("critical_term_gate", "SELECT query_id, id, rank::INT AS rank, hits FROM gated", (*RES, GT))
def critical_term_gate(spark, sf):
    return G.critical_gate(P.results(spark, sf)).select("query_id", "id", "rank", "hits")


@query("related_terms", """SELECT query_id, list(t ORDER BY n) AS terms FROM (SELECT query_id, t, row_number() OVER (PARTITION BY query_id ORDER BY count(*) DESC, length(t) DESC, t DESC) AS n FROM (
  SELECT query_id, unnest(list_filter(list_transform(regexp_extract_all(section || chr(10) || source_path || chr(10) || text, '[0-9A-Za-z가-힣]+'), lambda x: lower(x)), lambda x: length(x) >= 2 AND NOT regexp_full_match(x, '[0-9]+') AND NOT list_contains(terms, x))) AS t
  FROM hit WHERE rank <= 8) GROUP BY query_id, t) WHERE n <= 5 GROUP BY query_id""", (*RES, GT))  # fmt: skip
def related_terms(spark, sf):
    return G.related_terms(P.results(spark, sf))


@query("rerank_grounded", """SELECT query_id, id, grounded, (row_number() OVER (PARTITION BY query_id ORDER BY grounded DESC, score DESC, rank))::INT AS rank FROM (
  SELECT r.*, round(score * 0.05::DOUBLE + CASE WHEN len(q) > 0 THEN least(0.35::DOUBLE, len(list_intersect(q, t)) / len(q) * 0.35::DOUBLE) ELSE 0.0 END - is_normalized * 0.04::DOUBLE, 6) AS grounded FROM (
    SELECT *, list_distinct(list_filter(list_transform(regexp_extract_all(query, '[0-9A-Za-z가-힣]+'), lambda x: lower(x)), lambda x: length(x) >= 2)) AS q,
      list_distinct(list_filter(list_transform(regexp_extract_all(text, '[0-9A-Za-z가-힣]+'), lambda x: lower(x)), lambda x: length(x) >= 2)) AS t FROM res) r)""", RES)  # fmt: skip
def rerank_grounded(spark, sf):
    return G.rerank_grounded(P.results(spark, sf)).select("query_id", "id", "grounded", "rank")


@query("win_parent_limit", """SELECT query_id, id, (row_number() OVER (PARTITION BY query_id ORDER BY rank))::INT AS rank FROM (
  SELECT * FROM res QUALIFY row_number() OVER (PARTITION BY query_id, parent_key ORDER BY rank) <= 1) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank) <= 10""", RES)  # fmt: skip
def win_parent_limit(spark, sf):
    return G.parent_limit(P.results(spark, sf), 1, 10).select("query_id", "id", "rank")


@query("prefer_source", """SELECT query_id, id, (row_number() OVER (PARTITION BY query_id ORDER BY b, rank))::INT AS rank FROM (
  SELECT *, CASE WHEN is_normalized = 0 THEN 0 WHEN row_number() OVER (PARTITION BY query_id, is_normalized ORDER BY rank) <= 2 THEN 1 ELSE 2 END AS b FROM res)
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY b, rank) <= 20""", RES)  # fmt: skip
def prefer_source(spark, sf):
    return G.prefer_raw(P.results(spark, sf)).select("query_id", "id", "rank")


@query("win_diversity", """SELECT query_id, id, (row_number() OVER (PARTITION BY query_id ORDER BY b, rank))::INT AS rank FROM (
  SELECT *, CASE WHEN s AND row_number() OVER (PARTITION BY query_id, source_path, s ORDER BY rank) <= 6 THEN 0 ELSE 1 END AS b FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id, source_path, lower(trim(section)) ORDER BY rank) <= 2 AS s FROM res))
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY b, rank) <= 20""", RES)  # fmt: skip
def win_diversity(spark, sf):
    return G.diversify(P.results(spark, sf)).select("query_id", "id", "rank")


ANSWERABLE = """ans AS (SELECT query_id, max(CASE WHEN rank = 1 THEN semantic END) AS top1, coalesce(max(CASE WHEN rank = 2 THEN semantic END), 0.0) AS top2,
    count(DISTINCT CASE WHEN rank <= 6 THEN source_path END) AS unique_sources, max(CASE WHEN rank <= 6 THEN uploaded_at END) AS latest,
    list_sort(list_distinct(list(CASE WHEN rank <= 6 THEN doc_role END))) AS roles,
    list_distinct(flatten(list(CASE WHEN rank <= 6 THEN (SELECT tokens FROM toks t WHERE t.id = res.id) END))) AS tk FROM res GROUP BY query_id),
answ AS (SELECT a.* EXCLUDE (tk), len(list_intersect(kw, tk))::INT AS keyword_hits, len(kw)::INT AS keyword_total,
    CASE WHEN len(kw) = 0 THEN 1.0 ELSE len(list_intersect(kw, tk)) / len(kw) END AS coverage, top1 - top2 AS margin FROM ans a JOIN kw USING (query_id)),
expl AS (SELECT query_id, len(kw) = 0 OR len(list_filter(kw, lambda k: contains(j, k))) >= CASE WHEN len(kw) <= 4 THEN 1 ELSE 2 END AS explicit
  FROM kw JOIN (SELECT query_id, string_agg(lower(text), chr(10) ORDER BY rank) AS j FROM res WHERE rank <= 8 GROUP BY query_id) USING (query_id)),
top6 AS (SELECT res.query_id, res.rank, res.id, res.source_path, list_intersect(kw, tokens) AS kt, regexp_matches(lower(res.text), ' (was|from) ') AS neg, regexp_matches(lower(res.text), ' (this|it) ') AS pos
  FROM res JOIN kw USING (query_id) JOIN toks ON toks.id = res.id WHERE res.rank <= 6),
conf AS (SELECT a.query_id, a.id AS a, b.id AS b FROM top6 a JOIN top6 b ON a.query_id = b.query_id AND a.rank < b.rank AND a.source_path <> b.source_path
  WHERE (a.neg AND b.pos OR a.pos AND b.neg) AND len(list_intersect(a.kt, b.kt)) > 0)"""
NEG, POS = (" was ", " from "), (" this ", " it ")


@query("agg_answerability", "SELECT query_id, round(top1, 6) AS top1, round(top2, 6) AS top2, round(margin, 6) AS margin, round(coverage, 6) AS coverage, keyword_hits, keyword_total, unique_sources, latest, roles FROM answ", (*RES, ANSWERABLE))
def agg_answerability(spark, sf):
    a = G.answerability(P.results(spark, sf))
    return a.withColumns({c: F.round(c, 6) for c in ("top1", "top2", "margin", "coverage")})


@query("explicit_evidence", "SELECT query_id, explicit FROM expl", (*RES, ANSWERABLE))
def explicit_evidence(spark, sf):
    return G.explicit_evidence(P.results(spark, sf))


@query("join_conflict_pairs", "SELECT query_id, a, b FROM conf", (*RES, ANSWERABLE))
def join_conflict_pairs(spark, sf):
    return G.conflicts(P.results(spark, sf), NEG, POS)


@query("grounding_gate", """SELECT query_id, explicit, conflict, explicit AND CASE WHEN conflict THEN top1 >= 0.26 AND coverage >= 0.12
    ELSE top1 >= 0.33 AND coverage >= 0.22 OR top1 >= 0.26 AND coverage >= 0.12 AND (keyword_total = 0 OR keyword_hits >= least(keyword_total, 1)) END AS passed
  FROM (SELECT a.*, explicit, query_id IN (SELECT query_id FROM conf) AS conflict FROM answ a JOIN expl USING (query_id))""", (*RES, ANSWERABLE))  # fmt: skip
def grounding_gate(spark, sf):
    r = P.results(spark, sf)
    c = G.conflicts(r, NEG, POS).select("query_id").distinct().withColumn("conflict", F.lit(True))
    m = G.answerability(r).join(G.explicit_evidence(r), "query_id").join(c, "query_id", "left").na.fill(False, ["conflict"])
    return G.grounding_gate(m).select("query_id", "explicit", "conflict", "passed")


@query("win_context_budget", """SELECT query_id, id, chars::INT AS chars, running::BIGINT AS running FROM (SELECT *, sum(chars) OVER (PARTITION BY query_id ORDER BY rank ROWS UNBOUNDED PRECEDING) AS running FROM (
  SELECT *, length(trim(text)) AS chars FROM res QUALIFY row_number() OVER (PARTITION BY query_id, source_path, section ORDER BY rank) = 1)) WHERE running <= 5600""", RES)  # fmt: skip
def win_context_budget(spark, sf):
    return G.context_budget(P.results(spark, sf)).select("query_id", "id", "chars", "running")


@query("context_cap", "SELECT query_id, greatest(700, 5600 // greatest(2, least(8, count(*) + 1)))::INT AS cap FROM res GROUP BY query_id", RES)
def context_cap(spark, sf):
    n = P.results(spark, sf).groupBy("query_id").count()
    return n.select("query_id", F.greatest(F.lit(700), F.floor(F.lit(5600) / F.greatest(F.lit(2), F.least(F.lit(8), F.col("count") + 1)))).cast("int").alias("cap"))


VARIANTS = """vars AS (SELECT query_id, variant_no, id, score, uploaded_at, source_path || '|' || section || '|' || substr(trim(text), 1, 120) AS fingerprint FROM (
  SELECT query_id, 1 AS variant_no, id, score, uploaded_at, source_path, section, text FROM res
  UNION ALL SELECT query_id, 2, id, round(score * 0.9::DOUBLE, 6), uploaded_at, source_path, section, text FROM res WHERE id % 2 = 0
  UNION ALL SELECT query_id, 3, id, round(score * 1.1::DOUBLE, 6), uploaded_at, source_path, section, text FROM res WHERE id % 3 = 0)),
best AS (SELECT query_id, fingerprint, id, score, uploaded_at FROM vars QUALIFY row_number() OVER (PARTITION BY query_id, fingerprint ORDER BY score DESC, variant_no, id) = 1),
merged AS (SELECT b.*, n AS variant_hits FROM best b JOIN (SELECT query_id, fingerprint, count(DISTINCT variant_no) AS n FROM vars GROUP BY ALL) USING (query_id, fingerprint)),
mr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY variant_hits DESC, score DESC, uploaded_at DESC, id DESC) AS rank FROM merged)"""


@query("set_variant_merge", "SELECT query_id, id, score, variant_hits, rank::INT AS rank FROM mr WHERE rank <= 12", (*RES, VARIANTS))
def set_variant_merge(spark, sf):
    r = P.results(spark, sf).withColumn("fingerprint", F.concat_ws("|", "source_path", "section", F.substring(F.trim("text"), 1, 120))).withColumn("variant_no", F.lit(1))
    more = [r.filter(F.col("id") % n == 0).withColumn("score", F.round(F.col("score") * x, 6)).withColumn("variant_no", F.lit(k)) for k, n, x in ((2, 2, 0.9), (3, 3, 1.1))]
    return G.merge_variants(r.unionByName(more[0]).unionByName(more[1]), 12).select("query_id", "id", "score", "variant_hits", "rank")


@query("topk_variant", "SELECT query_id, id FROM mr WHERE rank <= 5", (*RES, VARIANTS))
def topk_variant(spark, sf):
    return set_variant_merge(spark, sf).filter("rank <= 5").select("query_id", "id")


@query("rerank_decide", """SELECT query_id, reason NOT IN ('no_candidates', 'simple_direct_question') AS use, reason FROM (SELECT query_id, CASE WHEN pool <= 0 THEN 'no_candidates' WHEN over >= 1 AND cond >= 2 THEN 'complex_multi_condition'
  WHEN pool >= 16 THEN 'large_candidate_pool' WHEN over >= 1 AND (length(c) >= 28 OR pool >= 10) THEN 'overview_request' WHEN cond >= 3 AND length(c) >= 28 THEN 'complex_multi_condition' ELSE 'simple_direct_question' END AS reason FROM (
    SELECT query_id, query_id % 20 AS pool, c, contains(c, 'outline')::INT + contains(c, 'summary')::INT AS over, contains(c, ',')::INT AS cond FROM (SELECT query_id, lower(regexp_replace(query, '\\s+', '', 'g')) AS c FROM questions)))""".replace("\\\\", "\\"), (C.QUESTIONS,))  # fmt: skip
def rerank_decide(spark, sf):
    use, reason = G.rerank_decision("query", F.col("query_id") % 20)
    return C.questions(spark, sf).select("query_id", use.alias("use"), reason.alias("reason"))


@query("rerank_parse", """SELECT query_id, list_concat(s, list_filter(range(1, 9), lambda x: NOT list_contains(s, x)))::INT[] AS ord FROM (SELECT query_id, list_filter(a, lambda x, i: x BETWEEN 1 AND 8 AND list_position(a, x) = i) AS s FROM (
  SELECT query_id, [query_id % 9, query_id % 4, query_id % 9, 12, query_id % 7] AS a FROM questions))""", (C.QUESTIONS,))  # fmt: skip
def rerank_parse(spark, sf):
    said = F.concat_ws(",", *[(F.col("query_id") % n).cast("string") for n in (9, 4, 9)], F.lit("12"), (F.col("query_id") % 7).cast("string"))
    return C.questions(spark, sf).select("query_id", G.rerank_parse(said, F.lit(8)).alias("ord"))


CAPS = (640, 480, 320, 240, 160, 96)


@query("rerank_budget", r"""WITH ln AS (SELECT query_id, rank, '[' || rank::VARCHAR || '] ' || substr(regexp_replace(text, '\s+', ' ', 'g'), 1, 700) AS line FROM res),
caps AS (SELECT *, unnest([640, 480, 320, 240, 160, 96]) AS cap FROM ln),
cuts AS (SELECT query_id, rank, cap, CASE WHEN length(line) <= cap THEN line ELSE substr(line, 1, greatest(1, cap - 3)) || '...' END AS cut FROM caps),
est AS (SELECT query_id, cap, rank, ceil(round(40 + sum(len(regexp_extract_all(cut, '[A-Za-z0-9_]+'))) OVER w * 1.1::DOUBLE + sum(len(regexp_extract_all(cut, '[가-힣]'))) OVER w * 0.65::DOUBLE + sum(len(regexp_extract_all(cut, '[^\p{L}\p{N}\p{M}_\s가-힣]'))) OVER w * 0.3::DOUBLE, 6)) AS e FROM cuts WINDOW w AS (PARTITION BY query_id, cap ORDER BY rank ROWS UNBOUNDED PRECEDING)),
fit AS (SELECT query_id, cap, count_if(e <= 900) AS n, count(*) AS total FROM est GROUP BY ALL)
SELECT query_id, cap, n::BIGINT AS n FROM fit QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY (n >= least(12, total)) DESC, CASE WHEN n >= least(12, total) THEN cap ELSE n END DESC, cap DESC) = 1""", RES)
def rerank_budget(spark, sf):
    line = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.substring(F.regexp_replace("text", T.SPACE, " "), 1, 700))
    return G.rerank_lines(P.results(spark, sf).select("query_id", "rank", line.alias("line")), F.lit(40.0), F.lit(900), 12, CAPS)


@query("topk_prefetch", """WITH p AS (SELECT *, row_number() OVER (PARTITION BY query_id, source_path, section ORDER BY rank) AS pg FROM res),
q AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc_role ORDER BY rank) AS rr FROM p WHERE pg = 1)
SELECT query_id, id, doc_role FROM q QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN rr = 1 AND doc_role = 'guide' THEN 0 WHEN rr = 1 THEN 1 ELSE 2 END, rank) <= 2""", RES)  # fmt: skip
def topk_prefetch(spark, sf):
    page = F.row_number().over(W.partitionBy("query_id", "source_path", "section").orderBy("rank"))
    r = P.results(spark, sf).withColumn("pg", page).filter("pg = 1")
    role = F.row_number().over(W.partitionBy("query_id", "doc_role").orderBy("rank"))
    bucket = F.when((role == 1) & (F.col("doc_role") == "guide"), 0).when(role == 1, 1).otherwise(2)
    n = F.row_number().over(W.partitionBy("query_id").orderBy("bucket", "rank"))
    return r.withColumn("bucket", bucket).withColumn("n", n).filter("n <= 2").select("query_id", "id", "doc_role")


@query("agg_distinct_sources", "SELECT query_id, count(DISTINCT source_path) AS sources, count(DISTINCT CASE WHEN source_type = 'pdf' THEN source_path END) AS pdf_sources FROM res GROUP BY query_id", RES)
def agg_distinct_sources(spark, sf):
    return P.results(spark, sf).groupBy("query_id").agg(F.count_distinct("source_path").alias("sources"), F.count_distinct(F.when(F.col("source_type") == "pdf", F.col("source_path"))).alias("pdf_sources"))


@query("role_filter", "SELECT query_id, id FROM res WHERE doc_role IN ('guide')", RES)
def role_filter(spark, sf):
    return P.results(spark, sf).filter(F.col("doc_role").isin("guide")).select("query_id", "id")


@query("doc_registry", "SELECT query_id, id, (row_number() OVER (PARTITION BY query_id ORDER BY first))::INT AS doc_no FROM (SELECT query_id, id, min(rank) AS first FROM res GROUP BY ALL)", RES)
def doc_registry(spark, sf):
    first = P.results(spark, sf).groupBy("query_id", "id").agg(F.min("rank").alias("first"))
    return first.select("query_id", "id", F.row_number().over(W.partitionBy("query_id").orderBy("first")).alias("doc_no"))


@query("citations_rows", "SELECT query_id, list(source_path || '#' || id::VARCHAR ORDER BY rank) AS citations FROM res WHERE rank <= 12 GROUP BY query_id", RES)
def citations_rows(spark, sf):
    r = P.results(spark, sf).filter("rank <= 12")
    item = F.struct("rank", F.concat_ws("#", "source_path", F.col("id").cast("string")).alias("c"))
    return r.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["c"]).alias("citations"))


# all attempts side by side: of their role, raw rows first, with a critical term, from several sections; then the gate's measures
TRIED = (
    """attempts AS (SELECT query_id AS question, query_id * 16 + n AS query_id, n, role, query FROM (SELECT query_id, query, unnest(plan) AS role, unnest(range(len(plan))) AS n FROM (
  SELECT query_id, query, CASE query_id % 3 WHEN 0 THEN ['guide', 'all'] WHEN 1 THEN ['casebook', 'guide', 'all'] ELSE ['all'] END AS plan FROM questions))),
pool AS (SELECT * FROM (SELECT a.query_id, a.question, a.n, a.role, r.id, r.semantic, r.score, r.uploaded_at, c.source_path, c.doc_role, c.is_normalized, c.section, c.text, row_number() OVER (PARTITION BY a.query_id ORDER BY r.rank) AS rank
  FROM ranked r JOIN chunks c USING (id) JOIN attempts a ON a.question = r.query_id WHERE a.role = 'all' OR a.role = c.doc_role) WHERE rank <= 8),
rawfirst AS (SELECT * EXCLUDE (rank, b), row_number() OVER (PARTITION BY query_id ORDER BY b, rank) AS rank FROM (SELECT *, CASE WHEN is_normalized = 0 THEN 0 WHEN row_number() OVER (PARTITION BY query_id, is_normalized ORDER BY rank) <= 2 THEN 1 ELSE 2 END AS b FROM pool)),
""" + GT.split(",\nhit AS")[0]
    + r""",
struck AS (SELECT r.*, t.terms, list_filter(t.terms, lambda x: contains(lower(regexp_replace(r.section || chr(10) || r.source_path || chr(10) || r.text, '\s+', '', 'g')), x)) AS hits FROM rawfirst r JOIN terms t ON t.query_id = r.question),
passing AS (SELECT * FROM (SELECT *, max(CASE WHEN len(hits) > 0 AND is_normalized = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY query_id) AS raw FROM struck) WHERE len(terms) = 0 OR len(hits) > 0 AND (is_normalized = 0 OR raw = 1)),
final AS (SELECT * EXCLUDE (rank, s, b), row_number() OVER (PARTITION BY query_id ORDER BY b, rank) AS rank FROM (SELECT *, CASE WHEN s AND row_number() OVER (PARTITION BY query_id, source_path, s ORDER BY rank) <= 6 THEN 0 ELSE 1 END AS b FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id, source_path, lower(trim(section)) ORDER BY rank) <= 2 AS s FROM passing))),
asks AS (SELECT a.query_id, k.kw FROM attempts a JOIN kw k ON k.query_id = a.question),
""".replace("\\\\", "\\")
    + re.sub(r"\bres\b", "final", ANSWERABLE).replace("JOIN kw USING", "JOIN asks USING").replace("FROM kw JOIN", "FROM asks JOIN").replace("<= 6 THEN", "<= 8 THEN")
    + """,
judged AS (SELECT f.question, f.n, f.role, f.ids, round(a.top1 + 0.35::DOUBLE * a.coverage, 6) AS selection, explicit AND CASE WHEN a.query_id IN (SELECT query_id FROM conf) THEN top1 >= 0.26 AND coverage >= 0.12
    ELSE top1 >= 0.33 AND coverage >= 0.22 OR top1 >= 0.26 AND coverage >= 0.12 AND (keyword_total = 0 OR keyword_hits >= least(keyword_total, 1)) END AS passed
  FROM answ a JOIN expl USING (query_id) JOIN (SELECT query_id, any_value(question) AS question, any_value(n) AS n, any_value(role) AS role, list(id ORDER BY rank) AS ids FROM final GROUP BY query_id) f USING (query_id))"""
)


@query("agent_search", """SELECT question, role, passed, CASE WHEN passed THEN n + 1 ELSE CASE question % 3 WHEN 0 THEN 2 WHEN 1 THEN 3 ELSE 1 END END::INT AS tried, selection, ids FROM judged
  QUALIFY row_number() OVER (PARTITION BY question ORDER BY passed DESC, CASE WHEN passed THEN -n ELSE selection END DESC, n) = 1""", (*P.CHAIN, TRIED))  # fmt: skip
def agent_search(spark, sf):
    """Calls of the search tool with roles to try in order: which attempt wins, and its rows."""
    from docloom.operators import agent

    q, n = C.questions(spark, sf), F.col("query_id")
    plans = [F.array(*map(F.lit, p)) for p in (("guide", "all"), ("casebook", "guide", "all"), ("all",))]
    q = q.withColumn("plan", F.when(n % 3 == 0, plans[0]).when(n % 3 == 1, plans[1]).otherwise(plans[2]))
    return agent.search(q, P.ranking(spark, sf).select("query_id", "id", "rank", "score", "semantic", "uploaded_at"), C.chunks(spark, sf), NEG, POS)


@query("trace_rows", r"SELECT query_id, id, round(score::DECIMAL(18,6), 4)::DOUBLE AS score, substr(trim(regexp_replace(text, '\s+', ' ', 'g')), 1, 220) AS snippet FROM res WHERE rank <= 8", RES)
def trace_rows(spark, sf):
    return P.results(spark, sf).filter("rank <= 8").select("query_id", "id", F.round(F.col("score").cast("decimal(18,6)"), 4).cast("double").alias("score"), F.substring(T.collapse("text"), 1, 220).alias("snippet"))
