"""Queries of hybrid retrieval."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators import answers as A
from docloom.operators import graph as G
from docloom.operators import index as I
from docloom.operators import retrieval as R
from docloom.operators import rules
from docloom.operators import vectors as V
from docloom.plans.registry import query
from docloom.settings import DEFAULTS
from docloom.sources import carriers as C
from docloom.tables import cut, stored

STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
# keywords in order, first of equals
KW = f"""kw0 AS (SELECT query_id, query, list_filter(list_transform(regexp_extract_all(query, '[0-9A-Za-zㄱ-ㆎ가-힣]+'), lambda x: lower(x)), lambda x: length(x) >= 2 AND x NOT IN ({STOP})) AS ks FROM questions),
kw AS (SELECT query_id, query, list_filter(ks, lambda x, i: list_position(ks, x) = i) AS kw FROM kw0)"""
TOKENS = "toks AS (SELECT id, list_distinct(list_transform(regexp_extract_all(text, '[0-9A-Za-zㄱ-ㆎ가-힣]+'), lambda x: lower(x))) AS tokens, lower(text) AS low FROM chunks)"
FTS = """ft AS (SELECT id, regexp_extract_all(strip_accents(lower(text)), '[\\p{L}\\p{N}]+') AS ts FROM chunks),
post AS MATERIALIZED (SELECT id, term, dl, count(*) AS tf FROM (SELECT id, len(ts) AS dl, unnest(ts) AS term FROM ft) GROUP BY id, term, dl),
qt AS (SELECT query_id, unnest(kw[1:24]) AS term FROM kw),
stats AS (SELECT count(*) AS n, avg(dl) AS avg_dl FROM (SELECT DISTINCT id, dl FROM post)),
dfs AS (SELECT term, count(*) AS df FROM post GROUP BY term),
bm AS (SELECT query_id, id, round(sum(CASE WHEN ln((n - df + 0.5) / (df + 0.5)) > 0 THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avg_dl))), 6) AS bm25
  FROM qt JOIN post USING (term) JOIN dfs USING (term), stats GROUP BY query_id, id),
fts AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY bm25 DESC, id DESC) AS rank FROM bm QUALIFY rank <= 240)"""
SUB = """sub AS (SELECT query_id, id FROM kw JOIN (SELECT t.id, low, uploaded_at FROM toks t JOIN chunks c ON t.id = c.id) ON len(list_filter(kw[1:6], lambda k: contains(low, k))) > 0
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY uploaded_at DESC, id DESC) <= 240)"""
CSTOP = ", ".join(f"'{w}'" for w in G.CONCEPT_STOP)
CT = f"""w AS (SELECT id, list_filter(list_transform(regexp_extract_all(text, '[0-9A-Za-zㄱ-ㆎ가-힣]+'), lambda x: lower(x)), lambda x: length(x) >= 2 AND x NOT IN ({CSTOP})) AS w FROM @SOURCE),
a AS (SELECT id, unnest(w) AS t, unnest(w[2:]) AS u, unnest(range(len(w))) AS i FROM w),
s1 AS (SELECT id, t, round(sum(1.0::DOUBLE + CASE WHEN i < 8 THEN 0.35::DOUBLE ELSE 0 END + CASE WHEN length(t) >= 4 THEN 0.15::DOUBLE ELSE 0 END), 4) AS s, min(i) AS first FROM a GROUP BY id, t),
s2 AS (SELECT id, t2 AS t, round(sum(1.25::DOUBLE + CASE WHEN i < 6 THEN 0.25::DOUBLE ELSE 0 END + 0.10::DOUBLE), 4) AS s FROM (SELECT id, i, t || ' ' || u AS t2 FROM a WHERE u IS NOT NULL) WHERE length(t2) >= 4 GROUP BY id, t2),
r1 AS (SELECT *, first < 3 AS lead, row_number() OVER (PARTITION BY id, first < 3 ORDER BY s DESC, length(t) DESC, t DESC) AS n, sum((first < 3)::INT) OVER (PARTITION BY id) AS leads FROM s1),
o AS (SELECT id, t, CASE WHEN lead THEN 0 WHEN n <= greatest(1, 3 - leads) THEN 1 ELSE 3 END AS b, CASE WHEN lead THEN first ELSE n END AS o FROM r1
  UNION ALL SELECT id, t, 2, row_number() OVER (PARTITION BY id ORDER BY s DESC, length(t) DESC, t DESC) FROM s2),
cterms AS (SELECT id, n, term, greatest(0.15::DOUBLE, 1 - 0.12::DOUBLE * (n - 1)) AS weight FROM (SELECT id, t AS term, row_number() OVER (PARTITION BY id ORDER BY b, o) AS n FROM o) WHERE n <= 6),
edges AS (SELECT id, regexp_replace(term, '\\s+', '', 'g') AS concept, min(weight) AS weight FROM cterms GROUP BY ALL)""".replace("\\\\", "\\")
# the concepts that questions name: their own terms, or their keywords where they have none
QTERMS = "qterms AS (WITH " + CT.replace("@SOURCE", "(SELECT query_id AS id, query AS text FROM questions)") + """ SELECT id AS query_id, concept FROM edges UNION ALL
  SELECT query_id, unnest(kw[1:6]) FROM kw WHERE query_id NOT IN (SELECT id FROM edges))"""
CT = CT.replace("@SOURCE", "chunks")


GEN = """SELECT query_id, id, round(score, 6) AS score FROM (SELECT query_id, id, max(weight) AS score FROM qterms JOIN edges USING (concept) GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, id) <= 240"""


FS = r"""q AS (SELECT query_id, list_filter(list_transform(regexp_extract_all(query, '[0-9A-Za-z가-힣]+'), lambda x: lower(x)), lambda x: length(x) >= 2) AS qt, lower(regexp_replace(query, '\s+', '', 'g')) AS qc FROM fq),
live AS (SELECT fact_id, confidence, lower(regexp_replace(subject, '\s+', '', 'g')) AS s, lower(regexp_replace(predicate, '\s+', '', 'g')) AS p, lower(regexp_replace(object, '\s+', '', 'g')) AS o FROM facts
  WHERE status = 'published' OR status = 'active' AND confidence >= 0.62),
links AS (SELECT lower(regexp_replace(object, '\s+', '', 'g')) AS o, lower(regexp_replace(subject, '\s+', '', 'g')) AS s FROM facts WHERE predicate = '상위개념' AND status IN ('active', 'published')),
h AS (SELECT query_id, fact_id, confidence, s,
    CASE WHEN contains(qc, s) THEN 2 ELSE 0 END + len(list_filter(qt, lambda t: contains(s, t))) AS d,
    contains(qc, p)::INT + len(list_filter(qt, lambda t: NOT contains(s, t) AND contains(p, t))) AS pr,
    contains(qc, o)::INT + len(list_filter(qt, lambda t: NOT contains(s, t) AND NOT contains(p, t) AND contains(o, t))) AS v,
    (EXISTS (SELECT 1 FROM links l WHERE l.s = live.s AND list_contains(qt, l.o)))::INT AS r0 FROM q, live),
sc AS (SELECT query_id, fact_id, CASE WHEN d > 0 THEN 1 ELSE 2 END AS hops, least(1.0::DOUBLE, 0.12::DOUBLE * (d + pr + v + CASE WHEN d > 0 THEN 0 ELSE r0 END) + 0.45::DOUBLE * confidence) AS base FROM h WHERE d > 0 OR r0 > 0 AND pr > 0),
fs AS (SELECT query_id, fact_id, hops, round(CASE WHEN hops = 2 THEN base * 0.72::DOUBLE ELSE base END, 6) AS score FROM sc),
fr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, fact_id DESC) AS rank FROM fs QUALIFY rank <= 20)"""
# candidates of concepts and facts, each with its own chain of tables
GCON = f"{QTERMS}, gcon AS (WITH {CT} {GEN})"
ONTO = f"onto AS (WITH fq AS (SELECT query_id, query FROM questions), {FS} SELECT query_id, chunk_id AS id, max(score) AS score FROM fr JOIN facts USING (fact_id) GROUP BY query_id, chunk_id)"
CAND = f"{GCON}, {ONTO}, cand AS (SELECT query_id, id FROM fts UNION SELECT query_id, id FROM sub UNION SELECT query_id, id FROM gcon UNION SELECT o.query_id, o.id FROM onto o JOIN chunks USING (id))"
BOOST = """tg AS (SELECT 'chunk' AS kind, chunk_id::VARCHAR AS target, greatest(1, reused) AS w FROM answers WHERE status = 'published' AND reused > 0 AND chunk_id > 0
  UNION ALL SELECT 'source', source_path, greatest(1, reused) FROM answers WHERE status = 'published' AND reused > 0
  UNION ALL SELECT unnest(['chunk', 'source']), unnest([max(id)::VARCHAR, source_path]), 1 FROM chunks GROUP BY source_path),
mem AS (SELECT id, round(least(0.05::DOUBLE, 0.025::DOUBLE * greatest(coalesce(a.weight, 0), coalesce(b.weight, 0))), 6) AS boost FROM chunks
  LEFT JOIN (SELECT target, sum(w) AS weight FROM tg WHERE kind = 'chunk' GROUP BY 1) a ON a.target = id::VARCHAR LEFT JOIN (SELECT target, sum(w) AS weight FROM tg WHERE kind = 'source' GROUP BY 1) b ON b.target = source_path)"""


def _any(words, text):
    """SQL: does any of the words stand in the text?"""
    return f"len(list_filter([{', '.join(chr(39) + w + chr(39) for w in words)}], lambda z: contains({text}, z))) > 0"


def numeric_sql(q):
    """SQL of a question that asks for figures or times."""
    c = f"lower(regexp_replace({q}, '\\s+', '', 'g'))"
    strong, other = _any(rules.NUMERIC_HINTS, c), _any(rules.OTHER_HINTS, c)
    return f"(CASE WHEN {other} AND NOT {strong} THEN false ELSE {_any(rules.TEXTUAL_HINTS, c)} OR regexp_matches({q}, '(^|[^0-9])[0-9]{{1,4}}\\s*(월|일)($|[^가-힣])') END)"


def tabular_sql(q, t, kind):
    """SQL of the table boost of a question, a text and its kind of source (no parser named, no alias shared)."""
    marks = _any(("표행:", "표행요약:", "표헤더:", "표값:", "표의미:"), t)
    paged = f"{kind} IN ('pdf', 'hwpx', 'xlsx')"
    row = f"(contains({t}, '표행요약:') OR contains({t}, '표의미: kind=table_row') OR {paged} AND contains({t}, '|') AND length({t}) >= 40)"
    heads = f"len(list_filter(['rate', 'amount', 'cost', 'period', 'date', 'cycle', 'count', 'base', 'month', 'quarter', 'year', 'interval'], lambda z: contains({q}, z) AND contains({t}, z)))"
    key = lambda x: f"regexp_replace(lower({x}), '[\\s·ㆍ/\\\\,()\\[\\]{{}}<>「」『』''\"`_-]+', '', 'g')"
    words = f"len(list_filter(regexp_extract_all({q}, '[0-9A-Za-z가-힣]{{3,}}'), lambda z: contains({key(t)}, lower(z)))) > 0"
    alias = f"CASE WHEN {_any(('표행요약:', '표값:', '표의미:'), t)} AND length({key(q)}) >= 2 AND (contains({key(t)}, {key(q)}) OR {words}) THEN 0.06 ELSE 0 END"
    header = f"CASE WHEN {heads} > 0 THEN least(0.12, 0.03 * {heads}) WHEN {row} AND {marks} THEN 0.06 ELSE 0 END"
    numeric = f"CASE WHEN {marks} THEN 0.08 ELSE 0 END + CASE WHEN {row} THEN 0.06 ELSE 0 END + {header} + {alias} + CASE WHEN {paged} AND {row} THEN 0.03 ELSE 0 END"
    return f"(CASE WHEN {marks} AND {row} THEN 0.08 ELSE 0 END + CASE WHEN {numeric_sql(q)} THEN {numeric} ELSE 0 END)::DOUBLE"


LEX = """lex0 AS (SELECT query_id, id, len(kw) AS total, len(list_intersect(kw, tokens)) AS overlap, len(list_filter(kw, lambda k: length(k) >= 3 AND contains(low, k))) AS inside FROM cand JOIN kw USING (query_id) JOIN toks USING (id)),
lex AS (SELECT query_id, id, CASE WHEN inside > 0 THEN least(1.0::DOUBLE, overlap / total + least(0.07::DOUBLE, 0.07::DOUBLE * inside / total)) ELSE overlap / total END AS lexical FROM lex0)"""
DENSE = """qv AS (SELECT q.query_id, v.v AS qv, v.dim AS qdim FROM questions q JOIN vectors v ON q.query_id = v.id),
sem AS (SELECT query_id, id, list_dot_product(v::DOUBLE[], qv::DOUBLE[]) AS semantic FROM cand JOIN vectors USING (id) JOIN qv USING (query_id) WHERE dim = qdim
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(semantic, 9) DESC, id) <= 120)"""
LIT = """lit AS (SELECT query_id, query, list_distinct(list_concat(list_concat(
    list_filter(list_transform(regexp_extract_all(query, '["''“”‘’]([^"''“”‘’]{2,80})["''“”‘’]', 1), lambda x: lower(trim(regexp_replace(x, '\\s+', ' ', 'g')))), lambda x: length(x) >= 2),
    list_filter(regexp_extract_all(query, '[0-9]+'), lambda x: length(x) BETWEEN 2 AND 4)),
    list_filter(list_transform(regexp_extract_all(query, '[0-9A-Za-zㄱ-ㆎ가-힣][0-9A-Za-zㄱ-ㆎ가-힣_\\-/]{2,40}'), lambda x: lower(x)), lambda x: regexp_matches(x, '[a-z]') AND regexp_matches(x, '[0-9_/-]')))) AS lits FROM questions)"""
HYBRID = """heads AS (SELECT id, list_distinct(list_filter(list_transform(regexp_extract_all(heading, '[0-9A-Za-zㄱ-ㆎ가-힣]+'), lambda x: lower(x)), lambda x: length(x) >= 2)) AS ht, lower(heading) AS hl FROM chunks),
parts AS (SELECT c.query_id, c.id, coalesce(1.0::DOUBLE * (f.id IS NOT NULL)::INT, 0) AS fts, lexical, coalesce(semantic, 0.0) AS semantic, coalesce(g.score, 0.0) AS concept, coalesce(o.score, 0.0) AS ontology, uploaded_at, is_normalized, text, query, lits,
    CASE WHEN len(lits) > 0 THEN len(list_filter(lits, lambda x: CASE WHEN regexp_full_match(x, '[0-9]+') THEN list_contains(regexp_extract_all(lower(text), '[0-9]+'), x) ELSE contains(lower(text), x) END)) / len(lits) ELSE 0.0 END AS literal,
    pow(0.5::DOUBLE, greatest(1711929600 - uploaded_at, 0) / 86400.0::DOUBLE / 45.0::DOUBLE) AS recency, boost AS memory, @TABULAR AS tabular,
    CASE WHEN len(kw) = 0 OR len(ht) = 0 THEN 0.0 ELSE len(list_intersect(kw, ht)) / len(kw) END AS ho, CASE WHEN len(kw) = 0 OR len(ht) = 0 THEN 0 ELSE len(list_filter(kw, lambda k: length(k) >= 3 AND contains(hl, k))) / len(kw) END AS hi,
    contains(text, 'OCR후보:') AND NOT regexp_matches(text, '표(행|행요약|헤더|값|의미):') AND length(trim(text)) <= 240 AS weak,
    list_filter(regexp_extract_all(query, '[0-9]+'), lambda x: length(x) BETWEEN 2 AND 4) AS qc, list_filter(regexp_extract_all(text, '[0-9]+'), lambda x: length(x) BETWEEN 2 AND 4) AS tc,
    regexp_matches(regexp_replace(lower(query), '\\s+', '', 'g'), 'code|class|category|number|id') AS asks
  FROM cand c LEFT JOIN fts f USING (query_id, id) LEFT JOIN lex USING (query_id, id) LEFT JOIN sem USING (query_id, id) LEFT JOIN gcon g USING (query_id, id) LEFT JOIN onto o USING (query_id, id)
    JOIN chunks USING (id) JOIN heads USING (id) JOIN mem USING (id) JOIN lit USING (query_id) JOIN (SELECT query_id, kw FROM kw) USING (query_id)),
coded AS (SELECT *, CASE WHEN asks AND len(qc) > 0 AND len(list_intersect(qc, tc)) > 0 THEN 2 WHEN asks AND len(qc) = 0 AND len(tc) > 0 THEN 1 ELSE 0 END AS code,
    CASE WHEN max(fts) OVER (PARTITION BY query_id) > 0 THEN 0.18::DOUBLE ELSE 0.0::DOUBLE END AS fts_w, 0.10::DOUBLE * least(1.0::DOUBLE, ho + CASE WHEN hi > 0 THEN least(0.07::DOUBLE, 0.07::DOUBLE * hi) ELSE 0 END) AS structure,
    CASE WHEN NOT weak THEN 0.0 WHEN greatest(concept, semantic, fts, lexical, literal) <= 0.001 THEN 0.08 WHEN greatest(concept, semantic, fts, lexical, literal) <= 0.03 THEN 0.04 ELSE 0.0 END AS penalty FROM parts),
scored AS (SELECT *, round(greatest(0.0::DOUBLE, 1 - 0.48::DOUBLE - fts_w) * semantic + 0.48::DOUBLE * lexical + 0.22::DOUBLE * concept + 0.26::DOUBLE * ontology + fts_w * fts + 0.08::DOUBLE * literal + 0.06::DOUBLE * recency + structure + memory + tabular - penalty
    + CASE code WHEN 2 THEN 0.12::DOUBLE WHEN 1 THEN 0.12::DOUBLE * 0.45::DOUBLE ELSE 0.0::DOUBLE END - 0.04::DOUBLE * is_normalized, 6) AS score FROM coded),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, uploaded_at DESC, id DESC) AS rank FROM scored)""".replace("@TABULAR", tabular_sql("query", "text", "source_type"))
CHAIN = tuple(x.replace("\\\\", "\\") for x in (C.CHUNKS, C.QUESTIONS, C.VECTORS, KW, TOKENS, FTS, f"{C.HIERARCHY}, {SUB}", CAND, LEX, DENSE, LIT, f"{C.ANSWERS}, {BOOST}, {HYBRID}"))
BASE = CHAIN[:5]
RES = "res AS (SELECT r.query_id, r.id, r.rank, r.score, r.lexical, r.semantic, c.source_path, c.source_type, c.doc_role, c.uploaded_at, c.is_normalized, c.parent_key, c.section, c.text, r.query FROM ranked r JOIN chunks c USING (id) WHERE rank <= 24)"


def _q(spark, sf):
    return R.with_keywords(C.questions(spark, sf))


def index(spark, sf):
    """The stored index of the chunks, built once for each version of their files."""
    c = C.chunks(spark, sf)
    return stored("index", [c], lambda: I.build(c))


def query_vectors(spark, sf):
    return C.questions(spark, sf).join(C.vectors(spark, sf).withColumnRenamed("id", "query_id"), "query_id").select("query_id", "v", "dim")


def question_concepts(spark, sf):
    """query_id, concept, match: the concept terms of each question, or its first keywords where it has none."""
    q = cut(_q(spark, sf), "concept-questions")
    terms = G.concept_edges(G.concept_terms(q.select(F.col("query_id").alias("id"), F.col("query").alias("text")))).select(F.col("id").alias("query_id"), "concept")
    terms = cut(terms, "concept-terms")
    rest = q.join(terms.select("query_id").distinct(), "query_id", "left_anti").select("query_id", F.explode(F.slice("kw", 1, DEFAULTS.concept_terms)).alias("concept"))
    return terms.unionByName(rest).withColumn("match", F.lit(1.0))


def concepts(spark, sf):
    """query_id, id, score, labels of the rows that share a concept with a question."""
    return G.concept_candidates(question_concepts(spark, sf), index(spark, sf).concepts, 240)


def fact_candidates(spark, sf, questions):
    """query_id, id, score of the rows that hold a fact of a question's best."""
    f = C.hierarchy(spark, sf)
    found = G.fact_scores(questions, f).join(f.select("fact_id", F.col("chunk_id").alias("id")), "fact_id")
    return found.join(C.chunks(spark, sf).select("id"), "id", "left_semi").groupBy("query_id", "id").agg(F.max("score").alias("score"))


def boost_weights(spark, sf):
    """kind, target, weight: reuse of published answers, and a page for each source's newest row."""
    pages = C.chunks(spark, sf).groupBy("source_path").agg(F.max("id").alias("chunk_id")).withColumn("status", F.lit("published"))
    return A.boost_targets(C.answers(spark, sf), pages)


def memory_boosts(spark, sf):
    """id, boost of every row: the larger of its own and its source's weight."""
    b = boost_weights(spark, sf)
    chunk = b.filter("kind = 'chunk'").select(F.col("target").cast("long").alias("id"), F.col("weight").alias("a"))
    source = b.filter("kind = 'source'").select(F.col("target").alias("source_path"), F.col("weight").alias("b"))
    rows = C.chunks(spark, sf).select("id", "source_path").join(chunk, "id", "left").join(source, "source_path", "left")
    return rows.select("id", F.round(F.least(F.lit(0.05), DEFAULTS.wiki_boost_weight * F.greatest(F.coalesce("a", F.lit(0)), F.coalesce("b", F.lit(0)))), 6).alias("boost"))


def ranking(spark, sf):
    """All candidates of all questions with their scores and ranks: written once for each version of the tables, shared by the queries below."""
    q, c, v = C.questions(spark, sf), C.chunks(spark, sf), C.vectors(spark, sf)

    def make():
        return R.scored(q, index(spark, sf), c, query_vectors(spark, sf), v, concepts(spark, sf), fact_candidates(spark, sf, q), memory_boosts(spark, sf))

    return stored("ranking", [q, c, v, C.answers(spark, sf), C.hierarchy(spark, sf)], make)


def tuning_base(spark, sf, confidence):
    """All candidates with the facts of the lowest confidence that is tried, and these facts: scored once for all settings."""
    q, c, v, f = C.questions(spark, sf), C.chunks(spark, sf), C.vectors(spark, sf), C.hierarchy(spark, sf)

    def make():
        facts = G.fact_scores(q, f, replace(DEFAULTS, min_confidence=confidence), 1 << 30).select("query_id", "fact_id", "score")
        facts = facts.join(f.select("fact_id", F.col("chunk_id").alias("id"), "confidence", "status"), "fact_id").join(c.select("id"), "id", "left_semi")
        facts = cut(facts, "tuning-facts")
        found = facts.groupBy("query_id", "id").agg(F.max("score").alias("score"))
        return R.scored(q, index(spark, sf), c, query_vectors(spark, sf), v, concepts(spark, sf), found, memory_boosts(spark, sf)), facts

    return stored(f"tuning-{confidence}", [q, c, v, C.answers(spark, sf), f], make)


def hybrid(spark, sf, top_k=DEFAULTS.top_k):
    return ranking(spark, sf).filter(F.col("rank") <= top_k)


@query("gen_keywords", "SELECT query_id, kw FROM kw", BASE)
def gen_keywords(spark, sf):
    return _q(spark, sf).select("query_id", "kw")


@query("gen_fts", "SELECT query_id, id, 1.0::DOUBLE AS score FROM fts", CHAIN[:6])
def gen_fts(spark, sf):
    return R.bm25(_q(spark, sf), index(spark, sf), 240).select("query_id", "id", F.lit(1.0).alias("score"))


@query("gen_substring", "SELECT query_id, id FROM sub", (*BASE, CHAIN[6]))
def gen_substring(spark, sf):
    ix, q = index(spark, sf), cut(_q(spark, sf), "sub-questions")
    return R.substring_candidates(q, ix, 240)


@query("set_candidate_union", "SELECT query_id, id FROM cand", CHAIN[:8])
def set_candidate_union(spark, sf):
    return ranking(spark, sf).select("query_id", "id")


@query("sc_lexical", "SELECT query_id, id, round(lexical, 6) AS lexical FROM lex", CHAIN[:9])
def sc_lexical(spark, sf):
    return ranking(spark, sf).select("query_id", "id", F.round("lexical", 6).alias("lexical"))


@query("gen_dense_brute", "SELECT query_id, id, round(semantic, 6) AS semantic FROM sem", CHAIN[:10])
def gen_dense_brute(spark, sf):
    found = R.dense(query_vectors(spark, sf), C.vectors(spark, sf), set_candidate_union(spark, sf), 120)
    return found.withColumn("semantic", F.round("semantic", 6))


@query("topk_dense", """SELECT a.id AS query_id, b.id, round(list_dot_product(a.v::DOUBLE[], b.v::DOUBLE[]), 6) AS semantic FROM vectors a JOIN vectors b ON a.dim = b.dim WHERE a.id % 50 = 0
  QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY round(list_dot_product(a.v::DOUBLE[], b.v::DOUBLE[]), 9) DESC, b.id) <= 10""", (C.VECTORS,))  # fmt: skip
def topk_dense(spark, sf):
    v = C.vectors(spark, sf)
    q = v.filter("id % 50 = 0").withColumnRenamed("id", "query_id")  # a stated query set against all rows
    return R.dense_blocks(q, v, 10).select("query_id", "id", F.round("semantic", 6).alias("semantic"))


@query("gen_dense_hnsw", """SELECT query_id, b.id, round(greatest(0.0::DOUBLE, list_dot_product(b.v::DOUBLE[], qv::DOUBLE[])), 6) AS score FROM qv JOIN vectors b ON b.dim = qdim
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(list_dot_product(b.v::DOUBLE[], qv::DOUBLE[]), 9) DESC, b.id) <= 120""", (C.QUESTIONS, C.VECTORS, "qv AS (SELECT q.query_id, v.v AS qv, v.dim AS qdim FROM questions q JOIN vectors v ON q.query_id = v.id)"))  # fmt: skip
def gen_dense_hnsw(spark, sf):
    """Nearest rows of every question by cosine (one less the distance, not below 0), by exact blocks instead of a graph: recall 1."""
    return R.dense_blocks(query_vectors(spark, sf), C.vectors(spark, sf), 120).select("query_id", "id", F.round(F.greatest(F.lit(0.0), F.col("semantic")), 6).alias("score"))


def vector_index(spark, sf):
    """The stored index of all vectors and the number of lists to probe, built once for each version of their files."""
    v = C.vectors(spark, sf)

    def make():
        index = V.build(v)
        return index, V.calibrate(spark, index, DEFAULTS.candidates)

    return stored("vectors", [v], make)


@query("gen_dense_lists")
def gen_dense_lists(spark, sf):
    """Nearest rows of every question from the stored lists: approximate, see dense_lists_recall; gen_dense_hnsw is the exact path."""
    index, probes = vector_index(spark, sf)
    return V.search(index, query_vectors(spark, sf), DEFAULTS.candidates, probes).select("query_id", "id", F.round(F.greatest(F.lit(0.0), F.col("semantic")), 6).alias("score"))


@query("dense_lists_recall", "SELECT count(*) AS questions, true AS recalled, true AS fewer_read FROM qv", (C.QUESTIONS, C.VECTORS, "qv AS (SELECT q.query_id, v.v AS qv, v.dim AS qdim FROM questions q JOIN vectors v ON q.query_id = v.id)"))
def dense_lists_recall(spark, sf):
    """Do the stored lists find nine tenths of the true neighbours of all questions, and read fewer vectors than there are?"""
    index, probes = vector_index(spark, sf)
    found, true = gen_dense_lists(spark, sf).select("query_id", "id"), gen_dense_hnsw(spark, sf).select("query_id", "id")
    hit = true.join(found.withColumn("hit", F.lit(1)), ["query_id", "id"], "left").agg((F.sum(F.coalesce("hit", F.lit(0))) >= 0.9 * F.count(F.lit(1))).alias("recalled"))
    read = V.vectors_read(index, query_vectors(spark, sf), probes).agg(F.count(F.lit(1)).alias("questions"), (F.sum("read") < F.sum("rows")).alias("fewer_read"))
    return read.join(F.broadcast(hit)).select("questions", "recalled", "fewer_read")  # one row each


@query("sc_recency", "SELECT id, round(pow(0.5::DOUBLE, greatest(1711929600 - uploaded_at, 0) / 86400.0::DOUBLE / 45.0::DOUBLE), 6) AS recency FROM chunks", (C.CHUNKS,))
def sc_recency(spark, sf):
    return C.chunks(spark, sf).select("id", F.round(R.recency(F.col("uploaded_at"), DEFAULTS.now_ts, DEFAULTS.half_life_days), 6).alias("recency"))


@query("sc_literal", "SELECT query_id, id, round(literal, 6) AS literal FROM parts", CHAIN)
def sc_literal(spark, sf):
    q = C.questions(spark, sf).select("query_id", R.literals("query").alias("lits"))
    rows = set_candidate_union(spark, sf).join(q, "query_id").join(C.chunks(spark, sf).select("id", "text"), "id")
    return rows.select("query_id", "id", F.round(R.literal_score(F.col("text"), F.col("lits")), 6).alias("literal"))


@query("sc_code", "SELECT query_id, id, code FROM coded", CHAIN)
def sc_code(spark, sf):
    return ranking(spark, sf).select("query_id", "id", "code")


@query("topk_hybrid", """SELECT query_id, id, rank::INT AS rank, score, round(lexical, 6) AS lexical, round(semantic, 6) AS semantic, round(concept, 6) AS concept, round(ontology, 6) AS ontology,
  round(structure, 6) AS structure, round(memory, 6) AS memory, round(tabular, 6) AS tabular, fts, code FROM ranked WHERE rank <= 5""", CHAIN)  # fmt: skip
def topk_hybrid(spark, sf):
    names = ("lexical", "semantic", "concept", "ontology", "structure", "memory", "tabular")
    return hybrid(spark, sf).select("query_id", "id", "rank", "score", *[F.round(c, 6).alias(c) for c in names], "fts", "code")


@query("sc_tabular", f"""SELECT query_id, id, round({tabular_sql("q", "t", "source_type")}, 6) AS boost FROM (
  SELECT query_id, id, source_type, CASE WHEN query_id % 2 = 0 THEN '단가 rate count year ' || query ELSE query END AS q,
    CASE source_type WHEN 'xlsx' THEN '표행요약: ' || text WHEN 'pdf' THEN '표값: ' || text ELSE text END AS t FROM res)""".replace("\\\\", "\\"), (*CHAIN, RES))  # fmt: skip
def sc_tabular(spark, sf):
    """The ranked rows, sheets and pages with their table marks, every second question asking for figures."""
    r = results(spark, sf)
    text = F.when(F.col("source_type") == "xlsx", F.concat(F.lit("표행요약: "), "text")).when(F.col("source_type") == "pdf", F.concat(F.lit("표값: "), "text")).otherwise(F.col("text"))
    r = r.withColumn("query", F.when(F.col("query_id") % 2 == 0, F.concat(F.lit("단가 rate count year "), "query")).otherwise(F.col("query"))).withColumn("text", text)
    return r.select("query_id", "id", F.round(R.tabular_boost("query", "text", F.col("source_type"), F.lit(""), F.lit(False)), 6).alias("boost"))


@query("sc_fuse", "SELECT query_id, id, score FROM ranked WHERE rank <= 24", CHAIN)
def sc_fuse(spark, sf):
    return hybrid(spark, sf, 24).select("query_id", "id", "score")


RANKED24 = (*CHAIN, RES)


def results(spark, sf, top_k=24):
    """Ranked results with the columns of their rows."""
    cols = ["id", "source_path", "source_type", "doc_role", "is_normalized", "parent_key", "section", "text"]
    top = cut(hybrid(spark, sf, top_k), "results")
    return top.join(R.texts_of(C.chunks(spark, sf).select(cols), top), "id").join(C.questions(spark, sf), "query_id")
