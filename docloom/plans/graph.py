"""Queries of concepts and facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators import graph as G
from docloom.plans.registry import query
from docloom.plans.retrieval import CT, FS, GEN, KW, QTERMS, concepts, index
from docloom.sources import carriers as C

@query("concept_terms", "SELECT id, n::INT AS n, term, round(weight, 6) AS weight FROM cterms", (C.CHUNKS, CT))
def concept_terms(spark, sf):
    return G.concept_terms(C.chunks(spark, sf)).withColumn("weight", F.round("weight", 6))


@query("concept_sync", "SELECT id, concept, round(weight, 6) AS weight FROM edges", (C.CHUNKS, CT))
def concept_sync(spark, sf):
    return G.concept_edges(G.concept_terms(C.chunks(spark, sf))).withColumn("weight", F.round("weight", 6))


@query("gen_concept", GEN, (C.CHUNKS, CT, C.QUESTIONS, KW, QTERMS))
def gen_concept(spark, sf):
    return concepts(spark, sf).select("query_id", "id", "score")


@query("join_concept_edges", """SELECT query_id, id, list(concept ORDER BY weight DESC, concept)[1:4] AS labels FROM qterms JOIN edges USING (concept) GROUP BY query_id, id
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(max(weight), 6) DESC, id) <= 240""", (C.CHUNKS, CT, C.QUESTIONS, KW, QTERMS))  # fmt: skip
def join_concept_edges(spark, sf):
    return concepts(spark, sf).select("query_id", "id", "labels")


@query("anti_orphan_concept", "SELECT DISTINCT concept FROM edges WHERE concept NOT IN (SELECT concept FROM edges WHERE id % 2 = 0)", (C.CHUNKS, CT))
def anti_orphan_concept(spark, sf):
    e = concept_sync(spark, sf)
    return e.select("concept").distinct().join(e.filter("id % 2 = 0").select("concept"), "concept", "left_anti")


# pairs of similar terms from shared runs of three characters, then one step for each term that has a similar one
RESOLVED = """firsts AS MATERIALIZED (SELECT concept AS term, row_number() OVER (ORDER BY min(id), concept) AS no FROM edges GROUP BY concept),
runs AS (SELECT no, term, list_distinct(list_transform(range(1, length(term) + 1), lambda i: substr('^' || term || '$', i, 3))) AS f FROM firsts),
flat AS (SELECT no, len(f) AS n, unnest(f) AS x FROM runs),
pairs AS MATERIALIZED (SELECT * FROM (SELECT p.no AS a, q.no AS b, round(count(*) / sqrt(any_value(p.n) * any_value(q.n)), 9) AS score FROM flat p JOIN flat q ON p.x = q.x AND p.no < q.no GROUP BY p.no, q.no) WHERE score >= 0.84),
involved AS (SELECT id, row_number() OVER (ORDER BY id) AS k, coalesce((SELECT list(a) FROM pairs WHERE b = id), []) AS earlier FROM (SELECT a AS id FROM pairs UNION SELECT b FROM pairs)),
fold AS (SELECT 0::BIGINT AS k, []::BIGINT[] AS nodes UNION ALL SELECT i.k, CASE WHEN len(list_intersect(i.earlier, f.nodes)) = 0 THEN list_append(f.nodes, i.id) ELSE f.nodes END FROM fold f JOIN involved i ON i.k = f.k + 1),
made AS (SELECT unnest(arg_max(nodes, k)) AS id FROM fold),
nearest AS (SELECT b, arg_max(a, score * 1000000000 * 1000000 - a) AS a, max(score) AS score FROM pairs WHERE a IN (SELECT id FROM made) AND b NOT IN (SELECT id FROM made) GROUP BY b)"""


@query("concept_resolve", "SELECT f.term, coalesce(t.term, f.term) AS node, round(coalesce(n.score, 1.0::DOUBLE), 6) AS score FROM firsts f LEFT JOIN nearest n ON n.b = f.no LEFT JOIN firsts t ON t.no = n.a", (C.CHUNKS, CT, RESOLVED), recursive=True)
def concept_resolve(spark, sf):
    """All concept terms in the order of their rows: each a node, or an alias of the most similar node before it."""
    from docloom.operators.resolve import resolve

    terms = index(spark, sf).concepts.select(F.col("concept").alias("term"), "id")
    return resolve(terms, [F.col("id")]).select("term", "node", F.round("score", 6).alias("score"))


@query("fact_upsert_entity", """WITH e AS (SELECT n_name AS key, n_name || ' v1' AS display, 0.5::DOUBLE AS confidence, CASE WHEN n_nationkey % 7 = 0 THEN 'archived' ELSE 'active' END AS status, 1 AS at_ FROM nation
  UNION ALL SELECT n_name, n_name || ' v2', 0.4::DOUBLE + n_regionkey * 0.1::DOUBLE, 'active', 2 FROM nation WHERE n_nationkey % 2 = 0)
SELECT key, arg_max(display, at_) AS display, round(max(confidence), 6) AS confidence, CASE WHEN bool_or(status = 'archived') THEN 'archived' ELSE arg_max(status, at_) END AS status FROM e GROUP BY key""")  # fmt: skip
def fact_upsert_entity(spark, sf):
    n = C.read(spark, sf, "nation")
    base = lambda v, conf, status, at: [F.col("n_name").alias("key"), F.concat("n_name", F.lit(v)).alias("display"), F.array("n_name").alias("aliases"), conf.alias("confidence"), status.alias("status"), F.lit(at).alias("at")]
    old = n.select(base(" v1", F.lit(0.5), F.when(F.col("n_nationkey") % 7 == 0, "archived").otherwise("active"), 1))
    new = n.filter("n_nationkey % 2 = 0").select(base(" v2", F.lit(0.4) + F.col("n_regionkey") * 0.1, F.lit("active"), 2))
    return G.merge_entities(old, new).select("key", "display", F.round("confidence", 6).alias("confidence"), "status")


QF = "fq AS (SELECT n_nationkey::BIGINT AS query_id, 'nation of ' || n_name || ' and 상위개념 ' || r_name AS query FROM nation JOIN region ON n_regionkey = r_regionkey)"
def _fact_questions(spark, sf):
    n, r = C.read(spark, sf, "nation"), C.read(spark, sf, "region")
    return n.join(r, n["n_regionkey"] == r["r_regionkey"]).select(F.col("n_nationkey").cast("long").alias("query_id"), F.concat(F.lit("nation of "), "n_name", F.lit(" and 상위개념 "), "r_name").alias("query"))


@query("fact_search", "SELECT query_id, fact_id, score, hops, rank::INT AS rank FROM fr", (C.HIERARCHY, QF, FS))
def fact_search(spark, sf):
    return G.fact_scores(_fact_questions(spark, sf), C.hierarchy(spark, sf))


@query("topk_facts", "SELECT query_id, fact_id FROM fr WHERE rank <= 5", (C.HIERARCHY, QF, FS))
def topk_facts(spark, sf):
    return fact_search(spark, sf).filter("rank <= 5").select("query_id", "fact_id")


@query("gen_ontology", "SELECT query_id, chunk_id, max(score) AS score, min(hops) AS hops FROM fr JOIN facts USING (fact_id) GROUP BY query_id, chunk_id", (C.HIERARCHY, QF, FS))
def gen_ontology(spark, sf):
    return fact_search(spark, sf).join(C.hierarchy(spark, sf).select("fact_id", "chunk_id"), "fact_id").groupBy("query_id", "chunk_id").agg(F.max("score").alias("score"), F.min("hops").alias("hops"))


@query("join_fact_full", """SELECT f.fact_id, f.subject, f.predicate, f.object, o.subject IS NOT NULL AS object_is_entity, c.source_path FROM facts f LEFT JOIN (SELECT DISTINCT subject FROM facts) o ON f.object = o.subject
  JOIN chunks c ON c.id = f.chunk_id WHERE f.status IN ('active', 'published')""", (C.CHUNKS, C.HIERARCHY))  # fmt: skip
def join_fact_full(spark, sf):
    f = C.hierarchy(spark, sf)
    entities = f.select(F.col("subject").alias("object")).distinct().withColumn("object_is_entity", F.lit(True))
    rows = f.filter(F.col("status").isin("active", "published")).join(entities, "object", "left").join(C.chunks(spark, sf).select(F.col("id").alias("chunk_id"), "source_path"), "chunk_id")
    return rows.select("fact_id", "subject", "predicate", "object", F.coalesce("object_is_entity", F.lit(False)).alias("object_is_entity"), "source_path")


@query("join_fact_detail", "SELECT subject, list(fact_id ORDER BY fact_id) AS fact_ids, list(object ORDER BY fact_id) AS objects FROM facts GROUP BY subject", (C.HIERARCHY,))
def join_fact_detail(spark, sf):
    rows = C.hierarchy(spark, sf).groupBy("subject").agg(F.array_sort(F.collect_list(F.struct("fact_id", "object"))).alias("f"))
    return rows.select("subject", F.transform("f", lambda x: x["fact_id"]).alias("fact_ids"), F.transform("f", lambda x: x["object"]).alias("objects"))


@query("join_two_hop", "SELECT a.fact_id AS parent_fact, b.fact_id FROM facts a JOIN facts b ON b.subject = a.subject WHERE a.predicate = '상위개념' AND a.status IN ('active', 'published') AND b.status IN ('active', 'published')", (C.HIERARCHY,))
def join_two_hop(spark, sf):
    f = C.hierarchy(spark, sf).filter(F.col("status").isin("active", "published"))
    up = f.filter(F.col("predicate") == G.PARENT).select(F.col("fact_id").alias("parent_fact"), "subject")
    return up.join(f, "subject").select("parent_fact", "fact_id")


@query("agg_fact_status", "SELECT status, count(*) AS facts, count(DISTINCT subject) AS entities FROM facts GROUP BY status", (C.HIERARCHY,))
def agg_fact_status(spark, sf):
    return C.hierarchy(spark, sf).groupBy("status").agg(F.count("*").alias("facts"), F.count_distinct("subject").alias("entities"))


@query("agg_fact_predicates", "SELECT predicate, count(*) AS n FROM facts GROUP BY predicate ORDER BY n DESC, predicate LIMIT 20", (C.HIERARCHY,))
def agg_fact_predicates(spark, sf):
    return C.hierarchy(spark, sf).groupBy("predicate").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "predicate").limit(20)


FB = """fb AS (SELECT fact_id, 'k' || (fact_id % 3)::VARCHAR AS feedback_key, CASE WHEN fact_id % 4 = 0 THEN 'report' ELSE 'publish' END AS signal FROM facts WHERE fact_id % 2 = 0 UNION ALL SELECT fact_id, 'k' || (fact_id % 3)::VARCHAR, CASE WHEN confidence < 0.65 THEN 'report' ELSE 'publish' END FROM facts WHERE fact_id % 2 = 1),
led AS (SELECT fact_id, 'k' || (fact_id % 3)::VARCHAR AS feedback_key FROM facts WHERE fact_id % 8 = 0),
fresh AS (SELECT * FROM fb WHERE NOT EXISTS (SELECT 1 FROM led WHERE led.fact_id = fb.fact_id AND led.feedback_key = fb.feedback_key)),
fbk AS (SELECT f.fact_id, f.status, f.confidence, CASE signal WHEN 'publish' THEN 'published' WHEN 'report' THEN 'needs_review' ELSE f.status END AS new_status,
  round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, confidence + CASE signal WHEN 'publish' THEN 0.08::DOUBLE WHEN 'report' THEN -0.08::DOUBLE ELSE 0.0::DOUBLE END)), 6) AS new_confidence, signal FROM facts f LEFT JOIN fresh USING (fact_id))"""


def _feedback(spark, sf):
    f = C.hierarchy(spark, sf)
    key = F.concat(F.lit("k"), (F.col("fact_id") % 3).cast("string")).alias("feedback_key")
    fb = f.filter("fact_id % 2 = 0").select("fact_id", key, F.when(F.col("fact_id") % 4 == 0, "report").otherwise("publish").alias("signal")).unionByName(f.filter("fact_id % 2 = 1").select("fact_id", key, F.when(F.col("confidence") < 0.65, "report").otherwise("publish").alias("signal")))
    fb = fb.unionByName(fb.filter("fact_id % 6 = 0"))  # said twice, counts once
    return G.apply_feedback(f, f.filter("fact_id % 8 = 0").select("fact_id", key), fb)


@query("fact_feedback", "SELECT fact_id, new_status AS status, new_confidence AS confidence FROM fbk", (C.HIERARCHY, FB))
def fact_feedback(spark, sf):
    return _feedback(spark, sf)[0].select("fact_id", "status", F.round("confidence", 6).alias("confidence"))


@query("st_idempotent_feedback", "SELECT fact_id, feedback_key FROM led UNION ALL SELECT fact_id, feedback_key FROM fresh", (C.HIERARCHY, FB))
def st_idempotent_feedback(spark, sf):
    return _feedback(spark, sf)[1]


@query("fact_status", "SELECT fact_id, status, new_status, round(confidence, 6) AS confidence, new_confidence FROM fbk WHERE signal IS NOT NULL AND (status <> new_status OR new_confidence <> confidence)", (C.HIERARCHY, FB))
def fact_status(spark, sf):
    return _feedback(spark, sf)[2].withColumn("confidence", F.round("confidence", 6))


@query("anti_orphan_fact", "SELECT fact_id FROM facts WHERE chunk_id NOT IN (SELECT id FROM chunks WHERE id % 3 = 0)", (C.CHUNKS, C.HIERARCHY))
def anti_orphan_fact(spark, sf):
    return C.hierarchy(spark, sf).join(C.chunks(spark, sf).filter("id % 3 = 0").select(F.col("id").alias("chunk_id")), "chunk_id", "left_anti").select("fact_id")


@query("fact_sync", "SELECT fact_id, subject FROM facts WHERE chunk_id % 5 <> 0 UNION ALL SELECT fact_id + 100000, subject FROM facts WHERE chunk_id % 5 = 0 AND chunk_id % 2 = 0", (C.HIERARCHY,))
def fact_sync(spark, sf):
    f = C.hierarchy(spark, sf)
    touched = f.filter("chunk_id % 5 = 0").select("chunk_id").distinct()
    fresh = f.filter("chunk_id % 5 = 0 AND chunk_id % 2 = 0").select((F.col("fact_id") + 100000).alias("fact_id"), "subject")
    return f.join(touched, "chunk_id", "left_anti").select("fact_id", "subject").unionByName(fresh)
