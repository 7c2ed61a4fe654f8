"""The document model over plain tables: chunks, uploads, queries, vectors, logs and table rows.

Each carrier is stated twice, as a DataFrame and as the SQL of a common table expression (CTE), so that
queries and their stated results start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BASE_TS = 1_704_067_200


#: Tables whose rows are long texts.
TEXTS = ("documents", "pages", "conversations")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table. A single file may be a single row group and so a single task: texts in one file are dealt anew, many files never."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return rows.repartition(spark.sparkContext.defaultParallelism) if name in TEXTS and len(rows.inputFiles()) == 1 else rows


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as retrieval rows; the first words of a text are its heading."""
    d = read(spark, sf_dir, "documents")
    number = F.regexp_extract("source", "([0-9]+)$", 1).cast("int")
    return d.select(
        F.col("doc_id").alias("id"), F.col("lang").alias("kb_id"), F.col("source").alias("source_path"),
        F.element_at(F.array(*map(F.lit, ("txt", "pdf", "hwpx", "xlsx"))), (F.col("doc_id") % 4 + 1).cast("int")).alias("source_type"),
        F.when(number % 2 == 0, "guide").otherwise("casebook").alias("doc_role"),
        (F.lit(BASE_TS) + (F.col("doc_id") * 7919) % 90 * 86400).alias("uploaded_at"),
        (F.col("doc_id") % 10 == 9).cast("int").alias("is_normalized"),
        F.concat("source", F.lit(":"), F.floor(F.col("doc_id") / 3).cast("string")).alias("parent_key"),
        F.concat(F.lit("s"), (F.col("doc_id") % 7).cast("string")).alias("section"),
        F.array_join(F.slice(F.split("text", " "), 1, 8), " ").alias("heading"),
        F.col("text"),
    )


CHUNKS = """chunks AS (
  SELECT doc_id AS id, lang AS kb_id, source AS source_path, (['txt','pdf','hwpx','xlsx'])[doc_id % 4 + 1] AS source_type,
         CASE WHEN regexp_extract(source, '([0-9]+)$', 1)::INT % 2 = 0 THEN 'guide' ELSE 'casebook' END AS doc_role,
         1704067200 + (doc_id * 7919) % 90 * 86400 AS uploaded_at, (doc_id % 10 = 9)::INT AS is_normalized,
         source || ':' || (doc_id // 3)::VARCHAR AS parent_key, 's' || (doc_id % 7)::VARCHAR AS section, array_to_string(string_split(text, ' ')[1:8], ' ') AS heading, text FROM documents)"""


def uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each source: role, newest time, a display name for most."""
    c = chunks(spark, sf_dir)
    return c.groupBy("source_path").agg(
        F.min("doc_role").alias("role"), F.max("uploaded_at").alias("at_"),
        F.when(F.length("source_path") > 4, F.concat("source_path", F.lit(".txt"))).alias("display"),
    )


UPLOADS = """uploads AS (SELECT source_path, min(doc_role) AS role, max(uploaded_at) AS at_,
  CASE WHEN length(source_path) > 4 THEN source_path || '.txt' END AS display FROM chunks GROUP BY source_path)"""


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as queries."""
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


QUESTIONS = "questions AS (SELECT item_id AS query_id, text AS query FROM benchmark)"


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unit vectors of chunks."""
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), F.size("embedding").alias("dim"))


VECTORS = "vectors AS (SELECT vec_id AS id, embedding AS v, len(embedding)::INT AS dim FROM embeddings)"


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as chat messages."""
    return read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("seq"), "role", "text")


MESSAGES = "messages AS (SELECT conv_id AS session_id, turn AS seq, role, text FROM conversations)"


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as rows of an operations log."""
    e = read(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    return e.select(
        F.col("event_id").alias("run_id"), F.concat(F.lit("kb"), (F.col("user_id") % 5).cast("string")).alias("kb"), F.col("user_id"),
        F.unix_timestamp("ts").alias("created_at"), F.col("event_type").alias("status"), F.col("value").alias("latency"), k.alias("k"),
        F.concat(F.lit("q"), F.floor(F.col("event_id") / 2).cast("string")).alias("query_id"),
        F.when(k % 3 == 0, F.concat(F.lit("code"), (k % 4).cast("string"))).otherwise("").alias("failure_code"),
    )


RUNS = """runs AS (SELECT event_id AS run_id, 'kb' || (user_id % 5)::VARCHAR AS kb, user_id, floor(epoch(ts))::BIGINT AS created_at,
  event_type AS status, value AS latency, (props->>'$.k')::INT AS k, 'q' || (event_id // 2)::VARCHAR AS query_id,
  CASE WHEN (props->>'$.k')::INT % 3 = 0 THEN 'code' || ((props->>'$.k')::INT % 4)::VARCHAR ELSE '' END AS failure_code FROM events)"""


def fact_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as table rows: headers and values."""
    p = read(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").alias("row_no"), F.array(*map(F.lit, ("품목", "brand", "type", "size"))).alias("headers"),
        F.array("p_name", "p_brand", "p_type", F.col("p_size").cast("string")).alias("values"),
    )


FACT_ROWS = """fact_rows AS (SELECT p_partkey AS row_no, ['품목','brand','type','size'] AS headers,
  [p_name, p_brand, p_type, p_size::VARCHAR] AS "values" FROM part)"""


def hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subject, predicate, object facts: parents of places and firms, and their figures."""
    region, nation, supplier = (read(spark, sf_dir, t) for t in ("region", "nation", "supplier"))
    up = nation.join(F.broadcast(region), nation["n_regionkey"] == region["r_regionkey"]).select(F.col("n_name").alias("subject"), F.lit("상위개념").alias("predicate"), F.col("r_name").alias("object"), F.col("n_nationkey").cast("long").alias("n"))
    firm = supplier.join(F.broadcast(nation), supplier["s_nationkey"] == nation["n_nationkey"]).select(F.col("s_name").alias("subject"), F.lit("nation").alias("predicate"), F.col("n_name").alias("object"), (F.col("s_suppkey") + 100).alias("n"))
    facts = up.unionByName(firm)
    return facts.select(
        (F.col("n") + 1).alias("fact_id"), "subject", "predicate", "object", (F.lit(0.5) + (F.col("n") % 5) * 0.1).alias("confidence"),
        F.element_at(F.array(*map(F.lit, ("active", "active", "published", "needs_review", "archived"))), (F.col("n") % 5 + 1).cast("int")).alias("status"),
        (F.col("n") * 3 % 200).alias("chunk_id"),
    )


HIERARCHY = """facts AS (
  SELECT n + 1 AS fact_id, subject, predicate, object, 0.5::DOUBLE + (n % 5) * 0.1::DOUBLE AS confidence,
         (['active','active','published','needs_review','archived'])[n % 5 + 1] AS status, n * 3 % 200 AS chunk_id
  FROM (SELECT n_name AS subject, '상위개념' AS predicate, r_name AS object, n_nationkey::BIGINT AS n FROM nation JOIN region ON n_regionkey = r_regionkey
        UNION ALL SELECT s_name, 'nation', n_name, s_suppkey + 100 FROM supplier JOIN nation ON s_nationkey = n_nationkey))"""


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as saved answers."""
    d, lab = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    return d.join(lab, "doc_id").select(
        F.col("doc_id").alias("answer_id"), F.concat(F.lit("q"), (F.col("doc_id") % 50).cast("string")).alias("question_key"),
        F.col("source").alias("source_path"), F.col("text").alias("answer"),
        F.when(F.col("toxic") == 1, "reported").when(F.col("quality") == 1, "published").otherwise("needs_review").alias("status"),
        (F.col("doc_id") % 4).cast("int").alias("reused"), (F.lit(BASE_TS) + F.col("doc_id") * 3600).alias("updated_at"),
        F.filter(F.array(F.when(F.col("quality") == 0, "low_quality"), F.when(F.col("toxic") == 1, "outside_claim"), F.when(F.length("text") < 200, "short")), lambda x: x.isNotNull()).alias("flags"),
        F.col("doc_id").alias("chunk_id"),
    )


ANSWERS = """answers AS (SELECT doc_id AS answer_id, 'q' || (doc_id % 50)::VARCHAR AS question_key, source AS source_path, text AS answer,
  CASE WHEN toxic = 1 THEN 'reported' WHEN quality = 1 THEN 'published' ELSE 'needs_review' END AS status, (doc_id % 4)::INT AS reused,
  1704067200 + doc_id * 3600 AS updated_at, list_filter([CASE WHEN quality = 0 THEN 'low_quality' END, CASE WHEN toxic = 1 THEN 'outside_claim' END,
  CASE WHEN length(text) < 200 THEN 'short' END], lambda x: x IS NOT NULL) AS flags, doc_id AS chunk_id FROM documents JOIN labels USING (doc_id))"""
