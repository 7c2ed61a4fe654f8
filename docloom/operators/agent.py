"""A search tool's call as one plan: all attempts of a question (roles in order) side by side, the first that is grounded wins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.operators import gates as G
from docloom.settings import DEFAULTS, Settings

# fixed values: rows that are kept, rows an attempt looks at, rows whose coverage counts, weight of the coverage
KEEP, CANDIDATES, COVERAGE_ROWS, COVERAGE_WEIGHT = 8, 32, 8, 0.35
#: Most attempts of a question.
ATTEMPTS = 16


def attempts(questions: DataFrame) -> DataFrame:
    """question, query_id (a number of the attempt), n, role, query: one row for each entry of a question's plan (query_id, query, plan)."""
    rows = questions.select(F.col("query_id").alias("question"), "query", F.posexplode(F.slice("plan", 1, ATTEMPTS)).alias("n", "role"))
    return rows.select("question", (F.col("question") * ATTEMPTS + F.col("n")).alias("query_id"), "n", "role", "query")


def tried(questions: DataFrame, scored: DataFrame, chunks: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """The rows that each attempt ends with: of its role, guarded by cited numbers, raw rows first, with a critical term, from several sections.

    scored: query_id, id, rank, score, semantic, uploaded_at of all candidates, ranked once for all attempts. chunks: their columns by id.
    """
    tries = attempts(questions)
    roles = scored.withColumnRenamed("query_id", "question").join(chunks.select("id", "doc_role"), "id")
    rows = roles.join(tries, "question").filter((F.col("role") == "all") | (F.col("doc_role") == F.col("role")))
    rows = rows.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("rank"))).filter(F.col("rank") <= CANDIDATES)
    rows = rows.drop("doc_role").join(chunks.select("id", "source_path", "doc_role", "is_normalized", "section", "text"), "id")
    rows = G.prefer_raw(G.number_guard(rows, KEEP), KEEP, s.max_normalized)
    return G.diversify(G.critical_gate(rows), KEEP, s.per_section, s.per_file)


def search(questions: DataFrame, scored: DataFrame, chunks: DataFrame, negative=G.NEGATIVE, positive=G.POSITIVE, s: Settings = DEFAULTS) -> DataFrame:
    """question, role, passed, tried, selection, ids: the first attempt whose rows pass the grounding gate; without one that with the best evidence (then the first).

    tried: attempts until the gate passed. A question without rows in any attempt is missing.
    """
    rows = tried(questions, scored, chunks, s)
    against = G.conflicts(rows, negative, positive).select("query_id").distinct().withColumn("conflict", F.lit(True))
    measures = G.answerability(rows, COVERAGE_ROWS).join(G.explicit_evidence(rows), "query_id").join(against, "query_id", "left").na.fill(False, ["conflict"])
    judged = G.grounding_gate(measures, s).withColumn("selection", F.round(F.col("top1") + COVERAGE_WEIGHT * F.col("coverage"), 6))
    kept = rows.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"]).alias("ids"))  # at most KEEP
    found = judged.join(kept, "query_id").join(attempts(questions).select("question", "query_id", "n", "role"), "query_id")
    better = F.struct(F.col("passed").cast("int").alias("p"), F.when(F.col("passed"), -F.col("n").cast("double")).otherwise(F.col("selection")).alias("s"), (-F.col("n")).alias("n"))
    best = found.groupBy("question").agg(F.max_by(F.struct("n", "role", "passed", "selection", "ids"), better).alias("b"))
    plans = questions.select(F.col("query_id").alias("question"), F.least(F.size("plan"), F.lit(ATTEMPTS)).alias("all"))
    return best.join(plans, "question").select("question", "b.role", "b.passed", F.when(F.col("b.passed"), F.col("b.n") + 1).otherwise(F.col("all")).alias("tried"), "b.selection", "b.ids")
