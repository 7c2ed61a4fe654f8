"""Concept links and subject-predicate-object facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.settings import DEFAULTS, Settings

# fixed values: words that are no concepts, and aliases of question words
CONCEPT_STOP = ("guide", "manual", "summary", "question", "answer", "document", "file", "upload", "content", "info")
QUERY_ALIASES = {"답례품": ("지급단가", "단가", "금액", "답례품"), "얼마": ("지급단가", "단가", "금액"), "농어가경제조사": ("농가경제조사", "농어가경제조사")}
PARENT = "상위개념"


def concept_terms(chunks: DataFrame, most: int = DEFAULTS.concept_terms) -> DataFrame:
    """id, n, term, weight of up to ``most`` concepts of each row.

    The first three distinct words lead; then words by score (1, early +0.35, four characters or more +0.15 per
    occurrence) until max(2, most / 2); then two-word phrases (1.25, early +0.25, +0.10) before words.
    """
    return concept_terms_of(chunks.select("id", F.filter(T.tokens("text"), lambda t: ~t.isin(*CONCEPT_STOP)).alias("w")), most)


def concept_terms_of(words: DataFrame, most: int = DEFAULTS.concept_terms) -> DataFrame:
    """The same from the words of each row (id, w)."""
    # all of a row alone: sorted words make runs, whose lengths are the counts; nothing is shuffled
    at = words.select("id", "w", F.slice("w", 1, 8).alias("head"), F.array_distinct(F.slice("w", 1, 3)).alias("leads"))
    pairs = F.when(F.size("w") > 1, F.transform(F.sequence(F.lit(0), F.size("w") - 2), lambda i: F.concat_ws(" ", F.get("w", i), F.get("w", i + 1)))).otherwise(F.array().cast("array<string>"))
    at = at.withColumn("pairs", pairs).select("id", "w", "head", "leads", F.slice("pairs", 1, 6).alias("early"), F.filter("pairs", lambda t: F.length(t) >= 4).alias("pairs"))
    among = lambda xs, t: F.when(F.array_contains(xs, t), F.size(F.filter(xs, lambda x: x == t))).otherwise(0)
    item = lambda s, t: F.struct(F.round(s, 4).alias("s"), F.length(t).alias("n"), t.alias("t"))  # noqa: E731  best first when sorted backwards
    ones = T.runs("w", lambda t, n: item(n * (1.0 + F.when(F.length(t) >= 4, 0.15).otherwise(0.0)) + 0.35 * among("head", t), t))
    twos = T.runs("pairs", lambda t, n: item(n * 1.35 + 0.25 * among("early", t), t))
    lists = at.select("id", "leads", F.sort_array(F.filter(ones, lambda x: ~F.array_contains("leads", x["t"])), False).alias("ones"), F.sort_array(twos, False).alias("twos"))
    preferred = max(1, min(most, max(2, most // 2)))
    # words below the preferred number come after the leading ones; one more is always taken, as the limit is checked after the append
    room = F.greatest(F.lit(1), preferred - F.size("leads"))
    names = lambda c: F.transform(c, lambda x: x["t"])
    rest = F.slice(F.col("ones"), room + 1, most)
    every = F.slice(F.concat(F.col("leads"), names(F.slice("ones", F.lit(1), room)), names(F.slice("twos", 1, most)), names(rest)), 1, most)
    out = lists.select("id", F.posexplode(every).alias("at", "term"))
    return out.select("id", (F.col("at") + 1).alias("n"), "term", F.greatest(F.lit(0.15), 1 - 0.12 * F.col("at")).alias("weight"))


def concept_edges(terms: DataFrame) -> DataFrame:
    """id, concept, weight: of a concept that a row names twice the last (lowest) weight."""
    return terms.groupBy("id", F.regexp_replace("term", T.SPACE, "").alias("concept")).agg(F.min("weight").alias("weight"))


def concept_candidates(question_terms: DataFrame, edges: DataFrame, limit: int) -> DataFrame:
    """query_id, id, score, labels: best match times weight over shared concepts; up to four labels. question_terms: query_id, concept, match."""
    hits = question_terms.join(edges, "concept").withColumn("s", F.col("match") * F.col("weight"))
    found = hits.groupBy("query_id", "id").agg(F.round(F.max("s"), 6).alias("score"), F.slice(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("s")).alias("o"), "concept"))), lambda x: x["concept"]), 1, 4).alias("labels"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= max(8, limit)).drop("rank")


def merge_entities(old: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert of entities (key, display, aliases, confidence, status, at): newest display and aliases, highest confidence, archived stays archived."""
    both = old.unionByName(new)
    newest = F.max_by(F.struct("display", "aliases", "status"), "at")
    out = both.groupBy("key").agg(newest.alias("x"), F.max("confidence").alias("confidence"), F.max(F.col("status") == "archived").alias("gone"), F.max("at").alias("at"))
    return out.select("key", "x.display", "x.aliases", "confidence", F.when(F.col("gone"), "archived").otherwise(F.col("x.status")).alias("status"), "at")


def expand_aliases(tokens: Column, aliases: dict[str, tuple[str, ...]] = QUERY_ALIASES) -> Column:
    """Each token followed by its aliases."""
    def more(t: Column) -> Column:
        out = F.array(t)
        for k, v in aliases.items():
            out = F.when(t == k, F.concat(F.array(t), F.array(*map(F.lit, v)))).otherwise(out)
        return out

    return F.flatten(F.transform(tokens, more))


def fact_scores(questions: DataFrame, facts: DataFrame, s: Settings = DEFAULTS, limit: int = 20) -> DataFrame:
    """query_id, fact_id, score, hops, rank of the best facts of each question.

    facts: fact_id, subject, predicate, object, confidence, status. A whole part inside the question counts 2 for the
    subject, 1 for the predicate or the object; a token inside a part counts 1. A fact needs a subject hit, or (two hops, times 0.72) a
    token that is the object of its subject's parent fact together with a predicate hit. Candidates come from equi-joins on
    the parts' leading n-grams and on the question's tokens, not from question-fact pairs.
    """
    live = facts.filter((F.col("status") == "published") | (F.col("status") == "active") & (F.col("confidence") >= s.min_confidence))
    q = questions.select("query_id", T.tokens("query", T.GATE_TOKEN).alias("qt"), T.compact("query").alias("qc"))
    parts = live.select("fact_id", F.explode(F.array(F.struct(F.lit(0).alias("k"), F.col("subject").alias("p")), F.struct(F.lit(1).alias("k"), F.col("predicate").alias("p")), F.struct(F.lit(2).alias("k"), F.col("object").alias("p")))).alias("x"))
    parts = parts.select("fact_id", "x.k", T.compact("x.p").alias("p")).filter("p <> ''")
    distinct_parts = parts.select("p").distinct()
    gram = lambda c, n: F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - n + 1, F.lit(1))), lambda i: F.substring(F.col(c), i, F.lit(n)))
    # parts inside a question
    keyed = distinct_parts.withColumn("g", F.substring("p", 1, 3))
    grams = q.select("query_id", "qc", F.explode(F.array_distinct(F.concat(gram("qc", 1), gram("qc", 2), gram("qc", 3)))).alias("g"))
    whole = grams.join(keyed, "g").filter(F.instr(F.col("qc"), F.col("p")) > 0).select("query_id", "p").distinct()
    whole = whole.join(parts, "p").select("query_id", "fact_id", F.when(F.col("k") == 0, 2).otherwise(0).alias("d"), F.when(F.col("k") == 1, 1).otherwise(0).alias("pr"), F.when(F.col("k") == 2, 1).otherwise(0).alias("v"))
    # tokens inside a part: the part's n-grams against the tokens
    tokens = q.select("query_id", F.explode("qt").alias("t"))
    kinds = distinct_parts.select("p", F.explode(F.array_distinct(F.concat(gram("p", 2), gram("p", 3)))).alias("g"))
    inside = tokens.select("t").distinct().withColumn("g", F.substring("t", 1, 3)).join(kinds, "g").filter(F.instr(F.col("p"), F.col("t")) > 0).select("t", "p").distinct()
    # of the parts of a fact that hold the token the first counts
    first = tokens.join(inside, "t").join(parts, "p").groupBy("query_id", "fact_id", "t").agg(F.min("k").alias("k"), (F.count(F.lit(1)) / F.count_distinct("k")).alias("times"))
    first = first.select("query_id", "fact_id", *[F.when(F.col("k") == k, F.col("times")).otherwise(0).cast("int").alias(c) for k, c in ((0, "d"), (1, "pr"), (2, "v"))])
    hits = whole.unionByName(first).groupBy("query_id", "fact_id").agg(F.sum("d").alias("d"), F.sum("pr").alias("pr"), F.sum("v").alias("v"))
    linked = facts.filter((F.col("predicate") == PARENT) & F.col("status").isin("active", "published")).select(T.compact("object").alias("t"), F.col("subject"))
    two = tokens.join(linked, "t").select("query_id", "subject").distinct().join(live.select("fact_id", "subject"), "subject").select("query_id", "fact_id", F.lit(1).alias("r"))
    rows = hits.join(two, ["query_id", "fact_id"], "left").na.fill(0, ["r"]).withColumn("r", F.when(F.col("d") > 0, 0).otherwise(F.col("r"))).join(live.select("fact_id", "confidence"), "fact_id")
    rows = rows.filter((F.col("d") > 0) | (F.lit(s.max_hops >= 2) & (F.col("r") > 0) & (F.col("pr") > 0)))
    base = F.least(F.lit(1.0), 0.12 * (F.col("d") + F.col("pr") + F.col("v") + F.col("r")) + 0.45 * F.col("confidence"))
    hops = F.when(F.col("d") > 0, 1).otherwise(2)
    rows = rows.select("query_id", "fact_id", F.round(F.when(hops == 2, base * 0.72).otherwise(base), 6).alias("score"), hops.alias("hops"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), F.desc("fact_id")))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= limit)


def apply_feedback(facts: DataFrame, ledger: DataFrame, feedback: DataFrame, step: float = DEFAULTS.feedback_step) -> tuple[DataFrame, DataFrame, DataFrame]:
    """New facts, new ledger, history rows. feedback: fact_id, feedback_key, signal ('publish' or 'report').

    A (fact, key) counts once ever; publish adds a step (at most 1) and publishes, report takes one (at least 0) and asks for review; of
    several new signals of a fact they add up and the last key decides the status. History only where something changed.
    """
    first = feedback.dropDuplicates(["fact_id", "feedback_key"]).join(ledger, ["fact_id", "feedback_key"], "left_anti")
    per = first.groupBy("fact_id").agg(F.sum(F.when(F.col("signal") == "publish", step).otherwise(-step)).alias("delta"), F.max_by("signal", "feedback_key").alias("last"))
    rows = facts.join(per, "fact_id", "left")
    confidence = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("confidence") + F.coalesce("delta", F.lit(0.0)))), 6)
    status = F.when(F.col("last") == "publish", "published").when(F.col("last") == "report", "needs_review").otherwise(F.col("status"))
    rows = rows.withColumn("new_confidence", confidence).withColumn("new_status", status)
    history = rows.filter(F.col("last").isNotNull() & ((F.col("new_status") != F.col("status")) | (F.col("new_confidence") != F.col("confidence")))).select("fact_id", "status", "new_status", "confidence", "new_confidence")
    out = rows.select(*[F.col("new_confidence").alias(c) if c == "confidence" else F.col("new_status").alias(c) if c == "status" else F.col(c) for c in facts.columns])
    return out, ledger.unionByName(first.select("fact_id", "feedback_key")), history
