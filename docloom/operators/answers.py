"""Answers and their evidence: numeric signatures, alignment, citations; the answer memory and its pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.functions import text as T

# fixed values: units and their factors, patterns of figures
MONEY = {"원": 1, "천원": 1_000, "만원": 10_000, "십만원": 100_000, "백만원": 1_000_000, "억원": 100_000_000}
UNIT = "천원|만원|억원|백만원|십만원|원|퍼센트|%|명|건|개|호|회"
NUMBER = rf"(?<![\d.])(\d[\d,]*(?:\.\d+)?)\s*(?:\(\s*(?:천원|만원|억원|백만원|십만원|원|퍼센트|%)\s*\)|(?:{UNIT}))"
BARE_PRICE = r"(?:단가|금액|비용|가격|수수료|요금)\s*=\s*(\d[\d,]*(?:\.\d+)?)\b(?!\s*(?:원|천원|만원|억원|백만원|십만원))"
ALIGN_MIN = 0.34


def plain(d: Column) -> Column:
    """A decimal without trailing zeros, in plain notation."""
    s = d.cast("string")
    return F.when(s.contains("."), F.regexp_replace(F.regexp_replace(s, "0+$", ""), r"\.$", "")).otherwise(s)


def numeric_signatures(c) -> Column:
    """Sorted distinct money:, percent: and count: signatures; bare figures under a price field count thousands of won. Exact decimals."""
    body = F.regexp_replace(T.text(c), r"\[DOC\s+\d+\]", " ")
    number = lambda x: F.replace(F.regexp_extract(x, r"(\d[\d,]*(?:\.\d+)?)", 1), F.lit(","), F.lit("")).cast("decimal(30,6)")
    unit = lambda x: F.regexp_extract(x, rf"({UNIT})\s*\)?$", 1)

    def sign(x: Column) -> Column:
        v, u = number(x), unit(x)
        factor = F.lit(None).cast("decimal(10,0)")
        for k, f in MONEY.items():
            factor = F.when(u == k, F.lit(f).cast("decimal(10,0)")).otherwise(factor)
        money = (v * factor).cast("decimal(38,6)")
        return F.when(u.isin(*MONEY), F.concat(F.lit("money:"), plain(money))).when(u.isin("%", "퍼센트"), F.concat(F.lit("percent:"), plain(v))).otherwise(F.concat(F.lit("count:"), plain(v), F.lit(":"), u))

    found = F.transform(F.regexp_extract_all(body, F.lit(NUMBER), F.lit(0)), sign)
    bare = F.transform(F.regexp_extract_all(body, F.lit(BARE_PRICE), F.lit(1)), lambda x: F.concat(F.lit("money:"), plain((number(x) * F.lit(1000).cast("decimal(5,0)")).cast("decimal(38,6)"))))
    return F.array_sort(F.array_distinct(F.concat(found, bare)))


def temporal_signatures(c) -> Column:
    body = F.regexp_replace(T.text(c), r"\[DOC\s+\d+\]", " ")
    literal = F.transform(F.regexp_extract_all(body, F.lit(r"(?<![\d.])\d{1,4}\s*(?:년|월|일|분기)"), F.lit(0)), lambda x: F.concat(F.lit("time:"), F.regexp_replace(x, r"\s", "")))
    word = F.transform(F.regexp_extract_all(body, F.lit("(?:상반기|하반기|반기|분기|연간|월간|주간|매월|매년|초순|중순|하순)"), F.lit(0)), lambda x: F.concat(F.lit("timekw:"), x))
    return F.array_sort(F.array_distinct(F.concat(literal, word)))


def grounded(answer: Column, evidence: Column) -> Column:
    """All of the answer's signatures occur among the evidence's."""
    return F.size(F.array_except(answer, evidence)) == 0


def alignment(query: Column, evidence: Column) -> Column:
    """Share of the question's tokens that equal, contain or lie inside a token of the evidence; 1 without tokens."""
    q = F.array_distinct(T.tokens(query, T.GATE_TOKEN))
    e = F.array_distinct(T.tokens(evidence, T.GATE_TOKEN))
    hit = F.filter(q, lambda t: F.exists(e, lambda x: x.contains(t) | t.contains(x)))
    return F.when(F.size(q) == 0, 1.0).otherwise(F.size(hit) / F.size(q))


def citation_label(name: Column, source_type: Column, page: Column, sheet: Column, row: Column, row_end: Column, line: Column, line_end: Column) -> Column:
    """Name with its page, sheet and rows, or lines."""
    span = lambda a, b, word: F.when(b > a, F.concat(a.cast("string"), F.lit("-"), b.cast("string"), F.lit(word))).otherwise(F.concat(a.cast("string"), F.lit(word)))
    return (
        F.when((source_type == "pdf") | (page > 0), F.when(page > 0, F.concat(name, F.lit(" "), page.cast("string"), F.lit("페이지"))).otherwise(name))
        .when(sheet != "", F.when(row > 0, F.concat_ws(" / ", name, sheet, span(row, row_end, "행"))).otherwise(F.concat_ws(" / ", name, sheet)))
        .when(line > 0, F.concat_ws(" / ", name, span(line, line_end, "라인"))).otherwise(name)
    )


# fixed values: older forms of a reference
OLD_REFERENCES = (r"(?i)\[\[\s*DOC\s+0*(\d+)(?:\|[^\]\n]*)?\s*\]\]", r"(?i)\[\[\s*CITATION\s*:\s*0*(\d+)(?:\|[^\]\n]*)?\s*\]\]", r"(?i)\[\s*CITATION\s*:\s*0*(\d+)(?:\|[^\]\n]*)?\s*\]")


def canonical_citations(c) -> Column:
    """[[DOC 3|…]], [[CITATION:3|…]] and [CITATION: 3] become [DOC 3]."""
    out = T.text(c)
    for pattern in OLD_REFERENCES:
        out = F.regexp_replace(out, pattern, "[DOC $1]")
    return out


def cited_numbers(c) -> Column:
    """Document numbers in order of first mention."""
    return F.array_distinct(F.transform(F.regexp_extract_all(canonical_citations(c), F.lit(r"\[DOC (\d+)\]"), F.lit(1)), lambda x: x.cast("int")))


def bottom_citations(c, labels: Column) -> Column:
    """The answer without its inline citations, and a line that renumbers the known ones by first mention. labels: map of number to label."""
    known = F.filter(cited_numbers(c), lambda n: F.map_contains_key(labels, n))
    body = F.trim(F.regexp_replace(F.regexp_replace(canonical_citations(c), r"\[DOC \d+\]", ""), r"[ \t]+([,.;:])", "$1"))
    line = F.concat(F.lit("근거: "), F.array_join(F.transform(known, lambda n, i: F.concat(F.lit("[[CITATION:"), (i + 1).cast("string"), F.lit("|"), F.element_at(labels, n), F.lit("]]"))), ", "))
    return F.when(F.size(known) == 0, body).when(body == "", line).otherwise(F.concat_ws("\n\n", body, line))


def memory_search(questions: DataFrame, saved: DataFrame, postings: DataFrame, limit: int = 3) -> DataFrame:
    """query_id, answer_id, score: share of the question's tokens in the saved text plus up to 0.2 for reuse, newest first among equals.

    saved: answer_id, reused, updated_at (published ones). postings: term, id of every row where the term occurs.
    """
    q = questions.select("query_id", F.explode(F.array_distinct(T.tokens("query", T.GATE_TOKEN))).alias("term"), F.size(F.array_distinct(T.tokens("query", T.GATE_TOKEN))).alias("total"))
    hits = q.join(postings, "term").groupBy("query_id", "id", "total").agg(F.count(F.lit(1)).alias("hits"))
    rows = hits.join(saved, hits["id"] == saved["answer_id"])
    rows = rows.withColumn("score", F.round(F.col("hits") / F.col("total") + F.least(F.lit(0.2), F.col("reused") * 0.02), 6))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), F.desc("updated_at"), F.desc("answer_id")))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= limit).select("query_id", "answer_id", "score", "rank")


def boost_targets(saved: DataFrame, pages: DataFrame) -> DataFrame:
    """kind ('chunk' or 'source'), target, weight: reuse of published answers plus one for each published page."""
    a = saved.filter("status = 'published' AND reused > 0").select("chunk_id", "source_path", F.greatest(F.lit(1), F.col("reused")).alias("w"))
    p = pages.filter("status = 'published'").select("chunk_id", "source_path", F.lit(1).alias("w"))
    both = a.unionByName(p)
    kind = F.explode(F.array(F.struct(F.lit("chunk").alias("kind"), F.when(F.col("chunk_id") > 0, F.col("chunk_id").cast("string")).alias("target")), F.struct(F.lit("source").alias("kind"), F.when(F.col("source_path") != "", F.col("source_path")).alias("target"))))
    return both.select(kind.alias("t"), "w").select("t.kind", "t.target", "w").filter("target IS NOT NULL").groupBy("kind", "target").agg(F.sum("w").alias("weight"))


def page_candidates(concepts: DataFrame, sources: DataFrame, blocked: DataFrame, least: int = 1) -> DataFrame:
    """concept, sources: published concepts of at least ``least`` related answers, none of them blocked, that have an active source."""
    ids = concepts.filter(F.size("answers") >= least).select("concept", F.explode("answers").alias("answer_id"))
    bad = ids.join(blocked, "answer_id", "left_semi").select("concept").distinct()
    ok = ids.join(bad, "concept", "left_anti").join(sources.filter("status = 'active'"), "answer_id")
    return ok.groupBy("concept").agg(F.count(F.lit(1)).alias("sources"))


def clip(c, most: int = 220) -> Column:
    """One line without citation tokens, at most ``most`` characters."""
    return F.substring(T.collapse(F.regexp_replace(T.text(c), r"\[DOC\s+\d+\]|\[\[CITATION:[^\]]*\]\]", " ")), 1, most)


def sentences(c) -> Column:
    """Sentences of a text, split after an end mark and white space."""
    return F.filter(F.split(T.collapse(c), r"(?<=[.!?。])\s+"), lambda x: x != "")


def delete_tree(rows: DataFrame, source: str, column: str = "source_path") -> DataFrame:
    """rows without those of a source or of its split parts."""
    return rows.filter(~((F.col(column) == source) | F.col(column).startswith(source + "::part:")) | F.col(column).isNull())


def status_signals(updates: DataFrame, facts: DataFrame) -> DataFrame:
    """fact_id, feedback_key, signal: what new statuses of saved answers (answer_id, chunk_id, status; blank asks for review) say about the facts (fact_id, chunk_id) of their rows."""
    new = F.when(F.trim(F.coalesce("status", F.lit(""))) == "", "needs_review").otherwise(F.trim("status"))
    said = updates.select("answer_id", "chunk_id", new.alias("new")).filter(F.col("new").isin("published", "reported", "needs_review") & (F.col("chunk_id") >= 0))
    key = F.concat_ws(":", F.lit("saved_answer_status"), F.col("answer_id").cast("string"), "new")
    return said.join(facts, "chunk_id").select("fact_id", key.alias("feedback_key"), F.when(F.col("new") == "published", "publish").otherwise("report").alias("signal"))


def insert_absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old, and one row of new for each key that old lacks."""
    fresh = new.join(old.select(*keys), keys, "left_anti").groupBy(*keys).agg(F.min(F.struct(*[c for c in new.columns if c not in keys])).alias("x"))
    return old.unionByName(fresh.select(*keys, "x.*"))
