"""Second-stage ranking and gates over ranked results (query_id, id, rank, …), for all queries at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators.rules import weak_hint
from docloom.settings import DEFAULTS, Settings

# fixed values: hint lists of questions and texts
CRITICAL_STOP = (
    "가구", "경우", "관련", "기준", "내용", "내용을", "농가", "대한", "대상", "되어", "되나요", "문서", "문의", "방법", "방법은", "설명", "소유", "요약", "자가", "자가소유", "정리", "정리해줘",
    "중요", "중요한", "조사", "조사해야해", "조사해야", "조사방법", "질문", "처리", "처리방법", "처리방법은", "해야", "해야해", "해줘", "해주세요", "했는데", "어떻게", "알려줘",
)
PARTICLES = ("으로는", "에서는", "에게는", "부터는", "까지는", "이라는", "은", "는", "이", "가", "을", "를", "에", "의", "도", "만")
NEGATIVE, POSITIVE = ("아니다", "않", "불가", "금지", "없음", "없다"), ("가능", "허용", "된다", "할 수", "있다")
OVERVIEW = ("요약", "정리", "전체", "흐름", "개요", "비교", "차이", "outline", "summary")
CONDITIONS = ("그리고", "또는", "예외", "조건", "서류", "기준", "절차", "처리", ",")
COMPARE = ("비교", "차이", "정리", "요약")
ROLE_ALIASES = {"guide": "guide", "casebook": "casebook", "manual": "guide", "case": "casebook"}


def by_rank() -> W:
    return W.partitionBy("query_id").orderBy("rank")


def rerank(rows: DataFrame, *order: Column) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(*order)))


def strip_particle(term: Column) -> Column:
    """Without one trailing particle (the first of the list that fits and leaves more than one character)."""
    out = term
    for p in reversed(PARTICLES):
        out = F.when((F.length(term) > len(p) + 1) & term.endswith(p), F.substring(term, 1, F.length(term) - len(p))).otherwise(out)
    return out


def critical_terms(query, limit: int = 6) -> Column:
    """First distinct gate tokens without particle that aren't stop words or numbers."""
    terms = F.transform(T.tokens(query, T.GATE_TOKEN), lambda t: strip_particle(t))
    keep = F.filter(terms, lambda t: ~t.isin(*CRITICAL_STOP) & ~t.rlike(r"^\d+$") & (F.length(t) >= 2))
    return F.slice(F.array_distinct(keep), 1, limit)


def critical_gate(results: DataFrame) -> DataFrame:
    """Results that hold a critical term (queries without terms pass whole); normalized rows need a raw hit in the query.

    results: query_id, query, id, rank, section, source_path, text, is_normalized. Adds terms and hits.
    """
    body = T.compact(F.concat_ws("\n", "section", "source_path", "text"))
    rows = results.withColumn("terms", critical_terms("query")).withColumn("__body", body)
    rows = rows.withColumn("hits", F.filter("terms", lambda t: F.instr(F.col("__body"), t) > 0)).drop("__body")
    raw = F.max(F.when((F.size("hits") > 0) & (F.col("is_normalized") == 0), 1).otherwise(0)).over(W.partitionBy("query_id"))
    ok = (F.size("terms") == 0) | (F.size("hits") > 0) & ((F.col("is_normalized") == 0) | (raw == 1))
    return rows.withColumn("__ok", ok).filter("__ok").drop("__ok")


def related_terms(results: DataFrame, limit: int = 5) -> DataFrame:
    """query_id, terms: the commonest gate tokens of the first eight rows, for queries whose gate lets nothing pass."""
    toks = F.filter(T.tokens(F.concat_ws("\n", "section", "source_path", "text"), T.GATE_TOKEN), lambda t: ~t.isin(*CRITICAL_STOP) & ~t.rlike(r"^\d+$"))
    words = results.filter("rank <= 8").withColumn("terms", critical_terms("query")).select("query_id", "terms", F.explode(toks).alias("t"))
    counts = words.filter(~F.array_contains("terms", F.col("t"))).groupBy("query_id", "t").count()
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("count"), F.length("t").desc(), F.desc("t")))
    return counts.withColumn("n", rank).filter(F.col("n") <= limit).groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "t"))), lambda x: x["t"]).alias("terms"))


def anchor_score(query, text) -> Column:
    """Boosts of survey questions for texts with the same anchors."""
    q, t = T.compact(query), T.compact(text)
    has, inside = (lambda *w: T.any_in(q, w)), (lambda *w: T.any_in(t, w))
    return (
        F.when(has("조사제외") & inside("조사제외", "제외가구", "조사대상이아닌"), 0.55).otherwise(0.0)
        + F.when(has("조사제외") & inside("조사대상") & inside("제외가구", "제외기준"), 0.25).otherwise(0.0)
        + F.when(has("조사대상") & inside("조사대상"), 0.35).otherwise(0.0) + F.when(has("조사대상") & inside("조사대상가구"), 0.25).otherwise(0.0)
        + F.when(has("처리", "어떻게조사") & inside("조사"), 0.20).otherwise(0.0) + F.when(has("기준") & inside("기준"), 0.15).otherwise(0.0)
    )


def fact_quality(text) -> Column:
    t = T.compact(text)
    noisy = T.any_in(t, ("subject=ⅰ", "subject=ⅱ", "subject=ⅲ", "subject=ⅳ", "subject=ⅴ", "subject=header", "subject=image"))
    return F.when(t.contains("표의미:kind=table_row"), 0.18).when(~t.contains("표의미:kind=definition_block"), 0.0).when(noisy, -0.35).otherwise(0.08)


def grounded_score(query, text, score: Column, weak: Column, normalized: Column) -> Column:
    """Second-stage score: a little of the first score, token overlap, anchors, fact quality and penalties."""
    q, t = F.array_distinct(T.tokens(query, T.GATE_TOKEN)), T.tokens(text, T.GATE_TOKEN)
    overlap = F.when(F.size(q) > 0, F.least(F.lit(0.35), F.size(F.array_intersect(q, t)) / F.size(q) * 0.35)).otherwise(0.0)
    return score * 0.05 + overlap + anchor_score(query, text) + fact_quality(text) - F.when(weak, 0.20).otherwise(0.0) - normalized * 0.04


def rerank_grounded(results: DataFrame) -> DataFrame:
    """Order by grounded score, then score, then the old rank."""
    rows = results.withColumn("grounded", F.round(grounded_score("query", "text", F.col("score"), weak_hint("text"), F.col("is_normalized")), 6))
    return rerank(rows.withColumn("__old", F.col("rank")), F.desc("grounded"), F.desc("score"), F.col("__old")).drop("__old")


def parent_limit(results: DataFrame, limit: int = 1, top_k: int = DEFAULTS.top_k) -> DataFrame:
    """At most ``limit`` rows of a non-empty parent, in rank order, until top_k."""
    n = F.row_number().over(W.partitionBy("query_id", "parent_key").orderBy("rank"))
    kept = results.withColumn("__n", n).filter((F.coalesce("parent_key", F.lit("")) == "") | (F.col("__n") <= limit)).drop("__n")
    return rerank(kept.withColumn("__old", F.col("rank")), F.col("__old")).drop("__old").filter(F.col("rank") <= top_k)


def prefer_raw(results: DataFrame, keep: int = DEFAULTS.keep, most: int = DEFAULTS.max_normalized) -> DataFrame:
    """Raw rows first, then up to ``most`` normalized ones, then the rest, until keep."""
    n = F.row_number().over(W.partitionBy("query_id", "is_normalized").orderBy("rank"))
    bucket = F.when(F.col("is_normalized") == 0, 0).when(n <= most, 1).otherwise(2)
    rows = results.withColumn("__b", bucket).withColumn("__old", F.col("rank"))
    return rerank(rows, F.col("__b"), F.col("__old")).drop("__b", "__old").filter(F.col("rank") <= keep)


def diversify(results: DataFrame, keep: int = DEFAULTS.keep, per_section: int = DEFAULTS.per_section, per_file: int = DEFAULTS.per_file) -> DataFrame:
    """At most per_section rows of a (source, section) and per_file of a source, refilled from the skipped rows in order.

    A row that its section stops uses up nothing of its file, and sections lie inside files: rank in the section first, then in the file among the survivors.
    """
    section = F.row_number().over(W.partitionBy("query_id", "source_path", F.lower(F.trim(T.text("section")))).orderBy("rank"))
    rows = results.withColumn("__s", section <= per_section)
    file = F.row_number().over(W.partitionBy("query_id", "source_path", "__s").orderBy("rank"))
    rows = rows.withColumn("__b", F.when(F.col("__s") & (file <= per_file), 0).otherwise(1)).withColumn("__old", F.col("rank"))
    return rerank(rows, F.col("__b"), F.col("__old")).drop("__s", "__b", "__old").filter(F.col("rank") <= keep)


def number_anchor(text: Column, n: Column) -> Column:
    """Does the text have an anchor of item ``n``: a numbered line, 'n번', '제n조', 'n단계', 'result n', '[n]'?"""
    patterns = (r"(^|\n)\s*#{0,6}\s*", r"(^|\n)\s*")
    out = F.lit(False)
    for p in patterns:
        out = out | F.regexp_like(text, F.concat(F.lit("(?i)" + p), n, F.lit(r"\s*[\.\)]")))
    for a, b in ((r"\b", r"\s*번"), (r"제\s*", r"\s*(장|절|항|조)"), (r"\b", r"\s*단계"), (r"\bresult\s*", r"\b"), (r"\[", r"\]")):
        out = out | F.regexp_like(text, F.concat(F.lit("(?i)" + a), n, F.lit(b)))
    return out


def number_guard(results: DataFrame, keep: int = DEFAULTS.keep, strict: bool = False) -> DataFrame:
    """Rows with an anchor of a number that the question cites come first (strict: only they); adds anchored, any_anchor."""
    refs = F.array_distinct(F.regexp_extract_all(T.text("query"), F.lit(r"(?<!\d)(\d{1,3})\s*번"), F.lit(1)))
    rows = results.withColumn("refs", refs).withColumn("anchored", F.exists("refs", lambda n: number_anchor(F.col("text"), n)))
    rows = rows.withColumn("any_anchor", F.max("anchored").over(W.partitionBy("query_id"))).withColumn("__old", F.col("rank"))
    if strict:
        rows = rows.filter("anchored OR NOT any_anchor")
    return rerank(rows, F.desc("anchored"), F.col("__old")).drop("__old", "refs").filter(F.col("rank") <= keep)


def answerability(results: DataFrame, rows: int = 6) -> DataFrame:
    """Per query: top1, top2, margin, coverage of the keywords by the first rows, sources, newest upload, roles."""
    first = F.col("rank") <= rows
    kw = T.keywords("query")
    agg = results.groupBy("query_id", "query").agg(
        F.max(F.when(F.col("rank") == 1, F.col("semantic"))).alias("top1"), F.coalesce(F.max(F.when(F.col("rank") == 2, F.col("semantic"))), F.lit(0.0)).alias("top2"),
        F.array_distinct(F.flatten(F.collect_list(F.when(first, T.tokens("text"))))).alias("__t"),
        F.count_distinct(F.when(first & (F.trim("source_path") != ""), F.col("source_path"))).alias("unique_sources"),
        F.max(F.when(first, F.col("uploaded_at"))).alias("latest"), F.array_sort(F.collect_set(F.when(first & (F.col("doc_role") != "unknown"), F.col("doc_role")))).alias("roles"),
    )
    agg = agg.withColumn("keyword_hits", F.size(F.array_intersect(kw, "__t"))).withColumn("keyword_total", F.size(kw))
    coverage = F.when(F.col("keyword_total") == 0, 1.0).otherwise(F.col("keyword_hits") / F.col("keyword_total"))
    return agg.withColumn("coverage", coverage).withColumn("margin", F.col("top1") - F.col("top2")).drop("__t", "query")


def explicit_evidence(results: DataFrame) -> DataFrame:
    """query_id, explicit: enough keywords (1 of up to 4, else 2) stand in the first eight texts."""
    kw = T.keywords("query")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("rank") <= 8, F.struct("rank", F.lower(T.text("text")).alias("t"))))), lambda x: x["t"]), "\n")
    rows = results.groupBy("query_id", "query").agg(joined.alias("j")).withColumn("kw", kw)
    hits = F.size(F.filter("kw", lambda k: F.instr(F.col("j"), k) > 0))
    return rows.select("query_id", ((F.size("kw") == 0) | (hits >= F.when(F.size("kw") <= 4, 1).otherwise(2))).alias("explicit"))


def conflicts(results: DataFrame, negative=NEGATIVE, positive=POSITIVE, rows: int = DEFAULTS.conflict_rows) -> DataFrame:
    """query_id, a, b: pairs of the first rows from different sources that share a keyword and take opposite sides (at most rows² pairs a query)."""
    low = F.lower(T.text("text"))
    first = results.filter(F.col("rank") <= rows).withColumn("kt", F.array_intersect(T.keywords("query"), T.tokens("text")))
    first = first.select("query_id", "rank", "id", "source_path", "kt", T.any_in(low, negative).alias("neg"), T.any_in(low, positive).alias("pos"))
    a, b = first.alias("a"), first.alias("b")
    pair = a.join(b, (F.col("a.query_id") == F.col("b.query_id")) & (F.col("a.rank") < F.col("b.rank")) & (F.col("a.source_path") != F.col("b.source_path")))
    opposite = F.col("a.neg") & F.col("b.pos") | F.col("a.pos") & F.col("b.neg")
    return pair.filter(opposite & F.arrays_overlap("a.kt", "b.kt")).select(F.col("a.query_id").alias("query_id"), F.col("a.id").alias("a"), F.col("b.id").alias("b"))


def grounding_gate(metrics: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """Adds passed. metrics: top1, coverage, keyword_hits, keyword_total, explicit, conflict."""
    soft = (F.col("top1") >= s.top1_soft) & (F.col("coverage") >= s.coverage_soft)
    strict = (F.col("top1") >= s.top1_min) & (F.col("coverage") >= s.coverage_min)
    enough = (F.col("keyword_total") == 0) | (F.col("keyword_hits") >= F.least(F.col("keyword_total"), F.lit(1)))
    return metrics.withColumn("passed", F.col("explicit") & F.when(F.col("conflict"), soft).otherwise(strict | soft & enough))


def merge_variants(rows: DataFrame, limit: int) -> DataFrame:
    """Rows of several question variants merged by their evidence: the best (then first) row stays, variants are counted.

    rows: query_id, variant_no, id, score, uploaded_at, fingerprint.
    """
    best = F.max_by(F.struct("id", "score", "uploaded_at"), F.struct(F.col("score"), (-F.col("variant_no")).alias("v"), (-F.col("id")).alias("i")))
    merged = rows.groupBy("query_id", "fingerprint").agg(best.alias("b"), F.count_distinct("variant_no").alias("variant_hits"))
    merged = merged.select("query_id", "b.id", "b.score", "b.uploaded_at", "variant_hits")
    return rerank(merged, F.desc("variant_hits"), F.desc("score"), F.desc("uploaded_at"), F.desc("id")).filter(F.col("rank") <= limit)


def context_budget(results: DataFrame, budget: int = DEFAULTS.context_chars) -> DataFrame:
    """Rows in rank order, one for each location, while the running length stays in the budget; the first overflow ends it."""
    place = F.row_number().over(W.partitionBy("query_id", "source_path", "section").orderBy("rank"))
    rows = results.withColumn("__p", place).filter("__p = 1").drop("__p").withColumn("chars", F.length(F.trim(T.text("text"))))
    total = F.sum("chars").over(by_rank().rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn("running", total).filter(F.col("running") <= budget)


def rerank_decision(query, pool: Column) -> tuple[Column, Column]:
    """Should a model rerank, and why."""
    c = T.compact(query)
    over, cond = T.hits_in(c, OVERVIEW), T.hits_in(c, CONDITIONS)
    long, compare = F.length(c) >= 28, T.any_in(c, COMPARE)
    reason = (
        F.when(pool <= 0, "no_candidates").when(compare & (cond >= 2) | (over >= 1) & (cond >= 2), "complex_multi_condition").when(pool >= 16, "large_candidate_pool")
        .when((over >= 1) & (long | (pool >= 10)), "overview_request").when((cond >= 3) & long, "complex_multi_condition").otherwise("simple_direct_question")
    )
    return ~reason.isin("no_candidates", "simple_direct_question"), reason


def rerank_parse(order: Column, n: Column) -> Column:
    """Candidate numbers of a model's answer ('3,1,5'), distinct and in range, then the missing ones."""
    said = F.array_distinct(F.filter(F.transform(F.regexp_extract_all(order, F.lit("[0-9]+"), F.lit(0)), lambda x: x.cast("int")), lambda x: x.between(1, n)))
    return F.concat(said, F.array_except(F.sequence(F.lit(1), n), said))


def expand_number_refs(query) -> Column:
    """The question with up to seven paraphrases of each of its first three item numbers."""
    refs = F.slice(F.regexp_extract_all(T.text(query), F.lit(r"(?<!\d)(\d{1,3})\s*번"), F.lit(1)), 1, 3)
    more = F.array_distinct(F.flatten(F.transform(refs, lambda n: F.array(F.concat(n, F.lit("번")), F.concat(n, F.lit(".")), F.concat(n, F.lit(" 항목")), F.concat(n, F.lit(" 단계")), F.concat(F.lit("제"), n, F.lit("항")), F.concat(F.lit("section "), n), F.concat(F.lit("result "), n)))))
    return F.when(F.size(refs) > 0, F.concat_ws(" ", T.text(query), F.array_join(more, " "))).otherwise(T.text(query))


def rerank_lines(lines: DataFrame, overhead: Column, budget: Column, keep: int, caps: tuple[int, ...]) -> DataFrame:
    """query_id, cap, n: the widest cap on candidate lines (query_id, rank, line) at which at least ``keep`` (or all) fit the token budget,
    else the cap that fits most. overhead and budget: unrounded tokens of the prompt and its limit, columns of lines."""
    cut = F.when(F.length("line") <= F.col("cap"), F.col("line")).otherwise(F.concat(F.substring(F.col("line"), F.lit(1), F.greatest(F.lit(1), F.col("cap") - 3)), F.lit("...")))
    rows = lines.withColumn("overhead", overhead).withColumn("budget", budget).withColumn("cap", F.explode(F.array(*map(F.lit, caps)))).withColumn("cut", cut)
    w, k, s = T.mixed_parts("cut")
    run = W.partitionBy("query_id", "cap").orderBy("rank").rowsBetween(W.unboundedPreceding, 0)
    est = F.ceil(F.round(F.col("overhead") + F.sum(w).over(run) * F.lit(1.1) + F.sum(k).over(run) * F.lit(0.65) + F.sum(s).over(run) * F.lit(0.3), 6))
    fit = rows.withColumn("est", est).groupBy("query_id", "cap").agg(F.count_if(F.col("est") <= F.col("budget")).alias("n"), F.count(F.lit(1)).alias("all"))
    ok = F.col("n") >= F.least(F.lit(keep), F.col("all"))
    best = F.max_by(F.struct("cap", "n"), F.struct(ok.cast("int").alias("ok"), F.when(ok, F.col("cap")).otherwise(F.col("n")).alias("x"), F.col("cap").alias("y")))
    return fit.groupBy("query_id").agg(best.alias("b")).select("query_id", "b.cap", "b.n")
