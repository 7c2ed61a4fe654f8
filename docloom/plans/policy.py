"""Queries of the answer policy, over answers that are made of the ranked results."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.operators import answers as A
from docloom.operators import gates as G
from docloom.operators import policy as Y
from docloom.operators import rules as R
from docloom.plans import retrieval as P
from docloom.plans.gates import ANSWERABLE
from docloom.plans.registry import query
from docloom.sources import carriers as C

# one answer for each question and kind: an echo, an echo with a tail, the best text with and without a reference, nothing, claims from outside, an abstention, a short one, an old reference
KINDS = 9
SAID = """said AS (SELECT a.query_id, kind, CASE WHEN a.query_id % 4 = 0 THEN '코드 ' || r.query WHEN a.query_id % 4 = 1 THEN '단가 얼마 ' || r.query ELSE r.query END AS q, top1, coverage, a.keyword_total::INT AS docs, CASE kind WHEN 0 THEN '- ' || r.query || ' [DOC 1]' WHEN 1 THEN r.query || '. ' || substr(r.text, 1, 30) || ' [DOC 2]'
    WHEN 2 THEN r.text WHEN 3 THEN r.text || ' [DOC 1]' WHEN 4 THEN chr(10) || ' ' WHEN 5 THEN r.text || chr(10) || chr(10) || '문서 밖 참고: ' || r.query || chr(10) || chr(10) || chr(10) || '관련 기관에 문의하세요' WHEN 6 THEN '문서상 확인되지 않습니다' WHEN 7 THEN 'short [DOC 3]' ELSE substr(r.text, 1, 60) || ' [[CITATION:4|x]] and [[DOC 5]]' END AS a
  FROM answ a JOIN res r ON r.query_id = a.query_id AND r.rank = 1, range(9) AS k(kind))"""
RAW = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(a, '(?i)\[\[\s*DOC\s+(\d+)(?:\|[^\]\n]*)?\s*\]\]', '[DOC \1]', 'g'), '(?i)\[\[\s*CITATION\s*:\s*(\d+)(?:\|[^\]\n]*)?\s*\]\]', '[DOC \1]', 'g'), '(?i)\[\s*CITATION\s*:\s*(\d+)(?:\|[^\]\n]*)?\s*\]', '[DOC \1]', 'g'), '^\s+|\s+$', '', 'g')"
CLOSE = lambda x: rf"lower(regexp_replace({x}, '\s+', '', 'g'))"
ONE = lambda x: rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"
NUMERIC = P.numeric_sql("q")
WORDS = lambda x: f"list_distinct(list_filter(list_transform(regexp_extract_all({x}, '[0-9A-Za-z가-힣]+'), lambda t: lower(t)), lambda t: length(t) >= 2 AND t NOT IN ({', '.join(repr(w) for w in Y.GROUND_STOP)})))"
ISSUES = rf"""cleaned AS (SELECT *, {RAW} AS raw, {NUMERIC} AS numeric FROM said),
leads AS (SELECT *, {ONE('q')} AS cq, {ONE(r"coalesce(list_filter(list_transform(string_split_regex(raw, '\r\n|\r|\n'), lambda x: regexp_replace(x, '^[ \-*\t]+|[ \-*\t]+$', '', 'g')), lambda x: x <> '')[1], raw)")} AS lead FROM cleaned),
worded AS (SELECT *, {WORDS('cq')} AS qw, {WORDS('lead')} AS aw FROM leads),
echoed AS (SELECT *, CASE WHEN cq = '' OR lead = '' THEN false WHEN starts_with(lead, cq) THEN length(regexp_replace(substr(lead, length(cq) + 1), '^[ .。!?！？:：\-–—]+|[ .。!?！？:：\-–—]+$', '', 'g')) <= 8
    WHEN length(cq) >= 14 AND contains(substr(lead, 1, greatest(60, least(length(lead), length(cq) + 20))), substr(cq, 1, 40)) THEN length(lead) <= length(cq) + 12
    ELSE len(qw) > 0 AND len(aw) > 0 AND len(list_intersect(qw, aw)) / greatest(1, least(len(qw), len(aw))) >= 0.8 AND len(list_filter(aw, lambda t: NOT list_contains(qw, t))) <= 2 END AS echo FROM worded),
issues AS (SELECT *, CASE WHEN raw = '' THEN 'empty' WHEN {P._any(Y.OUTSIDE, CLOSE('raw'))} THEN 'outside_document_claim' WHEN {P._any(Y.ABSTENTIONS, CLOSE('raw'))} THEN CASE WHEN NOT numeric AND top1 >= 0.38 AND coverage >= 0.24 THEN 'abstained_with_evidence' ELSE '' END
    WHEN NOT contains(raw, '[DOC') THEN 'missing_doc_citation' WHEN echo THEN 'question_echo' WHEN length(raw) < 40 THEN 'too_short' WHEN {P._any(Y.CODE_QUESTIONS, CLOSE('q'))} AND NOT regexp_matches(raw, '\(\d{{2,4}}\)|\b\d{{2,4}}\b') THEN 'missing_code' ELSE '' END AS issue FROM echoed)"""


def _said(spark, sf):
    m = G.answerability(P.results(spark, sf)).select("query_id", "top1", "coverage", F.col("keyword_total").alias("docs"))
    r = P.results(spark, sf).filter("rank = 1").select("query_id", "query", "text").join(m, "query_id").withColumn("kind", F.explode(F.sequence(F.lit(0), F.lit(KINDS - 1))))
    k, q, t = F.col("kind"), F.col("query"), F.col("text")
    a = (
        F.when(k == 0, F.concat(F.lit("- "), q, F.lit(" [DOC 1]"))).when(k == 1, F.concat(q, F.lit(". "), F.substring(t, 1, 30), F.lit(" [DOC 2]"))).when(k == 2, t).when(k == 3, F.concat(t, F.lit(" [DOC 1]"))).when(k == 4, "\n ")
        .when(k == 5, F.concat(t, F.lit("\n\n문서 밖 참고: "), q, F.lit("\n\n\n관련 기관에 문의하세요"))).when(k == 6, "문서상 확인되지 않습니다").when(k == 7, "short [DOC 3]").otherwise(F.concat(F.substring(t, 1, 60), F.lit(" [[CITATION:4|x]] and [[DOC 5]]")))
    )
    asked = F.when(F.col("query_id") % 4 == 0, F.concat(F.lit("코드 "), q)).when(F.col("query_id") % 4 == 1, F.concat(F.lit("단가 얼마 "), q)).otherwise(q)
    return r.select("query_id", "kind", asked.alias("q"), "top1", "coverage", "docs", a.alias("a"))


@query("answer_quality_issue", "SELECT query_id, kind::INT AS kind, issue FROM issues", (*P.RANKED24, ANSWERABLE, SAID, ISSUES))
def answer_quality_issue(spark, sf):
    """What is wrong with each answer."""
    s = _said(spark, sf)
    return s.select("query_id", "kind", Y.quality_issue("q", "a", R.numeric_question("q"), F.col("top1"), F.col("coverage")).alias("issue"))


@query("answer_question_echo", "SELECT query_id, kind::INT AS kind, echo FROM echoed", (*P.RANKED24, ANSWERABLE, SAID, ISSUES))
def answer_question_echo(spark, sf):
    from docloom.functions import text as T

    s = _said(spark, sf).withColumn("raw", T.strip(A.canonical_citations("a")))
    lead = T.let(Y.first_line(F.col("raw")), lambda x: F.when(x != "", x).otherwise(F.col("raw")))
    return s.select("query_id", "kind", Y.echoes("q", lead).alias("echo"))


@query("answer_outside_claims", rf"""SELECT query_id, kind::INT AS kind, md5(CASE WHEN {P._any(Y.OUTSIDE, CLOSE('raw'))} AND len(kept) > 0 THEN array_to_string(kept, chr(10) || chr(10)) ELSE raw END) AS text_md5 FROM (
  SELECT *, list_filter(list_transform(string_split_regex(raw, '\n{{2,}}'), lambda b: regexp_replace(b, '^\s+|\s+$', '', 'g')), lambda b: b <> '' AND NOT {P._any(Y.OUTSIDE, CLOSE('b'))}) AS kept FROM cleaned)""", (*P.RANKED24, ANSWERABLE, SAID, ISSUES))  # fmt: skip
def answer_outside_claims(spark, sf):
    """Answers without their blocks that claim something from outside the documents."""
    return _said(spark, sf).select("query_id", "kind", F.md5(Y.without_outside_claims("a")).alias("text_md5"))


@query("answer_recheck", """SELECT query_id, kind::INT AS kind, CASE WHEN kind = 7 OR query_id % 5 = 0 OR kind = 8 AND query_id % 2 = 0 OR kind = 3 THEN false WHEN abst AND NOT numeric AND NOT ok THEN false WHEN numeric THEN NOT (ok AND aligned) ELSE NOT ok OR NOT aligned END AS tool,
  numeric AND query_id % 5 > 0 AND docs > 0 AND kind <> 3 AND (kind <> 7 OR ok) AS prefetch, CASE WHEN numeric AND kind % 2 = 0 THEN true WHEN query_id % 3 = 0 OR kind % 2 = 1 THEN false ELSE NOT ok END AS outline
  FROM (SELECT *, docs > 0 AND (top1 >= 0.33 OR coverage >= 0.22) AS ok, query_id % 7 > 2 AS aligned, kind = 6 AS abst FROM cleaned)""", (*P.RANKED24, ANSWERABLE, SAID, ISSUES))  # fmt: skip
def answer_recheck(spark, sf):
    """Before an answer counts: is the tool called again, are figures looked up first, is the outline read? Requirements and events by question and kind."""
    s, q, k = _said(spark, sf), F.col("query_id"), F.col("kind")
    numeric, required, allowed, events = R.numeric_question("q"), k != 7, q % 5 > 0, F.when(k == 3, 2).otherwise(0)
    of = (F.col("docs"), F.col("top1"), F.col("coverage"))
    return s.select(
        "query_id", "kind", Y.recheck(required, allowed, *of, events, numeric, (k == 8) & (q % 2 == 0), Y.abstains("a"), q % 7 > 2).alias("tool"), Y.prefetch(required, allowed, *of, events, numeric).alias("prefetch"),
        Y.outline_recheck(q % 3 > 0, k % 2 == 1, *of, numeric).alias("outline"),
    )


@query("temporal_signatures", r"""SELECT session_id, seq, list_sort(list_distinct(list_concat(list_transform(regexp_extract_all(s, '(?:^|[^0-9.])([0-9]{1,4}\s*(?:년|월|일|분기))', 1), lambda x: 'time:' || regexp_replace(x, '\s', '', 'g')),
  list_transform(regexp_extract_all(s, '(상반기|하반기|반기|분기|연간|월간|주간|매월|매년|초순|중순|하순)'), lambda x: 'timekw:' || x)))) AS signatures FROM (SELECT session_id, seq, coalesce(text, '') || (['', ' 2024년 3월 ' || seq || '일', ' 상반기와 3 분기 매월', ' 12345월 1.5일 연간'])[(session_id + seq) % 4 + 1] AS s FROM messages)""", (C.MESSAGES,))  # fmt: skip
def temporal_signatures(spark, sf):
    """Dates and periods that messages name."""
    n = (F.col("session_id") + F.col("seq")) % 4
    tail = F.when(n == 1, F.concat(F.lit(" 2024년 3월 "), F.col("seq").cast("string"), F.lit("일"))).when(n == 2, " 상반기와 3 분기 매월").when(n == 3, " 12345월 1.5일 연간").otherwise("")
    return C.messages(spark, sf).select("session_id", "seq", A.temporal_signatures(F.concat(F.coalesce("text", F.lit("")), tail)).alias("signatures"))
