"""Queries of messages: classes, conversation mode, summaries, follow-ups, and facts in model output."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators import dialog as D
from docloom.operators import gates as G
from docloom.plans import retrieval as P
from docloom.plans.gates import ANSWERABLE
from docloom.plans.registry import query
from docloom.sources import carriers as C

TAILS = (" 고마워", " 그건 왜?", " 오늘 날씨", "", " 문서 전체 요약", " 말고 정정", " ok", " 그럼 12페이지")
#: Every second message is asked in short (its last word), the others whole; each with one of the endings.
SAID = f"""said AS (SELECT session_id, seq, role, CASE WHEN seq % 2 = 0 THEN text ELSE regexp_extract(text, '[^ ]*$') END
    || ([{', '.join(f"'{t}'" for t in TAILS)}])[(session_id + seq) % {len(TAILS)} + 1] AS text FROM messages),
comp AS (SELECT *, lower(regexp_replace(text, '\\s+', '', 'g')) AS v FROM said)"""


def _in(words, v="v"):
    return P._any(words, v)


SMALL = f"(v <> '' AND length(v) <= 24 AND NOT {_in(D.SERIOUS)} AND {_in(D.SMALL_TALK)})"
CLASSES = f"""cls AS (SELECT *, {SMALL} AS small_talk, (v <> '' AND NOT {SMALL} AND length(v) <= 80 AND ({_in(D.CORRECTION)} OR length(v) <= 40 AND {_in(D.CONTINUATION)})) AS followup,
  (v <> '' AND (length(v) <= 48 OR contains(v, '위에서') OR contains(v, '일부만')) AND {_in(D.CONTEXTUAL)}) AS contextual,
  (v <> '' AND (regexp_matches(v, '[0-9]+(페이지|쪽|행|라인|시트)') OR {_in(D.DOCUMENT_MARKS)} OR {_in(D.DOCUMENT)})) AS document,
  (v <> '' AND ({SMALL} OR regexp_matches(v, '{'|'.join(D.CASUAL_PATTERNS)}') OR {_in(D.CASUAL)})) AS casual, (v <> '' AND {_in(D.LIVE)}) AS live0,
  (v <> '' AND {_in(D.SUMMARY)} AND NOT {_in(D.SUMMARY_DETAIL)} AND ({_in(D.SUMMARY_SCOPE)} OR length(v) <= 24)) AS broad FROM comp)"""
ALL = (C.MESSAGES, SAID, CLASSES)


def _said(spark, sf):
    tail = F.element_at(F.array(*map(F.lit, TAILS)), ((F.col("session_id") + F.col("seq")) % len(TAILS) + 1).cast("int"))
    short = F.when(F.col("seq") % 2 == 0, F.col("text")).otherwise(F.regexp_extract("text", "[^ ]*$", 0))
    return C.messages(spark, sf).select("session_id", "seq", "role", F.concat(short, tail).alias("text"))


@query("text_classes", "SELECT session_id, seq, small_talk, followup, contextual, document, casual, live0 AND NOT document AS live FROM cls", ALL)
def text_classes(spark, sf):
    rules = {"small_talk": D.small_talk, "followup": D.followup, "contextual": D.contextual, "document": D.document, "casual": D.casual, "live": D.live}
    return _said(spark, sf).select("session_id", "seq", *[f("text").alias(k) for k, f in rules.items()])


@query("broad_summary", "SELECT session_id, seq, broad FROM cls", ALL)
def broad_summary(spark, sf):
    return _said(spark, sf).select("session_id", "seq", D.broad_summary("text").alias("broad"))


@query("conversation_mode", """SELECT session_id, seq, CASE WHEN document THEN 'document_qa' WHEN live0 OR casual THEN 'casual_chat' WHEN contextual THEN coalesce(last, 'casual_chat') WHEN followup AND last = 'document_qa' THEN last WHEN role <> 'system' THEN 'document_qa' ELSE 'casual_chat' END AS mode,
  CASE WHEN document THEN 'explicit_document_intent' WHEN live0 THEN 'live_info_request' WHEN casual THEN 'explicit_casual_intent' WHEN contextual AND last IS NOT NULL THEN 'inherited_from_last_assistant_mode' WHEN contextual THEN 'standalone_without_history_anchor'
    WHEN followup AND last = 'document_qa' THEN 'inherited_from_last_assistant_mode' WHEN role <> 'system' THEN 'default_document_when_kb_present' ELSE 'default_casual_without_kb' END AS reason
  FROM (SELECT *, lag(CASE role WHEN 'assistant' THEN 'casual_chat' ELSE 'document_qa' END) OVER (PARTITION BY session_id ORDER BY seq) AS last FROM cls)""", ALL)  # fmt: skip
def conversation_mode(spark, sf):
    """Each message after the mode of the one before it; system messages have no documents behind them."""
    last = F.lag(F.when(F.col("role") == "assistant", "casual_chat").otherwise("document_qa")).over(W.partitionBy("session_id").orderBy("seq"))
    rows = _said(spark, sf).withColumn("last", last)
    kind = F.when(D.followup("text"), "continuation").otherwise("standalone")
    return rows.select("session_id", "seq", D.mode("text", F.col("role") != "system", F.col("last"), kind).alias("m")).select("session_id", "seq", "m.mode", "m.reason")


@query("forced_followup", f"SELECT session_id, seq, coalesce(last = 'user', false) AND (contextual OR length(v) <= 12 AND contains(text, '?') AND {_in(D.SHORT_QUESTION)}) AS forced FROM (SELECT *, lag(role) OVER (PARTITION BY session_id ORDER BY seq) AS last FROM cls)", ALL)
def forced_followup(spark, sf):
    last = F.when(F.lag("role").over(W.partitionBy("session_id").orderBy("seq")) == "user", "document_qa")
    return _said(spark, sf).withColumn("last", last).select("session_id", "seq", D.forced_followup("text", F.col("last")).alias("forced"))


@query("effective_query", r"""SELECT session_id, seq, CASE WHEN NOT small_talk AND followup AND before <> '' AND own <> '' THEN before || ' ' || own ELSE own END AS query FROM (
  SELECT session_id, seq, small_talk, followup, trim(regexp_replace(text, '\s+', ' ', 'g')) AS own, coalesce(lag(trim(regexp_replace(text, '\s+', ' ', 'g'))) OVER (PARTITION BY session_id ORDER BY seq), '') AS before FROM cls)""", ALL)  # fmt: skip
def effective_query(spark, sf):
    """A follow-up is asked together with the message before it."""
    before = F.coalesce(F.lag(T.collapse("text")).over(W.partitionBy("session_id").orderBy("seq")), F.lit(""))
    rows = _said(spark, sf).withColumn("before", before)
    new = F.when(F.col("before") != "", F.concat_ws(" ", "before", T.collapse("text"))).otherwise("")
    kind = F.when(D.followup("text"), "continuation").otherwise("standalone")
    return rows.select("session_id", "seq", D.effective_query("text", kind, new, F.lit(True), D.small_talk("text")).alias("query"))


@query("scope_nudge", """SELECT query_id, sources::BIGINT AS sources, pdfs::BIGINT AS pdfs, CASE WHEN pdfs >= 4 THEN 'many_pdf_sources' WHEN query_id % 2 = 0 AND pdfs >= 3 THEN 'overview_many_pdf_sources' WHEN sources >= 5 THEN 'many_unique_sources'
    WHEN files >= 4 AND sources >= 3 THEN 'broad_kb_scope' ELSE 'broad_summary_scope' END AS reason,
  pdfs >= 4 OR sources >= 5 OR query_id % 2 = 0 AND (pdfs >= 3 OR sources >= 4) OR files >= 4 AND sources >= 3 AND coverage < 0.45 OR pdfs >= 3 AND (top1 < 0.45 OR coverage < 0.55) AS narrower
  FROM (SELECT query_id, count(DISTINCT source_path) AS sources, count(DISTINCT CASE WHEN source_type = 'pdf' THEN source_path END) AS pdfs FROM res WHERE rank <= 5 GROUP BY query_id) JOIN answ USING (query_id), (SELECT count(DISTINCT source_path) AS files FROM chunks)""",
  (*P.RANKED24, ANSWERABLE))
def scope_nudge(spark, sf):
    r = P.results(spark, sf)
    n = r.filter("rank <= 5").groupBy("query_id").agg(F.count_distinct("source_path").alias("sources"), F.count_distinct(F.when(F.col("source_type") == "pdf", F.col("source_path"))).alias("pdfs"))
    files = C.chunks(spark, sf).agg(F.count_distinct("source_path").alias("files"))  # one row
    rows = n.join(G.answerability(r).select("query_id", "top1", "coverage"), "query_id").join(F.broadcast(files))
    args = (F.col("sources"), F.col("pdfs"), F.col("files"), F.col("query_id") % 2 == 0)
    return rows.select("query_id", "sources", "pdfs", D.scope_reason(*args).alias("reason"), D.narrower(*args, F.col("top1"), F.col("coverage")).alias("narrower"))


RAW = """raw AS (SELECT p_partkey AS row_no, p_brand AS brand, p_name AS name, p_size AS size, p_partkey % 5 AS way FROM part)"""


def _raw(spark, sf):
    """A model's answer about each part: plain, fenced, between words, cut off, or about nothing."""
    p = C.read(spark, sf, "part")
    fact = lambda c: F.struct(F.col("p_name").alias("subject"), F.lit("brand").alias("predicate"), F.col("p_brand").alias("object"), c.alias("confidence"), F.lit("q").alias("evidence_quote"))
    body = F.to_json(F.array(fact(F.col("p_size") / 50.0), fact(F.lit(0.4))))
    way = F.col("p_partkey") % 5
    text = F.when(way == 0, body).when(way == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(way == 2, F.concat(F.lit("Facts: "), body, F.lit(" as asked.")))
    text = text.when(way == 3, F.regexp_replace(body, "[]]$", "")).otherwise("none found")
    return p.select(F.col("p_partkey").alias("row_no"), F.col("p_brand").alias("brand"), text.alias("raw"))


@query("model_facts", r"""SELECT row_no, trim(regexp_replace(name, '\s+', ' ', 'g')) AS subject, 'brand' AS predicate, brand AS object_value, least(0.95::DOUBLE, size / 50.0::DOUBLE) AS confidence FROM raw WHERE way < 3 AND size / 50.0::DOUBLE >= 0.5""", (RAW,))
def model_facts(spark, sf):
    return _raw(spark, sf).select("row_no", F.explode(D.model_facts("raw")).alias("f")).select("row_no", "f.subject", "f.predicate", "f.object_value", "f.confidence")


@query("llm_fact_payload", "SELECT brand, count(*) AS answers, count_if(way >= 3) AS errors, count_if(way < 3 AND size / 50.0::DOUBLE >= 0.5)::BIGINT AS facts FROM raw GROUP BY brand", (RAW,))
def llm_fact_payload(spark, sf):
    return D.payload_errors(_raw(spark, sf), "raw", ["brand"])
