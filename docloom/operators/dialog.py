"""What a message asks for: small talk, follow-ups, documents, live information, broad summaries; and model output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import text as T

# fixed values: hints of messages, without white space
SMALL_TALK = ("고마워", "감사", "땡큐", "알겠", "오케이", "ok", "ㅇㅋ", "좋아", "응", "네", "안녕", "반가워")
SERIOUS = ("?", "처리", "방법", "기준", "설치", "요건", "서류")
CORRECTION = ("아니라", "말고", "정정", "수정", "오타", "대신", "였어", "였고", "이아니라", "그게아니라")
CONTINUATION = ("그럼", "그러면", "그건", "그게", "그거", "이건", "이게", "이거", "저건", "저게", "저거", "추가로", "그리고")
DOCUMENT = (
    "문서", "업로드", "파일", "근거", "페이지", "시트", "행", "라인", "요약", "정리", "규정", "기준", "요건", "절차", "단가", "금액", "비율", "건수", "코드", "답례품", "지원대상", "신청", "주의사항", "유의사항",
)
DOCUMENT_MARKS = ("[doc", "pdf", "xlsx", "txt", "kb")
CASUAL = ("오늘어때", "뭐해", "뭐하고있", "잘지내", "심심", "재밌는이야기", "농담", "기분어때", "배고파", "졸려", "피곤")
CASUAL_PATTERNS = ("(오늘|요즘|지금).*(어때|어떠)", "(뭐해|뭐하고있)", "(재밌는|재미있는).*(이야기|얘기)", "(농담|심심)")
LIVE = ("날씨", "기온", "강수", "비와", "비오", "눈와", "눈오", "뉴스", "속보", "주가", "코스피", "코스닥", "환율", "비트코인", "btc", "이더리움", "eth", "실시간")
SHORT_QUESTION = ("얼마", "언제", "왜", "몇", "어떻게", "어느")
CONTEXTUAL = (
    "그건", "그게", "그거", "이건", "이게", "이거", "저건", "저게", "저거", "그럼", "그러면", "그리고", "추가로", "위에서", "앞에서", "방금", "그중", "일부만", "이경우", "그경우", "저경우", "경우는", "적용되는경우", "제외하면", "빼면", "왜",
)
SUMMARY = ("요약", "정리", "핵심", "주의사항", "유의사항", "체크포인트")
SUMMARY_DETAIL = ("단가", "금액", "얼마", "페이지", "쪽", "행", "라인", "기준")
SUMMARY_SCOPE = ("업로드한문서", "업로드문서", "문서를확인", "문서확인", "전체", "전부", "전반", "전반적", "전체적", "공통")
ACTIVE = ("casual_chat", "document_qa")


def small_talk(c) -> Column:
    v = T.compact(c)
    return (v != "") & (F.length(v) <= 24) & ~T.any_in(v, SERIOUS) & T.any_in(v, SMALL_TALK)


def followup(c) -> Column:
    """Is it worth rewriting the message with the history?"""
    v = T.compact(c)
    return (v != "") & ~small_talk(c) & (F.length(v) <= 80) & (T.any_in(v, CORRECTION) | (F.length(v) <= 40) & T.any_in(v, CONTINUATION))


def contextual(c) -> Column:
    """Does the message lean on what came before?"""
    v = T.compact(c)
    return (v != "") & ((F.length(v) <= 48) | v.contains("위에서") | v.contains("일부만")) & T.any_in(v, CONTEXTUAL)


def document(c) -> Column:
    v = T.compact(c)
    return (v != "") & (v.rlike(r"\d+(페이지|쪽|행|라인|시트)") | T.any_in(v, DOCUMENT_MARKS) | T.any_in(v, DOCUMENT))


def casual(c) -> Column:
    v = T.compact(c)
    return (v != "") & (small_talk(c) | v.rlike("|".join(CASUAL_PATTERNS)) | T.any_in(v, CASUAL))


def live(c) -> Column:
    v = T.compact(c)
    return (v != "") & ~document(c) & T.any_in(v, LIVE)


def forced_followup(c, last_mode: Column) -> Column:
    v = T.compact(c)
    short = (F.length(v) <= 12) & T.text(c).contains("?") & T.any_in(v, SHORT_QUESTION)
    return last_mode.eqNullSafe(F.lit("document_qa")) & (contextual(c) | short)


def mode(c, has_docs: Column, last_mode: Column, followup_type: Column) -> Column:
    """Struct of mode and reason, by the first rule that holds."""
    pick = lambda m, r: F.struct((F.lit(m) if isinstance(m, str) else m).alias("mode"), F.lit(r).alias("reason"))
    carried = followup_type.isin("correction", "continuation") & last_mode.eqNullSafe(F.lit("document_qa"))
    return (
        F.when(document(c), pick("document_qa", "explicit_document_intent")).when(live(c), pick("casual_chat", "live_info_request")).when(casual(c), pick("casual_chat", "explicit_casual_intent"))
        .when(contextual(c) & last_mode.isin(*ACTIVE), pick(last_mode, "inherited_from_last_assistant_mode")).when(contextual(c), pick("casual_chat", "standalone_without_history_anchor"))
        .when(carried, pick("document_qa", "inherited_from_last_assistant_mode")).when(has_docs, pick("document_qa", "default_document_when_kb_present")).otherwise(pick("casual_chat", "default_casual_without_kb"))
    )


def broad_summary(c) -> Column:
    v = T.compact(c)
    return (v != "") & T.any_in(v, SUMMARY) & ~T.any_in(v, SUMMARY_DETAIL) & (T.any_in(v, SUMMARY_SCOPE) | (F.length(v) <= 24))


def scope_reason(sources: Column, pdfs: Column, files: Column, overview: Column) -> Column:
    return (
        F.when(pdfs >= 4, "many_pdf_sources").when(overview & (pdfs >= 3), "overview_many_pdf_sources").when(sources >= 5, "many_unique_sources")
        .when((files >= 4) & (sources >= 3), "broad_kb_scope").otherwise("broad_summary_scope")
    )


def narrower(sources: Column, pdfs: Column, files: Column, overview: Column, top1: Column, coverage: Column) -> Column:
    """Should a broad request be asked to narrow its scope?"""
    many = (pdfs >= 4) | (sources >= 5) | overview & ((pdfs >= 3) | (sources >= 4))
    return many | (files >= 4) & (sources >= 3) & (coverage < 0.45) | (pdfs >= 3) & ((top1 < 0.45) | (coverage < 0.55))


def effective_query(message, kind: Column, rewritten, use_history: Column, is_small_talk: Column) -> Column:
    own, new = T.collapse(message), T.collapse(rewritten)
    return F.when((own != "") & ~is_small_talk & kind.isin("correction", "continuation") & use_history & (new != ""), new).otherwise(own)


FACT = "array<struct<subject:string,subject_aliases:string,predicate:string,object:string,object_value:string,confidence:double,evidence_quote:string>>"


def model_facts(raw) -> Column:
    """Facts in a model's answer: JSON behind an optional fence, else the outermost brackets; null where nothing can be read.

    Only facts with subject, predicate, object and a confidence of 0.5 or more count; confidence is at most 0.95.
    """
    v = F.trim(T.text(raw))
    plain = F.when(v.startswith("```"), F.regexp_replace(F.regexp_replace(v, r"(?i)^```(?:json)?\s*", ""), r"\s*```$", "")).otherwise(v)
    # the parser reads a prefix, so text around the list would be taken for a list of one
    whole = F.when(plain.rlike(r"(?s)^\[.*\]$"), F.from_json(plain, FACT, {"mode": "PERMISSIVE"}))
    inner = F.from_json(F.regexp_extract(plain, r"(?s)(\[.*\])", 1), FACT, {"mode": "PERMISSIVE"})
    clean = lambda x: T.collapse(x)
    made = F.transform(F.coalesce(whole, inner), lambda x: F.struct(
        clean(x["subject"]).alias("subject"), clean(x["predicate"]).alias("predicate"), clean(F.coalesce(x["object"], x["object_value"])).alias("object_value"),
        F.least(F.lit(0.95), F.coalesce(x["confidence"], F.lit(0.0))).alias("confidence"), clean(x["evidence_quote"]).alias("evidence_quote"),
    ))
    return F.filter(made, lambda x: (x["subject"] != "") & (x["predicate"] != "") & (x["object_value"] != "") & (x["confidence"] >= 0.5))


def payload_errors(rows: DataFrame, raw: str, keys: list[str]) -> DataFrame:
    """keys, answers, errors, facts: how many answers could not be read, and the facts of the others."""
    facts = rows.withColumn("__facts", model_facts(raw))
    return facts.groupBy(*keys).agg(F.count(F.lit(1)).alias("answers"), F.count_if(F.col("__facts").isNull()).alias("errors"), F.sum(F.coalesce(F.size("__facts"), F.lit(0))).alias("facts"))
