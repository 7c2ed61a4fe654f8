"""Small deterministic rules: questions, roles, OCR decisions, labels, prefixes, citations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions import text as T

# fixed values: hints of questions, file names and texts
NUMERIC_HINTS = (
    "단가", "금액", "비용", "얼마", "가격", "예산", "수수료", "요금", "천원", "만원", "억원", "%", "퍼센트", "비율", "건수", "몇 건", "몇건", "몇 명", "몇명", "총액", "합계", "수량", "언제", "시기", "주기", "일정", "기일", "월별",
    "기준월", "지급시기", "지급 시기", "지급주기", "지급 주기", "지급기준월", "지급 기준월", "지급대상월", "보고기일", "보고 기일", "조사시기", "조사 시기", "조사주기", "조사 주기", "연간", "반기", "분기", "기준일", "지급기준일",
)
TEXTUAL_HINTS = (*NUMERIC_HINTS, "답례품")
OTHER_HINTS = ("종류", "품목", "무엇", "뭐", "어떤", "절차", "방법", "개념", "차이", "요약", "설명", "목록", "주의사항", "처리방법", "조사방법")
RISK_HINTS = ("법", "법률", "세금", "세무", "의료", "병원", "치료", "약", "복용", "투자", "주식", "대출", "계약", "판결", "판례", "규정", "정책", "안전", "보안", "개인정보", "보험")
GUIDE_HINTS = ("지침", "규정", "원칙", "기준", "정의", "절차", "작성요령", "매뉴얼", "원문 규정")
CASE_HINTS = ("사례", "사례집", "질답", "q&a", "qa", "faq", "예시", "예를 들어", "이럴때", "이럴 때", "이런 경우", "실제 케이스", "케이스", "case")
CASE_NAMES, GUIDE_NAMES = ("사례", "질답", "faq", "q&a", "qa", "case"), ("지침", "규정", "manual", "guide")
INTENTS = (("summary", ("요약", "정리", "핵심", "전체")), ("definition", ("정의", "의미", "뭐야", "무엇")), ("procedure", ("방법", "절차", "어떻게")), ("comparison", ("비교", "차이")))
TABLE_MARKS = ("표행:", "표행요약:", "표헤더:", "표값:", "표의미:")
INDEX_STAGES, EMBED_STAGES = ("store_chunks", "refresh_index", "sync_derived"), ("embed_chunks", "embed_concepts", "sync_derived_concept_embedding")
PAGE_WORDS = ("header", "footer", "image", "text", "paragraph_title", "statistics korea")


def numeric_question(c) -> Column:
    """Does the question ask for a figure or a time?"""
    v = T.compact(c)
    strong, other = T.any_in(v, NUMERIC_HINTS), T.any_in(v, OTHER_HINTS)
    return F.when(other & ~strong, False).otherwise(T.any_in(v, TEXTUAL_HINTS) | strong | T.text(c).rlike(r"(?<!\d)\d{1,4}\s*(?:월|일)(?![가-힣])"))


def general_answer_allowed(c, has_docs: Column) -> Column:
    return ~has_docs & ~numeric_question(c) & ~T.any_in(T.compact(c), RISK_HINTS)


def role_intent(c) -> Column:
    """guide, casebook or mixed, by hint scores and a margin of two."""
    low, v = F.lower(F.trim(T.text(c))), T.compact(c)
    hits = lambda words: sum(((low.contains(w) | v.contains(w.replace(" ", ""))).cast("int") for w in words), F.lit(0))
    case = hits(CASE_HINTS) + low.rlike("했는데|인데|라면|이면|할 때|경우").cast("int")
    guide = hits(GUIDE_HINTS) + low.rlike("정의|원칙|기준|규정").cast("int")
    return F.when((case >= 2) & (guide == 0), "casebook").when((guide >= 2) & (case == 0), "guide").when(case >= guide + 2, "casebook").when(guide >= case + 2, "guide").otherwise("mixed")


def role_plan(intent: Column) -> Column:
    """Attempts in order: the role first, then all."""
    return F.when(intent.isin("guide", "casebook"), F.array(intent, F.lit("all"))).otherwise(F.array(F.lit("all")))


def question_intent(c) -> Column:
    v = T.collapse(c)
    out = F.when(v != "", "fact").otherwise("mixed")
    for name, words in reversed(INTENTS):
        out = F.when(T.any_in(v, words), name).otherwise(out)
    return out


def upload_role(name: Column, ext: Column) -> Column:
    """Role from the file name, then from its kind; archives stay unknown."""
    low = F.lower(F.trim(name))
    return F.when(T.any_in(low, CASE_NAMES), "casebook").when(T.any_in(low, GUIDE_NAMES), "guide").when(ext == ".xlsx", "casebook").when(ext.isin(".txt", ".pdf"), "guide").otherwise("unknown")


def expansion(c, most: int = 12) -> Column:
    """The cleaned question and its tokens, distinct."""
    v = T.collapse(c)
    items = F.array_distinct(F.concat(F.array(v), F.regexp_extract_all(v, F.lit("[0-9A-Za-z가-힣_.%/()·ㆍ-]{2,}"), F.lit(0))))
    return F.when(v == "", "").otherwise(F.array_join(F.slice(items, 1, most), " "))


def retry_mode(mode: Column, reason: Column, remaining: Column, cpu: bool = False) -> Column:
    """Next OCR mode, or null to stop."""
    gpu = reason.isin("gpu_oom", "gpu_timeout")
    fall = F.lit("cpu") if cpu else F.lit(None).cast("string")
    return F.when(remaining <= 0, None).when((mode == "parallel_gpu") & gpu, "single_gpu").when((mode == "parallel_gpu") & reason.isin("gpu_init_fail", "gpu_fail"), fall).when((mode == "single_gpu") & (gpu | reason.isin("gpu_init_fail", "gpu_fail")), fall)


def fast_page_ok(chars: Column, score: Column, orphan: Column, pair: Column) -> Column:
    """Enough text and score, few orphans, enough pairs (or a page of one column)."""
    return (chars >= 80) & (score >= 0.72) & (orphan <= 0.35) & ((pair >= 0.45) | (pair == 0) & (orphan == 0))


def stage_failure(stage: Column, ocr_done: Column) -> Column:
    s = F.lower(F.trim(stage))
    return F.when(~ocr_done, "upload_ingest_fail").when(s.isin(*EMBED_STAGES), "upload_embedding_fail").when(s.isin(*INDEX_STAGES), "upload_index_fail").otherwise("upload_ingest_fail")


def page_of(page: Column, section) -> Column:
    """The page column, else the page that the section names, else 0."""
    named = F.regexp_extract(T.text(section), r"PDF page\s+(\d+)", 1)
    return F.when(F.coalesce(page, F.lit(0)) > 0, page).when(named != "", F.greatest(F.lit(1), named.cast("int"))).otherwise(0)


def progress_pages(message) -> Column:
    """Current and total page of '(n/m)'; the total is at least the current one; null without it."""
    a, b = (F.nullif(F.regexp_extract(T.text(message), r"\((\d+)\s*/\s*(\d+)\)", k), F.lit("")).cast("int") for k in (1, 2))
    return F.when(a.isNotNull(), F.struct(a.alias("current_page"), F.greatest(a, b).alias("total_pages")))


def ocr_rates(pages: Column, seconds: Column, target_pages: int = 200, target_seconds: float = 300.0) -> list[Column]:
    """Pages per minute, and whether the target is met."""
    return [F.round(F.when(seconds > 0, pages / seconds * 60.0).otherwise(0.0), 3).alias("per_minute"), ((pages >= target_pages) & (seconds <= target_seconds)).alias("target_met")]


def location(start: Column, end: Column, section) -> Column:
    s = F.trim(T.text(section))
    return F.when(start > 0, F.concat(F.lit("라인 "), start.cast("string"), F.lit("-"), end.cast("string"))).when(s != "", s).otherwise("위치 정보 없음")


def task_prefix(model: Column, task: Column, text, instruction: str) -> Column:
    """Query and passage prefixes by model family."""
    low, v = F.lower(model), F.trim(T.text(text))
    qwen = low.contains("qwen") & low.contains("embedding")
    return F.when(low.contains("jina") & low.contains("embeddings-v5"), v).when(qwen & (task == "query"), F.concat(F.lit(f"Instruct: {instruction}\nQuery: "), v)).when(~qwen & low.contains("e5"), F.concat(task, F.lit(": "), v)).otherwise(v)


def table_path(path) -> Column:
    """table, row and cell numbers of 'tbl[1]/tr[2]/tc[3]'."""
    at = lambda names: F.coalesce(F.nullif(F.regexp_extract(F.lower(T.text(path)), rf"(?:{names})\[(\d+)\]", 1), F.lit("")).cast("int"), F.lit(0))
    return F.struct(at("tbl|table").alias("table"), at("tr|row").alias("row"), at("tc|cell").alias("cell"))


def thousand_won(c) -> Column:
    """A bare figure over 0 and up to 500."""
    v = F.replace(F.trim(T.text(c)), F.lit(","), F.lit(""))
    return v.rlike(r"^\d[\d,]*(?:\.\d+)?$") & F.try_to_number(v, F.lit("999999999999.999999")).between(0.000001, 500)


def helper_items(c, limit: int = 4) -> Column:
    """Distinct cleaned parts between two vertical bars."""
    parts = F.transform(F.split(T.text(c), r"\|\|"), lambda x: T.collapse(x))
    return F.slice(F.array_distinct(F.filter(parts, lambda x: (x != "") & (x != "-"))), 1, limit)


def renumber(c, start: int) -> Column:
    """Shift the numbers of [DOC n] so that 1 becomes start."""
    parts = F.split(T.text(c), r"\[DOC ")
    shift = lambda x: F.concat((F.regexp_extract(x, r"^(\d+)\]", 1).cast("int") + (start - 1)).cast("string"), F.regexp_replace(x, r"^\d+", ""))
    rest = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda x: F.when(x.rlike(r"^\d+\]"), shift(x)).otherwise(x))
    return F.array_join(F.concat(F.slice(parts, 1, 1), rest), "[DOC ")


def max_doc(c) -> Column:
    return F.coalesce(F.array_max(F.transform(F.regexp_extract_all(T.text(c), F.lit(r"\[DOC\s+(\d+)\]"), F.lit(1)), lambda x: x.cast("int"))), F.lit(0))


def repair_citation(answer, docs: Column, preferred: Column, strong: Column, abstains: Column) -> Column:
    """Two preferred document references under an answer that cites none though strong evidence exists."""
    v = F.trim(T.text(answer))
    refs = F.slice(F.array_distinct(F.concat(F.array_intersect(preferred, docs), F.array_sort(docs))), 1, 2)
    add = (v != "") & (F.size(docs) > 0) & ~abstains & ~v.rlike(r"\[DOC\s+\d+\]") & (strong > 0)
    return F.when(add, F.concat(v, F.lit("\n\n근거: "), F.array_join(F.transform(refs, lambda n: F.concat(F.lit("[DOC "), n.cast("string"), F.lit("]"))), ", "))).otherwise(v)


def truncate_to_tokens(c, limit: int) -> Column:
    """Cut in proportion when the server's estimate is over the limit."""
    n, v = T.server_tokens(c), T.text(c)
    return F.when(n <= limit, v).otherwise(F.substring(v, F.lit(1), F.greatest(F.lit(1), F.floor(F.length(v) * limit / n)).cast("int")))


def weak_hint(text) -> Column:
    """Is the text only a placeholder for a page that OCR would have to read?"""
    v = F.trim(T.text(text))
    solid = ~T.any_in(v, TABLE_MARKS)
    lines = F.filter(F.transform(F.split(v, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return v.contains("OCR후보:") & solid & (F.forall(lines, lambda x: x.startswith("OCR후보:")) | (F.length(v) <= 240))


def chrome_line(c) -> Column:
    """Header, footer, address, image or numeral lines of pages."""
    v = T.collapse(c)
    low = F.lower(v)
    return (v == "") | low.isin(*PAGE_WORDS) | low.rlike(r"^https?://") | v.rlike(r"^[·ㆍ∙.\-–—_ ]{3,}$") | low.startswith("imgs/") | low.rlike(r"\.(?:jpg|jpeg|png|gif|webp)\b") | low.startswith("표의미:") | T.compact(c).rlike("^[ⅰ-ⅹ]+$")


def fact_matches(subject, aliases: Column, query) -> Column:
    """The subject or an alias (three characters or more) stands in the question, separators aside."""
    q = T.alias_key(query)
    keys = F.transform(F.concat(F.array(T.text(subject)), aliases), lambda x: T.alias_key(x))
    return F.exists(keys, lambda k: (F.length(k) >= 3) & (F.instr(q, k) > 0))


def accept_fact(quote, chunk, confidence: Column, least: float = 0.62) -> Column:
    """Status of a proposed fact whose quote stands in its chunk, white space aside; null drops it."""
    q, t = T.compact(quote), T.compact(chunk)
    return F.when((confidence >= 0.5) & (q != "") & t.contains(q), F.when(F.least(confidence, F.lit(0.95)) >= least, "active").otherwise("needs_review"))


def cache_key(query, top_k: Column, roles: Column) -> Column:
    """Normalised key of a query's cached result."""
    return F.concat_ws("|", F.lower(T.collapse(query)), top_k.cast("string"), F.array_join(F.array_sort(F.array_distinct(roles)), ","))
