"""Answer policy: what is wrong with an answer, what goes out of it, and when evidence is looked up again."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators.answers import canonical_citations

# fixed values: marks of claims from outside, abstentions, stop words, hints of questions about codes; least evidence and lengths
OUTSIDE = ("문서밖참고", "문서밖정보", "문서밖", "외부지식", "관련기관에문의", "기관에문의")
ABSTENTIONS = ("문서근거부족", "근거부족으로단정할수없", "단정할수없", "문서상확인되지않", "확인되지않", "찾지못했", "근거가부족")
GROUND_STOP = ("전체", "내용", "질문", "문의", "요약", "설명", "알려줘", "해주세요", "해줘", "무엇", "뭐", "어떤")
CODE_QUESTIONS = ("부호", "코드", "분류", "항목", "몇번", "몇 번", "코드값")
TOP1_MIN, COVERAGE_MIN, ABSTAIN_TOP1, ABSTAIN_COVERAGE = 0.33, 0.22, 0.38, 0.24
LEAST_CHARS, TAIL, HEAD, LONG_QUESTION, MORE, WINDOW, NEAR, OVERLAP, NOVEL = 40, 8, 40, 14, 12, 60, 20, 0.8, 2


def outside_claim(c) -> Column:
    return T.any_in(T.compact(c), OUTSIDE)


def abstains(c) -> Column:
    return T.any_in(T.compact(c), ABSTENTIONS)


def without_outside_claims(answer) -> Column:
    """The answer's blocks that claim nothing from outside its documents; the whole answer if none is left."""
    def of(raw: Column) -> Column:
        kept = F.filter(F.transform(F.split(raw, "\n{2,}"), T.strip), lambda b: (b != "") & ~outside_claim(b))
        return F.when(outside_claim(raw) & (F.size(kept) > 0), F.array_join(kept, "\n\n")).otherwise(raw)

    return T.let(T.strip(canonical_citations(answer)), of)


def first_line(c: Column) -> Column:
    """The first line with something beside bullets; '' if none."""
    return F.coalesce(F.get(F.filter(F.transform(F.split(T.text(c), "\r\n|\r|\n"), lambda x: F.regexp_replace(x, r"^[ \-*\t]+|[ \-*\t]+$", "")), lambda x: x != ""), F.lit(0)), F.lit(""))


def echoes(query, answer) -> Column:
    """Does the answer only repeat the question?"""
    words = lambda c: F.array_distinct(F.filter(T.tokens(c, T.GATE_TOKEN), lambda t: ~t.isin(*GROUND_STOP)))

    def of(s: Column) -> Column:
        q, a = s["q"], s["a"]
        tail = F.regexp_replace(F.substring(a, F.length(q) + 1, F.lit(1 << 30)), r"^[ .。!?！？:：\-–—]+|[ .。!?！？:：\-–—]+$", "")
        begun = (F.length(q) >= LONG_QUESTION) & F.substring(a, F.lit(1), F.greatest(F.lit(WINDOW), F.least(F.length(a), F.length(q) + NEAR))).contains(F.substring(q, 1, HEAD))
        same = F.size(F.array_intersect(s["qw"], s["aw"])) / F.greatest(F.lit(1), F.least(F.size(s["qw"]), F.size(s["aw"])))
        alike = (F.size(s["qw"]) > 0) & (F.size(s["aw"]) > 0) & (same >= OVERLAP) & (F.size(F.array_except(s["aw"], s["qw"])) <= NOVEL)
        return F.when((q == "") | (a == ""), False).when(a.startswith(q), F.length(tail) <= TAIL).when(begun, F.length(a) <= F.length(q) + MORE).otherwise(alike)

    q, a = T.collapse(query), T.collapse(answer)
    return T.let(F.struct(q.alias("q"), a.alias("a"), words(q).alias("qw"), words(a).alias("aw")), of)


def seeded(docs: Column, top1: Column, coverage: Column) -> Column:
    """Has the first retrieval found evidence?"""
    return (docs > 0) & ((top1 >= TOP1_MIN) | (coverage >= COVERAGE_MIN))


def quality_issue(query, answer, numeric: Column, top1: Column, coverage: Column) -> Column:
    """What is wrong with an answer: empty, outside_document_claim, abstained_with_evidence, missing_doc_citation, question_echo, too_short, missing_code; '' if nothing is."""
    def of(raw: Column) -> Column:
        held = ~numeric & (top1 >= ABSTAIN_TOP1) & (coverage >= ABSTAIN_COVERAGE)
        lead = T.let(first_line(raw), lambda x: F.when(x != "", x).otherwise(raw))
        return (
            F.when(raw == "", "empty").when(outside_claim(raw), "outside_document_claim").when(abstains(raw), F.when(held, "abstained_with_evidence").otherwise("")).when(~raw.contains("[DOC"), "missing_doc_citation")
            .when(echoes(query, lead), "question_echo").when(F.length(raw) < LEAST_CHARS, "too_short").when(T.any_in(T.compact(query), CODE_QUESTIONS) & ~raw.rlike(r"\(\d{2,4}\)|\b\d{2,4}\b"), "missing_code").otherwise("")
        )

    return T.let(T.strip(canonical_citations(answer)), of)


def recheck(required: Column, allowed: Column, docs: Column, top1: Column, coverage: Column, events: Column, numeric: Column, prefetched: Column, abstained: Column, aligned: Column) -> Column:
    """Must the tool be called again before the answer counts?"""
    ok = seeded(docs, top1, coverage)
    off = ~required | ~allowed | prefetched | (events > 0) | abstained & ~numeric & ~ok
    return F.when(off, False).when(numeric, ~(ok & aligned)).otherwise(~ok | ~aligned)


def prefetch(required: Column, allowed: Column, docs: Column, top1: Column, coverage: Column, events: Column, numeric: Column) -> Column:
    """Is numeric evidence looked up before the answer is written?"""
    return numeric & allowed & (docs > 0) & (events <= 0) & (required | seeded(docs, top1, coverage))


def outline_recheck(wanted: Column, used: Column, docs: Column, top1: Column, coverage: Column, numeric: Column) -> Column:
    """Must the outline of the sources be read?"""
    return F.when(numeric & ~used, True).when(~wanted | used, False).otherwise(~seeded(docs, top1, coverage))
