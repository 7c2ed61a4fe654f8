"""Pages of scanned or printed documents: which text counts, lines from OCR payloads, hints, definitions, statistics; rows of sheets."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators.ingest import page_text_ok

MODES = ("text_only", "ocr_only", "ocr_first", "hybrid")
# fixed values: markers of question and answer columns, lines of page chrome
QUESTION_COLUMNS = ("질문", "question", "문의", "query", "q")
ANSWER_COLUMNS = ("답변", "answer", "해설", "조치", "결과", "a")
CODE_LINE = r"^(?:[①-⑳㉑-㊿]|\(?\d{1,2}\)?[.)]?|[가-힣A-Za-z]\))\s*.+"
PAGE_EXACT = ("header", "footer", "image", "text", "paragraph_title", "statistics korea")


def page_source(text, ocr, mode: Column) -> Column:
    """Struct of parser and text of a page: the mode's first choice, else the other one."""
    a, b = T.text(text), T.text(ocr)
    has = lambda c: F.trim(c) != ""
    pick = lambda parser, c: F.struct(F.lit(parser).alias("parser"), c.alias("text"))
    either = F.when(has(b), pick("ocr", b)).otherwise(pick("text", a))
    return F.when(mode == "text_only", pick("text", a)).when(mode == "ocr_only", pick("ocr", b)).when(mode == "ocr_first", either).otherwise(F.when(page_text_ok(text), pick("text", a)).otherwise(either))


PAYLOAD = "struct<rec_texts:array<string>,rec_scores:array<double>,rec_boxes:array<array<double>>>"


def ocr_lines(payload) -> Column:
    """Lines of an OCR payload with text, score and box; a line without a box stands below its predecessors."""
    p = F.from_json(payload, PAYLOAD)
    none = lambda kind: F.array().cast(f"array<{kind}>")
    # one pass: the parsed lists side by side
    parts = F.arrays_zip(F.coalesce(p["rec_texts"], none("string")).alias("text"), F.coalesce(p["rec_scores"], none("double")).alias("score"), F.coalesce(p["rec_boxes"], none("array<double>")).alias("box"))
    kept = F.filter(parts, lambda x: T.collapse(x["text"]) != "")

    def line(x: Column, row: Column) -> Column:
        text, box = T.collapse(x["text"]), x["box"]
        at = lambda k, other: F.when(F.size(box) == 4, F.get(box, F.lit(k))).otherwise(other.cast("double"))
        xa, ya, xb, yb = at(0, F.lit(0)), at(1, row * 20), at(2, F.greatest(F.lit(40), F.length(text) * 12)), at(3, row * 20 + 16)
        x1, x2, y1, y2 = F.least(xa, xb), F.greatest(xa, xb), F.least(ya, yb), F.greatest(ya, yb)
        score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(x["score"], F.lit(1.0))))
        return F.struct(text.alias("text"), score.alias("score"), x1.alias("x1"), ((x1 + x2) / 2).alias("cx"), ((y1 + y2) / 2).alias("cy"), F.greatest(F.lit(1.0), y2 - y1).alias("height"))

    return F.transform(kept, line)


def lazy_hints(page: Column, table_like: Column, hints: Column) -> Column:
    """Placeholder lines of a page that OCR should read, and its table hints."""
    n = page.cast("string")
    kind = F.when(table_like, "표형 페이지").otherwise("텍스트 부족 페이지")
    why = F.when(table_like, "숫자 표 단가 금액 합계 지급 기준월 OCR 필요").otherwise("이미지 스캔 표 숫자 단가 금액 확인")
    what = F.when(table_like, "표 원문 재확인 필요").otherwise("원문 확인 필요")
    line = lambda tail: F.concat(F.lit("OCR후보: "), kind, F.lit(" | 페이지 "), n, F.lit(" | "), tail)
    kept = F.filter(F.transform(hints, lambda x: T.collapse(x)), lambda x: x.startswith("표행:") | x.startswith("표행요약:") | x.startswith("표값:"))
    return F.array_distinct(F.concat(F.array(line(why), line(what)), kept))


def chrome(c) -> Column:
    """Header, footer, address, image or rule lines."""
    v = T.collapse(c)
    low = F.lower(v)
    return (v == "") | low.isin(*PAGE_EXACT) | low.rlike("^https?://") | v.rlike(r"^[·ㆍ∙.\-–—_ ]{3,}$") | low.startswith("imgs/") | low.rlike(r"\.(?:jpg|jpeg|png|gif|webp)\b") | low.startswith("표의미:")


def is_code(c) -> Column:
    return T.collapse(c).rlike(CODE_LINE)


def is_heading(c) -> Column:
    """A short line with letters that is no code and ends no sentence."""
    v = T.collapse(c)
    return (v != "") & (F.length(v) <= 12) & ~chrome(c) & ~is_code(c) & ~v.rlike("[.!?。]$") & v.rlike("[A-Za-z가-힣]")


def definitions(lines: DataFrame, key: str = "doc_id", order: str = "line_no") -> DataFrame:
    """key, block_no, subject, body: headings and codes begin a block, the lines below are its body; a code stands under the last heading.

    Blocks without a proper subject or a body with Korean text of eight characters or more are dropped.
    """
    rows = lines.filter(~chrome("text")).withColumn("head", is_heading("text")).withColumn("code", ~F.col("head") & is_code("text"))
    before = W.partitionBy(key).orderBy(order)
    rows = rows.withColumn("block", F.sum((F.col("head") | F.col("code")).cast("int")).over(before.rowsBetween(W.unboundedPreceding, 0)))
    rows = rows.withColumn("heading", F.last(F.when(F.col("head"), T.collapse("text")), ignorenulls=True).over(before.rowsBetween(W.unboundedPreceding, 0)))
    mark = F.col("head") | F.col("code")
    item = F.struct(F.col(order), T.collapse("text").alias("t"))
    blocks = rows.filter("block > 0").groupBy(key, "block").agg(
        F.max(F.when(F.col("head"), T.collapse("text"))).alias("own"), F.max(F.when(F.col("code"), F.struct(F.coalesce("heading", F.lit("")).alias("h"), T.collapse("text").alias("t")))).alias("coded"),
        F.array_sort(F.collect_list(F.when(~mark, item))).alias("body"),
    )
    subject = F.coalesce("own", F.when(F.col("coded.h") != "", F.concat(F.col("coded.h"), F.lit(" > "), F.col("coded.t"))).otherwise(F.col("coded.t")))
    out = blocks.select(key, F.col("block").alias("block_no"), subject.alias("subject"), F.array_join(F.transform("body", lambda x: x["t"]), " ").alias("body"))
    good = (F.col("subject").contains(">") | (F.length(F.regexp_replace("subject", T.SPACE, "")) > 1)) & F.col("subject").rlike("[가-힣A-Za-z①-⑳㉑-㊿]")
    return out.filter(good & (F.length("body") >= 8) & F.col("body").rlike("[가-힣]"))


def normalize_stats(stats, defaults: dict[str, object]) -> list[Column]:
    """Typed columns of a JSON object of statistics; what is absent or can't be read gets its default."""
    kind = {int: "bigint", float: "double", str: "string", bool: "boolean"}
    value = lambda k, d: F.get_json_object(stats, f"$.{k}").try_cast(kind[type(d)])
    return [F.coalesce(value(k, d), F.lit(d)).alias(k) for k, d in defaults.items()]


def text_params(max_chars: int = 1200, overlap: int = 180, min_chars: int = 280) -> dict[str, float]:
    """Token parameters of chunking from sizes in characters."""
    most, least = max(240, int(max_chars / 2.2)), max(120, int(min_chars / 2.2))
    return {"max_tokens": most, "min_tokens": least, "target_tokens": (least + most) // 2, "overlap": max(0.1, min(0.2, overlap / max(1, max_chars)))}


def qa_pair(row: Column) -> Column:
    """Struct of question and answer of a sheet's row (map of column to value, in order): by column markers, else by place."""
    entries = F.map_entries(row)
    name = lambda e: T.compact(e["key"])
    first = lambda marks: F.get(F.transform(F.filter(entries, lambda e: T.any_in(name(e), marks) & (T.text(e["value"]) != "")), lambda e: e["value"]), F.lit(0))
    values = F.filter(F.map_values(row), lambda v: T.text(v) != "")
    return F.struct(F.trim(F.coalesce(first(QUESTION_COLUMNS), F.get(values, F.lit(0)), F.lit(""))).alias("question"), F.trim(F.coalesce(first(ANSWER_COLUMNS), F.get(values, F.lit(1)), F.get(values, F.lit(0)), F.lit(""))).alias("answer"))


def row_chunks(rows: DataFrame) -> DataFrame:
    """Rows of sheets (sheet, row, columns, row_text, fact_text) as chunks of one row each."""
    head = F.array(F.concat(F.lit("[Sheet: "), "sheet", F.lit("]")), F.concat(F.lit("[Columns: "), F.array_join("columns", "|"), F.lit("]")), F.col("row_text"))
    text = F.array_join(F.concat(head, F.when(T.text("fact_text") != "", F.array("fact_text")).otherwise(F.array().cast("array<string>"))), "\n")
    return rows.select("sheet", "row", F.col("row").alias("row_end"), F.concat(F.lit("Sheet:"), "sheet").alias("section"), text.alias("text"))


def grouped_row_chunks(rows: DataFrame, least: int = 10, most: int = 30, overlap: int = 3, target: int = 620, limit: int = 780) -> DataFrame:
    """sheet, row, row_end, rows: windows of neighbouring rows of a sheet (in one file a sheet is bounded) by tokens, each taking up the last rows of the one before."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row")
        numbers, tokens = pdf["row"].tolist(), pdf["tokens"].tolist()
        start, out = 0, []
        while start < len(numbers):
            end, used = start, 0
            while end < len(numbers) and end - start < most:
                if end - start >= least and used + tokens[end] > limit:
                    break
                used += tokens[end]
                end += 1
                if end - start >= least and used >= target:
                    break
            out.append((pdf["sheet"].iloc[0], numbers[start], numbers[end - 1], end - start))
            if end >= len(numbers):
                break
            start = max(start + 1, end - max(1, overlap))
        return pd.DataFrame(out, columns=["sheet", "row", "row_end", "rows"])

    return rows.select("sheet", "row", T.chunk_tokens("row_text").alias("tokens")).groupBy("sheet").applyInPandas(fold, "sheet string, row long, row_end long, rows long")
