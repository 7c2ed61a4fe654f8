"""Hints of tables in page texts, of table grids and of survey lists; texts inside nested OCR payloads."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

from docloom.functions import text as T
from docloom.operators import ingest as I
from docloom.operators import rules as R

# fixed values: words of header lines, units of values, the patterns of values and numeric tokens, header units
HEADER_HINTS = (
    "단가", "금액", "조사항목", "항목", "구분", "비고", "답례품", "품목", "조사명", "수량", "비율", "건수", "작물명", "조사 시기", "조사시기", "보고 기일", "보고기일",
    "지급 기준월", "지급기준월", "지급 단가", "지급단가", "지급 단위", "지급단위", "조사 방법", "조사방법", "마감 시기", "마감시기", "지급대상월",
)
VALUE_UNITS = ("천원", "만원", "억원", "원", "%", "퍼센트", "명", "건", "개", "호", "회")
VALUE = r"(?<![\d.])\d[\d,]*(?:\.\d+)?\s*(?:\(\s*(?:천원|만원|억원|원|퍼센트|%)\s*\)|(?:천원|만원|억원|원|퍼센트|%|명|건|개|호|회))"
FIGURE = r"(?<![\d.])\d[\d,]*(?:\.\d+)?"
NUMERIC_TOKEN = r"^\d[\d,]*(?:\.\d+)?(?:년|월|일|천원|만원|억원|원|퍼센트|%|명|건|개|호|회)?$"
HEADER_UNITS = ("(천원)", "(만원)", "(억원)", "(원)", "(퍼센트)", "(%)")
# fixed values: keys of an OCR payload that hold no text
SKIP_KEYS = frozenset({"bbox", "boxes", "points", "polygon", "polygons", "score", "scores", "confidence", "confidences"})


def header_like(line: Column) -> Column:
    """A header word and at most one digit."""
    return T.any_in(line, HEADER_HINTS) & (F.size(T.extract_all(line, r"\d")) <= 1)


def value_like(line: Column) -> Column:
    """A bar, two figures, or one figure with a unit in a line of twelve words or fewer."""
    n = F.size(T.extract_all(line, FIGURE))
    return line.contains("|") | (n >= 2) | ((n >= 1) & T.any_in(line, VALUE_UNITS) & (F.size(F.split(line, " ")) <= 12))


def value_hints(line: Column) -> Column:
    """Figures with their units, without commas, spaces and brackets."""
    return F.transform(T.extract_all(line, VALUE), lambda m: F.concat(F.lit("표값: "), F.regexp_replace(m, r"[,\s()]", "")))


def numeric_tokens(line: Column) -> Column:
    """How many words are a number with or without a unit."""
    return F.size(F.filter(F.split(line, " "), lambda t: F.regexp_replace(t, "^,+|,+$", "").rlike(NUMERIC_TOKEN)))


def flat_fact(header: Column, row: Column) -> Column:
    """The fact of a row and a header line split by words; surplus words belong to a first column of names."""
    hs, vs = F.split(header, " "), F.split(row, " ")
    extra = F.size(vs) - F.size(hs)
    joined = F.concat(F.array(F.array_join(F.slice(vs, 1, F.greatest(extra, F.lit(0)) + 1), " ")), F.slice(vs, F.greatest(extra, F.lit(0)) + 2, F.greatest(F.size(vs), F.lit(1))))
    return I.row_fact(hs, F.when((extra > 0) & F.get(hs, F.lit(0)).rlike(I.NAME_HEADER), joined).otherwise(vs))


def flat_rows(words: list[str]) -> list[tuple[str, str]]:
    """Header and row text of the rows of a table that was printed as one line: a label, then two figures or more.

    Up to the first row, words to the last header word of a label are its header, and leading words are given up until the rest is a label.
    """
    if len(words) < 8:
        return []
    number = [bool(re.match(NUMERIC_TOKEN, w.strip(","))) for w in words]
    head = [w in HEADER_UNITS or any(h in w for h in HEADER_HINTS) for w in words]
    wordy = [bool(re.search("[A-Za-z가-힣]", w)) for w in words]

    def label(a: int, b: int) -> bool:
        return 0 < b - a <= 8 and any(wordy[a:b]) and not all(head[a:b])

    out, header, at = [], "", 0
    while at < len(words):
        mid = next((i for i in range(at, len(words)) if number[i]), len(words))
        end = next((i for i in range(mid, len(words)) if not number[i]), len(words))
        start = at
        if not out and mid > at:
            last = max((i for i in range(at, mid) if head[i]), default=-1)
            if at <= last < mid - 1:
                start = last + 1
                header = " ".join(words[at:start]) if label(start, mid) and end - mid >= 2 else words[last]
            # a suffix of more than eight words is no label
            tries = (start, *range(max(start + 1, mid - 8), mid))
            start = next((s for s in tries if label(s, mid)), mid)
        if end - mid >= 2 and label(start, mid):
            out.append((header, " ".join(words[start:mid] + words[mid : min(end, mid + 12)])))
        at = end
    return out


@F.pandas_udf(ArrayType(StructType().add("header", "string").add("row", "string")))
def _flat(lines: pd.Series) -> pd.Series:
    return lines.map(lambda s: [{"header": h, "row": r} for h, r in flat_rows(s.split())])


def table_hints(lines: DataFrame, key: str, order: str = "line_no", text: str = "text") -> DataFrame:
    """key, hints, n_lines, numeric, needs_ocr of every page with a line that isn't empty.

    A header holds for the value lines below it, up to a line that is neither; a repeated value line is combined with its first header only.
    """
    rows = lines.select(key, order, F.trim(F.regexp_replace(T.text(text), r"(?U)\s+", " ")).alias("line")).filter("line <> ''")
    rows = rows.withColumn("head", header_like(F.col("line"))).withColumn("value", ~F.col("head") & value_like(F.col("line")))
    upto = W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("stretch", F.sum((~F.col("head") & ~F.col("value")).cast("int")).over(upto))
    within = W.partitionBy(key, "stretch").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("header", F.coalesce(F.last(F.when(F.col("head"), F.col("line")), ignorenulls=True).over(within), F.lit("")))
    rows = rows.withColumn("again", F.row_number().over(W.partitionBy(key, "line").orderBy(order)) > 1)
    kind = F.when(F.col("head"), "head").when(F.col("value"), "value").otherwise("other")
    item = lambda part, n, k, h, r: F.struct(F.lit(part).alias("part"), n.cast("int").alias("n"), k.alias("kind"), h.alias("header"), r.alias("row"))
    own = F.array(item(0, F.lit(0), kind, F.when(F.col("again"), F.lit("")).otherwise(F.col("header")), F.col("line")))
    long = F.size(F.split("line", " ")) >= 8
    flat = F.when(long, _flat(F.when(long, F.col("line")).otherwise(F.lit("")))).otherwise(F.array().cast("array<struct<header:string,row:string>>"))
    rows = rows.withColumn("flat", flat)
    items = rows.withColumn("numeric", numeric_tokens(F.col("line"))).select(key, order, "numeric", F.explode(F.concat(own, F.transform("flat", lambda x, i: item(1, i, F.lit("flat"), x["header"], x["row"])))).alias("i")).select(key, order, "numeric", "i.*")
    h, r = F.col("header"), F.col("row")
    both = F.concat(h, F.lit(" | "), r)
    named = h != ""
    none = F.array().cast("array<string>")
    say = lambda mark, c: F.concat(F.lit(mark), c)
    items = items.withColumn("fact", F.when(named & F.col("kind").isin("value", "flat"), flat_fact(h, r)))
    value = F.concat(F.array(say("표행: ", r)), F.when(named, F.array(say("표행: ", both), say("표행요약: ", both), F.col("fact"))).otherwise(none), value_hints(r))
    flat_hints = F.when(named, F.array(say("표행요약: ", both), F.col("fact"))).otherwise(F.array(say("표행요약: ", r)))
    hints = F.when(F.col("kind") == "head", F.array(say("표헤더: ", r))).when(F.col("kind") == "value", value).when(F.col("kind") == "flat", flat_hints).otherwise(none)
    first = F.col("part") == 0
    pages = items.withColumn("hints", hints).groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("part", order, "n", "hints"))).alias("o"), F.count_if(first).alias("n_lines"), F.sum(F.when(first, F.col("numeric")).otherwise(0)).alias("numeric"),
    )
    pages = pages.select(key, F.array_distinct(F.flatten(F.transform("o", lambda x: x["hints"]))).alias("hints"), "n_lines", "numeric")
    return pages.withColumn("needs_ocr", needs_ocr(F.col("hints"), F.col("n_lines"), F.col("numeric")))


def needs_ocr(hints: Column, lines: Column, numeric: Column) -> Column:
    """Should a page whose text looks like a table be read by OCR?"""
    rows = F.exists(hints, lambda x: x.startswith("표행요약:"))
    return F.when(F.size(hints) == 0, False).when(rows, (numeric >= 4) | (lines >= 3)).otherwise(((lines <= 2) & (numeric >= 3)) | (numeric >= 10))


def grid_hints(cells: DataFrame, key: list[str]) -> DataFrame:
    """key, row_no, hints of tables with two rows or more and two headers or more; cells: key, row_no, cell_no, text.

    The first row is the header. A table's rows stand in one window, as a table in a document has bounded rows.
    """
    item = F.struct("cell_no", T.collapse("text").alias("t"))
    rows = cells.filter("row_no > 0 AND cell_no > 0").groupBy(*key, "row_no").agg(F.array_sort(F.collect_list(item)).alias("cells"))
    table = W.partitionBy(*key)
    rows = rows.withColumn("head", F.min_by("cells", "row_no").over(table)).withColumn("first", F.min("row_no").over(table)).withColumn("n", F.count("*").over(table))
    filled = lambda c: F.filter(F.transform(c, lambda x: x["t"]), lambda t: t != "")
    rows = rows.withColumn("headers", filled(F.col("head"))).withColumn("values", filled(F.col("cells"))).filter("n >= 2 AND size(headers) >= 2")
    whole = F.array_join("values", " ")
    mine = lambda c: F.get(F.filter("cells", lambda x: x["cell_no"] == c["cell_no"]), F.lit(0))["t"]
    pair = lambda c, i: F.struct(F.get("headers", i).alias("h"), I.format_value(F.get("headers", i), T.text(mine(c)), whole).alias("v"))
    rows = rows.withColumn("pairs", F.filter(F.transform("head", pair), lambda x: x["h"].isNotNull() & (x["v"] != "")))
    names = F.transform(F.filter("pairs", lambda x: x["h"].rlike(I.NAME_HEADER)), lambda x: I.name_aliases(x["v"]))
    aliases = F.array_distinct(F.flatten(F.filter(names, lambda a: F.size(a) > 1)))
    survey = F.get(F.filter("values", lambda v: v.contains("조사")), F.lit(0))
    prices = F.when(survey.isNotNull(), F.transform(F.filter("pairs", lambda x: x["h"].rlike(I.PRICE_HEADER)), lambda x: F.concat(F.lit("표값: "), survey, F.lit(" "), x["h"], F.lit(" "), x["v"])))
    none = F.array().cast("array<string>")
    told = F.concat(F.transform("pairs", lambda x: F.concat(x["h"], F.lit("="), x["v"])), F.when(F.size(aliases) > 0, F.array(F.concat(F.lit("명칭별칭="), F.array_join(aliases, ", ")))).otherwise(none))
    body = F.concat(F.array(F.concat(F.lit("표행요약: "), F.array_join(told, " | ")), I.row_fact(F.col("headers"), F.col("values"))), F.coalesce(prices, none))
    hints = F.when(F.col("row_no") == F.col("first"), F.array(F.concat(F.lit("표헤더: "), F.array_join("headers", " | ")))).when(F.size("values") >= 2, body)
    return rows.select(*key, "row_no", hints.alias("hints")).filter("hints IS NOT NULL")


def survey_hints(cells: DataFrame, key: list[str], order: str = "line") -> DataFrame:
    """key, order, hints of lists without row numbers: a name with aliases, the price among the five cells after it, the gift before it."""
    rows = I.islands(cells.withColumn("t", T.collapse("text")), key, order, 1)
    w = W.partitionBy(*key, "island").orderBy(order)
    ahead = [F.lead("t", k).over(w) for k in range(1, 6)]
    price = F.coalesce(*[F.when(R.thousand_won(c), F.concat(c, F.lit("천원"))) for c in ahead])
    rows = rows.withColumn("price", price).withColumn("gift", F.lag("t").over(w)).withColumn("aliases", I.name_aliases("t")).filter("price IS NOT NULL AND size(aliases) > 1")
    t, p, gift = F.col("t"), F.col("price"), F.col("gift")
    told = F.concat_ws(" | ", F.when(T.text(gift) != "", F.concat(F.lit("답례품="), gift)), F.concat(F.lit("조사명="), t), F.concat(F.lit("지급단가="), p), F.concat(F.lit("명칭별칭="), F.array_join("aliases", ", ")))
    names = lambda *xs: F.array(*map(F.lit, xs))
    fact = F.when(gift.isNotNull(), I.row_fact(names("답례품", "조사명", "지급단가"), F.array(gift, t, p))).otherwise(I.row_fact(names("조사명", "지급단가"), F.array(t, p)))
    return rows.select(*key, order, F.array(F.concat(F.lit("표행요약: "), told), fact, F.concat(F.lit("표값: "), t, F.lit(" 지급단가 "), p)).alias("hints"))


def collect_texts(payload: str | None) -> list[str]:
    """Distinct strings of a nested payload in its order, but for those of keys that hold places and scores."""
    try:
        stack = [json.loads(payload or "null")]
    except (ValueError, RecursionError):
        return []
    found: dict[str, None] = {}
    while stack:
        node = stack.pop()
        if isinstance(node, str):
            lines = (re.sub(r"[ \t\r\f\v]+", " ", x.strip()) for x in node.splitlines())
            if body := "\n".join(x for x in lines if x):
                found[body] = None
        elif isinstance(node, list):
            stack.extend(reversed(node))
        elif isinstance(node, dict):
            stack.extend(v for k, v in reversed(node.items()) if k.strip().lower() not in SKIP_KEYS)
    return list(found)


@F.pandas_udf(ArrayType(StringType()))
def payload_texts(payload: pd.Series) -> pd.Series:
    """:func:`collect_texts` of a column of payloads; null and broken ones have none."""
    return payload.map(collect_texts)
