"""Ingest: lines, sections, structure, chunking, bundles, table facts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators.packing import pack
from docloom.settings import DEFAULTS, Settings


def lines(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, line_no (from 1), text, is_section: collapsed lines without blanks and page lines (unless they are sections)."""
    raw = docs.select(key, F.posexplode(F.split(T.text(text), "\r\n|\r|\n")).alias("at", "raw"))
    rows = raw.select(key, (F.col("at") + 1).alias("line_no"), T.collapse("raw").alias("text"))
    rows = rows.withColumn("is_section", T.is_section("text"))
    return rows.filter((F.col("text") != "") & (F.col("is_section") | ~T.is_page_line("text")))


def previous_section(rows: DataFrame, key: str, lookback: int = 36) -> DataFrame:
    """Adds prev_section: the nearest section line among the ``lookback`` rows before, or ''."""
    w = W.partitionBy(key).orderBy("line_no").rowsBetween(-lookback, -1)
    return rows.withColumn("prev_section", F.coalesce(F.last(F.when(F.col("is_section"), F.col("text")), ignorenulls=True).over(w), F.lit("")))


def chunk_lines(rows: DataFrame, key: str, s: Settings = DEFAULTS) -> DataFrame:
    """Greedy windows of lines: up to target tokens, topped up to the minimum, never over the maximum (a first line always
    fits); the next window steps back by the overlap. Sequential inside a document, parallel over documents."""
    rows = previous_section(rows, key).withColumn("n", T.chunk_tokens("text"))
    target, least, most = s.target_tokens, s.min_tokens, s.max_tokens
    back = max(30, int(most * max(0.1, min(0.2, s.overlap))))

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("line_no", kind="stable")
        n, texts, numbers = pdf["n"].tolist(), pdf["text"].tolist(), pdf["line_no"].tolist()
        sections, before = pdf["is_section"].tolist(), pdf["prev_section"].tolist()
        out, start = [], 0
        while start < len(n):
            end, used = start, 0
            while end < len(n) and (end == start or used + n[end] <= most) and not (used >= target and used >= least):
                used += n[end]
                end += 1
            while end < len(n) and used < least and used + n[end] <= most:
                used += n[end]
                end += 1
            hint = before[start]
            body = "\n".join(texts[start:end])
            if hint and not any(sections[start:end]):
                body = f"[Section: {hint}]\n{body}"
            out.append((pdf[key].iloc[0], len(out) + 1, numbers[start], numbers[end - 1], used, hint, body))
            if end >= len(n):
                break
            nxt, gone = end, 0
            while nxt > start and gone < back:
                nxt -= 1
                gone += n[nxt]
            start = end if nxt <= start else nxt
        return pd.DataFrame(out, columns=[key, "chunk_no", "line_start", "line_end", "tokens", "section", "text"])

    schema = f"{key} long, chunk_no int, line_start int, line_end int, tokens int, section string, text string"
    return rows.select(key, "line_no", "text", "is_section", "prev_section", "n").groupBy(key).applyInPandas(fold, schema)


def split_parts(rows: DataFrame, key: str, target: int = 2200, most: int = 2800, least: int = 900) -> DataFrame:
    """key, part, line_start, line_end, tokens: long texts cut at ``most`` tokens, or before a section once ``target`` is reached; a tail
    shorter than max(180, 35 % of least) joins the part before."""
    rows = rows.withColumn("n", T.chunk_tokens("text"))
    tail = max(180, int(least * 0.35))

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("line_no", kind="stable")
        parts: list[list[int]] = []
        used = 0
        for no, n, section in zip(pdf["line_no"], pdf["n"], pdf["is_section"], strict=True):
            if not parts or used + n > most or section and used >= target:
                parts.append([int(no), int(no), 0])
                used = 0
            used += int(n)
            parts[-1][1:] = [int(no), used]
        if len(parts) > 1 and parts[-1][2] < tail:
            last = parts.pop()
            parts[-1][1:] = [last[1], parts[-1][2] + last[2]]
        return pd.DataFrame([(pdf[key].iloc[0], i, *p) for i, p in enumerate(parts, 1)], columns=[key, "part", "line_start", "line_end", "tokens"])

    return rows.select(key, "line_no", "n", "is_section").groupBy(key).applyInPandas(fold, f"{key} long, part int, line_start int, line_end int, tokens int")


def heading_path(c) -> Column:
    """Distinct collapsed parts of a path written with '>'."""
    return F.array_distinct(F.filter(F.transform(F.split(T.text(c), ">"), lambda x: T.collapse(x)), lambda x: x != ""))


def embedding_text(body: Column, source: Column, role: Column, headings: Column, kind: Column, body_chars: int = 1800, chars: int = 2400) -> Column:
    """Header ``source | role | path | kind`` over the body, both cut to their limits."""
    name = T.basename(F.trim(source))
    path = F.concat_ws(" > ", headings)
    parts = F.concat_ws(
        " | ", F.when(name != "", F.concat(F.lit("source="), name)), F.when(T.collapse(role) != "", F.concat(F.lit("role="), T.collapse(role))),
        F.when(path != "", F.concat(F.lit("path="), path)), F.when((T.collapse(kind) != "") & (T.collapse(kind) != "body"), F.concat(F.lit("kind="), T.collapse(kind))),
    )
    short = T.ellipsis(T.collapse(body), body_chars)
    return T.ellipsis(F.when(parts != "", F.concat(parts, F.lit("\n"), short)).otherwise(short), chars)


def merge_table_rows(cells: DataFrame) -> DataFrame:
    """One row for each parent of table cells: texts by cell number, first and last line."""
    order = F.sort_array(F.collect_list(F.struct("cell_no", "line_start", "text")))
    return cells.groupBy("parent_key").agg(F.min("line_start").alias("line_start"), F.max("line_end").alias("line_end"), order.alias("o")).select(
        "parent_key", "line_start", "line_end", F.concat_ws(" | ", F.filter(F.transform("o", lambda x: F.trim(x["text"])), lambda x: x != "")).alias("text")
    )


def page_text_ok(c, least: int = 80, ratio: float = 0.4) -> Column:
    """Has a page enough text, and enough that isn't white space?"""
    v = T.text(c)
    solid = F.length(F.regexp_replace(v, T.SPACE, ""))
    return (F.length(F.trim(v)) >= least) & (solid / F.greatest(F.length(v), F.lit(1)) >= ratio)


def merge_pages(pages: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """First non-empty text of each page in page order, and page counts by parser with the document's parser label."""
    w = W.partitionBy(key, "page_no").orderBy("attempt")
    first = pages.filter(F.trim(T.text("text")) != "").withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")
    label = first.groupBy(key).agg(F.count_if(F.col("parser") == "text").alias("text_pages"), F.count_if(F.col("parser") == "ocr").alias("ocr_pages"), F.count("*").alias("pages"))
    kind = F.when((F.col("text_pages") > 0) & (F.col("ocr_pages") > 0), "hybrid").when(F.col("ocr_pages") > 0, "ocr").otherwise("text")
    return first, label.withColumn("parser", kind)


def compact_lines(c) -> Column:
    """Distinct useful lines: at least four characters, no page lines, in order."""
    parts = F.transform(F.split(T.text(c), "\n"), lambda x: T.collapse(x))
    return F.array_distinct(F.filter(parts, lambda x: (F.length(x) >= 4) & ~x.rlike(T.CHROME[0]) & ~x.rlike(T.CHROME[1]) & ~x.rlike(T.CHROME[2])))


# fixed values: header and name patterns of table facts
NAME_HEADER = "(조사명|사업명|항목명|품목|대상|구분|명칭|이름|명$)"
PRICE_HEADER = "(단가|금액|비용|가격|수수료|요금)"
NUMERIC = r"^\d[\d,]*(?:\.\d+)?$"
FACT_MARK = "표의미: kind=table_row"


def name_aliases(c) -> Column:
    """The name, the parts around parentheses, and variants of names joined by a connector."""
    none = F.array().cast("array<string>")

    def of(v: Column) -> Column:
        outer, inner = (F.trim(F.regexp_extract(v, r"^(.+?)\((.+?)\)$", k)) for k in (1, 2))

        def variants(parts: Column) -> Column:
            tail = F.element_at(parts, -1)
            short = F.transform(F.filter(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: F.length(p) <= 2), lambda p: F.concat(p, F.substring(tail, 2, 10_000)))
            return F.when(F.size(parts) >= 2, F.concat(F.array(F.regexp_replace(v, "[·ㆍ/]", "")), F.when(F.length(tail) >= 2, F.concat(short, F.array(tail))).otherwise(none))).otherwise(none)

        joined = T.let(F.filter(F.split(v, "[·ㆍ/]"), lambda x: x != ""), variants)
        halves = lambda key: F.array(F.concat(F.substring(key, 1, 1), F.substring(key, 3, 10_000)), F.concat(F.substring(key, 2, 1), F.substring(key, 3, 10_000)))
        pair = T.let(T.alias_key(v), lambda key: F.when((F.length(key) >= 5) & key.rlike("^(농어|남여|내외)"), halves(key)).otherwise(none))
        return distinct_by_key(F.filter(F.concat(F.array(v, outer, inner), joined, pair), lambda x: F.length(T.alias_key(x)) >= 2))

    return T.let(T.collapse(c), of)


def distinct_by_key(items: Column) -> Column:
    """First of the items that agree without case."""
    start = F.array().cast("array<string>")
    return F.aggregate(items, start, lambda acc, x: F.when(F.exists(acc, lambda y: F.lower(y) == F.lower(x)), acc).otherwise(F.concat(acc, F.array(x))))


def format_value(header: Column, value: Column, row_text: Column) -> Column:
    """A bare number under a price header counts in thousands of won."""
    price = header.rlike(PRICE_HEADER) & value.rlike(NUMERIC) & ~row_text.contains("천원") & ~row_text.contains("만원") & ~value.contains("원")
    return F.when(price, F.concat(value, F.lit("천원"))).otherwise(value)


def row_fact(headers: Column, values: Column) -> Column:
    """``표의미: kind=table_row | subject=… | aliases=… | header=value …`` of a table row."""
    hs, vs = F.transform(headers, lambda x: T.collapse(x)), F.transform(values, lambda x: T.collapse(x))

    def of(both: Column) -> Column:
        named = F.get(F.filter(both, lambda x: x["h"].rlike(NAME_HEADER) & (x["v"] != "")), F.lit(0))["v"]
        worded = F.get(F.filter(both, lambda x: (x["v"] != "") & ~F.replace(x["v"], F.lit(","), F.lit("")).rlike(NUMERIC)), F.lit(0))["v"]
        row_text = F.array_join(F.transform(both, lambda x: x["v"]), " ")

        def line(s: Column) -> Column:
            # the subject's own variants come first if it stands under a name header
            more = F.flatten(F.transform(F.filter(both, lambda x: x["h"].rlike(NAME_HEADER) & (x["v"] != "")), lambda x: name_aliases(x["v"])))
            own = F.when(s["named"], T.let(name_aliases(s["x"]), lambda a: F.when(F.size(a) > 1, a).otherwise(F.filter(F.array(s["x"]), lambda x: x != "")))).otherwise(F.filter(F.array(s["x"]), lambda x: x != ""))
            aliases = T.let(distinct_by_key(F.concat(own, more)), lambda a: F.when(F.size(a) > 0, F.concat(F.lit("aliases="), F.array_join(a, ", "))))
            pairs = T.let(row_text, lambda text: F.filter(F.transform(both, lambda x: F.when((x["h"] != "") & (x["v"] != ""), F.concat(x["h"], F.lit("="), format_value(x["h"], x["v"], text)))), lambda x: x.isNotNull()))
            return F.concat_ws(" | ", F.lit(FACT_MARK), F.when(s["x"] != "", F.concat(F.lit("subject="), s["x"])), aliases, F.array_join(pairs, " | "))

        first = F.coalesce(named, worded, F.get(F.transform(both, lambda x: x["v"]), F.lit(0)), F.lit(""))
        return T.let(F.struct(first.alias("x"), named.isNotNull().alias("named")), line)

    return T.let(F.zip_with(hs, vs, lambda h, v: F.struct(h.alias("h"), v.alias("v"))), of)


def parse_fact(line: Column) -> Column:
    """Key and value structs of a fact line, the last of equal keys; empty for other lines."""
    none = F.array().cast("array<struct<k:string,v:string>>")

    def of(v: Column) -> Column:
        halves = lambda p: F.struct(F.trim(F.substring_index(p, "=", 1)).alias("k"), F.trim(F.regexp_extract(p, "(?s)^[^=]*=(.*)$", 1)).alias("v"))
        parts = F.transform(F.filter(F.transform(F.split(F.regexp_replace(v, "^표의미:", ""), r"\|"), lambda p: F.trim(p)), lambda p: p.contains("=")), halves)
        kept = T.let(parts, lambda ps: F.filter(ps, lambda x, i: ~F.exists(F.slice(ps, i + 2, F.size(ps)), lambda y: y["k"] == x["k"])))
        return F.when(v.startswith("표의미:"), kept).otherwise(none)

    return T.let(T.collapse(line), of)


def fact_value(parsed: Column, key: str) -> Column:
    return F.coalesce(F.get(F.filter(parsed, lambda x: x["k"] == key), F.lit(0))["v"], F.lit(""))


def extract_facts(rows: DataFrame, id_col: str, text: str = "text") -> DataFrame:
    """subject, aliases, predicate, object_value, fact_kind, confidence of every non-reserved pair in fact lines, and parents of definition paths."""
    parsed = rows.select(id_col, F.explode(F.split(T.text(text), "\n")).alias("line")).select(id_col, F.explode(F.array(parse_fact(F.col("line")))).alias("p"))  # a row of its own, so that it is parsed once
    parsed = parsed.withColumn("kind", fact_value(F.col("p"), "kind")).withColumn("whole", fact_value(F.col("p"), "subject")).filter(F.col("kind").isin("table_row", "definition_block") & (F.col("whole") != ""))
    nested = (F.col("kind") == "definition_block") & F.col("whole").contains(" > ")
    parsed = parsed.withColumn("subject", F.when(nested, F.trim(F.regexp_extract("whole", "^.*? > (.*)$", 1))).otherwise(F.col("whole"))).withColumn("parent", F.when(nested, F.trim(F.substring_index("whole", " > ", 1))).otherwise(""))
    aliases = distinct_by_key(F.filter(F.transform(F.split(fact_value(F.col("p"), "aliases"), ","), lambda x: T.collapse(x)), lambda x: x != ""))
    aliases = T.let(aliases, lambda a: F.when(F.array_contains(a, F.col("subject")), a).otherwise(F.concat(F.array("subject"), a)))
    pairs = parsed.select(id_col, "subject", aliases.alias("aliases"), F.explode(F.filter("p", lambda x: ~x["k"].isin("kind", "subject", "aliases") & (x["v"] != ""))).alias("x"), "kind")
    out = pairs.select(id_col, "subject", "aliases", F.col("x.k").alias("predicate"), F.col("x.v").alias("object_value"), F.col("kind").alias("fact_kind"), F.lit("deterministic_table_fact").alias("method"), F.lit(0.78).alias("confidence"))
    up = parsed.filter("parent <> '' AND subject <> ''").select(id_col, "subject", F.array("subject").alias("aliases"), F.lit("상위개념").alias("predicate"), F.col("parent").alias("object_value"), F.lit("hierarchy").alias("fact_kind"), F.lit("deterministic_definition_path").alias("method"), F.lit(0.72).alias("confidence"))
    return out.unionByName(up)


def dedupe_newest(rows: DataFrame) -> DataFrame:
    """Of rows of a role with the same collapsed lower-case text the newest (then the highest id)."""
    key = F.lower(T.collapse("text"))
    w = W.partitionBy("doc_role", "text_key").orderBy(F.col("uploaded_at").desc(), F.col("id").desc())
    return rows.withColumn("text_key", F.sha2(key, 256)).withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn", "text_key")


def pack_bundles(rows: DataFrame, group: str, target: int = 360, most: int = 460) -> DataFrame:
    """group, bundle, ids, tokens: rows of a group, newest first, packed until target, never over the maximum. Rows: id, uploaded_at, n."""
    packed = pack(rows.select(group, "id", "uploaded_at", "n"), group, [F.desc("uploaded_at"), F.desc("id")], "n", most, target)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("at", "id"))), lambda x: x["id"])
    return packed.groupBy(group, (F.col("bundle") + 1).cast("int").alias("bundle")).agg(listed.alias("ids"), F.sum("n").cast("int").alias("tokens"))


def islands(rows: DataFrame, part: list[str], at: str, gap: int = 1) -> DataFrame:
    """Adds island: number of the run of neighbouring ``at`` values whose gaps are at most ``gap``."""
    w = W.partitionBy(*part).orderBy(at)
    jump = F.when(F.col(at) - F.lag(at).over(w) <= gap, 0).otherwise(1)
    return rows.withColumn("__jump", jump).withColumn("island", F.sum("__jump").over(w)).drop("__jump")
