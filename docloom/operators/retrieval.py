"""Hybrid retrieval for batches of questions.

Texts are matched through the postings of a stored index, never by joining questions with texts: full-text and overlap
tokens are equi-joined; a term occurs inside a text exactly where it occurs inside one of its tokens, so substring
matches are found in the vocabulary (by a shared n-gram) and taken to the rows through the postings. The terms of a batch
of questions have numbers, and a row's are gathered once: substring candidates and lexical scores come from these.
Candidates, whose number per question is bounded, are written once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators import rules
from docloom.operators.index import Index, build, small, token_grams, vocabulary_grams
from docloom.operators.ingest import name_aliases
from docloom.settings import DEFAULTS, Settings
from docloom.tables import cut, together

def with_keywords(questions: DataFrame) -> DataFrame:
    """questions (query_id, query) with their keywords."""
    return questions.withColumn("kw", T.keywords("query"))


def numbered_terms(questions: DataFrame) -> DataFrame:
    """term, no: the distinct keywords of a batch of questions."""
    return cut(questions.select(F.explode("kw").alias("term")).distinct().withColumn("no", F.monotonically_increasing_id()), "batch-terms")


def bm25(questions: DataFrame, index: Index, limit: int, k1: float = 1.2, b: float = 0.75, terms: int = DEFAULTS.fts_terms) -> DataFrame:
    """query_id, id, rank: the best ``limit`` rows by BM25 of up to ``terms`` keywords each (idf floored at 1e-6)."""
    q = cut(questions.select("query_id", F.explode(F.slice("kw", 1, terms)).alias("term")), "fts-terms")
    postings = index.words.join(small(q.select("term").distinct()), "term")
    df = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    size = index.rows.filter("dl > 0").agg(F.count(F.lit(1)).alias("rows"), F.avg("dl").alias("avg_dl"))
    idf = F.log((F.col("rows") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    q = cut(q.join(df, "term").join(F.broadcast(size)).select("query_id", "term", F.when(idf > 0, idf).otherwise(1e-6).alias("idf"), "avg_dl"), "fts-asked")
    weight = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avg_dl")))
    # hits move once, by row, before questions multiply them; their sums stay where they are
    terms = cut(q.select("term").distinct().withColumn("no", F.monotonically_increasing_id().cast("int")), "fts-numbers")
    hits = index.words.join(small(terms), "term").select("id", "no", F.col("tf").cast("int").alias("tf"), "dl").repartition("id")
    asked = q.join(terms, "term").select("query_id", "no", "idf", "avg_dl")
    scored = hits.join(small(cut(asked, "fts-weights")), "no").groupBy("query_id", "id").agg(F.round(F.sum(weight), 6).alias("bm25"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("bm25").desc(), F.col("id").desc()))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= max(8, limit)).select("query_id", "id", "rank")


def terms_inside(terms: DataFrame, grams: DataFrame) -> DataFrame:
    """token, exact, nos: for tokens of the vocabulary the number of the term that they are (null if none), and of all terms (term, no) that stand in them."""
    keyed = cut(terms.withColumn("gram", F.substring("term", 1, 3)), "inside-terms")
    found = grams.join(small(keyed), "gram").filter(F.instr(F.col("token"), F.col("term")) > 0)
    return cut(found.groupBy("token").agg(F.max(F.when(F.col("token") == F.col("term"), F.col("no"))).alias("exact"), F.collect_set("no").alias("nos")), "inside-found")


def rows_of_terms(terms: DataFrame, index: Index, ids: DataFrame | None = None) -> DataFrame:
    """id, exact, inside: numbers of the batch's terms that are tokens of a row, and that occur in its text. At most the batch's terms for each row. ids: only these rows (id, distinct)."""
    tokens, vocabulary = index.tokens, index.vocabulary
    if ids is not None:
        tokens = cut(tokens.join(small(ids), "id", "left_semi"), "held-tokens")
        vocabulary = tokens.select("token").distinct()
    hits = tokens.join(small(terms_inside(terms, token_grams(vocabulary))), "token")
    return hits.groupBy("id").agg(F.collect_set("exact").alias("exact"), F.array_distinct(F.flatten(F.collect_list("nos"))).alias("inside"))


def substring_hits(terms: DataFrame, postings: DataFrame) -> DataFrame:
    """term, id: rows in whose lower-case text the term (of token characters) occurs. terms: distinct ``term`` rows of two characters or more; postings: id, token."""
    keyed = cut(terms.select("term").distinct().withColumn("no", F.monotonically_increasing_id()), "sub-terms")
    found = terms_inside(keyed, vocabulary_grams(postings))
    # a row's terms are gathered by number before they move
    rows = postings.join(small(found), "token").groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("nos"))).alias("nos"))
    return rows.select("id", F.explode("nos").alias("no")).join(small(keyed), "no").select("term", "id")


def overlap_postings(chunks: DataFrame) -> DataFrame:
    """id, token: distinct overlap tokens (of any length) of each row."""
    return chunks.select("id", F.explode(F.array_distinct(F.transform(T.extract_all("text", T.TOKEN), lambda t: F.lower(t)))).alias("token"))


#: Newest rows that are asked for all terms of a batch; only terms with too few hits among them are looked for in all rows.
NEWEST_ROWS = 16_384


def substring_candidates(questions: DataFrame, index: Index, limit: int, most: int = DEFAULTS.substring_terms, newest_rows: int = NEWEST_ROWS) -> DataFrame:
    """query_id, id: the newest rows that hold any of the first ``most`` keywords.

    The newest rows of a question are among the newest of its terms, so every term gives at most ``limit`` rows before questions are joined.
    A term that fills its limit among the newest rows of all is settled by them; the others are looked for in all rows.
    """
    limit = max(8, limit)
    q = questions.select("query_id", F.explode(F.slice("kw", 1, most)).alias("term"))
    terms = cut(numbered_terms(q.groupBy("query_id").agg(F.collect_list("term").alias("kw"))), "sub-terms")
    q = cut(q.join(small(terms), "term").select("query_id", "no"), "sub-asked")
    order = (F.col("uploaded_at").desc(), F.col("id").desc())
    newest = lambda key: F.row_number().over(W.partitionBy(key).orderBy(*order))
    first = cut(index.rows.select("id", "uploaded_at").orderBy(*order).limit(newest_rows), "sub-rows")
    best = lambda rows: rows.withColumn("rank", newest("no")).filter(F.col("rank") <= limit).select("no", "id", "uploaded_at")
    here = rows_of_terms(terms, index, first.select("id")).select("id", F.explode("inside").alias("no")).join(small(first), "id")
    here = cut(best(here), "sub-newest")
    full = here.groupBy("no").count().filter(F.col("count") >= limit)
    rest = cut(terms.join(full, "no", "left_anti"), "sub-rest")
    there = rows_of_terms(rest, index).select("id", F.explode("inside").alias("no")).join(index.rows.select("id", "uploaded_at"), "id")
    rows = here.join(full, "no", "left_semi").unionByName(cut(best(there), "sub-older"))
    rows = rows.join(small(q), "no").select("query_id", "id", "uploaded_at").distinct()
    return rows.withColumn("rank", newest("query_id")).filter(F.col("rank") <= limit).select("query_id", "id")


def texts_of(chunks: DataFrame, rows: DataFrame) -> DataFrame:
    """The chunks (or vectors) whose id stands in rows, which are few: others don't move."""
    return chunks.join(small(rows.select("id").distinct()), "id", "left_semi")


def spread(rows: DataFrame, key: str = "id") -> DataFrame:
    """Few bytes with much work a row: a number of tasks that isn't cut down by their size."""
    spark = rows.sparkSession
    return rows.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), key)


def lexical_score(kw: Column, tokens: Column, low: Column, bonus: float = DEFAULTS.substring_bonus) -> Column:
    """Share of keywords among the row's tokens, plus the bonus for keywords of three characters or more inside its lower-case text.

    For candidate pairs only: their number is bounded per question, while pairs that share some frequent word are not.
    """
    overlap = F.size(F.array_intersect(kw, tokens)) / F.size(kw)
    inside = F.size(F.filter(kw, lambda k: (F.length(k) >= 3) & (low.contains(k))))
    extra = F.least(F.lit(bonus), bonus * inside / F.size(kw))
    # without a hit inside the bonus is 0
    return F.when((F.size(kw) == 0) | (F.size(tokens) == 0), 0.0).otherwise(F.least(F.lit(1.0), overlap + extra))


def lexical_share(asked: Column, long: Column, exact: Column, inside: Column, bonus: float = DEFAULTS.substring_bonus) -> Column:
    """The same from numbers of terms: the question's, those of three characters or more, and the row's (see rows_of_terms)."""
    n = F.size(asked)
    extra = F.least(F.lit(bonus), bonus * F.size(F.array_intersect(long, inside)) / n)
    return F.when(n == 0, 0.0).otherwise(F.least(F.lit(1.0), F.size(F.array_intersect(asked, exact)) / n + extra))


def heading_boost(kw: Column, heads: Column, heading: Column, s: Settings = DEFAULTS) -> Column:
    """Boost of a row by its heading path: the lexical score of the path's distinct tokens and its lower-case text."""
    return F.least(F.lit(s.structure_boost), s.structure_boost * lexical_score(kw, heads, heading, s.substring_bonus))


def dot(a: Column, b: Column) -> Column:
    """Dot product in doubles."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def dense_pairs(query_vectors: DataFrame, vectors: DataFrame, found: DataFrame) -> DataFrame:
    """query_id, id, semantic: dot products of the given pairs whose dimensions agree."""
    q = query_vectors.select("query_id", F.col("v").alias("qv"), F.col("dim").alias("qdim"))
    found = found.select("query_id", "id").distinct()
    pairs = found.join(texts_of(vectors, found), "id").join(q, "query_id").filter("dim = qdim")
    return pairs.select("query_id", "id", dot(F.col("v"), F.col("qv")).alias("semantic"))


def dense(query_vectors: DataFrame, vectors: DataFrame, candidates: DataFrame, limit: int) -> DataFrame:
    """query_id, id, semantic: the best ``limit`` of the candidates by dot product; dimensions must agree."""
    scored = dense_pairs(query_vectors, vectors, candidates)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.round("semantic", 9).desc(), F.col("id")))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= limit).drop("rank")


def dense_blocks(queries: DataFrame, vectors: DataFrame, limit: int, block: int = 4096) -> DataFrame:
    """query_id, id, semantic: the best ``limit`` of all vectors for every query, exact.

    Queries (query_id, v, dim) go in blocks of at most ``block`` vectors, which are sent to the executors; each Arrow batch of vectors is
    multiplied with the block and keeps its best rows per query, so that what is shuffled grows with batches times ``limit``, not with pairs.
    """
    from collections.abc import Iterator

    import numpy as np
    import pyarrow as pa

    spark = vectors.sparkSession
    numbered = cut(queries.select("query_id", "v", "dim"), "dense-queries")
    blocks = -(-numbered.count() // block)
    out = None
    for no in range(blocks):
        held = numbered.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == no).collect()  # about one block
        by_dim = {d: ([r.query_id for r in held if r.dim == d], np.array([r.v for r in held if r.dim == d], float)) for d in {r.dim for r in held}}
        given = spark.sparkContext.broadcast(by_dim)

        def run(batches: Iterator[pa.RecordBatch], given=given) -> Iterator[pa.RecordBatch]:
            for t in batches:
                ids, dims = t.column(0).to_numpy(zero_copy_only=False), t.column(2).to_numpy(zero_copy_only=False)
                for d, (names, q) in given.value.items():
                    at = np.flatnonzero(dims == d)
                    if not len(at):
                        continue
                    v = np.array(t.column(1).take(pa.array(at)).flatten().to_numpy(zero_copy_only=False), float).reshape(len(at), d)
                    scores = v @ q.T
                    k = min(limit, len(at))
                    # ties at the limit are kept here and cut by the window below
                    floor = np.partition(scores, len(at) - k, axis=0)[len(at) - k]
                    row, col = np.nonzero(scores >= floor[None, :] - 1e-9)
                    yield pa.RecordBatch.from_arrays([pa.array([names[c] for c in col.tolist()], pa.int64()), pa.array(ids[at][row], pa.int64()), pa.array(scores[row, col])], ["query_id", "id", "semantic"])

        part = vectors.select(F.col("id").cast("long").alias("id"), "v", F.col("dim").cast("int").alias("dim")).mapInArrow(run, "query_id long, id long, semantic double")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], "query_id long, id long, semantic double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.round("semantic", 9).desc(), F.col("id")))
    return out.withColumn("rank", rank).filter(F.col("rank") <= limit).drop("rank")


def recency(uploaded_at: Column, now_ts: int, half_life_days: float) -> Column:
    """Half-life decay of the age; 0 without a time."""
    days = F.greatest(F.lit(now_ts) - uploaded_at, F.lit(0)) / 86400.0
    return F.when(F.coalesce(uploaded_at, F.lit(0)) == 0, 0.0).otherwise(F.pow(F.lit(0.5), days / half_life_days))


def codes(c) -> Column:
    """Distinct digit runs of two to four digits, sorted."""
    return F.array_sort(F.array_distinct(F.filter(T.extract_all(c, "[0-9]+"), lambda d: F.length(d).between(2, 4))))


def literals(c) -> Column:
    """Hard anchors of a question: quoted phrases, codes, tokens that mix letters with digits or - _ /."""
    quoted = F.transform(F.regexp_extract_all(T.text(c), F.lit("[\"'“”‘’]([^\"'“”‘’]{2,})[\"'“”‘’]"), F.lit(1)), lambda x: F.lower(T.collapse(x)))
    mixed = F.filter(F.transform(T.extract_all(c, r"[0-9A-Za-zㄱ-ㆎ가-힣][0-9A-Za-zㄱ-ㆎ가-힣_\-/]{2,40}"), lambda x: F.lower(x)), lambda x: x.rlike("[a-z]") & x.rlike("[0-9_/-]"))
    return F.array_distinct(F.concat(F.filter(quoted, lambda x: F.length(x) >= 2), codes(c), mixed))


def literal_score(text: Column, lits: Column) -> Column:
    """Share of the anchors found; digits must stand alone."""
    low = F.lower(T.text(text))
    return literal_share(low, F.regexp_extract_all(low, F.lit("[0-9]+"), F.lit(0)), lits)


def literal_share(low: Column, digits: Column, lits: Column) -> Column:
    """The same from the lower-case text and its digit runs."""
    hit = F.filter(lits, lambda x: F.when(x.rlike("^[0-9]+$"), F.array_contains(digits, x)).otherwise(low.contains(x)))
    return F.when(F.size(lits) > 0, F.size(hit) / F.size(lits)).otherwise(0.0)


# fixed values: words of questions about codes
CODE_HINTS = ("code", "class", "category", "number", "id")


def code_match(query: Column, text: Column) -> Column:
    """2: a code of the question stands in the text; 1: the question names none and the text has one; else 0."""
    return code_level(T.any_in(T.compact(query), CODE_HINTS), codes(query), codes(text))


def code_level(asks: Column, mine: Column, theirs: Column) -> Column:
    """The same from the codes of both."""
    return F.when(asks & (F.size(mine) > 0) & F.arrays_overlap(mine, theirs), 2).when(asks & (F.size(mine) == 0) & (F.size(theirs) > 0), 1).otherwise(0)


# fixed values: table markers and header words of numeric questions
ROW_SUMMARY, ROW_MEANING = "표행요약:", "표의미: kind=table_row"
HEADER_WORDS = ("rate", "amount", "cost", "period", "date", "cycle", "count", "base", "month", "quarter", "year", "interval")
PAGED = ("pdf", "hwpx", "xlsx")


def alias_boost(query, text, key: Column | None = None) -> Column:
    """0.06 if the question or one of its words stands in a table text, separators aside; 0.04 if they share an alias. key: the text's, if at hand."""
    mine, body = T.alias_key(query), T.alias_key(text) if key is None else key
    words = F.filter(F.transform(T.extract_all(query, "[0-9A-Za-z가-힣]{3,}"), lambda x: T.alias_key(x)), lambda x: F.length(x) >= 3)
    keys = lambda c: F.filter(F.transform(name_aliases(T.text(c)), lambda x: T.alias_key(x)), lambda x: x != "")
    inside = (F.instr(body, mine) > 0) | F.exists(words, lambda w: F.instr(body, w) > 0)
    return F.when(F.length(mine) < 2, 0.0).when(inside, 0.06).when(F.arrays_overlap(keys(query), keys(text)), 0.04).otherwise(0.0)


def _headers(c) -> Column:
    """The header words that stand in a question or a text."""
    return F.filter(F.array(*map(F.lit, HEADER_WORDS)), lambda w: F.instr(T.text(c), w) > 0)


def tabular_features(text, source_type: Column, page_parser: Column, table_like: Column) -> Column:
    """What the table boost needs of a text: marked, summary, aliased (it has a mark that aliases look for), page, headers."""
    v = T.text(text)
    paged = source_type.isin(*PAGED)
    summary = v.contains(ROW_SUMMARY) | v.contains(ROW_MEANING) | paged & v.contains("|") & (F.length(v) >= 40)
    aliased = T.any_in(v, ("표행요약:", "표값:", "표의미:"))
    return F.struct(T.any_in(v, rules.TABLE_MARKS).alias("marked"), summary.alias("summary"), aliased.alias("aliased"), (paged & (summary | page_parser.startswith("paddleocr") | table_like)).alias("page"), _headers(v).alias("headers"))


def tabular_score(numeric: Column, headers: Column, t: Column, alias: Column) -> Column:
    """Boost from the question's part (does it ask for figures? its header words), the text's, and what their aliases add."""
    shared = F.size(F.array_intersect(headers, t["headers"]))
    header = F.when(shared > 0, F.least(F.lit(0.12), 0.03 * shared)).when(t["summary"] & t["marked"], 0.06).otherwise(0.0)
    more = F.when(t["marked"], 0.08).otherwise(0.0) + F.when(t["summary"], 0.06).otherwise(0.0) + header + alias + F.when(t["page"], 0.03).otherwise(0.0)
    return F.when(t["marked"] & t["summary"], 0.08).otherwise(0.0) + F.when(numeric, more).otherwise(0.0)


def tabular_boost(query, text, source_type: Column, page_parser: Column, table_like: Column) -> Column:
    """Boost of table texts, above all for questions that ask for figures."""
    t = tabular_features(text, source_type, page_parser, table_like)
    return tabular_score(rules.numeric_question(query), _headers(query), t, F.when(t["aliased"], alias_boost(query, text)).otherwise(0.0))


def weak_penalty(weak: Column, signal: Column) -> Column:
    """A placeholder text counts less if nothing else speaks for it."""
    return F.when(weak & (signal <= 0.001), 0.08).when(weak & (signal <= 0.03), 0.04).otherwise(0.0)


def candidates(full: DataFrame, near: DataFrame, concept: DataFrame | None = None, ontology: DataFrame | None = None) -> DataFrame:
    """query_id, id, the scores fts, concept, ontology of the rows that any generator has found, and own (found without facts)."""
    zero = F.lit(0.0)
    own = lambda rows, **scores: rows.select("query_id", "id", *[scores.get(c, zero).alias(c) for c in ("fts", "concept", "ontology")], F.lit("ontology" not in scores).alias("own"))
    rows = own(full, fts=F.lit(1.0)).unionByName(own(near))
    if concept is not None:
        rows = rows.unionByName(own(concept, concept=F.col("score")))
    if ontology is not None:
        rows = rows.unionByName(own(ontology, ontology=F.col("score")))
    return rows.groupBy("query_id", "id").agg(*[F.max(c).alias(c) for c in ("fts", "concept", "ontology", "own")])


def asked_features(questions: DataFrame, terms: DataFrame) -> DataFrame:
    """What scores need of a question: its terms by number, anchors (digits and others), codes, hints. One row for each question that has its keywords."""
    numbers = questions.select("query_id", F.explode("kw").alias("term")).join(small(terms), "term").groupBy("query_id").agg(F.collect_list("no").alias("nos"), F.collect_list(F.when(F.length("term") >= 3, F.col("no"))).alias("longs"))
    none = F.array().cast("array<bigint>")
    digit = lambda x: x.rlike("^[0-9]+$")
    q = questions.withColumn("lits", literals("query")).join(numbers, "query_id", "left")
    return q.select(
        "query_id", "query", "kw", F.coalesce("nos", none).alias("nos"), F.coalesce("longs", none).alias("longs"), F.size("lits").alias("n_lits"), F.filter("lits", digit).alias("digit_lits"), F.filter("lits", lambda x: ~digit(x)).alias("text_lits"),
        codes("query").alias("asked_codes"), T.any_in(T.compact("query"), CODE_HINTS).alias("asks"), rules.numeric_question("query").alias("numeric"), _headers("query").alias("asked_headers"),
    )


def scored(
    questions: DataFrame, index: Index, chunks: DataFrame, query_vectors: DataFrame, vectors: DataFrame, concept: DataFrame | None = None, ontology: DataFrame | None = None,
    boosts: DataFrame | None = None, roles: tuple[str, ...] = (), s: Settings = DEFAULTS, top_k: int | None = None,
) -> DataFrame:
    """All candidates of a batch of questions with the components of their score and their rank (see search).

    Rows are scored from the index; chunks (id, text) are read only for pairs whose question has an anchor that isn't a
    number, or asks for figures and meets a table text.
    """
    top_k = top_k or s.top_k
    target = max(s.candidates, top_k, 6 * top_k if roles else 0)
    q = cut(with_keywords(questions), "search-questions")
    budget = max(2 * target, 4 * top_k)

    def numbered() -> tuple[DataFrame, DataFrame]:
        terms = numbered_terms(q)
        return terms, cut(asked_features(q, terms), "search-asked")

    keep = lambda rows, label, *cols: cut(rows.select(*cols), label) if rows is not None else None
    near, (terms, asked), full, concept, ontology, boosts = together(
        lambda: cut(substring_candidates(q, index, budget, s.substring_terms), "search-substring"), numbered, lambda: cut(bm25(q, index, budget, terms=s.fts_terms), "search-words"),
        lambda: keep(concept, "search-concepts", "query_id", "id", "score"), lambda: keep(ontology, "search-facts", "query_id", "id", "score"), lambda: keep(boosts, "search-boosts", "id", "boost"),
    )
    found = cut(candidates(full, near, concept, ontology), "search-candidates")
    ids = cut(found.select("id").distinct(), "search-ids")
    held = rows_of_terms(terms, index, ids)
    semantic = dense(query_vectors, vectors, found, target)
    rows = found.join(semantic, ["query_id", "id"], "left").na.fill(0.0, ["semantic"])
    rows = rows.withColumn("fts_w", F.when(F.max("fts").over(W.partitionBy("query_id")) > 0, s.fts_weight).otherwise(0.0))
    body = index.rows.join(small(ids), "id", "left_semi")
    if roles:
        body = body.filter(F.col("doc_role").isin(*roles))
    none = F.array().cast("array<bigint>")
    body = body.join(held, "id", "left").withColumns({"exact": F.coalesce("exact", none), "inside": F.coalesce("inside", none)})
    body = body.join(boosts.select("id", F.col("boost").alias("memory")), "id", "left").na.fill(0.0, ["memory"]) if boosts is not None else body.withColumn("memory", F.lit(0.0))
    body = cut(body, "search-rows")
    rows = spread(rows).join(small(asked), "query_id").join(body, "id")
    textual = (F.size("text_lits") > 0) | F.col("numeric") & F.col("table.aliased")
    near = cut(rows.filter(textual).select("query_id", "id", "query", "text_lits", F.col("table.aliased").alias("aliased")), "search-textual")
    near = near.join(texts_of(chunks, near).select("id", F.lower(T.text("text")).alias("low")), "id")
    near = near.select("query_id", "id", F.size(F.filter("text_lits", lambda x: F.col("low").contains(x))).alias("text_hits"), F.when(F.col("aliased"), alias_boost("query", "low")).otherwise(0.0).alias("alias"))
    rows = rows.join(near, ["query_id", "id"], "left").na.fill(0, ["text_hits"]).na.fill(0.0, ["alias"])
    literal = F.when(F.col("n_lits") > 0, (F.size(F.array_intersect("digit_lits", "digits")) + F.col("text_hits")) / F.col("n_lits")).otherwise(0.0)
    rows = rows.withColumns({
        "lexical": lexical_share(F.col("nos"), F.col("longs"), F.col("exact"), F.col("inside"), s.substring_bonus), "literal": literal, "code": code_level(F.col("asks"), F.col("asked_codes"), F.col("codes")),
        "structure": heading_boost(F.col("kw"), F.col("heads"), F.col("heading"), s), "tabular": tabular_score(F.col("numeric"), F.col("asked_headers"), F.col("table"), F.col("alias")),
        "recency": recency(F.col("uploaded_at"), s.now_ts, s.half_life_days),
    })
    weak = weak_penalty(F.col("weak"), F.greatest("concept", "semantic", "fts", "lexical", "literal"))
    score = (
        F.greatest(F.lit(0.0), 1 - s.lexical_weight - F.col("fts_w")) * F.col("semantic") + s.lexical_weight * F.col("lexical") + s.concept_weight * F.col("concept") + s.ontology_weight * F.col("ontology")
        + F.col("fts_w") * F.col("fts") + s.literal_boost * F.col("literal") + s.recency_boost * F.col("recency") + F.col("structure") + F.col("memory") + F.col("tabular") - weak
        + F.when(F.col("code") == 2, s.code_boost).when(F.col("code") == 1, s.code_boost * s.code_hint_ratio).otherwise(0.0) - s.normalized_penalty * F.col("is_normalized")
    )
    rows = rows.withColumn("score", F.round(score, 6))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("uploaded_at").desc(), F.col("id").desc()))
    keep = ["query_id", "id", "score", "fts", "lexical", "semantic", "concept", "ontology", "literal", "recency", "structure", "memory", "tabular", "code", "own", "uploaded_at"]
    return cut(rows.select(keep).withColumn("rank", rank), "search-scored")


def search(
    questions: DataFrame, chunks: DataFrame, query_vectors: DataFrame, vectors: DataFrame, concept: DataFrame | None = None, ontology: DataFrame | None = None,
    boosts: DataFrame | None = None, roles: tuple[str, ...] = (), s: Settings = DEFAULTS, top_k: int | None = None, index: Index | None = None,
) -> DataFrame:
    """The fused ranking: query_id, id, rank, score and a column for each component.

    questions: query_id, query. chunks: as for index.build, which is called if no index is given. concept, ontology: query_id, id, score.
    boosts: id, boost. roles: only these are ranked.
    """
    top_k = top_k or s.top_k
    return scored(questions, index or build(chunks), chunks, query_vectors, vectors, concept, ontology, boosts, roles, s, top_k).filter(F.col("rank") <= top_k)
