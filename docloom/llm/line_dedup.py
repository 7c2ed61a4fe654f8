"""Line dedup by a log-template tree [native: DataFrame functions only].

The tree has fixed depth: a line goes down by its number of tokens, then by its leading tokens (a token with a
digit counts as variable); leaves hold the lines of one shape. In a leaf that lines of several documents
reach, positions are compared: a position is constant if its commonest token fills at least CONSTANT of the
leaf's distinct lines, else it is a variable field, as are tokens with digits. A line whose share of matching
constant positions is at least SIMILARITY belongs to the leaf's template. The rest go down further, level by
level: each line by a common token that splits its leaf, and are compared within these smaller leaves, where a
constant needs more than half of the lines and the leading tokens don't count. There are LEVELS levels at most, and a
level's template counts only if chance doesn't explain it: lines that share some tokens turn up in any large leaf
whose positions have few tokens, so the expected number of sets of as many lines that agree in as many positions, if
the tokens of the whole leaf were dealt independently, must be under CHANCE. A line that fits nowhere keeps a template
of its own (the masked line). Templates that occur in at least LEAST_DOCUMENTS documents are recurring: their lines are dropped.

Lines are counted per distinct masked line before anything is grouped by leaf, so a line that a third of all
documents share is one row per task.

Cases: null and empty texts have no lines and stay as they are; blank lines are kept; lines end at \n; a line
that repeats inside one document only isn't recurring; a document is a doc_id with its text: rows with one doc_id
and several texts are several documents, rows equal in both are one (and get equal results), equal texts under
several doc_ids are several; rows with a null doc_id are kept whole; other columns stay. A text is rebuilt in time
linear in its lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import cut, maybe_in

#: Leading tokens that the tree goes down by.
DEPTH = 3
CONSTANT, SIMILARITY = 0.5, 0.6
LEAST_DOCUMENTS = 3
#: Levels below a leaf, and the expected number of chance templates of a leaf that is tolerated.
LEVELS, CHANCE = 4, 0.01
VARIABLE = "<*>"


def template_lines(docs: DataFrame) -> DataFrame:
    """doc_id, v (hash of the text, which tells rows of one id apart), line_no, masked, h1, h2, leaf: every line that has a token, with tokens that hold a digit masked; the hash of the
    masked line (96 bits) and of its place in the tree."""
    lines = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("v"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line_no", "line"))
    # one scan finds the few lines that need work
    odd = F.col("line").rlike(r"[\t\r\x0B\f0-9]|  ")
    single = F.trim(F.regexp_replace("line", r"[ \t\r\x0B\f]+", " "))
    masked = F.when(odd, F.regexp_replace(single, r"(?<![^ ])[^ 0-9]*+[0-9][^ ]*", VARIABLE)).otherwise(F.trim("line"))
    lines = lines.select("doc_id", "v", "line_no", masked.alias("masked")).filter("masked <> ''")
    size = F.octet_length("masked") - F.octet_length(F.replace("masked", F.lit(" "), F.lit(""))) + 1
    leaf = F.xxhash64(size, F.substring_index("masked", " ", DEPTH))
    return lines.select("doc_id", "v", "line_no", "masked", F.xxhash64("masked").alias("h1"), F.hash("masked").alias("h2"), leaf.alias("leaf"))


def templates(lines: DataFrame) -> DataFrame:
    """h1, h2, n, template of the distinct lines in shared leaves (template: tokens with fields)."""
    seen = lines.groupBy("h1", "h2").agg(F.count_distinct("doc_id", "v").alias("n"), F.min("leaf").alias("leaf"), F.min(F.struct("doc_id", "v", "line_no")).alias("at"))
    seen = cut(seen, "line-leaves")
    # leaves that lines of at least LEAST_DOCUMENTS documents reach (an upper bound: sums over distinct lines)
    shared = cut(seen.groupBy("leaf").agg(F.sum("n").alias("m"), F.count(F.lit(1)).alias("lines")).filter(F.col("m") >= LEAST_DOCUMENTS), "line-shared")
    # one text for each distinct line, from the place where it comes first
    firsts = maybe_in(seen, shared, "leaf").join(shared.select("leaf", "lines"), "leaf").select("at.doc_id", "at.v", "at.line_no", "h1", "h2", "leaf", "n", "lines")
    place = ["doc_id", "v", "line_no"]
    texts = maybe_in(lines.select(*place, "masked", "leaf"), shared, "leaf").drop("leaf")
    leaf_lines = cut(firsts.join(texts.dropDuplicates(place), place).drop(*place), "line-texts")
    # a leaf of one line is its own template
    several = leaf_lines.filter("lines > 1")
    shape = cut(_shapes(several, F.col("lines") * CONSTANT), "line-shapes")  # so that the join stands alone and a huge leaf can be split
    level = cut(_fitted(several, shape, 0), "line-level")
    kept = ["h1", "h2", "n", "template"]
    out, rest = level.filter("near"), level.filter("NOT near").withColumn("root", F.col("leaf"))
    own = leaf_lines.filter("lines = 1").select("h1", "h2", "n", F.col("masked").alias("template")).unionByName(rest.select(kept))
    found = None
    for _ in range(LEVELS):
        parts = _split(rest)
        if parts.isEmpty():
            break
        shapes = cut(_shapes(parts, F.floor(F.col("lines") / 2) + 1), "line-shapes")
        level = cut(_believable(_fitted(parts, shapes, DEPTH), shapes, shape), "line-level")
        near, rest = level.filter("near").select(kept), level.filter("NOT near")
        found = near if found is None else found.unionByName(near)
    if found is not None:  # lines that fitted further down no longer stand alone
        own = own.join(found.select("h1", "h2"), ["h1", "h2"], "left_anti").unionByName(found)
    out = out.select(kept).unionByName(own)
    return cut(out.withColumn("t", F.unhex(F.md5("template"))), "line-fit")


def _shapes(rows: DataFrame, least: Column) -> DataFrame:
    """leaf, all (its lines), shape: by position the commonest token, if at least ``least`` of the leaf's lines have it, else a field; agree: the share of
    pairs of lines that have the same token there."""
    counts = rows.select("leaf", "lines", F.posexplode(F.split("masked", " ")).alias("at", "token")).groupBy("leaf", "lines", "at", "token").agg(F.count(F.lit(1)).alias("c"))
    best = counts.groupBy("leaf", "lines", "at").agg(F.max(F.struct("c", "token")).alias("top"), (F.sum(F.col("c") * F.col("c")) / F.first(F.col("lines") * F.col("lines"))).alias("agree"))
    field = best.select("leaf", "lines", "at", "agree", F.when((F.col("top.c") >= least) & (F.col("top.token") != VARIABLE), F.col("top.token")).otherwise(VARIABLE).alias("token"))
    lists = field.groupBy("leaf").agg(F.first("lines").alias("all"), F.array_sort(F.collect_list(F.struct("at", "token", "agree"))).alias("s"))
    return lists.select("leaf", "all", F.transform("s", lambda x: x["token"]).alias("shape"), F.transform("s", lambda x: x["agree"]).alias("agree"))


def _fitted(rows: DataFrame, shape: DataFrame, skip: int) -> DataFrame:
    """rows with near (is the line like the shape of its leaf, judged after the first ``skip`` tokens?) and template."""
    fit = rows.join(shape.select("leaf", "shape"), "leaf").withColumn("k", F.size("shape") - skip)
    same = F.expr(f"size(filter(slice(zip_with(split(masked, ' '), shape, (a, b) -> a = b AND b <> '{VARIABLE}'), {skip + 1}, size(shape)), x -> x))")
    constants = F.expr(f"size(filter(slice(shape, {skip + 1}, size(shape)), x -> x <> '{VARIABLE}'))")
    near = (same >= constants * SIMILARITY) & (constants * 2 >= F.col("k"))
    more = [c for c in ("root",) if c in rows.columns]
    return fit.select("h1", "h2", "n", "leaf", "lines", "masked", *more, near.alias("near"), (same == constants).alias("whole"), F.when(near, F.concat_ws(" ", "shape")).otherwise(F.col("masked")).alias("template"))


def _believable(rows: DataFrame, shapes: DataFrame, roots: DataFrame) -> DataFrame:
    """rows of a level; near only where chance doesn't explain the shape of the leaf. roots: shapes of the leaves of the tree, with the tokens' chances."""
    sets = rows.groupBy("leaf", "root").agg(F.count_if("whole").alias("m"))
    chance = roots.select(F.col("leaf").alias("root"), F.col("all").alias("everyone"), F.col("agree").alias("chances"))
    sets = sets.join(shapes.select("leaf", "shape"), "leaf").join(chance, "root")
    tail = lambda c: F.slice(c, F.lit(DEPTH + 1), F.size("shape"))
    shared = F.filter(F.zip_with(tail("shape"), tail("chances"), lambda a, b: F.when(a != VARIABLE, b)), lambda x: x.isNotNull())
    sets = sets.select("leaf", "m", "everyone", (F.size("shape") - DEPTH).alias("k"), F.size(shared).alias("c"), F.aggregate(shared, F.lit(0.0), lambda a, x: a + F.log(x)).alias("each"))
    pick = lambda n, k: F.when(k > 0, k * (1 + F.log(n / k))).otherwise(0.0)  # noqa: E731  at least the logarithm of n over k
    expected = pick(F.col("everyone"), F.col("m")) + pick(F.col("k"), F.least(F.col("c"), F.col("k") - F.col("c"))) + (F.col("m") - 1) * F.col("each")
    sure = sets.select("leaf", (expected < F.log(F.lit(CHANCE))).alias("sure"))
    near = F.col("near") & F.col("sure")
    return rows.join(sure, "leaf").select("h1", "h2", "n", "leaf", "lines", "masked", "root", near.alias("near"), F.when(near, F.col("template")).otherwise(F.col("masked")).alias("template"))


def _split(rest: DataFrame) -> DataFrame:
    """rest (lines that didn't fit) in smaller leaves; lines is null where a line can't belong to a recurring template any more.

    A leaf that lost its fitting lines is tried again whole. In another, a line goes by its commonest token that at most half of
    the leaf has (else by the rarest that some lack); lines without one stay together. Each new leaf is smaller than the old one,
    and mostly half of it. A line can't fit any part of the leaf if too few of its tokens occur twice in it.
    """
    now = rest.groupBy("leaf").agg(F.count(F.lit(1)).alias("now"))
    rest = cut(rest.select("h1", "h2", "n", "leaf", "lines", "masked", "root").join(now, "leaf").filter("lines > 2"), "line-rest")
    tokens = rest.filter("now = lines").select("h1", "h2", "leaf", "now", F.posexplode(F.split("masked", " ")).alias("at", "token")).filter(F.col("at") >= DEPTH)
    counts = cut(tokens.filter(F.col("token") != VARIABLE).groupBy("leaf", "at", "token").agg(F.count(F.lit(1)).alias("c")).filter("c > 1"), "line-anchors")
    c, half = F.col("c"), F.col("c") * 2 <= F.col("now")
    rank = F.struct(half.alias("half"), F.when(half, c).otherwise(-c).alias("c"), (-F.col("at")).alias("back"), "token")
    best = tokens.join(counts, ["leaf", "at", "token"]).groupBy("h1", "h2").agg(F.max(F.when(c < F.col("now"), rank)).alias("anchor"), F.count(F.lit(1)).alias("shared"))
    rows = rest.join(best, ["h1", "h2"], "left").withColumn("k", F.size(F.split("masked", " ")) - DEPTH)
    able = (F.col("now") < F.col("lines")) | (F.coalesce("shared", F.lit(0)) >= F.col("k") * CONSTANT * SIMILARITY)
    part = F.when(F.col("anchor").isNull(), F.col("leaf")).otherwise(F.xxhash64("leaf", "anchor.back", "anchor.token"))
    rows = cut(rows.filter(able).select("h1", "h2", "n", part.alias("leaf"), F.col("lines").alias("was"), "masked", "root"), "line-split")
    groups = rows.groupBy("leaf").agg(F.count(F.lit(1)).alias("lines"), F.sum("n").alias("m"), F.max("was").alias("was")).filter((F.col("lines") > 1) & (F.col("lines") < F.col("was")) & (F.col("m") >= LEAST_DOCUMENTS))
    return cut(rows.drop("was").join(groups.select("leaf", "lines"), "leaf"), "line-parts")


def recurring(lines: DataFrame) -> DataFrame:
    """h1, h2, template of every line whose template occurs in at least LEAST_DOCUMENTS documents."""
    fit = templates(lines)
    # a template with a form of enough documents is sure; others are counted from their lines (few documents each)
    many = fit.groupBy("t").agg(F.count(F.lit(1)).alias("forms"), F.max("n").alias("most"), F.sum("n").alias("all"))
    sure = many.filter(F.col("most") >= LEAST_DOCUMENTS).select("t")
    open_ = many.filter((F.col("most") < LEAST_DOCUMENTS) & (F.col("forms") > 1) & (F.col("all") >= LEAST_DOCUMENTS)).select("t")
    forms = fit.join(open_, "t").select("t", "h1", "h2")
    counted = lines.select("h1", "h2", "doc_id", "v").join(forms, ["h1", "h2"]).groupBy("t").agg(F.count_distinct("doc_id", "v").alias("k")).filter(F.col("k") >= LEAST_DOCUMENTS).select("t")
    return cut(fit.join(sure.unionByName(counted), "t", "left_semi").select("h1", "h2", "template"), "line-recurring")


def line_dedup(docs: DataFrame) -> DataFrame:
    """docs with ``text`` free of recurring lines, and the columns n_lines, n_dropped (named with a prefix if docs has them)."""
    lines = cut(template_lines(docs.filter("doc_id IS NOT NULL")), "line-all")
    gone = recurring(lines).select("h1", "h2")
    drop = lines.select("doc_id", "v", "line_no", "h1", "h2").join(gone, ["h1", "h2"], "left_semi").groupBy(F.col("doc_id").alias("__id"), F.col("v").alias("__v")).agg(F.collect_set("line_no").alias("__drop"))
    out = docs.withColumn("__id", F.col("doc_id").cast("long")).withColumn("__v", F.xxhash64("text")).join(drop, ["__id", "__v"], "left").drop("__id", "__v")
    text = F.coalesce("text", F.lit(""))
    name = lambda c: c if c not in docs.columns else f"dedup_{c}"
    out = out.withColumn(name("n_lines"), F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).withColumn(name("n_dropped"), F.coalesce(F.size("__drop"), F.lit(0)))
    out = out.withColumn("__lines", F.when(F.col("__drop").isNotNull(), F.split(text, "\n")))
    # what stays lies between neighbouring dropped lines
    out = out.withColumn("__drop", F.array_sort(F.concat(F.array(F.lit(-1)), "__drop", F.array(F.size("__lines")))))
    kept = F.flatten(F.transform(F.sequence(F.lit(1), F.size("__drop") - 1), lambda j: F.slice("__lines", F.col("__drop")[j - 1] + 2, F.col("__drop")[j] - F.col("__drop")[j - 1] - 1)))
    return out.withColumn("text", F.when(F.col("__lines").isNull(), F.col("text")).otherwise(F.concat_ws("\n", kept))).drop("__drop", "__lines")


ORACLE = r"""
WITH l AS (
  SELECT doc_id, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS line_no, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents),
m AS (SELECT doc_id, line_no, regexp_replace(trim(regexp_replace(line, '[ \t\r\x0B\f]+', ' ', 'g'), ' '), '[^ ]*[0-9][^ ]*', '<*>', 'g') AS masked FROM l),
lines AS (SELECT * FROM m WHERE masked <> ''),
seen AS (SELECT masked, count(DISTINCT doc_id) AS n, string_split(masked, ' ') AS toks FROM lines GROUP BY masked),
leafed AS (SELECT *, len(toks) AS k, len(toks)::VARCHAR || ' ' || array_to_string(toks[1:3], ' ') AS leaf FROM seen),
shared AS (SELECT *, count(*) OVER (PARTITION BY leaf) AS lines, sum(n) OVER (PARTITION BY leaf) AS total FROM leafed),
ll AS (SELECT * FROM shared WHERE total >= 3),
cells AS (SELECT leaf, lines, unnest(range(len(toks))) AS pos, unnest(toks) AS token FROM ll),
counts AS (SELECT leaf, lines, pos, token, count(*) AS c FROM cells GROUP BY ALL),
best AS (SELECT leaf, pos, CASE WHEN c >= lines * 0.5 AND token <> '<*>' THEN token ELSE '<*>' END AS token FROM counts
         QUALIFY row_number() OVER (PARTITION BY leaf, pos ORDER BY c DESC, token DESC) = 1),
shape AS (SELECT leaf, list(token ORDER BY pos) AS shape FROM best GROUP BY leaf),
fit AS (SELECT masked, n, CASE WHEN len(list_filter(list_zip(toks, shape), lambda x: x[1] = x[2] AND x[2] <> '<*>')) >= len(list_filter(shape, lambda x: x <> '<*>')) * 0.6
             AND len(list_filter(shape, lambda x: x <> '<*>')) * 2 >= k THEN array_to_string(shape, ' ') ELSE masked END AS template FROM ll JOIN shape USING (leaf)),
rec AS (SELECT template FROM fit JOIN lines USING (masked) GROUP BY template HAVING count(DISTINCT doc_id) >= 3),
gone AS (SELECT doc_id, line_no FROM lines JOIN fit USING (masked) WHERE template IN (SELECT template FROM rec))
SELECT d.doc_id, len(string_split(coalesce(text, ''), chr(10)))::INT AS n_lines, coalesce(x.n, 0)::INT AS n_dropped,
       sha256(CASE WHEN x.n IS NULL THEN coalesce(text, '') ELSE array_to_string(list_transform(list_filter(list_zip(string_split(text, chr(10)), range(len(string_split(text, chr(10))))), lambda p: NOT list_contains(x.ns, p[2])), lambda p: p[1]), chr(10)) END) AS text_sha256
FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n, list(line_no) AS ns FROM gone GROUP BY doc_id) x USING (doc_id)
"""
