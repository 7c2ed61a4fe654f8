"""Resolution of terms to concept nodes, as one sequential pass would do it, in parallel.

The pass takes terms in order: a term that is similar enough to a node made before becomes an alias of the most similar
one, else a node of its own. A term's fate depends only on the similar terms before it, so the pairs of similar terms are
found first (a set-similarity join), and only they are folded: in each round the terms without an open similar term
before them become nodes and settle all that are similar to them. That gives the same nodes as the pass in order.

A term's vector is its set of three-character runs, and similarity the cosine of two such sets; ``similar_pairs`` takes
any other set of features.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.operators.index import ngrams
from docloom.settings import DEFAULTS
from docloom.tables import cut


def trigrams(terms: DataFrame) -> DataFrame:
    """no, f of terms (no, term): distinct runs of three characters of a term with marks at both ends, as numbers."""
    marked = terms.select("no", F.concat(F.lit("^"), "term", F.lit("$")).alias("marked"))
    return marked.select("no", F.array_distinct(F.transform(ngrams("marked", 3), lambda g: F.xxhash64(g))).alias("f"))


def similar_pairs(terms: DataFrame, threshold: float = DEFAULTS.concept_similarity) -> DataFrame:
    """a, b, score: pairs of terms (no, f: array of distinct longs) with no a < no b whose cosine reaches the threshold.

    Sets whose cosine reaches t differ in size by a factor of t² at most, and a set shares with each similar one at least one of its
    |f| - ceil(t² |f|) + 1 rarest features: only these are joined. Candidates are counted on whole sets.
    """
    square = threshold * threshold
    flat = cut(terms.select("no", F.size("f").alias("n"), F.explode("f").alias("x")), "resolve-features")
    df = flat.groupBy("x").agg(F.count(F.lit(1)).alias("df"))
    # features that one term alone has join nothing, but count in its size
    ranked = flat.join(df, "x").groupBy("no").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("df", "x"))).alias("r"))
    least = F.ceil(F.lit(square) * F.col("n") - 1e-9)
    ranked = cut(ranked.select("no", "n", F.transform("r", lambda v: v["x"]).alias("f"), F.transform(F.slice("r", F.lit(1), (F.col("n") - least + 1).cast("int")), lambda v: v["x"]).alias("prefix")), "resolve-ranked")
    side = lambda s: ranked.select(F.col("no").alias(s), F.col("n").alias(f"n{s}"), F.col("f").alias(f"f{s}"), F.explode("prefix").alias("x"))
    near = (F.col("a") < F.col("b")) & (F.col("na") >= square * F.col("nb") - 1e-9) & (F.col("nb") >= square * F.col("na") - 1e-9)
    pairs = side("a").join(side("b"), "x").filter(near)
    score = F.round(F.size(F.array_intersect("fa", "fb")) / F.sqrt(F.col("na") * F.col("nb")), 9)
    return pairs.select("a", "b", score.alias("score")).filter(F.col("score") >= threshold).distinct()


def fold(pairs: DataFrame, most_rounds: int = 10_000) -> DataFrame:
    """a: the terms of pairs (a before b) that become nodes, in the order of their numbers."""
    open_ = cut(pairs.select("a", "b"), "resolve-open")
    left = cut(open_.select("a").union(open_.select("b")).distinct(), "resolve-left")
    nodes = left.limit(0)
    for _ in range(most_rounds):
        if left.isEmpty():
            return nodes
        # nothing open stands before these
        made = cut(left.join(open_.select(F.col("b").alias("a")), "a", "left_anti"), "resolve-made")
        gone = cut(open_.join(made, "a").select(F.col("b").alias("a")).distinct(), "resolve-gone")
        done = cut(made.union(gone), "resolve-done")
        nodes = cut(nodes.union(made), "resolve-nodes")
        left = cut(left.join(done, "a", "left_anti"), "resolve-left")
        # what has been settled holds nothing up any more; an alias doesn't stand before anything
        open_ = open_.join(done, "a", "left_anti")
        open_ = cut(open_.join(done.withColumnRenamed("a", "b"), "b", "left_anti").select("a", "b"), "resolve-open")
    raise RuntimeError(f"terms are still open after {most_rounds} rounds")


def resolve(terms: DataFrame, order: list[Column], threshold: float = DEFAULTS.concept_similarity) -> DataFrame:
    """term, node, score: for every distinct term (the first in order counts) the node it belongs to; a node's own score is 1.

    terms: term and the columns of order; a null or empty term is left out.
    """
    if not 0 < threshold <= 1 or math.isnan(threshold):
        raise ValueError("a threshold lies between 0 and 1")
    first = terms.filter(F.coalesce("term", F.lit("")) != "").groupBy("term").agg(F.min(F.struct(*order)).alias("__first"))
    # numbers rise with the order: sorted ranges, numbered by partition
    named = cut(first.repartitionByRange("__first", "term").sortWithinPartitions("__first", "term").select(F.monotonically_increasing_id().alias("no"), "term"), "resolve-terms")
    pairs = cut(similar_pairs(trigrams(named), threshold), "resolve-pairs")
    nodes = fold(pairs)
    best = F.max_by(F.struct("a", "score"), F.struct("score", (-F.col("a")).alias("first")))
    # an alias goes to the nearest node before it; of equal ones to the first
    alias = pairs.join(nodes, "a").join(nodes.withColumnRenamed("a", "b"), "b", "left_anti").groupBy("b").agg(best.alias("m")).select(F.col("b").alias("no"), "m.a", "m.score")
    names = named.select(F.col("no").alias("a"), F.col("term").alias("node"))
    alias = cut(alias.join(names, "a").select("no", "node", "score"), "resolve-aliases")
    return named.join(alias, "no", "left").select("term", F.coalesce("node", "term").alias("node"), F.coalesce("score", F.lit(1.0)).alias("score"))
