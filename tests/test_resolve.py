"""Concept resolution against the sequential pass."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.operators import resolve as R


def sequential(terms, threshold):
    """term to (node, score), in the given order."""
    runs = lambda t: {f"^{t}$"[i : i + 3] for i in range(max(1, len(t)))}
    nodes, out = [], {}
    for t in terms:
        if t in out:
            continue
        f = runs(t)
        best, score = None, 0.0
        for name, g in nodes:
            s = round(len(f & g) / math.sqrt(len(f) * len(g)), 9)
            if s > score:
                best, score = name, s
        if best is not None and score >= threshold:
            out[t] = (best, score)
        else:
            nodes.append((t, f))
            out[t] = (t, 1.0)
    return out


@pytest.mark.parametrize("threshold", [0.84, 0.5])
def test_resolve(spark, threshold):
    rng = np.random.default_rng(1)
    syllables = ["ka", "to", "mi", "ra", "sen", "lo"]
    words = ["".join(rng.choice(syllables, rng.integers(1, 9))) for _ in range(400)]
    words += [w + str(rng.choice(["s", "n", "x", ""])) for w in words[:200]] + ["a", "ab", "가구", "가구원", ""]
    rng.shuffle(words)
    rows = [(str(w), i) for i, w in enumerate(words)] + [(None, 3)]
    out = R.resolve(spark.createDataFrame(rows, "term string, at int").repartition(5), [F.col("at")], threshold).collect()
    want = sequential([str(w) for w in words if w], threshold)
    assert Counter(r.term for r in out) == Counter(want.keys())
    assert {r.term: (r.node, round(r.score, 9)) for r in out} == want
    assert 0 < sum(t != n for t, (n, _) in want.items()) < len(want)


def test_chains_follow_the_order(spark):
    """a ~ b ~ c without a ~ c: b is an alias of a, so c is a node."""
    pairs = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (4, 5), (6, 7)], "a long, b long")
    assert sorted(r.a for r in R.fold(pairs).collect()) == [1, 3, 5, 6]
    assert R.resolve(spark.createDataFrame([], "term string, at int"), [F.col("at")]).count() == 0
    with pytest.raises(ValueError):
        R.resolve(pairs, [], 0.0)
