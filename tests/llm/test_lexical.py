"""Ranked search against a plain scorer over every document and item."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from docloom.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, lang string, n long, score long, item long, rank int"


def plain(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k=20):
    bags = [(d, Counter(plain(t))) for d, t in docs]
    bags = [(d, b, b.total()) for d, b in bags if b]
    count, length = len(bags), sum(n for *_, n in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    out = []
    for item, text in items:
        asked, scored = Counter(plain(text)), []
        for d, b, n in bags:
            m = 75 + (25 * n * count) // length
            score = sum(q * math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 12 * m)) for t, q in asked.items() if b[t])
            if score > 0:
                scored.append((-score, d is None, d or 0))
        out += [(item, i + 1, None if none else d, -s) for i, (s, none, d) in enumerate(sorted(scored)[:k])]
    return Counter(out)


def run(spark, docs, items, **kw):
    frame = spark.createDataFrame([(d, t, "en", 7, 8, 9, 1) for d, t in docs], DOCS)
    asked = spark.createDataFrame([(i, t, 5) for i, t in items], "item_id long, text string, doc_id long")
    out = lexical.search(frame.repartition(3), asked, **kw)
    assert out.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    return Counter(map(tuple, out.collect()))


def random_docs(n, seed):
    rng = np.random.default_rng(seed)
    words = np.array([f"W{i}" for i in range(400)])
    weights = 1 / np.arange(1, 401)
    return [(i, " ".join(rng.choice(words, rng.integers(1, 120), p=weights / weights.sum()))) for i in range(n)]


def test_against_every_document(spark):
    docs = random_docs(600, 1)
    items = [(i, docs[i * 7][1][:200] + " w1, w1;W2") for i in range(30)]
    assert run(spark, docs, items) == brute(docs, items)
    assert run(spark, docs, items, top_k=3) == brute(docs, items, 3)


def test_small_blocks(spark, monkeypatch):
    """Bounds carry over from block to block, and items are asked in several scans."""
    docs = random_docs(300, 2)
    items = [(i, docs[i][1]) for i in range(9)]
    monkeypatch.setattr(lexical, "ITEMS", 4)
    monkeypatch.setattr(lexical, "POSTINGS", 500)
    assert run(spark, docs, items) == brute(docs, items)


def test_cases(spark):
    docs = [(5, "Éa b_c"), (3, "Éa b c"), (3, "Éa b c"), (None, "éa B"), (1, None), (2, ""), (4, " .,!"), (6, "x\x00y [z] 1`2"), (7, "漢字 ９ éa")]
    items = [(1, "Éa"), (1, "Éa"), (2, None), (3, "?!"), (4, "none"), (None, "Y z 2 2"), (5, "漢字９ 漢字")]
    assert run(spark, docs, items) == brute(docs, items)
    assert run(spark, [], items) == run(spark, docs, []) == run(spark, [(1, None)], items) == Counter()


def test_ties_and_copies(spark):
    docs = [(i, "alpha beta gamma") for i in reversed(range(50))] + [(100 + i, f"own{i} delta") for i in range(200)]
    items = [(1, "beta"), (2, "alpha delta delta")]
    got = run(spark, docs, items)
    assert got == brute(docs, items) and {d for i, _, d, _ in got if i == 1} == set(range(20))


@pytest.mark.parametrize("most", [5, 64])
def test_long_texts_go_in_windows(most):
    text = ("word " * 30 + "x" * 100 + "\x0bLast–one").encode()
    parts = list(lexical.windows(text, lexical._GAP, most))
    assert b"".join(parts) == text and len(parts) > 1
    assert [t for p in parts for t in p.translate(lexical._PLAIN).split()] == next(lexical.terms(text))
