"""Levels of the template tree: no templates out of chance, those that are there are found."""

import time

import numpy as np
import pytest

from docloom.llm import line_dedup


def dropped(spark, lines):
    rows = [(i, f"{t}\nown line of document q{i}x only") for i, t in enumerate(lines)]
    out = line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    return {r.doc_id for r in out if lines[r.doc_id] not in r.text}


@pytest.mark.parametrize("choices", [4, 20, 200])
def test_random_lines_are_no_templates(spark, choices):
    rng = np.random.default_rng(choices)
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(choices)]
    lines = list(dict.fromkeys("the same start " + " ".join(rng.choice(words, 8)) for _ in range(300)))
    began = time.perf_counter()
    assert dropped(spark, lines) == set()
    assert time.perf_counter() - began < 60


def test_templates_among_random_lines(spark):
    rng = np.random.default_rng(9)
    name = lambda: "".join(rng.choice(list("abcdefgh"), 6))
    real = [f"the same start user {name()} opened the door of {name()}" for _ in range(20)] + [f"the same start of {name()} was lost on disk {name()}" for _ in range(12)] + [f"the same start has {name()} more words than {name()} had" for _ in range(8)]
    noise = ["the same start " + " ".join(name() for _ in range(7)) for _ in range(150)]
    assert dropped(spark, real + noise) == set(range(len(real)))
