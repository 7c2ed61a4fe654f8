"""Fingerprints and components against plain code over all pairs."""

from collections import Counter

import numpy as np
import pytest
import xxhash

from docloom.llm import simhash

DOCS = "doc_id long, text string, fp long, component_id string, lang string"


def plain(text):
    raw = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        raw = raw.replace(c, " ")
    words = [w for w in raw.split(" ") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(rows):
    """{position: smallest doc_id reachable}; rows: (doc_id, fingerprint)."""
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (_, x) in enumerate(rows):
        for j in range(i):
            if (x ^ rows[j][1]).bit_count() <= 2:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [least.get(find(i)) for i in range(len(rows))]


def brute(docs):
    rows = [(d, plain(t)) for d, t in docs]
    return Counter((d, f"{x:016x}", c) for (d, x), c in zip(rows, components(rows), strict=True))


def run(spark, docs):
    out = simhash.simhash(spark.createDataFrame([(d, t, 1, "c", "en") for d, t in docs], DOCS).repartition(3))
    assert out.columns == ["doc_id", "fingerprint", "component_id"]
    return Counter(map(tuple, out.collect()))


def test_documents(spark):
    rng = np.random.default_rng(3)
    words = np.array([f"W{i}" for i in range(500)])
    docs = []
    for g in range(40):
        base = list(rng.choice(words, rng.integers(1, 300)))
        for _ in range(5):
            new = list(base)
            for _ in range(rng.integers(0, 2 + len(base) // 200)):
                new[rng.integers(len(new))] = str(rng.choice(words))
            docs.append((int(rng.integers(10_000)), (" " if g % 2 else "\n\t").join(new)))
    got = run(spark, docs)
    assert got == brute(docs) and len({c for *_, c in got}) < 180


def test_cases(spark):
    docs = [(9, None), (4, ""), (8, " \t\x0b"), (3, "One"), (2, "one\x0c"), (7, "ÉA b"), (6, "éa b"), (None, "one"), (None, "only here with no id"), (5, "a\x85b a\xa0b c"), (5, "a\x85b a\xa0b c"), (5, "other")]
    assert run(spark, docs) == brute(docs)
    assert run(spark, []) == Counter()


@pytest.mark.parametrize("cell", [1, 8, 2048])
def test_links(spark, monkeypatch, cell):
    """Random balls around few centres: cells of all sizes, by pairs and by middle values, give the components of all pairs."""
    monkeypatch.setattr(simhash, "CELL", cell)
    rng = np.random.default_rng(cell)
    fps = set()
    for _ in range(12):
        centre = int(rng.integers(0, 1 << 63)) << 1
        for _ in range(60):
            x = centre
            for b in rng.integers(0, 64, rng.integers(0, 6)):
                x ^= 1 << int(b)
            fps.add(x)
    fps = sorted(fps)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    pairs = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long")).distinct().collect()
    bits = {s: x for s, x in zip(signed, fps, strict=True)}
    assert all((bits[r.a] ^ bits[r.b]).bit_count() <= 2 for r in pairs)
    label = {r.id: r.component for r in simhash.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = components(list(zip(signed, fps, strict=True)))
    assert [label.get(s, s) for s in signed] == want and len(set(want)) < len(fps) * 0.9


def test_long_texts_go_in_windows(monkeypatch):
    text = "Some  words\nthat " * 400 + "end"
    want = simhash.fingerprint(text.encode())
    assert want == plain(text)
    cut = simhash.windows
    monkeypatch.setattr(simhash, "windows", lambda raw, gap: cut(raw, gap, 50))
    assert simhash.fingerprint(text.encode()) == want
    assert simhash.fingerprint(b"a  b") == plain("a b") and simhash.fingerprint(b" ") == 0
