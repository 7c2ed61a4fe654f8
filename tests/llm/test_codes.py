"""Product codes against a plain Lloyd iteration, and the deltas against full sums."""

import hashlib
import math
from collections import Counter

import numpy as np

from docloom.llm import codes

TABLE = "vec_id long, embedding array<float>, label int, code int, v string"


def brute(rows, parts, entries, rounds):
    kept = [(i, [math.floor(float(np.float32(x)) * 4096) for x in e], lab) for i, e, lab in rows if e is not None and all(x is not None and math.isfinite(x) for x in e) and e and len(e) % parts == 0]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    if not kept:
        return Counter()
    s = len(kept[0][1]) // parts
    books = [[r[1][p * s : (p + 1) * s] for r in kept[:entries]] for p in range(parts)]

    def nearest(v, p):
        x = v[p * s : (p + 1) * s]
        return min((sum((a - b) ** 2 for a, b in zip(x, y, strict=True)), c) for c, y in enumerate(books[p]))

    for _ in range(rounds):
        members = {}
        for _, v, _ in kept:
            for p in range(parts):
                members.setdefault((p, nearest(v, p)[1]), []).append(v[p * s : (p + 1) * s])
        for (p, c), xs in members.items():
            books[p][c] = [sum(col) // len(xs) for col in zip(*xs, strict=True)]
    digest = hashlib.sha256(",".join(str(z) for b in books for y in b for z in y).encode()).hexdigest()
    found = [(i, lab, [nearest(v, p) for p in range(parts)]) for i, v, lab in kept]
    total = Counter()
    for _, lab, n in found:
        total[lab] += sum(d for d, _ in n)
    return Counter((i, "".join(f"{c:02x}" for _, c in n), sum(d for d, _ in n), total[lab], digest) for i, lab, n in found)


def run(spark, rows, **kw):
    out = codes.compress(spark.createDataFrame([(*r, 3, "clash") for r in rows], TABLE).repartition(3), **kw)
    assert out.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    return Counter(map(tuple, out.collect()))


def test_against_full_sums(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(0, 1, (20, 16))
    rows = [(int(i), (centres[rng.integers(20)] + rng.normal(0, 0.1, 16)).tolist(), [0, 1, None][int(rng.integers(3))]) for i in rng.permutation(300)]
    want = brute(rows, 8, 16, 6)
    assert run(spark, rows) == want and len({c for _, c, *_ in want}) > 20
    assert run(spark, rows, parts=4, entries=5, rounds=2) == brute(rows, 4, 5, 2)
    assert run(spark, rows, rounds=0) == brute(rows, 8, 16, 0)


def test_cases(spark):
    nan, inf = math.nan, math.inf
    ok = [[0.1 * i, -0.2, 0.3, 0.0, 1e-5, -1e-5, 2.0, -float(i)] for i in range(4)]
    rows = [(3, ok[0], 1), (3, ok[1], 1), (3, ok[1], 1), (None, ok[2], None), (1, ok[3], None), (0, None, 1), (0, [], 1), (0, [1.0, None] * 4, 1), (0, [nan] * 8, 2), (0, [inf] * 8, 2), (0, [-inf] * 8, 2), (4, ok[0] * 2, 1), (5, [1.0] * 7, 1)]
    assert run(spark, rows) == brute(rows, 8, 16, 6)
    assert run(spark, [(1, None, 1)]) == run(spark, []) == Counter()
    assert run(spark, [(7, ok[1], None)] * 3) == brute([(7, ok[1], None)] * 3, 8, 16, 6)
    [(_, _, error, *_)] = run(spark, [(1, [3e38] * 8, 0)])
    assert error == 0


def test_only_changes_are_summed(spark):
    rows = [([1, 2, 3, 4], None, [0, 1]), ([5, 6, 7, 8], [0, 1], [0, 1]), ([9, 9, 1, 1], [0, 1], [1, 1]), ([-3, 0, 2, 5], [2, 0], [0, 1])]
    got = {(r.part, r.entry): tuple(r)[2:] for r in codes.deltas(spark.createDataFrame(rows, "v array<int>, was array<byte>, code array<byte>"), 2).collect()}
    assert got == {(0, 0): (1, 1 - 9 - 3, 2 - 9), (1, 1): (2, 3 + 2, 4 + 5), (0, 1): (1, 9, 9), (0, 2): (-1, 3, 0), (1, 0): (-1, -2, -5)}
