"""How many tables the labelling of components writes: each costs a round of tasks over all partitions."""

import numpy as np
from test_operators import brute_components, frame

from docloom.llm import common, components, near_dedup


def written(monkeypatch) -> list[str]:
    """Labels of the tables cut from now on."""
    out, cut_at = [], common.cut_at

    def counted(df, label, options=None):
        out.append(label)
        return cut_at(df, label, options)

    for module in (common, components):
        monkeypatch.setattr(module, "cut_at", counted)
    return out


def test_stars_take_no_round(spark, monkeypatch):
    edges = spark.createDataFrame([(100 * i + j, 100 * i) for i in range(3) for j in range(1, 9)] * 2, "a long, b long")
    names = written(monkeypatch)
    label = {r.id: r.component for r in components.components(edges).collect()}
    assert label == {100 * i + j: 100 * i for i in range(3) for j in range(9)}
    assert names == ["cc", "cc-low", "cc-label"]


def test_random_graphs(spark):
    """Repeated edges, both directions, loops and negative ids."""
    rng = np.random.default_rng(5)
    for n, m in ((40, 30), (60, 60), (30, 90)):
        pairs = [(int(a), int(b)) for a, b in rng.integers(-n, n, (m, 2))]
        pairs += [(b, a) for a, b in pairs[::2]] + pairs[:9]
        root = {x: x for p in pairs if p[0] != p[1] for x in p}
        for _ in root:
            for a, b in pairs:
                if a != b:
                    root[a] = root[b] = min(root[a], root[b])
        rows = components.components(spark.createDataFrame(pairs, "a long, b long").repartition(3)).collect()
        assert len(rows) == len(root) and {r.id: r.component for r in rows} == root


def test_near_dedup_folds_classes_once(spark, monkeypatch):
    """Copies, near copies and rows without words: one table of classes, none of members, and few rounds."""
    base = [f"w{k}" for k in range(60)]
    rows = [(i, " ".join(base[:k] + [f"x{k}"] + base[k + 1 :]) if (k := i % 30) else " ".join(base), "en", "a", 1) for i in range(90)]
    rows += [(200, "", "en", "a", 1), (201, None, "en", "a", 1), (202, "three words only", "en", "a", 1), (203, "three  Words only", "en", "a", 1)]
    names = written(monkeypatch)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_dedup(frame(spark, rows)).collect()}
    assert got == brute_components(rows)
    assert names.count("near-classes") == 1 and not {"near-class-reps", "near-member"} & set(names)
    assert names.count("cc") <= 6
