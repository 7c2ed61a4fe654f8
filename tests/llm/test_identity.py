"""Rows that repeat, share or lack a doc_id: no text is lost, one row of each group stays."""

from collections import Counter

import pytest

from docloom.llm import common, components, exact_dedup, line_dedup, mixing, near_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k long, root string, own int"
W = [f"w{i}" for i in range(60)]
BASE = " ".join(W)
NEAR = " ".join([*W[:-2], "other", "end"])
ROWS = [
    (1, BASE), (2, BASE), (2, "another unique text of the second row"), (3, NEAR), (4, "first text under four"), (4, "second text under four"),
    (5, "twice the same row"), (5, "twice the same row"), (None, BASE), (None, "no id at all"), (None, "no id at all"), (6, None), (7, ""), (7, " "),
]


def frame(spark, rows=ROWS):
    return spark.createDataFrame([(*r, "en", "a" if (r[0] or 0) % 2 else None, 1, 9, "clash", 3) for r in rows], SCHEMA)


def texts(df):
    return Counter((r.doc_id, r.text) for r in df.collect())


def test_exact_dedup(spark):
    kept = exact_dedup.drop_copies(frame(spark))
    assert kept.columns == frame(spark).columns
    want = {(1, BASE), (2, ROWS[2][1]), (3, NEAR), *ROWS[4:6], ROWS[6], ROWS[9], (6, None), (7, " ")}
    assert texts(kept) == Counter(want)
    out = Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(frame(spark)).collect())
    assert out[2, 1, 3, False] == out[2, 2, 1, True] == out[None, 1, 3, False] == 1 and out[None, None, 2, True] == 2 and out[5, 5, 2, True] == 2 and out[7, 6, 2, False] == 1


def test_index_of_many_batches(spark):
    rows = [(i, f"text {i % 37}") for i in range(200)]
    index = exact_dedup.Index()
    runs = [exact_dedup.flush_runs(frame(spark, rows[k : k + 30])) for k in range(0, 200, 30)]
    for r in runs:
        index.add(r)
    assert len(index.levels) <= exact_dedup.FAN
    whole = exact_dedup.Index()
    whole.add(exact_dedup.flush_runs(frame(spark, rows)))
    want = {bytes(r.digest): (r.keep_id, r.group_size) for r in whole.lookup(runs[0]).collect()}
    for r in runs:
        got = {bytes(x.digest): (x.keep_id, x.group_size) for x in index.lookup(r).collect()}
        assert got and got.items() <= want.items()


def test_near_dedup(spark):
    out = Counter((r.doc_id, r.component_id, r.kept) for r in near_dedup.near_dedup(frame(spark)).collect())
    assert out == Counter([(1, 1, True), (2, 1, False), (2, 2, True), (3, 1, False), *[(4, 4, True)] * 2, *[(5, 5, True)] * 2, (None, 1, False), *[(None, None, True)] * 2, (6, 6, True), *[(7, 7, True)] * 2])
    kept = near_dedup.drop_near_copies(frame(spark))
    assert kept.columns == frame(spark).columns
    assert texts(kept) == Counter([(1, BASE), ROWS[2], *ROWS[4:7], ROWS[9], (6, None), (7, ""), (7, " ")])
    # two near copies under the id that stays: one of them
    both = near_dedup.drop_near_copies(frame(spark, [(1, BASE), (1, NEAR), (2, BASE + " more")])).collect()
    assert len(both) == 1 and both[0].doc_id == 1
    assert near_dedup.drop_near_copies(frame(spark, [])).count() == 0


def test_line_dedup(spark):
    rows = [(1, "keep me unique alpha"), (1, "shared by all\nown one"), (2, "shared by all\nown two"), (3, "shared by all\nown three"), (2, "shared by all\nown two"), (None, "shared by all")]
    got = Counter((r.doc_id, r.text) for r in line_dedup.line_dedup(frame(spark, rows)).collect())
    assert got == Counter([(1, "keep me unique alpha"), (1, "own one"), (2, "own two"), (2, "own two"), (3, "own three"), (None, "shared by all")])


def test_line_dedup_long_text(spark):
    """A text of 20,000 lines, every second of which recurs."""
    lines = [f"line that stays number x{chr(97 + i % 26)}{'y' * (i // 26 % 40)}{'z' * (i // 1040)}" if i % 2 else "recurring line of all" for i in range(20_000)]
    rows = [(1, "\n".join(lines)), (2, "recurring line of all"), (3, "recurring line of all\n")]
    out = {r.doc_id: r for r in line_dedup.line_dedup(frame(spark, rows)).collect()}
    assert out[1].n_lines == 20_000 and out[1].n_dropped == 10_000 and out[1].text == "\n".join(x for i, x in enumerate(lines) if i % 2)
    assert out[2].text == "" and out[3].text == ""


def test_mixed_rows(spark):
    """Every row plays its own part: ids that are null or repeat don't drop or multiply others."""
    rows = [(None, f"null row {i} of six words") for i in range(30)] + [(1, "repeated row")] * 4 + [(2, "one text"), (2, "quite another text")] + [(i, f"row {i} here") for i in range(10, 40)]
    docs = frame(spark, rows)
    played = texts(mixing.mixed_rows(docs))
    want = Counter()
    for r in mixing.plays(docs).collect():
        want[r.doc_id, r.text] += r.plays
    assert played == Counter({k: v for k, v in want.items() if v})
    assert sum(v for (i, _), v in played.items() if i is None) > 0 and mixing.mixed_rows(docs).columns == docs.columns
    assert mixing.mixed_rows(frame(spark, [])).count() == 0


def test_components_raise_when_unfinished(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)], "a long, b long")
    with pytest.raises(RuntimeError):
        components.components(edges, most_rounds=1)


def test_shared_folder_is_demanded_on_a_cluster():
    class Conf:
        def get(self, *_):
            return None

    class Cluster:
        conf = Conf()
        sparkContext = type("c", (), {"master": "yarn", "applicationId": "a"})

    with pytest.raises(ValueError):
        common.shared_dir(Cluster())
