"""Archives written as files and read back: records, offsets, and trees over both replicas."""

import gzip

import pytest

from docloom.llm import fixity

SCHEMA = "page_id long, url string, html string, file string, digest string"


def pages(spark):
    rows = [(i if i % 9 else None, f"http://x/{i}", f"<p>{'é' * (i % 30)}\r\n\r\nWARC/1.1 not a head") for i in range(300)] + [(7, None, None)] * 3
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA)


@pytest.mark.parametrize("packed", [False, True])
def test_read_archive(spark, tmp_path, packed):
    rows = fixity.records(pages(spark), 3)
    leaves = fixity.leaves(rows)
    bodies = {(r.file, bytes(r.digest)): bytes(r.body) for r in rows.collect()}
    want = sorted((r.file, r.position, bytes(r.digest), r.begin, r.end) for r in leaves.collect())
    for f in range(3):
        parts = [bodies[f, d] for file, _, d, *_ in want if file == f]
        (tmp_path / f"{f}.warc").write_bytes(b"".join(gzip.compress(p) if packed else p for p in parts))
    got = fixity.read_archive(spark, str(tmp_path)).collect()
    at = lambda r: int(r.path.rsplit("/", 1)[1][:1])
    assert sorted((at(r), r.position, bytes(r.digest)) for r in got) == [w[:3] for w in want]
    if not packed:
        assert sorted((at(r), r.position, bytes(r.digest), r.begin, r.end) for r in got) == want
    for r in got:
        data = (tmp_path / f"{at(r)}.warc").read_bytes()[r.begin : r.end]
        assert (gzip.decompress(data) if packed else data) == bodies[at(r), bytes(r.digest)]
        assert r.date == fixity.DATE and r.type == "resource" and r.record_id.startswith("<urn:page:") and bytes(r.block) in data or packed


def test_broken_archives():
    good = b"WARC/1.1\r\nWARC-Type: resource\r\nX: a\r\n  b\r\nContent-Length: 2\r\n\r\nhi\r\n\r\n"
    assert [(a, n, h["x"], b) for a, n, h, b in fixity.parse_records(good * 2)] == [(0, len(good), "a b", b"hi"), (len(good), len(good), "a b", b"hi")]
    for bad in (good[:-3], good + b"junk", good.replace(b"2", b"1"), good.replace(b"WARC/", b"CRAW/")):
        with pytest.raises(ValueError):
            list(fixity.parse_records(bad))


def test_trees_grow_with_files(spark):
    table = spark.createDataFrame([(i, f"http://x/{i}", "a" * (i % 7)) for i in range(600)], "page_id long, url string, html string")
    rows = fixity.records(table, 1)
    assert fixity.height(fixity.leaves(rows)) == 3 and fixity.height(fixity.leaves(rows.limit(0))) == 1
    out = fixity.audit(rows, fixity.worn(rows, 50)).collect()
    bad = {r.position for r in out if r.digest_a != r.digest_b}
    assert bad and {r.position for r in out if not r.intact} == bad and not any(r.root_equal for r in out)


def test_clashing_columns_and_long_records(spark):
    out = fixity.audit_pages(pages(spark).union(spark.createDataFrame([(10_000, "http://long/", "y" * 3_000_000, "f", "d")], SCHEMA))).collect()
    assert len(out) == 304 and max(r.end - r.begin for r in out) > 3_000_000
