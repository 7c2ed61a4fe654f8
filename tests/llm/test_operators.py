"""The corpus operators against brute force, exact round trips and odd inputs."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from docloom.llm import bpe, components, exact_dedup, fixity, html_extract, langid, line_dedup, media, mixing, near_dedup, quality
from docloom.llm.queries import tokenizer

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WS = re.compile(r"[\x20\x09-\x0D]+")
LONG = " ".join(f"word{i}" for i in range(30_000))
BASE = " ".join(f"w{i}" for i in range(200))
ODD = [
    (1, None, None, None, None),
    (2, "", "en", "a", 0),
    (3, " \t\n", "en", "a", 3),
    (4, BASE, "en", "a", 9),
    (5, BASE.replace(" ", "  "), "en", None, 9),
    (6, BASE.replace("w100 ", "changed "), "en", "b", 9),
    (7, LONG, "en", "b", 9),
    (8, BASE.upper(), "de", "b", 9),
    (9, "one two", "de", "c", 9),
    (10, "One  Two", "de", "c", 9),
    (11, "Grüße 日本 🎉 'll 123 !!", "de", "c", 9),
    (4, BASE, "en", "a", 9),
]


def frame(spark, rows=ODD):
    return spark.createDataFrame([(*r, "clash", r[0]) for r in rows], SCHEMA + ", digest string, component long")


def norm(t):
    return WS.sub(" ", t or "")


def test_exact_dedup_brute_force(spark):
    got = sorted(map(tuple, exact_dedup.exact_dedup(frame(spark)).collect()), key=str)
    groups = Counter(norm(r[1]) for r in ODD)
    low = {}
    for r in ODD:
        low[norm(r[1])] = min(r[0], low.get(norm(r[1]), 99))
    want = sorted(((r[0], low[norm(r[1])], groups[norm(r[1])], r[0] == low[norm(r[1])], hashlib.sha256(norm(r[1]).encode()).hexdigest()) for r in ODD), key=str)
    assert got == want
    assert exact_dedup.exact_dedup(frame(spark, [])).count() == 0
    kept = exact_dedup.drop_copies(frame(spark))
    assert kept.columns == frame(spark).columns
    assert {r.doc_id for r in kept.collect()} == set(low.values())


def shingles(t):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
    return frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[k : k + 5]) for k in range(len(w) - 4)]) if w else frozenset()


def brute_components(rows):
    sets = {r[0]: shingles(r[1]) for r in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_near_dedup_odd_rows(spark):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_dedup(frame(spark)).collect()}
    assert got == brute_components(ODD)
    assert near_dedup.near_dedup(frame(spark, [])).count() == 0
    # repeated rows stay repeated
    assert near_dedup.near_dedup(frame(spark)).count() == len(ODD)


def test_near_dedup_families(spark):
    """A hot group: copies of a base with one to sixteen words changed, so that similarities lie on both sides of the threshold."""
    rng = np.random.default_rng(3)
    rows = []
    for i in range(160):
        w = [f"b{k}" for k in range(120)]
        for k in rng.choice(120, int(rng.integers(0, 17)), replace=False):
            w[k] = f"x{rng.integers(1e9)}"
        rows.append((i, " ".join(w), "en", "a", 1))
    rows += [(1000 + i, " ".join(f"r{rng.integers(1e9)}" for _ in range(60)) + " a common passage of many words that all of these rows share", "en", "b", 1) for i in range(60)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_dedup(frame(spark, rows)).collect()}
    want = brute_components(rows)
    assert got == want
    assert 1 < len({c for _, c in want.values()}) < 220


def test_register_estimate_follows_jaccard():
    rng = np.random.default_rng(1)
    for size in (40, 400, 4000):
        for share in (0.2, 0.6, 0.9):
            common, own = int(size * share), int(size * (1 - share) / 2)
            x = [np.unique(rng.integers(0, 2**63, common + own, dtype=np.uint64)) for _ in range(2)]
            x[1][: len(x[1])] = np.sort(np.concatenate((x[0][:common], x[1][common:])))
            a, b = (np.unique(v) for v in x)
            j = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            regs = near_dedup.registers([a, b])
            e = near_dedup.estimate(regs[:1], regs[1:], np.array([len(a)]), np.array([len(b)]))[0]
            assert abs(e - j) < 0.2, (size, share, j, e)


def test_components_of_paths(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 200), (200, 150)], "a long, b long")
    got = {r.id: r.component for r in components.components(edges).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 150: 100, 200: 100}


def test_bpe_equals_tiktoken(spark):
    import tiktoken

    path, pattern = tokenizer()
    ranks = bpe.read_ranks(path)
    enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    rows = [*ODD, (20, "aaaaaaaaaaaa  bbbb\n\n\n  c", None, None, None), (21, "<|endoftext|> x", None, None, None), (22, "ab" * 5000, None, None, None)]
    for r in bpe.encode_documents(frame(spark, rows), path, pattern, with_ids=True).collect():
        text = next(x[1] or "" for x in rows if x[0] == r.doc_id)
        ids = enc.encode_ordinary(text)
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.encode_documents(frame(spark, []), path, pattern).count() == 0


def water_fill(sizes):
    """Targets by repeated resharing, as the contract words it."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, target, capped = sum(sizes.values()), {}, set()
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(3 * sizes[s] for s in capped)
        for s in free:
            target[s] = left * weight[s] / sum(weight[x] for x in free)
        over = [s for s in free if target[s] > 3 * sizes[s]]
        if not over:
            return target
        for s in over:
            target[s] = 3 * sizes[s]
            capped.add(s)


def test_mixing_targets_and_bounds(spark):
    rows = [(i, "w " * (1 + i % 50), None, (None, "a", "b", "c", "d")[i % 5] if i % 7 else "hot", None) for i in range(700)]
    out = mixing.mix(frame(spark, rows)).collect()
    src = {r[0]: r[3] for r in rows}
    sizes, taken = Counter(), Counter()
    for r in out:
        sizes[src[r.doc_id]] += r.size
        taken[src[r.doc_id]] += r.taken
        assert 0 <= r.taken <= 3 * r.size
    want = water_fill(sizes)
    for r in out:
        assert r.target == pytest.approx(want[src[r.doc_id]])
        assert r.source_size == sizes[src[r.doc_id]]
    for s, t in want.items():
        assert abs(taken[s] - t) <= max(30, 0.03 * t)
    again = mixing.mix(frame(spark, rows)).collect()
    assert sorted(map(tuple, out)) == sorted(map(tuple, again))
    odd = mixing.mix(frame(spark)).collect()
    assert len(odd) == len(ODD) and all(r.taken == 0 for r in odd if r.size == 0)
    assert mixing.mix(frame(spark, [])).count() == 0
    assert mixing.mixed_rows(frame(spark)).columns == frame(spark).columns


@pytest.mark.parametrize("big", [3_000_000, 12_000_000])
def test_mixing_small_sources_of_large_tables(spark, big):
    """Sources far below a full block come near their targets beside sources of any size."""
    small = {"b": 60, "c": 300, "d": 700, "e": 1500, "f": 5000, None: 40}
    rows = [(i, "w " * (big // 100), None, "a", None) for i in range(100)]
    rows += [(1000 * k + j, "w " * 20, None, s, None) for k, (s, n) in enumerate(small.items(), 1) for j in range(n // 20)]
    src = {r[0]: r[3] for r in rows}
    taken, target = Counter(), {}
    for r in mixing.mix(frame(spark, rows)).collect():
        taken[src[r.doc_id]] += r.taken
        target[src[r.doc_id]] = r.target
        assert 0 <= r.taken <= 3 * r.size
    assert set(target) == {"a", *small}
    for s, t in target.items():
        assert abs(taken[s] - t) <= max(3, 0.03 * t), (s, t, taken[s])


def test_media_round_trip(spark):
    for n in [0, 1, 63, 64, 65, *range(100, 20_000, 613), 16_384, 100_000]:
        raw = bytes(i * 7 % 256 for i in range(n))
        payload = raw + b"\0" * (-n % 64 or (0 if n else 64))
        back, f = media.read_stream(media.write_stream(payload))
        assert back == payload and f["errors"] == 0 and len(f["pts"]) == f["units"] and f["entries"][0] == 0
    for r in media.media_columns(frame(spark), with_media=True).collect():
        raw = (next(x[1] for x in ODD if x[0] == r.doc_id) or "").encode()
        payload = raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-64:]) and r.media_sha256 == hashlib.sha256(bytes(r.media)).hexdigest() and r.media_bytes == len(r.media)


def test_media_finds_damage():
    media_bytes = bytearray(media.write_stream(b"x" * 50_048))
    lost = bytes(media_bytes[: 188 * 20] + media_bytes[188 * 21 :])
    with pytest.raises(ValueError):
        media.read_stream(lost)
    media_bytes[188 * 9 + 3] ^= 5
    assert media.read_stream(bytes(media_bytes))[1]["errors"] > 0
    media_bytes[188 * 3] = 0
    with pytest.raises(ValueError):
        media.read_stream(bytes(media_bytes))


def test_quality_votes(spark):
    rng = np.random.default_rng(2)
    good = [" ".join("".join(rng.choice(list("abcdefgh"), 5)) for _ in range(80)).capitalize() + "." for _ in range(40)]
    bad = [" ".join("".join(rng.choice(list("ABCDEFGH"), 5)) + "!!" for _ in range(80)) for _ in range(40)]
    rows = [(i, t, None, None, None) for i, t in enumerate([*good, *bad, None, "", LONG])]
    labels = spark.createDataFrame([(i, int(i < 40)) for i in range(0, 80, 2)] + [(None, 1), (3, None), (9999, 1)], "doc_id long, quality int")
    docs = frame(spark, rows)
    model = quality.fit(docs, labels)
    out = {r.doc_id: r for r in quality.score(docs, model).collect()}
    assert all(out[i].predicted == int(i < 40) for i in range(80)) and all(0 <= r.score <= 1 for r in out.values()) and len(out) == 83
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} >= set(range(40))
    empty = quality.fit(docs, labels.limit(0))
    assert {r.score for r in quality.score(docs, empty).collect()} == {0.5}


def test_language_kernel(spark):
    words = {"en": "the of and tion with that", "de": "der die und ung schaft nicht", "fr": "le la les des ment qui"}
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(rng.choice(words[s].split(), 30)), s, None, None) for i, s in enumerate(list(words) * 20)]
    rows += [(100, None, None, None, None), (101, "", None, None, None), (102, "123 !!", "en", None, None), (103, "THE OF AND TION", None, None, None), (104, LONG, None, None, None)]
    docs = frame(spark, rows)
    out = {r.doc_id: r for r in langid.predict(docs, langid.fit(docs.filter("doc_id % 3 <> 5 AND doc_id % 4 <> 2"))).collect()}
    assert all(out[r[0]].lang_pred == r[2] for r in rows[:60])
    assert [out[i].lang_pred for i in (100, 101, 102, 103)] == ["und", "und", "und", "en"] and all(0 <= r.score <= 1 for r in out.values())
    nothing = langid.predict(docs, langid.fit(docs.limit(0)))
    assert {r.lang_pred for r in nothing.collect()} == {"und"}


def test_language_kernel_is_presence():
    x, letters = langid.presence(["abc abc", "abc", "", "é É", "12 !"])
    assert x[0].sum() >= x[1].sum() > 0 and not x[2].any() and letters.tolist() == [6, 3, 0, 2, 0] and not x[4].any()
    assert (langid.presence(["É"])[0] == langid.presence(["é"])[0]).all()


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><header class="site">Top</header>
<nav><ul><li><a href="/x">Menu</a></li></ul></nav><div class="cookie-notice">Accept</div><aside>Side</aside><article><h1>Title &amp; more</h1><p>First   <b>bold</b>
text.<br>Next line<p>Second &lt;para&gt;</p><form><input><button>Send</button></form><section class="comments"><p>A reader says</p></section></article><div class="ad">Buy</div><footer>&copy; x</footer></body></html>"""
TEXT = "Title & more\n\nFirst bold text. Next line\n\nSecond <para>"


def test_html_extraction(spark):
    rows = [(i, f"http://h{i % 2}.example/{i}", PAGE) for i in range(12)] + [(50, None, None), (51, "odd", ""), (52, "http://one.example/", PAGE), (53, "http://two.example/", "<p>plain <i>text</i>")]
    out = {r.page_id: r for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in [*range(12), 52]:
        assert out[i].text == TEXT, out[i].text
        assert out[i].n_chars == len(TEXT)
    assert out[50].text == "" and out[51].text == "" and out[53].text == "plain text"
    assert out[0].template_slots > 0 and out[52].template_slots == 0
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_html_template_drops_constant_text_outside_articles(spark):
    page = "<body><div>Welcome to our site</div><div><p>Story number {0} is here</p></div></body>"
    rows = [(i, f"http://c.example/{i}", page.format(i)) for i in range(9)]
    out = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert all(r.text == f"Story number {r.page_id} is here" for r in out)


def test_html_template_of_a_minority(spark):
    """Text that is constant on the pages of one template goes, though most pages of the host have another template."""
    usual = "<body><div><p>Story number {0} is here</p></div></body>"
    rare = "<body><section><div>Sold by our shop since long</div><b>{0}</b></section><div><p>Item number {0} is here</p></div></body>"
    rows = [(i, f"http://c.example/{i}", (rare if i < 6 else usual).format(i)) for i in range(30)]
    out = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in out} == {i: f"{i}\n\nItem number {i} is here" if i < 6 else f"Story number {i} is here" for i in range(30)}


def test_line_dedup_templates(spark):
    lines = [f"error {i} in module {i * 7} while reading the block" for i in range(6)]
    rows = [(i, f"Own text of document number x{i} only here\n{lines[i]}\n\nShared footer line of all\nlast q{i}z", None, None, None) for i in range(6)]
    rows += [(20, None, None, None, None), (21, "", None, None, None), (22, "Twice in one\nTwice in one", None, None, None), (None, "Shared footer line of all", None, None, None)]
    out = line_dedup.line_dedup(frame(spark, rows))
    assert set(frame(spark).columns) < set(out.columns)
    got = {r.doc_id: r for r in out.collect()}
    for i in range(6):
        assert "error" not in got[i].text and "Shared" not in got[i].text and got[i].n_lines == 5 and got[i].n_dropped >= 2
    assert got[20].text is None and got[21].text == "" and got[22].n_dropped == 0 and got[None].n_dropped == 0
    assert line_dedup.line_dedup(frame(spark, [])).count() == 0


@pytest.mark.parametrize("noise", [0, 200])
def test_line_dedup_several_templates_of_a_leaf(spark, noise):
    """Two templates with the same leading tokens recur, alone and among ordinary lines; the ordinary lines stay."""
    names = lambda p: (f"{p}{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(260))
    big = [f"we have seen user {x} open the red front door" for x, _ in zip(names("b"), range(60))]
    small = [f"we have seen {x} files lost on disk of night" for x, _ in zip(names("a"), range(40))]
    rng = np.random.default_rng(5)
    other = ["we have seen " + " ".join("".join(rng.choice(list("abcdefgh"), 5)) for _ in range(6)) + rng.choice([" door", " night"]) for _ in range(noise)]
    rows = [(i, f"{t}\nOwn line x{i}", None, None, None) for i, t in enumerate([*big, *small, *other])]
    dropped = {r.doc_id for r in line_dedup.line_dedup(frame(spark, rows)).collect() if "we have seen" not in r.text}
    assert dropped == set(range(100))


def test_fixity_finds_planted_damage(spark):
    pages = spark.createDataFrame([(i if i % 50 else None, f"http://x/{i}", "<p>" + "y" * (i % 40)) for i in range(3000)] + [(7, None, None)] * 2, "page_id long, url string, html string")
    rows = fixity.records(pages, 3)
    worn = fixity.worn(rows, 40)
    out = fixity.audit(rows, worn).collect()
    assert len(out) == 3002
    bad = {(r.file, r.position) for r in out if r.digest_a != r.digest_b}
    assert bad and {(r.file, r.position) for r in out if not r.intact} == bad
    assert all(r.intact and r.root_equal for r in fixity.audit(rows, rows).collect())
    short = fixity.audit(rows, rows.filter("page_id <> 13 OR page_id IS NULL")).collect()
    assert any(not r.intact for r in short)
    assert fixity.audit_pages(pages.limit(0)).count() == 0
