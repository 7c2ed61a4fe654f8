"""Near-duplicate documents by HyperMinHash.

A document is the set of its distinct five-word shingles (64-bit hashes). The hash's top bits choose one of
128 buckets; of each bucket's smallest remaining hash a register of 16 bits is kept: the number of leading
zeros (6 bits) and the mantissa after the leading one (10 bits). Buckets without a shingle are filled from a
hash of their own over the whole set, so that in sets of any size a register of two documents agrees with
the probability of their Jaccard similarity. 32 bands of four registers give the candidate keys: a pair at
0.75 shares none with a probability of 5e-6. Registers also give an estimate of the similarity, corrected
for chance collisions; pairs far below the threshold go no further, all others are verified on the full sets.

No group is expanded into pairs. Equal sets are one class. In each band bucket every class is tried against
the bucket's smallest id, and components are formed. Buckets that still hold several components are scanned:
members whose estimate leaves a link possible are joined into families (spanning stars leave the scan, not
the pairs). Inside a family, members outside its largest component are compared with all others on the full
sets, in blocks of bounded size; a link is emitted only where it joins two components. A link that is skipped
therefore lies inside a component.

Cases: texts without words have empty sets, n_shingles 0, and are linked with nothing; fewer than five words
are one shingle. Rows, not ids, are linked: a class of equal sets has a number of its own, so rows that share a
doc_id but not their text belong to the components of their texts, and component_id is the smallest doc_id among
a component's rows. Null ids never lend it their name while another row does; a component of null ids only has a
null component_id. Equal rows share a component; other columns are ignored. ``drop_near_copies`` leaves exactly
one row of each component, also where ids repeat or are null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import cut, cut_alone, maybe_in, mix, one_of_each, row_key, slices, small_batches, stream, tidy, utf8, words
from docloom.llm.components import components

SHINGLE = 5
REGISTERS, BAND = 128, 4
#: Link where 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Estimates at least this low rule a pair out (over four standard deviations under the threshold).
LEAST_ESTIMATE = 0.55
#: Largest bucket that one task scans for families (a larger one is a family as a whole), and shingles in a block of a family.
SCAN, BLOCK = 2048, 100_000
_BUCKET_BITS = 7
_W = stream(SHINGLE + 1, 11)
_FILL = stream(REGISTERS, 13)
_BANDS = stream(REGISTERS // BAND, 17)


def shingle_sets(data: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each row."""
    row, h = words(data, off)
    n = len(off) - 1
    counts = np.bincount(row, minlength=n)
    ends = np.cumsum(counts)
    full = np.zeros(0, np.uint64)
    if len(h) >= SHINGLE:
        m = len(h) - SHINGLE + 1
        full = h[:m] * _W[0]
        for k in range(1, SHINGLE):
            full = full + h[k : k + m] * _W[k]
        full = mix(full)
    out = []
    for i in range(n):
        a, b = int(ends[i] - counts[i]), int(ends[i])
        if b - a >= SHINGLE:
            s = np.sort(full[a : b - SHINGLE + 1])
            out.append(s[np.append(True, s[1:] != s[:-1])])
        elif b > a:
            out.append(mix(np.add.reduce(h[a:b] * _W[: b - a], keepdims=True) + np.array([b - a], np.uint64) * _W[SHINGLE]))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _code(v: np.ndarray) -> np.ndarray:
    """Leading zeros (6 bits) and ten mantissa bits of 64-bit values."""
    f, e = np.frexp((v >> np.uint64(11)).astype(np.float64))
    zeros = np.where(v >> np.uint64(11) == 0, 53, 53 - e).astype(np.uint64)
    mantissa = (v << (zeros + np.uint64(1))) >> np.uint64(54)
    return (zeros << np.uint64(10) | mantissa).astype(np.uint16)


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """One row of registers for each (non-empty) set."""
    out = np.zeros((len(sets), REGISTERS), np.uint16)
    for i, s in enumerate(sets):
        if not len(s):
            continue
        bucket = (s >> np.uint64(64 - _BUCKET_BITS)).astype(np.int64)
        first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
        out[i, bucket[first]] = _code(s[first] << np.uint64(_BUCKET_BITS))
        if len(first) < REGISTERS:
            full = np.zeros(REGISTERS, bool)
            full[bucket[first]] = True
            empty = np.flatnonzero(~full)
            least = np.full(len(empty), np.uint64(2**64 - 1))
            for k in range(0, len(s), 512):
                least = np.minimum(least, mix(s[k : k + 512, None] * _FILL[empty][None, :] ^ _FILL[empty][None, :]).min(axis=0))
            out[i, empty] = _code(least)
    return out


def band_keys(regs: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band: its four registers, mixed with the band's number."""
    packed = np.ascontiguousarray(regs).view(np.uint64)
    return mix(packed ^ _BANDS[None, :]).view(np.int64)


def chance(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Probability that registers of unrelated sets of n and m shingles agree: same zeros and same mantissa."""
    p = np.zeros(np.broadcast(n, m).shape)
    cells = np.linspace(0, 1, 9)[:-1] + 1 / 16
    for zeros in range(40):
        x = 2.0 ** -(zeros + 1) * (1 + cells)
        width = 2.0 ** -(zeros + 11)
        for c in x:
            a, b = (np.maximum(k / REGISTERS, 1.0) for k in (n, m))
            p += 128 * (a * width * np.exp(-a * c)) * (b * width * np.exp(-b * c))
    return np.minimum(p, 0.5)


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard similarity from registers, corrected for chance agreement."""
    agree = (a == b).mean(axis=1)
    c = chance(n, m)
    return np.clip((agree - c) / (1 - c), 0, 1)


def sketches(docs: DataFrame) -> DataFrame:
    """k (row key), doc_id, n, f1, f2 (fingerprints of the set), regs, keys for every row."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = utf8(batch.column(2))
            for lo, hi in slices(off, 1 << 20):
                sets = shingle_sets(data, off[lo : hi + 1])
                regs = registers(sets)
                n = [len(s) for s in sets]
                f1 = [int(s.sum(dtype=np.uint64).view(np.int64)) for s in sets]
                f2 = [int(np.bitwise_xor.reduce(mix(s * _W[0])).view(np.int64)) if len(s) else 0 for s in sets]
                keys = band_keys(regs)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()),
                     pa.array([r.tobytes() if k else None for r, k in zip(regs, n, strict=True)], pa.binary()),
                     pa.array([r if k else None for r, k in zip(keys, n, strict=True)], pa.list_(pa.int64()))],
                    ["k", "doc_id", "n", "f1", "f2", "regs", "keys"],
                )

    rows = docs.select(row_key(docs).alias("k"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(tidy(run), "k long, doc_id long, n long, f1 long, f2 long, regs binary, keys array<long>")


def _likely(pairs: DataFrame, sketch: DataFrame) -> DataFrame:
    """Pairs (a, b) whose register estimate does not rule them out."""
    one = lambda x: sketch.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("regs").alias(f"r{x}"))
    both = pairs.join(one("b"), "b").join(one("a"), "a").select("a", "b", "na", "nb", "ra", "rb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            if t.num_rows:
                ra, rb = (np.frombuffer(b"".join(t.column(k).to_pylist()), np.uint16).reshape(-1, REGISTERS) for k in (4, 5))
                n, m = (t.column(k).to_numpy(zero_copy_only=False).astype(float) for k in (2, 3))
                ok = pa.array(estimate(ra, rb, n, m) >= LEAST_ESTIMATE)
                yield pa.RecordBatch.from_arrays([t.column(0).filter(ok), t.column(1).filter(ok)], ["a", "b"])

    return both.mapInArrow(tidy(run), "a long, b long")


def _texts(docs: DataFrame, sketch: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, text of the given nodes: the text of the row that stands for the class."""
    wanted = sketch.join(nodes.distinct(), "node").select("node", "k", F.col("doc_id").alias("own"))
    texts = maybe_in(docs.select(row_key(docs).alias("k"), F.col("doc_id").cast("long").alias("doc_id"), "text"), wanted, "k")
    # an inner join: the optimizer would move a semi join below the filter
    return texts.join(wanted, "k").filter(F.col("doc_id").eqNullSafe(F.col("own"))).select("node", "text").dropDuplicates(["node"])


def _verified(pairs: DataFrame, docs: DataFrame, sketch: DataFrame) -> DataFrame:
    """Pairs (a, b) that hold on the full sets of their texts."""
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node")))
    texts = cut(_texts(docs, sketch, nodes), "near-texts")
    both = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for t in batches:
            bs = t.column(1).to_pylist()
            data, off = utf8(t.column(3))
            for i, b in enumerate(bs):  # the same b comes again and again: its set is made once
                if b not in held:
                    if len(held) >= 64:
                        held.clear()
                    held[b] = shingle_sets(data, off[i : i + 2])[0]
                    bs[i] = held[b]
                else:
                    bs[i] = held[b]
            data, off = utf8(t.column(2))
            keep = []
            for lo, hi in slices(off, 1 << 20):
                for i, s in enumerate(shingle_sets(data, off[lo : hi + 1]), lo):
                    other = bs[i]
                    small, large = (s, other) if len(s) <= len(other) else (other, s)
                    common = int((large[np.minimum(np.searchsorted(large, small), len(large) - 1)] == small).sum()) if len(small) else 0
                    keep.append(100 * common >= PERCENT * (len(s) + len(other) - common) and common > 0)
            ok = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([t.column(0).filter(ok), t.column(1).filter(ok)], ["a", "b"])

    return both.select("a", "b", "ta", "tb").mapInArrow(tidy(run), "a long, b long")


def _near_size(a: str, b: str):
    return F.least(a, b) * 100 >= F.greatest(a, b) * PERCENT


def _spanning(open_rows: DataFrame) -> DataFrame:
    """Spanning stars (a, b) of the pairs in each bucket whose estimate leaves a link possible. Rows: key, m, low, node, n, regs."""

    def scan(ids: np.ndarray, n: np.ndarray, regs: np.ndarray) -> tuple[list[int], list[int]]:
        root = list(range(len(ids)))

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        for i in range(1, len(ids)):
            may = np.flatnonzero((np.minimum(n[:i], n[i]) * 100 >= np.maximum(n[:i], n[i]) * PERCENT) & ((regs[:i] == regs[i]).sum(axis=1) >= LEAST_ESTIMATE * REGISTERS))
            for j in may.tolist():
                a, b = find(i), find(j)
                if a != b:
                    root[max(a, b)] = min(a, b)
        low = [find(i) for i in range(len(ids))]
        return ids[[i for i, b in enumerate(low) if i != b]].tolist(), ids[[b for i, b in enumerate(low) if i != b]].tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def done() -> pa.RecordBatch | None:
            if len(held) < 2:
                return None
            ids, n = np.array([h[0] for h in held]), np.array([h[1] for h in held])
            a, b = scan(ids, n, np.frombuffer(b"".join(h[2] for h in held), np.uint16).reshape(-1, REGISTERS))
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for t in batches:
            for k, *row in zip(*(c.to_pylist() for c in t.columns), strict=True):
                if k != key:
                    if (out := done()) is not None:
                        yield out
                    key, held = k, []
                held.append(row)
        if (out := done()) is not None:
            yield out

    scanned = open_rows.filter(F.col("m") <= SCAN).repartition("key").sortWithinPartitions("key", "node")
    whole = open_rows.filter((F.col("m") > SCAN) & (F.col("node") != F.col("low"))).select(F.col("node").alias("a"), F.col("low").alias("b"))
    return scanned.select("key", "node", "n", "regs").mapInArrow(tidy(run), "a long, b long").union(whole).distinct()


def _family_links(family: DataFrame, docs: DataFrame, sketch: DataFrame) -> DataFrame:
    """Links (a, b) that join components inside families. Rows of family: node, n, component, family."""
    sizes = family.groupBy("family", "component").agg(F.count(F.lit(1)).alias("m"))
    top = sizes.groupBy("family").agg(F.max(F.struct("m", "component")).alias("top"), F.count(F.lit(1)).alias("k")).filter("k > 1")
    rows = family.join(top.select("family", F.col("top.component").alias("largest")), "family").withColumn("probe", F.col("component") != F.col("largest"))
    blocks = rows.groupBy("family").agg(
        *[F.greatest(F.lit(1), F.ceil(F.sum(F.when(F.col("probe") == k, F.col("n"))) / BLOCK)).cast("int").alias(c) for k, c in ((True, "np"), (False, "nm"))]
    )
    rows = cut(rows.join(blocks, "family").select("node", "component", "family", "probe", "np", "nm"), "near-family")
    # groups (i, j): probe blocks i <= j, and probe block i with main block j (written as -1 - j)
    mine = F.pmod(F.xxhash64("node"), F.when(F.col("probe"), F.col("np")).otherwise(F.col("nm"))).cast("int")
    rows = rows.withColumn("mine", mine)
    probes = F.concat(
        F.transform(F.sequence(F.lit(0), F.col("np") - 1), lambda x: F.struct(F.least("mine", x).alias("i"), F.greatest("mine", x).alias("j"))),
        F.transform(F.sequence(F.lit(0), F.col("nm") - 1), lambda x: F.struct(F.col("mine").alias("i"), (-1 - x).alias("j"))),
    )
    mains = F.transform(F.sequence(F.lit(0), F.col("np") - 1), lambda x: F.struct(x.alias("i"), (-1 - F.col("mine")).alias("j")))
    rows = rows.withColumn("g", F.explode(F.when(F.col("probe"), probes).otherwise(mains)))
    rows = rows.join(_texts(docs, sketch, rows.select("node")), "node").select("family", "g.i", "g.j", "node", "component", "probe", "text")

    def links(ids: list[int], components: list[int], probe: list[bool], sets: list[np.ndarray]) -> tuple[list[int], list[int]]:
        root = {c: c for c in components}

        def find(c: int) -> int:
            while root[c] != c:
                root[c] = root[root[c]]
                c = root[c]
            return c

        n = np.array([len(s) for s in sets])
        shingles, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), n)
        order = np.argsort(shingles, kind="stable")
        shingles, owner = shingles[order], owner[order]
        out: tuple[list[int], list[int]] = ([], [])
        for i in np.flatnonzero(probe).tolist():
            lo, hi = np.searchsorted(shingles, sets[i], "left"), np.searchsorted(shingles, sets[i], "right")
            count = hi - lo
            at = np.repeat(lo - np.append(0, np.cumsum(count)[:-1]), count) + np.arange(int(count.sum()))
            common = np.bincount(owner[at], minlength=len(sets))
            for j in np.flatnonzero(100 * common >= PERCENT * (n[i] + n - common)).tolist():
                if j != i and (a := find(components[i])) != (b := find(components[j])):
                    root[a] = b
                    out[0].append(ids[i])
                    out[1].append(ids[j])
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, ([], [], [], [])

        def done() -> pa.RecordBatch | None:
            if len(held[0]) < 2:
                return None
            a, b = links(*held)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for t in batches:
            data, off = utf8(t.column(6))
            keys = list(zip(*(t.column(k).to_pylist() for k in (0, 1, 2)), strict=True))
            rest = [t.column(k).to_pylist() for k in (3, 4, 5)]
            for lo, hi in slices(off, 1 << 20):
                for i, s in enumerate(shingle_sets(data, off[lo : hi + 1]), lo):
                    if keys[i] != key:
                        if (out := done()) is not None:
                            yield out
                        key, held = keys[i], ([], [], [], [])
                    for h, v in zip(held, (rest[0][i], rest[1][i], rest[2][i], s), strict=True):
                        h.append(v)
        if (out := done()) is not None:
            yield out

    return rows.repartition("family", "i", "j").sortWithinPartitions("family", "i", "j").mapInArrow(tidy(run), "a long, b long").distinct()


def links_and_components(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Members (k, doc_id, n, f1, f2), classes (n, f1, f2, node, least: smallest doc_id) and labels (id, component) of the linked nodes."""
    sketch = cut(sketches(docs), "near-sketch")
    member = sketch.select("k", "doc_id", "n", "f1", "f2")
    # equal sets are one class, a node of the link graph, folded map-side: the row with the smallest id stands for it, registers and keys are all rows'
    one = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k"))
    sketch = sketch.filter("n > 0").groupBy("n", "f1", "f2").agg(one.alias("one"), F.first("regs").alias("regs"), F.first("keys").alias("keys"))
    # written, so that numbers stay
    sketch = cut(sketch.select(F.monotonically_increasing_id().alias("node"), "one.k", "one.doc_id", "n", "f1", "f2", "regs", "keys"), "near-classes")
    classes = sketch.select("n", "f1", "f2", "node", F.col("doc_id").alias("least"))
    rows = sketch.select("node", "n", F.explode("keys").alias("key"))
    shared = cut(rows.groupBy("key").agg(F.min(F.struct("node", "n")).alias("low"), F.count(F.lit(1)).alias("m")).filter("m > 1"), "near-shared")
    bands = cut(rows.join(shared.select("key", "m", F.col("low.node").alias("low"), F.col("low.n").alias("low_n")), "key"), "near-bands")

    stars = bands.filter((F.col("node") != F.col("low")) & _near_size("n", "low_n")).select(F.col("node").alias("a"), F.col("low").alias("b")).distinct()
    links = cut_alone(lambda: _verified(cut(_likely(stars, sketch), "near-likely"), docs, sketch), "near-links")
    label = components(links)

    component = F.coalesce("component", "node")
    open_ = bands.select("key", "m", "low", "node").join(label.withColumnRenamed("id", "node"), "node", "left").withColumn("component", component)
    mixed = open_.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x <> y").select("key")
    # in an open bucket of two classes the star has been the only pair
    mixed = cut(mixed, "near-mixed")
    open_ = cut(bands.select("key", "m", "low", "node").filter("m > 2").join(mixed, "key"), "near-open")
    edges = cut(_spanning(open_.join(sketch.select("node", "n", "regs"), "node")), "near-spanning")
    if edges.isEmpty():
        return member, classes, label
    family = components(edges).withColumnRenamed("id", "node").withColumnRenamed("component", "family")
    family = family.join(label.withColumnRenamed("id", "node"), "node", "left").withColumn("component", component).join(sketch.select("node", "n"), "node")
    found = cut_alone(lambda: _family_links(family, docs, sketch), "near-links")
    if found.isEmpty():
        return member, classes, label
    # the labels stand for the links: stars, so that few rounds are left
    return member, classes, components(label.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(found))


def verdicts(docs: DataFrame) -> DataFrame:
    """k, doc_id, n, root (number of the component), component_id, kept for every row."""
    member, classes, label = links_and_components(docs)
    roots = cut(classes.join(label.withColumnRenamed("id", "node"), "node", "left").select("n", "f1", "f2", "least", F.coalesce("component", "node").alias("root")), "near-roots")
    names = cut(roots.groupBy("root").agg(F.min("least").alias("component_id")), "near-names")
    # written, so that the join with the rows stands alone: a huge class of copies can be split
    named = cut(roots.join(names, "root").select("n", "f1", "f2", "root", "component_id"), "near-named")
    out = member.join(named, ["n", "f1", "f2"], "left").withColumn("component_id", F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
    return out.select("k", "doc_id", "n", "root", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def near_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row."""
    return verdicts(docs).select("doc_id", F.col("n").alias("n_shingles"), "component_id", "kept")


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """One row of each component: the one with the smallest doc_id; rows without words stay."""
    found = cut_alone(lambda: verdicts(docs), "near-verdicts")
    rows = docs.withColumn("__k", row_key(docs))
    same = lambda t: (rows["__k"] == t["__gk"]) & rows["doc_id"].cast("long").eqNullSafe(t["__gid"])
    ids = lambda t: t.select(F.col("k").alias("__gk"), F.col("doc_id").alias("__gid"), F.col("root").alias("__root")).distinct()
    gone = ids(found.filter("NOT kept"))
    # rows that share the name of their component: equal rows, or several near copies under one id
    kept = found.filter("kept AND root IS NOT NULL")
    twins = cut(ids(kept.join(kept.groupBy("root").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("root"), "root")), "near-twins")
    if twins.isEmpty():
        return rows.join(gone, same(gone), "left_anti").select(docs.columns)
    others = gone.unionByName(twins)
    single = rows.join(others, same(others), "left_anti")
    return single.select(docs.columns).unionByName(one_of_each(rows.join(twins, same(twins)), ["__root"], docs.columns))
