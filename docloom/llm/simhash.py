"""Near-duplicate documents by SimHash fingerprints and a table of pivot distances.

A fingerprint bit is set if over half of the XXH64 hashes of a text's three-word shingles have it. Distinct
fingerprints get a row of Hamming distances to 42 reference fingerprints (written once). By the triangle inequality
two fingerprints within LIMIT bits differ by at most LIMIT in every coordinate.

The first 33 references are zero and, for each pair of neighbouring bits, the fingerprint with just these two set:
from its distance and that of zero follows how many of the two bits are set, and a difference of one bit moves one
of these 32 numbers by one. They are dealt into six groups; a link touches two groups at most, so it leaves some
four of them equal: the numbers of four groups are the key of a cell (15 cells for each fingerprint), and only
fingerprints that share a cell can be linked. Pairs of a cell are discarded if one of the other nine references,
which are dense, is more than LIMIT nearer to one than to the other; survivors are compared bit by bit. Nothing but
links leaves that join, and a fingerprint has at most 2,080 others within two bits.

A cell of more than ``CELL`` fingerprints isn't compared pair by pair. Two fingerprints are within two bits exactly if
some value is within one bit of both: the cell's members are grouped by the 65 values within one bit, each group hangs
under its smallest member, and so the same components come out of work that is linear in the cell.

Cases: null, empty and blank texts have fingerprint zero, linked like any other; fewer than three words are one
shingle. Rows, not ids, are linked; component_id is the smallest doc_id of a component's rows, null only if none has
one. Repeated rows stay repeated. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import cut, small_batches, stream, tidy, windows
from docloom.llm.components import components

SHINGLE, SEED, LIMIT = 3, 42, 2
GROUPS = 6
#: Most fingerprints of a cell whose pairs are compared.
CELL = 2048
_BLANK = re.compile(rb"[\x20\x09-\x0D]")
_PARTS = 1 << 16
#: Reference fingerprints: zero and pairs of bits, and dense ones.
PAIRS = [0, *(3 << 2 * j for j in range(32))]
DENSE = [int(x) for x in stream(9, 29)]


def _bits(h: list[int]) -> np.ndarray:
    """How many of the hashes have each bit, the highest first."""
    out = np.zeros(64, np.int64)
    for lo in range(0, len(h), _PARTS):
        out += np.unpackbits(np.array(h[lo : lo + _PARTS], ">u8").view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return out


def fingerprint(raw: bytes) -> int:
    """SimHash of a UTF-8 text: 64 bits, 0 without words."""
    digest, last, bits, n = xxhash.xxh64_intdigest, [], np.zeros(64, np.int64), 0
    for part in windows(raw, _BLANK):
        last += part.lower().split()
        if len(last) >= SHINGLE:
            h = [digest(b" ".join(s), SEED) for s in zip(*(last[i:] for i in range(SHINGLE)), strict=False)]
            bits += _bits(h)
            n += len(h)
            last = last[1 - SHINGLE :]
    if not n and last:
        return digest(b" ".join(last), SEED)
    return int.from_bytes(np.packbits(2 * bits > n).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fps = np.array([fingerprint(t.as_py() or b"") for t in b.column(1).cast(pa.large_binary())], np.uint64)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) for every row."""
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).mapInArrow(tidy(_fingerprints), "doc_id long, fp long")


def _far(fp: Column, reference: int) -> Column:
    signed = reference - (1 << 64) if reference >> 63 else reference
    return F.bit_count(fp.bitwiseXOR(F.lit(signed).cast("long"))).cast("long")


def pivot_table(classes: DataFrame) -> DataFrame:
    """fp, near (distances to the pairs of bits), far (those to the dense references, seven bits each in one long)."""
    fp = F.col("fp")
    far = sum((F.shiftleft(_far(fp, r), 7 * i) for i, r in enumerate(DENSE)), F.lit(0).cast("long"))
    return classes.select("fp", F.array(*[_far(fp, r).cast("byte") for r in PAIRS]).alias("near"), far.alias("far"))


def _cells() -> tuple[list[Column], Column]:
    """The groups' numbers from a fingerprint's distances, and the keys of its cells from the groups g0, g1, ..."""
    count = [F.expr(f"(cast(near[0] as long) + 2 - near[{j + 1}]) div 2") for j in range(32)]
    base = 3 ** -(-32 // GROUPS)
    group = [sum((count[j] * 3**i for i, j in enumerate(range(g, 32, GROUPS))), F.lit(0).cast("long")) for g in range(GROUPS)]
    keys = []
    for c, chosen in enumerate(combinations(range(GROUPS), GROUPS - LIMIT)):
        key = F.lit(c).cast("long")
        for g in chosen:
            key = key * base + F.col(f"g{g}")
        keys.append(key)
    return group, F.array(*keys)


def links(classes: DataFrame) -> DataFrame:
    """a, b: pairs of distinct fingerprints that join all that are within LIMIT bits into the same components."""
    table = cut(pivot_table(classes), "simhash-pivots")
    groups, keys = _cells()
    rows = table.select("fp", "far", *[g.alias(f"g{i}") for i, g in enumerate(groups)]).select("fp", "far", F.explode(keys).alias("cell"))
    shared = cut(rows.groupBy("cell").agg(F.count(F.lit(1)).alias("m")).filter("m > 1"), "simhash-shared")
    rows = cut(rows.join(shared, "cell"), "simhash-cells")
    small = rows.filter(F.col("m") <= CELL)
    a, b = (small.select("cell", F.col("fp").alias(x), F.col("far").alias(f"{x}_far")) for x in "ab")
    apart = lambda x, i: F.shiftrightunsigned(F.col(f"{x}_far"), 7 * i).bitwiseAND(F.lit(127).cast("long"))
    linked = F.col("a") < F.col("b")
    for i in range(len(DENSE)):
        linked &= F.abs(apart("a", i) - apart("b", i)) <= LIMIT
    linked &= F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= LIMIT
    pairs = a.join(b, (a["cell"] == b["cell"]) & linked).select("a", "b")
    ones = F.array(*[F.lit(v).cast("long") for v in (0, *(1 << i for i in range(63)), -(1 << 63))])
    large = rows.filter(F.col("m") > CELL).select("fp").distinct()
    around = large.select("fp", F.explode(ones).alias("one")).select("fp", F.col("fp").bitwiseXOR(F.col("one")).alias("z"))
    low = around.groupBy("z").agg(F.min("fp").alias("b"), F.count(F.lit(1)).alias("m")).filter("m > 1")
    stars = around.join(low.select("z", "b"), "z").filter("fp <> b").select(F.col("fp").alias("a"), "b")
    return pairs.unionByName(stars)


def simhash(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, component_id for every row."""
    rows = cut(fingerprints(docs), "simhash-rows")
    classes = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-classes")
    label = components(links(classes.select("fp")).distinct())
    roots = cut(classes.join(label.withColumnRenamed("id", "fp"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("root")), "simhash-roots")
    names = cut(roots.groupBy("root").agg(F.min("least").alias("component_id")), "simhash-names")
    # written, so that the join with the rows stands alone: a huge class of copies can be split
    named = cut(roots.join(names, "root").select("fp", "component_id"), "simhash-named")
    return rows.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
