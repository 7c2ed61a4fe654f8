"""Byte-level BPE encoding and decoding by corpus-level merge replay.

Each slice of the corpus is encoded as a whole: its distinct pre-tokens (words of the pattern) are laid end
to end as byte symbols in a linked list, an inverted index maps each mergeable pair to the positions where
it stands, and the merges are replayed in rank order over all words at once. A merge touches only the
positions listed for its pair and their neighbours, whose new pairs join the index. Then every document is
read off its words. The ids do not depend on how the corpus is cut into slices.

Cases: null and empty texts encode to no ids; decoding gives their empty bytes; texts of any length are
encoded whole; repeated rows give equal results; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from docloom.llm.common import slices, small_batches, tidy, utf8

#: Bytes of text in a slice, and words remembered between slices of a task.
SLICE = 4 << 20
REMEMBERED = 300_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file of base64 tokens and ranks."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class MergeReplay:
    """Encoder of word lists: ``encode(words)`` gives one id list per word (bytes)."""

    def __init__(self, ranks: dict[bytes, int]):
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.token = {r: t for t, r in ranks.items()}
        self.shift = max(ranks.values()).bit_length()
        pairs = [(ranks[t[:k]] << self.shift | ranks[t[k:]], r) for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        pairs.sort()
        self.pair_key = np.array([p for p, _ in pairs], np.int64)
        self.pair_rank = np.array([r for _, r in pairs], np.int32)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where it isn't mergeable."""
        key = left.astype(np.int64) << self.shift | right
        at = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
        return np.where(self.pair_key[at] == key, self.pair_rank[at], np.int32(-1))

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words end to end, and offsets (one more than words)."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths)
        n = int(ends[-1]) if len(words) else 0
        if not n:
            return np.zeros(0, np.int64), np.zeros(len(words) + 1, np.int64)
        sym = self.byte_id[np.frombuffer(b"".join(words), np.uint8)].astype(np.int32)
        word = np.repeat(np.arange(len(words), dtype=np.int32), lengths)
        last = np.zeros(n, bool)
        last[ends[lengths > 0] - 1] = True
        # the linked list; position n is the end of every word
        nxt = np.arange(1, n + 2, dtype=np.int32)
        nxt[:-1][last] = n
        prv = np.arange(-1, n, dtype=np.int32)
        prv[1:][np.append(last, True)[:n]] = n
        prv[0] = n
        prv = np.append(prv[:n], np.int32(n))
        sym = np.append(sym, np.int32(0))
        rank = np.full(n + 1, -1, np.int32)
        at = np.flatnonzero(~last)
        rank[at] = self._rank(sym[at], sym[nxt[at]])
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def file(positions: np.ndarray) -> None:
            """Enter positions in the index under the rank of the pair that begins there."""
            positions = positions[rank[positions] >= 0]
            if not len(positions):
                return
            order = np.argsort(rank[positions], kind="stable")
            positions = positions[order]
            own = rank[positions]
            cuts = np.flatnonzero(np.diff(own)) + 1
            for part, r in zip(np.split(positions, cuts), own[np.append(0, cuts)].tolist(), strict=True):
                if r not in index:
                    index[r] = []
                    heapq.heappush(heap, r)
                index[r].append(part)

        file(at)
        alive = np.ones(n + 1, bool)
        while heap:
            r = heapq.heappop(heap)
            listed = index.pop(r)
            where = np.unique(np.concatenate(listed)) if len(listed) > 1 else np.sort(listed[0])
            where = where[alive[where] & (rank[where] == r)]
            if not len(where):
                continue
            # of overlapping pairs (aaa) every second one counts, from the left
            if len(where) > 1:
                chained = np.append(False, nxt[where[:-1]] == where[1:])
                if chained.any():
                    i = np.arange(len(where))
                    start = np.maximum.accumulate(np.where(chained, 0, i))
                    where = where[(i - start) % 2 == 0]
            gone = nxt[where]
            after = nxt[gone]
            alive[gone] = False
            rank[gone] = -1
            sym[where] = r
            nxt[where] = after
            prv[after[after < n]] = where[after < n]
            rank[where] = -1
            open_ = where[after < n]
            rank[open_] = self._rank(sym[open_], sym[nxt[open_]])
            left = prv[where]
            left = left[left < n]
            rank[left] = self._rank(sym[left], sym[nxt[left]])
            file(np.unique(np.concatenate((open_, left))))
        kept = np.flatnonzero(alive[:n])
        counts = np.bincount(word[kept], minlength=len(words))
        return sym[kept], np.append(0, np.cumsum(counts))


class _Index(dict):
    """Numbers for words; a new word gets the next number and waits in ``new`` for its ids."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self.new.append(word)
        self[word] = number = len(self)
        return number


def _gather(flat: np.ndarray, off: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Segments ``which`` of flat (bounded by off) end to end, and where each ends."""
    size = off[which + 1] - off[which]
    ends = np.cumsum(size)
    return flat[np.repeat(off[which] - ends + size, size) + np.arange(int(ends[-1]) if len(ends) else 0)], ends


class Codec:
    """Whole texts to ids and back; remembers a bounded number of words."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.replay, self.split = MergeReplay(ranks), regex.compile(pattern)
        tokens = [self.replay.token.get(r, b"") for r in range(max(ranks.values()) + 1)]
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8), np.append(0, np.cumsum([len(t) for t in tokens]))
        names = [f"{r}," for r in range(len(tokens))]
        self.names = np.frombuffer("".join(names).encode(), np.uint8), np.append(0, np.cumsum([len(t) for t in names]))
        self._forget()

    def _forget(self) -> None:
        self.index, self.ids, self.off = _Index(), np.zeros(0, np.int32), np.zeros(1, np.int64)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        if len(self.index) > REMEMBERED:
            self._forget()
        number = self.index.__getitem__
        rows = [np.fromiter(map(number, c), np.int32, len(c)) for c in map(self.split.findall, texts)]
        if self.index.new:
            ids, off = self.replay.encode([w.encode("utf-8", "surrogatepass") for w in self.index.new])
            self.index.new = []
            self.ids, self.off = np.append(self.ids, ids.astype(np.int32)), np.append(self.off, self.off[-1] + off[1:])
        return [_gather(self.ids, self.off, r)[0] if len(r) else np.zeros(0, np.int32) for r in rows]

    def decode(self, ids: np.ndarray) -> bytes:
        return _gather(*self.bytes, ids)[0].tobytes() if len(ids) else b""

    def digits(self, ids: np.ndarray) -> bytes:
        """The ids in decimal, with commas between."""
        return _gather(*self.names, ids)[0][:-1].tobytes() if len(ids) else b""


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for every row (and ids). The rank file is read on the driver and broadcast
    (its size is that of one vocabulary)."""
    spark = docs.sparkSession
    small_batches(spark)
    given = spark.sparkContext.broadcast((read_ranks(ranks_path), pattern))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(*given.value)
        for batch in batches:
            _, off = utf8(batch.column(1))
            for lo, hi in slices(off, SLICE):
                texts = [t or "" for t in batch.column(1).slice(lo, hi - lo).to_pylist()]
                rows = codec.encode(texts)
                columns = [
                    batch.column(0).slice(lo, hi - lo), pa.array([len(r) for r in rows], pa.int64()),
                    pa.array([hashlib.sha256(codec.digits(r)).hexdigest() for r in rows], pa.string()),
                    pa.array([hashlib.sha256(codec.decode(r)).hexdigest() for r in rows], pa.string()),
                ]
                if with_ids:
                    columns.append(pa.array(rows, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: len(columns)])

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "text").mapInArrow(tidy(run), schema)
