"""Media columns: payloads stored as MPEG transport streams and read back.

A payload is cut into access units, each an elementary packet (PES) with a 33-bit timestamp; packets of 188
bytes carry program association and program map tables, the units with continuity counters, stuffing in
adaptation fields, a clock reference and a random-access flag at every GROUP-th unit. The reader parses the
tables with their checksums, finds the elementary stream, checks its continuity, reassembles the units and
returns payload, timestamps and random-access points.

Cases: null and empty texts are 64 zero bytes of payload; texts of any length are stored whole; equal texts
give equal streams; other columns are ignored. The reader raises ValueError for lost sync, broken tables or
units, and counts continuity errors.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from docloom.llm.common import small_batches, tidy

PACKET, BODY = 188, 184
PMT_PID, ES_PID = 0x1000, 0x0100
PRIVATE = 0x06
#: Bytes of payload in an access unit, ticks of the 90 kHz clock between units, units between random-access points.
UNIT, TICKS, GROUP = 16_384, 3_600, 8
_CRC = []
for _i in range(256):
    _c = _i << 24
    for _ in range(8):
        _c = (_c << 1) ^ 0x04C11DB7 if _c & 0x80000000 else _c << 1
    _CRC.append(_c & 0xFFFFFFFF)


def crc_mpeg(b: bytes) -> int:
    c = 0xFFFFFFFF
    for x in b:
        c = ((c << 8) & 0xFFFFFFFF) ^ _CRC[(c >> 24) ^ x]
    return c


def _section(table: int, number: int, body: bytes) -> bytes:
    head = bytes([table]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + number.to_bytes(2, "big") + b"\xc1\x00\x00"
    s = head + body
    return s + crc_mpeg(s).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> bytes:
    p = b"\x47" + (0x4000 | pid).to_bytes(2, "big") + b"\x10\x00" + section
    return p + b"\xff" * (PACKET - len(p))


TABLES = _table_packet(0, _section(0, 1, (1).to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))) + _table_packet(
    PMT_PID, _section(2, 1, (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([PRIVATE]) + (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\x00")
)


def _stamp(pts: int) -> bytes:
    return bytes([0x21 | (pts >> 29) & 0x0E, (pts >> 22) & 0xFF, (pts >> 14) & 0xFE | 1, (pts >> 7) & 0xFF, (pts << 1) & 0xFE | 1])


def _unstamp(b: bytes) -> int:
    return (b[0] & 0x0E) << 29 | b[1] << 22 | (b[2] & 0xFE) << 14 | b[3] << 7 | b[4] >> 1


def _clock(ticks: int) -> bytes:
    return ((ticks & (1 << 33) - 1) << 15 | 0x7E00).to_bytes(6, "big")


def write_stream(payload: bytes) -> bytes:
    """The transport stream of a payload (a positive multiple of 64 bytes)."""
    out, cc = [TABLES], 0
    for k in range(0, len(payload), UNIT):
        number = k // UNIT
        pts = number * TICKS & (1 << 33) - 1
        part = payload[k : k + UNIT]
        pes = b"\x00\x00\x01\xbd" + (len(part) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + _stamp(pts) + part
        entry = number % GROUP == 0
        # the first packet: adaptation field with flag and clock; grown by stuffing if the unit ends in it
        field = bytes([0x50 if entry else 0x10]) + _clock(pts)
        room = BODY - 1 - len(field)
        if len(pes) < room:
            field += b"\xff" * (room - len(pes))
            room = len(pes)
        out.append(b"\x47" + (0x4000 | ES_PID).to_bytes(2, "big") + bytes([0x30 | cc, len(field)]) + field + pes[:room])
        cc = cc + 1 & 15
        rest = pes[room:]
        full = len(rest) // BODY
        if full:
            block = np.empty((full, PACKET), np.uint8)
            block[:, 0], block[:, 1], block[:, 2] = 0x47, ES_PID >> 8, ES_PID & 0xFF
            block[:, 3] = 0x10 | (np.arange(cc, cc + full) & 15)
            block[:, 4:] = np.frombuffer(rest, np.uint8, full * BODY).reshape(full, BODY)
            out.append(block.tobytes())
            cc = cc + full & 15
        tail = rest[full * BODY :]
        if tail:
            gap = BODY - len(tail)
            field = b"" if gap == 1 else b"\x00" + b"\xff" * (gap - 2)
            out.append(b"\x47" + ES_PID.to_bytes(2, "big") + bytes([0x30 | cc, len(field)]) + field + tail)
            cc = cc + 1 & 15
    return b"".join(out)


def _read_section(packet: bytes, table: int) -> bytes:
    at = 5 + packet[4]
    if packet[3] & 0x30 != 0x10 or packet[at] != table:
        raise ValueError("table expected")
    n = int.from_bytes(packet[at + 1 : at + 3], "big") & 0x0FFF
    s = packet[at : at + 3 + n]
    if crc_mpeg(s):
        raise ValueError("broken table")
    return s[8:-4]


def read_stream(media: bytes) -> tuple[bytes, dict]:
    """Payload and figures of a transport stream: units, first and last timestamp, entry points, continuity errors."""
    if not media or len(media) % PACKET:
        raise ValueError("not a whole number of packets")
    p = np.frombuffer(media, np.uint8).reshape(-1, PACKET)
    if (p[:, 0] != 0x47).any():
        raise ValueError("lost sync")
    pid = (p[:, 1].astype(int) & 0x1F) << 8 | p[:, 2]
    first = lambda x: p[int(np.argmax(pid == x))].tobytes() if (pid == x).any() else b""
    pat = _read_section(first(0), 0)
    pmt_pid = int.from_bytes(pat[2:4], "big") & 0x1FFF
    pmt = _read_section(first(pmt_pid), 2)
    at = 4 + (int.from_bytes(pmt[2:4], "big") & 0x0FFF)
    kind, es = pmt[at], int.from_bytes(pmt[at + 1 : at + 3], "big") & 0x1FFF
    q = p[pid == es]
    counters = q[:, 3] & 15
    errors = int((counters[1:] != (counters[:-1] + 1 & 15)).sum())
    begins = (q[:, 1] & 0x40) > 0
    adapted = (q[:, 3] & 0x20) > 0
    skip = np.where(adapted, q[:, 4].astype(int) + 5, 4)
    entry = begins & adapted & (q[:, 4] > 0) & ((q[:, 5] & 0x40) > 0)
    units, stamps = [], []
    edges = [*np.flatnonzero(begins).tolist(), len(q)]
    plain = skip == 4
    for a, b in zip(edges, edges[1:], strict=False):
        inner = plain[a + 1 : b]
        if inner[:-1].all():  # only the first and the last packet are adapted
            end = b - 1 if len(inner) and not inner[-1] else b
            pes = q[a, skip[a] :].tobytes() + q[a + 1 : end, 4:].tobytes() + (q[b - 1, skip[b - 1] :].tobytes() if end < b else b"")
        else:
            pes = b"".join(q[i, skip[i] :].tobytes() for i in range(a, b))
        n = int.from_bytes(pes[4:6], "big")
        if pes[:3] != b"\x00\x00\x01" or len(pes) != n + 6:
            raise ValueError("broken unit")
        stamps.append(_unstamp(pes[9:14]))
        units.append(pes[9 + pes[8] :])
    points = (np.cumsum(begins)[entry] - 1).tolist()
    return b"".join(units), {"kind": kind, "pid": es, "packets": len(p), "units": len(units), "pts": stamps, "entries": points, "errors": errors}


def feature(figures: dict) -> str:
    """One line of features read from a stream."""
    s = figures["pts"]
    return f"pid={figures['pid']};type={figures['kind']};packets={figures['packets']};units={figures['units']};pts={s[0]}-{s[-1]};random_access={len(figures['entries'])};continuity_errors={figures['errors']}"


def media_columns(docs: DataFrame, with_media: bool = False) -> DataFrame:
    """The payload, stored form and features of every row's text; with_media adds the stream, timestamps and entry points."""
    small_batches(docs.sparkSession)
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    if with_media:
        names, kinds = [*names, "media", "pts", "entries"], [*kinds, pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        schema += ", media binary, pts array<long>, entries array<long>"

    def one(doc_id, text) -> tuple:
        raw = (text or "").encode("utf-8", "surrogatepass")
        media = write_stream(raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64)))
        back, figures = read_stream(media)
        row = (doc_id, len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature(figures))
        return row + (media, figures["pts"], figures["entries"]) if with_media else row

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            for lo in range(0, t.num_rows, 256):
                part = t.slice(lo, 256)
                rows = [one(a, b) for a, b in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "text").mapInArrow(tidy(run), schema)
