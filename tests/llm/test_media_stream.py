"""Transport streams against a reader written from the standard's packet layout, one packet at a time."""

import hashlib
import zlib

from docloom.llm import media

SCHEMA = "doc_id long, text string, media long, pts string"


def walk(stream):
    """Payload and the figures of the feature line, without the operator's reader."""
    packets = [stream[i : i + 188] for i in range(0, len(stream), 188)]
    pids, counter, errors, random_access, units, stamps, current = {}, None, 0, 0, [], [], None
    program = elementary = kind = None
    for p in packets:
        assert len(p) == 188 and p[0] == 0x47
        pid, start, control = (p[1] & 31) << 8 | p[2], bool(p[1] & 64), p[3] >> 4 & 3
        pids[pid] = pids.get(pid, 0) + 1
        at = 4
        if control & 2:
            length = p[4]
            if length and p[5] & 0x40:
                random_access += 1
            at = 5 + length
        body = p[at:] if control & 1 else b""
        if pid == 0 and start:
            section = body[1 + body[0] :]
            assert section[0] == 0
            program = (section[10] & 31) << 8 | section[11]
        elif pid == program and start:
            section = body[1 + body[0] :]
            assert section[0] == 2
            skip = 12 + ((section[10] & 15) << 8 | section[11])
            kind, elementary = section[skip], (section[skip + 1] & 31) << 8 | section[skip + 2]
        elif pid == elementary:
            if counter is not None and p[3] & 15 != (counter + 1) % 16:
                errors += 1
            counter = p[3] & 15
            if start:
                current = bytearray()
                units.append(current)
            current += body
    payload = b""
    for u in units:
        assert u[:3] == b"\0\0\1" and int.from_bytes(u[4:6], "big") == len(u) - 6
        t = u[9:14]
        assert u[7] >> 6 == 2 and t[0] & 1 and t[2] & 1 and t[4] & 1
        stamps.append((t[0] >> 1 & 7) << 30 | t[1] << 22 | t[2] >> 1 << 15 | t[3] << 7 | t[4] >> 1)
        payload += bytes(u[9 + u[8] :])
    line = f"pid={elementary};type={kind};packets={len(packets)};units={len(units)};pts={stamps[0]}-{stamps[-1]};random_access={random_access};continuity_errors={errors}"
    return payload, line, stamps


def test_streams_follow_the_standard(spark):
    texts = [None, "", "x", "é" * 31, "y" * 64, "z" * 16_383, "long text 🎉 " * 40_000, "x"]
    docs = spark.createDataFrame([(i, t, 1, "clash") for i, t in enumerate(texts)], SCHEMA)
    rows = {r.doc_id: r for r in media.media_columns(docs, with_media=True).collect()}
    assert len(rows) == len(texts)
    for i, text in enumerate(texts):
        r, raw = rows[i], (text or "").encode()
        payload, line, stamps = walk(bytes(r.media))
        assert payload == raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))
        assert (r.n_bytes, r.payload_bytes, r.media_bytes) == (len(raw), len(payload), len(r.media))
        assert r.feature == line and r.pts == stamps and r.tail_crc32 == zlib.crc32(payload[-64:])
        assert r.media_sha256 == hashlib.sha256(bytes(r.media)).hexdigest() and r.payload_sha256 == hashlib.sha256(payload).hexdigest()
        units = -(-len(payload) // media.UNIT)
        assert stamps == [k * media.TICKS for k in range(units)] and r.entries == list(range(0, units, media.GROUP))
    assert rows[0].media_sha256 == rows[1].media_sha256 and rows[2].feature == rows[7].feature
    assert media.media_columns(docs.limit(0)).count() == 0
