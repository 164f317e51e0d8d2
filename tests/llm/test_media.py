import hashlib
import zlib

import pytest

from tessera.llm import transport_stream as ts

from .fixtures import AWKWARD, documents, empty


@pytest.mark.parametrize("size", [0, 1, 575, 576, 577, 9215, 9216, 9217, 9216 * 8 + 5, 400_000])
def test_round_trip_and_access_points(size):
    payload = ts.padded(bytes(i * 7 % 256 for i in range(size)))
    got, units = ts.parse(ts.stream(payload))
    assert got == payload and len(ts.stream(payload)) % 188 == 0
    assert [u[2] for u in units] == [i % ts.GROUP == 0 for i in range(len(units))]
    assert [u[0] for u in units] == [i * ts.UNIT // ts.BLOCK * ts.TICKS for i in range(len(units))]
    for pts in (0, 1, 2**33 - 1, 12345678901 % 2**33):
        s = ts._stamp(pts)
        assert (s[0] & 0x0E) << 29 | s[1] << 22 | (s[2] & 0xFE) << 14 | s[3] << 7 | s[4] >> 1 == pts


def test_damage_is_named():
    good = ts.stream(ts.padded(b"x" * 5000))
    cases = {"length_not_in_packets": good[:-1], "sync_byte_missing": b"\0" + good[1:], "continuity_counter_jumps": good[: 188 * 4] + good[188 * 5 :], "program_table_missing": good[188:], "program_table_damaged": good[:20] + b"\x55" + good[21:]}
    for fault, media in cases.items():
        with pytest.raises(ValueError, match=fault):
            ts.parse(media)


def test_awkward_rows(spark):
    df = documents(spark)
    texts = {r.doc_id: r.text for r in df.collect()}
    got = ts.digest(df).collect()
    assert len(got) == df.count()
    for r in got:
        assert ts.expected(texts[r.doc_id]).items() <= r.asDict().items()
    assert len({(r.media_sha256, r.feature) for r in got if texts[r.doc_id] == "same text here twice"}) == 1
    assert ts.digest(empty(spark)).collect() == []
    media = ts.from_streams(ts.to_streams(df.withColumnRenamed("source", "payload")).withColumnRenamed("media", "media"))
    assert media.columns.count("payload") == 1 and not media.where("fault IS NOT NULL").count()
    odd = ts.from_streams(ts.to_streams(df.selectExpr("*", "1 AS `a.b`", "'x' AS `c``d`")))
    assert {(r["a.b"], r["c`d"], r["fault"]) for r in odd.collect()} == {(1, "x", None)} and "source" in odd.columns
    bad = ts.from_streams(spark.createDataFrame([(1, None), (2, bytearray(b"zz"))], "doc_id long, media binary")).collect()
    assert [r.fault for r in bad] == ["length_not_in_packets"] * 2 and all(r.payload is None for r in bad)


def bits(*fields):
    """Bytes of (value, width in bits), one after another."""
    total = "".join(format(v, f"0{w}b") for v, w in fields)
    return int(total, 2).to_bytes(len(total) // 8, "big")


def checksum(data):
    """CRC of program tables by long division."""
    n = int.from_bytes(data, "big") << 32
    n ^= 0xFFFFFFFF << 8 * len(data)
    for i in range(8 * len(data) + 31, 31, -1):
        if n >> i & 1:
            n ^= 0x104C11DB7 << (i - 32)
    return n.to_bytes(4, "big")


def written(payload):
    """A transport stream by the letter of the standard, packet by packet, and its access units' times and first packets."""
    packets, counters, units = [], {}, []

    def put(pid, start, data, field=None):
        counter = counters[pid] = (counters.get(pid, -1) + 1) % 16
        head = bits((0x47, 8), (0, 1), (start, 1), (0, 1), (pid, 13), (0, 2), (1 if field is None else 3, 2), (counter, 4))
        packets.append(head + (b"" if field is None else bytes([len(field)]) + field) + data)

    def table(kind, body):
        section = bits((kind, 8), (1, 1), (0, 1), (3, 2), (len(body) + 9, 12), (1, 16), (3, 2), (0, 5), (1, 1), (0, 8), (0, 8)) + body
        return (b"\0" + section + checksum(section)).ljust(184, b"\xff")

    for n, at in enumerate(range(0, len(payload), 9216)):
        unit, pts, access = payload[at : at + 9216], at // 576 * 576 % 2**33, n % 8 == 0
        if access:
            put(0, 1, table(0, bits((1, 16), (7, 3), (256, 13))))
            put(256, 1, table(2, bits((7, 3), (257, 13), (15, 4), (0, 12), (6, 8), (7, 3), (257, 13), (15, 4), (0, 12))))
        units.append((pts, len(packets), access))
        stamp = bits((2, 4), (pts >> 30, 3), (1, 1), (pts >> 15 & 0x7FFF, 15), (1, 1), (pts & 0x7FFF, 15), (1, 1))
        rest, start = bits((1, 24), (0xBD, 8), (len(unit) + 8, 16), (2, 2), (0, 6), (2, 2), (0, 6), (5, 8)) + stamp + unit, 1
        while rest:
            field = bits((1, 2), (1, 2), (0, 4), (pts, 33), (63, 6), (0, 9)) if access and start else None
            room = 184 if field is None else 183 - len(field)
            if len(rest) < room:
                # Stuffing stands in the adaptation field.
                free = 183 - len(rest)
                field = ((field or (b"\0" if free else b"")) + b"\xff" * 184)[:free]
                room = len(rest)
            put(257, start, rest[:room], field)
            rest, start = rest[room:], 0
    return b"".join(packets), units


def test_query_against_an_independent_writer(spark):
    more = ["x" * n for n in (1, 150, 158, 159, 160, 170, 176, 177, 575, 576, 577, 9216, 9217, 9216 * 8, 9216 * 17 + 3)] + ["é中😀" * 40_000]
    df = documents(spark, [*AWKWARD, *more])
    texts = {r.doc_id: r.text for r in df.collect()}
    for r in ts.digest(df).collect():
        raw = (texts[r.doc_id] or "").encode()
        payload = raw + b"\xff" * ((-len(raw)) % 576 if raw else 576)
        media, units = written(payload)
        points = ",".join(f"{pts}@{packet}" for pts, packet, access in units if access)
        want = (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), f"units={len(units)};last_pts={units[-1][0]};access={points}")
        assert tuple(r)[1:] == want, r.doc_id
