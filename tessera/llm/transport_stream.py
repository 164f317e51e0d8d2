"""Media columns: MPEG transport streams that hold a payload losslessly, with timestamps and random-access points.

`to_streams(df)` adds `media` (binary): program tables, then access units of UNIT bytes as elementary packets with
presentation timestamps; a random-access point (tables, clock reference, indicator) opens every GROUP units.
`from_streams(df)` replaces `media` by what it read: `payload`, `units` (array of pts, packet, random_access) and
`fault`. It parses the program tables, checks sync bytes and continuity counters and reassembles elementary packets.
A stream that breaks a rule, or a null, gives null payload and units and the rule's name as its fault.

Defined results: a null text counts as empty; the payload of an empty text is 576 bytes of 255; whole texts of any
length; equal texts have equal streams; other columns pass through (columns named as the outputs are replaced); an empty
table gives an empty one.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import masked, schema_of, text_or_empty

PAD, BLOCK = 255, 576
UNIT, GROUP = 16 * BLOCK, 8
#: One block lasts this many ticks of the 90 kHz clock.
TICKS = 576
PMT_PID, ES_PID = 0x100, 0x101


def _crc_mpeg(data: bytes) -> int:
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = ((crc << 1) ^ (0x04C11DB7 if crc & 0x80000000 else 0)) & 0xFFFFFFFF
    return crc


def _section(table: int, number: int, body: bytes) -> bytes:
    head = bytes([table]) + struct.pack(">H", 0xB000 | (len(body) + 9)) + struct.pack(">H", number) + bytes([0xC1, 0, 0])
    data = head + body
    data += struct.pack(">I", _crc_mpeg(data))
    return (b"\0" + data).ljust(184, b"\xff")


_PAT = _section(0, 1, struct.pack(">HH", 1, 0xE000 | PMT_PID))
_PMT = _section(2, 1, struct.pack(">HHBHH", 0xE000 | ES_PID, 0xF000, 0x06, 0xE000 | ES_PID, 0xF000))


def padded(text: bytes) -> bytes:
    size = max(BLOCK, -(-len(text) // BLOCK) * BLOCK)
    return text.ljust(size, bytes([PAD]))


def _clock(pts: int) -> bytes:
    return struct.pack(">Q", (pts << 15) | 0x7E00)[2:]


def _stamp(pts: int) -> bytes:
    return bytes([0x21 | (pts >> 29) & 0x0E, (pts >> 22) & 0xFF, 1 | (pts >> 14) & 0xFE, (pts >> 7) & 0xFF, 1 | (pts << 1) & 0xFE])


def _packets(pes: bytes, count: int, access: bool, pts: int) -> tuple[bytes, int]:
    """An elementary packet in packets of 188 bytes; the continuity counter that follows."""
    field = b"\x07\x50" + _clock(pts) if access else b""
    room = 184 - len(field)
    parts = []
    if len(pes) < room:
        parts.append(_stuffed(pes, count, field, True))
        return parts[0], (count + 1) % 16
    parts.append(struct.pack(">BHB", 0x47, 0x4000 | ES_PID, (0x30 if field else 0x10) | count) + field + pes[:room])
    count = (count + 1) % 16
    full, rest = divmod(len(pes) - room, 184)
    if full:
        rows = np.empty((full, 188), np.uint8)
        rows[:, 0], rows[:, 1], rows[:, 2] = 0x47, ES_PID >> 8, ES_PID & 0xFF
        rows[:, 3] = 0x10 | (np.arange(count, count + full) % 16)
        rows[:, 4:] = np.frombuffer(pes, np.uint8, full * 184, room).reshape(full, 184)
        parts.append(rows.tobytes())
        count = (count + full) % 16
    if rest:
        parts.append(_stuffed(pes[len(pes) - rest :], count, b"", False))
        count = (count + 1) % 16
    return b"".join(parts), count


def _stuffed(data: bytes, count: int, field: bytes, first: bool) -> bytes:
    """One packet whose adaptation field fills what the data leaves."""
    fill = 184 - len(data)
    body = field[1:] or (b"\0" if fill > 1 else b"")
    field = bytes([fill - 1]) + body.ljust(fill - 1, b"\xff")
    return struct.pack(">BHB", 0x47, (0x4000 if first else 0) | ES_PID, 0x30 | count) + field + data


def stream(payload: bytes) -> bytes:
    """The transport stream of a payload."""
    out, count, tables = [], 0, 0
    for i, at in enumerate(range(0, len(payload), UNIT)):
        unit, pts = payload[at : at + UNIT], (at // BLOCK * TICKS) % (1 << 33)
        if access := i % GROUP == 0:
            out += [struct.pack(">BHB", 0x47, 0x4000, 0x10 | tables), _PAT, struct.pack(">BHB", 0x47, 0x4000 | PMT_PID, 0x10 | tables), _PMT]
            tables = (tables + 1) % 16
        pes = b"\0\0\1\xbd" + struct.pack(">H", len(unit) + 8) + b"\x80\x80\x05" + _stamp(pts) + unit
        packets, count = _packets(pes, count, access, pts)
        out.append(packets)
    return b"".join(out)


def _table(packets: np.ndarray, pid: np.ndarray, wanted: int, table: int) -> bytes:
    rows = np.flatnonzero(pid == wanted)
    if not rows.size:
        raise ValueError("program_table_missing")
    data = packets[rows[0], 4:].tobytes()
    data = data[1 + data[0] :]
    size = 3 + ((data[1] & 0x0F) << 8 | data[2])
    if data[0] != table or size > len(data) or _crc_mpeg(data[:size]):
        raise ValueError("program_table_damaged")
    return data[8 : size - 4]


def parse(media: bytes) -> tuple[bytes, list[tuple[int, int, bool]]]:
    """The payload and, for each access unit, its timestamp, first packet and whether it is a random-access point."""
    if not media or len(media) % 188:
        raise ValueError("length_not_in_packets")
    packets = np.frombuffer(media, np.uint8).reshape(-1, 188)
    if (packets[:, 0] != 0x47).any():
        raise ValueError("sync_byte_missing")
    pid = (packets[:, 1].astype(np.int32) & 0x1F) << 8 | packets[:, 2]
    pat = _table(packets, pid, 0, 0)
    pmt_pid = struct.unpack(">HH", pat[:4])[1] & 0x1FFF
    pmt = _table(packets, pid, pmt_pid, 2)
    skip = 4 + (struct.unpack(">H", pmt[2:4])[0] & 0x0FFF)
    es_pid = struct.unpack(">H", pmt[skip + 1 : skip + 3])[0] & 0x1FFF
    for one in (0, pmt_pid, es_pid):
        counters = packets[pid == one, 3] & 0x0F
        if ((counters[1:] - counters[:-1]) % 16 != 1).any():
            raise ValueError("continuity_counter_jumps")
    rows = np.flatnonzero(pid == es_pid)
    es = packets[rows]
    field = (es[:, 3] & 0x20) > 0
    begin = 4 + np.where(field, 1 + es[:, 4].astype(np.int64), 0)
    if (begin > 188).any():
        raise ValueError("adaptation_field_too_long")
    access = field & (begin > 5) & ((es[:, 5] & 0x40) > 0)
    data = es[np.arange(188) >= begin[:, None]].tobytes()
    at = np.concatenate([[0], np.cumsum(188 - begin)])
    opens = np.flatnonzero(es[:, 1] & 0x40)
    if not opens.size or opens[0]:
        raise ValueError("elementary_packet_headless")
    payload, units = [], []
    for k, i in enumerate(opens.tolist()):
        pes = data[at[i] : at[opens[k + 1]] if k + 1 < len(opens) else len(data)]
        if pes[:3] != b"\0\0\1" or struct.unpack(">H", pes[4:6])[0] != len(pes) - 6 or pes[7] & 0x80 == 0:
            raise ValueError("elementary_packet_damaged")
        s = pes[9:14]
        pts = (s[0] & 0x0E) << 29 | s[1] << 22 | (s[2] & 0xFE) << 14 | s[3] << 7 | s[4] >> 1
        payload.append(pes[9 + pes[8] :])
        units.append((pts, int(rows[i]), bool(access[i])))
    return b"".join(payload), units


_UNITS = pa.list_(pa.struct([("pts", pa.int64()), ("packet", pa.int64()), ("random_access", pa.bool_())]))


def _declared(df: DataFrame, *more: str) -> str:
    return ", ".join(x for x in (schema_of(df), *more) if x)


def to_streams(df: DataFrame) -> DataFrame:
    kept = df.drop("media").withColumn("text", text_or_empty())
    at = kept.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [stream(padded(x.as_buffer().to_pybytes())) for x in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.binary())], names=[*kept_names, "media"])

    kept_names = kept.columns
    return masked(kept).mapInArrow(run, _declared(kept, "media binary"))


def from_streams(df: DataFrame) -> DataFrame:
    kept = df.drop("payload", "units", "fault").select(*[F.col(f"`{c.replace('`', '``')}`") for c in df.columns if c not in ("media", "payload", "units", "fault")], "media")
    names = kept.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            payloads, units, faults = [], [], []
            for x in batch.column(len(names)):
                try:
                    payload, found = parse(x.as_py() or b"")
                    payloads.append(payload)
                    units.append([dict(zip(("pts", "packet", "random_access"), u, strict=True)) for u in found])
                    faults.append(None)
                except (ValueError, IndexError, struct.error) as e:
                    payloads.append(None)
                    units.append(None)
                    faults.append(str(e) if type(e) is ValueError else "stream_cut_short")
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(payloads, pa.binary()), pa.array(units, _UNITS), pa.array(faults, pa.string())], names=[*names, "payload", "units", "fault"])

    return masked(kept).mapInArrow(run, _declared(kept.drop("media"), "payload binary", "units array<struct<pts:bigint,packet:bigint,random_access:boolean>>", "fault string"))


def digest(df: DataFrame) -> DataFrame:
    """The contract's row per document; payload figures are of the bytes read back from the stored stream."""
    made = to_streams(df.select("doc_id", "text")).select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "media")
    points = F.transform(F.filter("units", lambda u: u["random_access"]), lambda u: F.concat_ws("@", u["pts"].cast("string"), u["packet"].cast("string")))
    return from_streams(made).select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -32, 32)")).alias("tail_crc32"),
        "media_bytes",
        "media_sha256",
        F.concat(F.lit("units="), F.size("units").cast("string"), F.lit(";last_pts="), F.element_at("units", -1)["pts"].cast("string"), F.lit(";access="), F.array_join(points, ",")).alias("feature"),
    )


def expected(text: str | None) -> dict:
    """The figures of one text, straight from its bytes (for tests)."""
    payload = padded((text or "").encode())
    return {"n_bytes": len((text or "").encode()), "payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-32:])}
