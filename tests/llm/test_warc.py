import base64
import hashlib

import numpy as np
import pytest

from tessera.llm import warc
from tessera.operators import components

SCHEMA = "page_id long, url string, html string"


def expected(pages):
    first = {}
    for i, _, h in pages:
        if i is not None:
            k = h or ""
            first[k] = min(i, first.get(k, i))
    out = []
    for i, _, h in pages:
        b = (h or "").encode()
        head = first.get(h or "")
        own = head is None or i == head
        out.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if own else "revisit", None if own else head))
    return sorted(out, key=repr)


def test_records_survive_magic_in_payloads(spark):
    inner = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    pages = [(1, "http://a", "x"), (2, "http://b", "x"), (3, None, None), (4, "u\r\nInjected: 1", ""), (5, "http://c", inner * 3), (6, "http://d", "WARC/1.1\r\n"), (None, "http://e", "x"), (None, "http://f", "only null"), (5, "http://c", inner * 3), (7, "http://g", "é中😀" * 70_000), (8, "http://h", "\r\n\r\n")]
    df = spark.createDataFrame(pages, SCHEMA)
    got = warc.digest(df.withColumn("payload_digest", df["url"])).collect()
    assert sorted((tuple(r) for r in got), key=repr) == expected(pages)
    assert warc.digest(spark.createDataFrame([], SCHEMA)).collect() == []


def test_copies_beyond_what_is_broadcast(spark, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(components, "HEAVY", 5)
    pages = [(i, f"u{i}", "hot" if i % 3 == 0 else f"pair {i // 2}" if i < 40 else str(i)) for i in range(90)]
    got = warc.digest(spark.createDataFrame(pages, SCHEMA)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == expected(pages)


def test_payloads_read_back(spark, tmp_path):
    pages = [(i, f"http://h/{i}", f"<p>{i % 3}</p>" * (i + 1)) for i in range(30)]
    warc.write_archives(spark.createDataFrame(pages, SCHEMA), f"file://{tmp_path}/w", records=4)
    got = {r.page_id: r for r in warc.read_archives(spark, f"file://{tmp_path}/w").collect()}
    assert {i: got[i].payload.decode() for i in got} == {i: h for i, _, h in pages}
    assert len(list((tmp_path / "w").rglob("part-*"))) > 4


def test_headers_of_any_length(spark, tmp_path):
    pages = [(1, "data:," + "x" * 100_000, "a"), (2, "http://h/WARC/1.1", "b"), (3, "http://h/" + "y" * 70_000 + "WARC/1.1", "a"), (4, "http://h", "WARC/1.1\r\n" * 50_000), (5, "http://i", "c")]
    df = spark.createDataFrame(pages, SCHEMA)
    assert sorted((tuple(r) for r in warc.digest(df).collect()), key=repr) == expected(pages)
    warc.write_archives(df, f"file://{tmp_path}/w")
    assert {r.page_id: r.url for r in warc.read_archives(spark, f"file://{tmp_path}/w").collect()} == {i: u for i, u, _ in pages}


def test_pointer_jumping_keeps_the_chain():
    at, after = np.array([0, 10, 25, 40]), np.array([25, 40, 60, 60])
    assert warc.reachable(at, after, 60).tolist() == [0, 2]
    with pytest.raises(ValueError):
        warc.reachable(at, after, 61)
    with pytest.raises(ValueError):
        warc.reachable(np.array([5]), np.array([60]), 60)
    assert warc.reachable(np.zeros(0, np.int64), np.zeros(0, np.int64), 0).tolist() == []
    n = 1000
    at = np.arange(0, 3 * n, 3)
    assert warc.reachable(at, at + 3, 3 * n).tolist() == list(range(n))


def test_files_are_bounded_in_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "CLASS_BYTES", 1000)
    sizes = [0, 10, 300, 5_000, 15_000, 15_500, 200_000, 250_000, 300_000, 40, 1_000_000]
    pages = [(i, f"http://h/{i}", chr(97 + i % 26) * n) for i, n in enumerate(sizes * 4)]
    df = spark.createDataFrame([(i, u, h + str(i)) for i, u, h in pages], SCHEMA).coalesce(2)
    warc.write_archives(df, f"file://{tmp_path}/w", records=64)
    files = [p for p in (tmp_path / "w").rglob("part-*")]
    assert max(p.stat().st_size for p in files) <= 1_000_000 + 1000
    assert {p.parent.name for p in files} == {"0", "1", "2", "3"}
    got = {r.page_id: r.payload.decode() for r in warc.read_archives(spark, f"file://{tmp_path}/w").collect()}
    assert got == {r.page_id: r.html for r in df.collect()}
