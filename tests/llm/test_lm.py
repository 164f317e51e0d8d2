import collections
import math
import zlib

import numpy as np
import pytest

from tessera.llm import ngram_bloom

from .fixtures import WORDS, documents, empty, lowered


def brute(docs):
    tokens = [(i, [*WORDS.findall(lowered(t)), 0]) for i, t in docs]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    count = collections.Counter(w for i, ws in tokens if not held(i) for w in ws)
    both = collections.Counter(p for i, ws in tokens if not held(i) for p in zip([0, *ws[:-1]], ws, strict=True))
    n, v = sum(count.values()), len(count)
    scale = n + 0.1 * (v + 1)
    out = []
    for i, ws in tokens:
        base = sum(math.log10((count[w] + 0.1) / scale) for w in ws)
        stands = lambda c: 0 if not c else 1 if c == 1 else math.floor(2 ** (math.floor(math.log2(c)) + 0.5))
        score = sum(math.log10(0.75 * min(1, stands(both[p]) / max(1, count[p[0]])) + 0.25 * (count[p[1]] + 0.1) / scale) for p in zip([0, *ws[:-1]], ws, strict=True))
        out.append((i, held(i), len(ws), sum(count[w] > 0 for w in ws), n, base, score))
    return out


@pytest.mark.parametrize("frequent,filter_bytes", [(1 << 20, 64 << 20), (40, 400)])
def test_scores(spark, small, monkeypatch, frequent, filter_bytes):
    monkeypatch.setattr(ngram_bloom, "FREQUENT", frequent)
    monkeypatch.setattr(ngram_bloom, "FILTER_BYTES", filter_bytes)
    texts = [r.text for r in spark.read.parquet(f"{small}/documents.parquet").limit(60).collect()]
    df = documents(spark, [None, "", " ", "a", "same text here twice", "same text here twice", "x " * 30_000, *texts])
    key = lambda r: (r[0] is not None, r[0] or 0, r[2])
    got = sorted(map(tuple, ngram_bloom.digest(df).collect()), key=key)
    want = sorted(brute([(r.doc_id, r.text) for r in df.collect()]), key=key)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert all(abs(g[5] - w[5]) <= 1e-6 * max(1, abs(w[5])) for g, w in zip(got, want, strict=True))
    if frequent > 1000:
        # The filter may only take absent pairs for seen ones, or a level for the next.
        assert all(g[6] >= w[6] - 1e-6 for g, w in zip(got, want, strict=True))
        assert sum(g[6] - w[6] for g, w in zip(got, want, strict=True)) <= 0.02 * sum(w[2] for w in want)


def test_score_does_not_depend_on_what_is_broadcast(spark, small, monkeypatch):
    texts = [r.text for r in spark.read.parquet(f"{small}/documents.parquet").limit(60).collect()]
    df = documents(spark, [None, "", "never never seen never seen", "x " * 30_000, *texts])
    key = lambda r: (r[0] is not None, r[0] or 0, r[2])
    whole = sorted(map(tuple, ngram_bloom.digest(df).collect()), key=key)
    for frequent, filter_bytes, passes in ((40, 400, 1000), (0, 64 << 20, 8), (1 << 20, 400, 1), (40, 400, 0)):
        monkeypatch.setattr(ngram_bloom, "MOST_PASSES", passes)
        monkeypatch.setattr(ngram_bloom, "FREQUENT", frequent)
        monkeypatch.setattr(ngram_bloom, "FILTER_BYTES", filter_bytes)
        got = sorted(map(tuple, ngram_bloom.digest(df).collect()), key=key)
        assert [g[:5] for g in got] == [w[:5] for w in whole]
        assert all(abs(g[k] - w[k]) <= 1e-9 * max(1, abs(w[k])) for g, w in zip(got, whole, strict=True) for k in (5, 6))


def test_one_group_of_filters_is_alive_at_a_time(spark, small, monkeypatch):
    monkeypatch.setattr(ngram_bloom, "FILTER_BYTES", 400)
    monkeypatch.setattr(ngram_bloom, "MOST_PASSES", 10_000)
    df = spark.read.parquet(f"{small}/documents.parquet").limit(40)
    context, alive, most = type(spark.sparkContext), set(), []
    put = context.broadcast

    def broadcast(self, value):
        out = put(self, value)
        if isinstance(value, ngram_bloom.Filters):
            alive.add(id(out))
            most.append(len(alive))
            end = out.destroy
            out.destroy = lambda: (alive.discard(id(out)), end())
        return out

    monkeypatch.setattr(context, "broadcast", broadcast)
    assert ngram_bloom.digest(df).count() == 40
    assert len(most) > 1 and set(most) == {1} and not alive


def test_routed_pairs_of_awkward_tables(spark, monkeypatch):
    monkeypatch.setattr(ngram_bloom, "MOST_PASSES", 0)
    df = documents(spark, [None, "", " ", "a b a b", "x " * 30_000]).repartition(3)
    routed = sorted(map(tuple, ngram_bloom.digest(df).collect()), key=repr)
    monkeypatch.undo()
    assert [r[:5] for r in routed] == [r[:5] for r in sorted(map(tuple, ngram_bloom.digest(df).collect()), key=repr)]
    assert ngram_bloom.digest(empty(spark)).collect() == []


def test_empty_and_untrained(spark):
    assert ngram_bloom.digest(empty(spark)).collect() == []
    held = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 10 == 0)
    (row,) = ngram_bloom.digest(documents(spark, []).where("doc_id IS NULL")).collect()
    assert (row.held_out, row.n_known, row.train_tokens) == (True, 0, 0) and row.base_score < 1e-9 and held >= 0


def test_filter_never_forgets():
    rng = np.random.default_rng(5)
    h = np.unique(rng.integers(0, 1 << 63, 20_000).astype(np.uint64))
    c = rng.integers(1, 500, len(h))
    f = ngram_bloom.Filters(w := ngram_bloom.filled(h, c), np.array([len(w)]), 0, 1)
    level = np.floor(np.log2(c)).astype(int) + 1
    got = f.level(h)
    assert (got >= level).all() and (got > level).mean() < 0.05
    assert (f.level(h + np.uint64(1)) > 0).mean() < 0.05


@pytest.mark.parametrize("passes", [0, 10_000])
def test_scans_planned_anew_between_passes(spark, small, monkeypatch, tmp_path, passes):
    """Files are split by the cores that are alive: an executor that comes or goes must not change which row is which."""
    spark.read.parquet(f"{small}/documents.parquet").repartition(6).write.parquet(str(tmp_path / "d"))
    df = spark.read.parquet(str(tmp_path / "d"))
    monkeypatch.setattr(ngram_bloom, "FILTER_BYTES", 20_000)
    monkeypatch.setattr(ngram_bloom, "MOST_PASSES", passes)
    want = sorted(map(repr, ngram_bloom.digest(df).select("doc_id", "n_tokens", "n_known").collect()))
    part, key, calls = ngram_bloom._part, "spark.sql.files.minPartitionNum", []

    def replanned(*a):
        spark.conf.set(key, str(1 + 7 * (len(calls) % 2)))
        calls.append(a)
        return part(*a)

    monkeypatch.setattr(ngram_bloom, "_part", replanned)
    try:
        got = ngram_bloom.digest(df)
        spark.conf.set(key, "5")
        assert sorted(map(repr, got.select("doc_id", "n_tokens", "n_known").collect())) == want and (len(calls) > 1 or not passes)
    finally:
        spark.conf.unset(key)


def test_reducers_hold_a_small_segment_at_a_time(spark, small, monkeypatch):
    """However few partitions a shuffle has, pairs are counted in many segments, of which equal hashes share one."""
    df = spark.read.parquet(f"{small}/documents.parquet").limit(60)
    size = df.selectExpr("sum(octet_length(text))").first()[0]
    monkeypatch.setattr(ngram_bloom, "SEGMENT_BYTES", size // 600, raising=False)
    model = ngram_bloom.train(df)
    segments = model.counts.where("n = 2").select("segment", "distinct").collect()
    assert spark.conf.get("spark.sql.shuffle.partitions") == "4" and len(segments) == len({r[0] for r in segments}) > 500
    assert max(r[1] for r in segments) * 100 < sum(r[1] for r in segments)


def test_large_rows_lie_in_small_row_groups(spark):
    import pyarrow.parquet as pq

    from tessera.storage import stored

    rows = stored(spark.range(0, 30, 1, 1).selectExpr("id", "randstr(1000000, 7) AS v"), "large", large=True)
    (path,) = (f.removeprefix("file://") for f in rows.inputFiles())
    meta = pq.ParquetFile(path).metadata
    assert meta.num_row_groups > 3 and rows.count() == 30
