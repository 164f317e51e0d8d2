"""Importance resampling and the mix of sources, against plain Python."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.llm import importance, pareto_mix
from tests.llm.fixtures import AWKWARD, LONG, documents, empty, lowered

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
MORE = [" ".join(f"w{(i * j) % 31}" for j in range(5 + i)) for i in range(40)]


def benchmark(spark, texts=("w1 w2 w3 word5", "The same TEXT", None)):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "item_id long, text string")


def grams(text, longest):
    w = WORD.findall(lowered(text))
    return [" ".join(w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1)]


def expected(docs, target, longest=1):
    of = lambda texts: Counter(zlib.crc32(g.encode()) % 10_000 for t in texts for g in grams(t, longest))
    s, t = of([x[1] for x in docs]), of(target)
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + 10_000) / ((s[b] + 1) * (t.total() + 10_000))))
    out = []
    for key, text in docs:
        found = [gain(zlib.crc32(g.encode()) % 10_000) for g in grams(text, longest)]
        weight = sum(found) // len(found) if found else 0
        h = int(hashlib.sha256(f"2024:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        out.append((key, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(WORD.findall(lowered(text)))))
    able = sorted((-x[3], x[0] is None, x[0] or 0) for x in out if x[4] >= 20)
    return out, able[: len(able) * 10 // 100]


def test_importance_like_plain_python(spark):
    docs = documents(spark, [*AWKWARD, *MORE])
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = importance.digest(docs, benchmark(spark)).collect()
    want, drawn = expected(rows, ["w1 w2 w3 word5", "The same TEXT", None])
    key = lambda x: tuple((v is None, v or 0) for v in x)
    assert sorted([tuple(r)[:4] for r in got], key=key) == sorted([w[:4] for w in want], key=key)
    assert sorted((r.rank, -r.score, r.doc_id is None, r.doc_id or 0) for r in got if r.rank) == [(i + 1, *d) for i, d in enumerate(drawn)]


@pytest.mark.parametrize("longest", [2, 3])
def test_longer_runs_are_tuples_of_word_ids(spark, longest):
    docs = documents(spark, [*AWKWARD[:7], *MORE])
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    target = benchmark(spark).select(F.lit(None).cast("long").alias("doc_id"), "text")
    got = importance.weighed(docs.select("doc_id", "text"), target, longest).collect()
    want, _ = expected(rows, ["w1 w2 w3 word5", "The same TEXT", None], longest)
    key = lambda x: tuple((v is None, v or 0) for v in x)
    assert sorted([(r.doc_id, r.n_features, r.weight) for r in got], key=key) == sorted([w[:3] for w in want], key=key)


def test_blocks_do_not_matter(spark, monkeypatch):
    docs, target = documents(spark, [*AWKWARD, *MORE]), benchmark(spark)
    whole = sorted(map(str, importance.digest(docs, target).collect()))
    monkeypatch.setattr(importance, "BLOCK", 100)
    assert sorted(map(str, importance.digest(docs.repartition(7), target).collect())) == whole


def test_resampled_rows_keep_their_columns(spark):
    docs = documents(spark, MORE).withColumns({"rank": F.lit("own"), "n_words": F.lit(-1), "row.1": F.lit(2)})
    got = importance.resampled(docs, benchmark(spark), per_cent=20)
    assert got.columns == [*docs.columns, "rank"]
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == sum(len(WORD.findall(t)) >= 20 for t in MORE) * 20 // 100
    assert sorted(r[-1] for r in rows) == list(range(1, len(rows) + 1)) and all(r[-4:-1] == ("own", -1, 2) for r in rows)


def test_importance_of_empty_tables(spark):
    assert importance.digest(empty(spark), benchmark(spark)).collect() == []
    got = importance.digest(documents(spark), benchmark(spark, [])).collect()
    want, _ = expected([(r.doc_id, r.text) for r in documents(spark).collect()], [])
    assert sorted(r.weight for r in got) == sorted(w[2] for w in want)


def fill(sizes, share=1.5, most=2.0):
    """Targets by resharing one excess after the other."""
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s)))}
    full, budget = {}, share * sum(sizes.values())
    while True:
        rest = budget - sum(full.values())
        w = sum(weight[s] for s in sizes if s not in full)
        new = {s: most * sizes[s] for s in sizes if s not in full and weight[s] * rest / w >= most * sizes[s]}
        if not new:
            return full | {s: weight[s] * rest / w for s in sizes if s not in full}
        full |= new


def mix(spark, n=600):
    rows = [(i, " ".join(["w"] * (i * 7919 % 97)) + (" long" * 900 if i % 40 == 0 else ""), "en", None if i % 11 == 0 else "big" if i % 3 else f"s{i % 5}", 0) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_mix_meets_its_targets(spark):
    docs = mix(spark)
    got = pareto_mix.digest(docs).join(docs.select("doc_id", "source"), "doc_id").collect()
    size = Counter()
    for r in got:
        size[r.source] += r["size"]
    want = fill(dict(size))
    taken = Counter()
    for r in got:
        assert r.source_size == size[r.source] and r.target == pytest.approx(want[r.source])
        assert r.taken in (0, r["size"], 2 * r["size"])
        taken[r.source] += r.taken
    # Shorter documents make up for what longer ones leave: within a few words of the target.
    assert all(abs(taken[s] - want[s]) <= 97 for s in size)
    assert sorted(map(tuple, pareto_mix.digest(docs.repartition(5)).collect())) == sorted(tuple(r)[:5] for r in got)


def test_bins_do_not_matter(spark, monkeypatch):
    docs = mix(spark, 300)
    whole = sorted(map(tuple, pareto_mix.digest(docs).collect()))
    monkeypatch.setattr(pareto_mix, "BINS", 2)
    assert sorted(map(tuple, pareto_mix.digest(docs).collect())) == whole


def test_preference_moves_inclusion_odds(spark):
    docs = mix(spark).where("doc_id % 40 <> 0").withColumn("source", F.lit("one")).withColumn("good", (F.col("doc_id") % 2 == 0).cast("int")).withColumn("odds", F.when(F.col("good") == 1, 50.0).otherwise(1.0))
    plain = pareto_mix.mixed(docs).where("good = 1").agg(F.sum("copies")).first()[0]
    liked = pareto_mix.mixed(docs, preference="odds").where("good = 1").agg(F.sum("copies")).first()[0]
    assert liked > 1.1 * plain


def test_mix_of_awkward_rows(spark):
    docs = documents(spark, more=[(90, LONG, "en", None, 1), (90, LONG, "en", None, 1), (91, None, "en", "silent", 0)]).withColumns({"copies": F.lit("own"), "size": F.lit(1)})
    got = pareto_mix.mixed(docs)
    assert got.columns == [*docs.columns, "copies"] and got.count() == docs.count()
    rows = pareto_mix.digest(docs).collect()
    assert all(r.taken <= 2 * r["size"] for r in rows) and [r.target for r in rows if r.doc_id == 91] == [0.0]
    assert pareto_mix.digest(empty(spark)).collect() == []
