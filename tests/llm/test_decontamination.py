import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import suffix_array

from .fixtures import AWKWARD, documents, empty, lowered

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ITEMS = "item_id long, text string"


def brute(docs, items, width=10):
    windows = {}
    for i, t in items:
        w = WORD.findall(lowered(t))
        for k in range(max(1, len(w) - width + 1) if w else 0):
            windows.setdefault(tuple(w[k : k + width]), set()).add(i)
    out = []
    for i, t in docs:
        w, hit, found, longest = WORD.findall(lowered(t)), set(), set(), 0
        for z in {len(k) for k in windows}:
            for k in range(len(w) - z + 1):
                if ids := windows.get(tuple(w[k : k + z])):
                    found |= ids
                    hit.update(range(k, k + z))
        for _, s in items if hit else []:
            v = WORD.findall(lowered(s))
            for a in range(len(w)):
                for b in range(len(v)):
                    n = 0
                    while a + n < len(w) and b + n < len(v) and w[a + n] == v[b + n]:
                        n += 1
                    if n >= min(width, len(v)):
                        longest = max(longest, n)
        ids = sorted(map(str, found - {None}))
        out.append((i, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit), longest))
    return sorted(out, key=repr)


def data():
    r = random.Random(3)
    vocabulary = ["alpha", "Beta", "gamma", "é", "中", "delta9", "x"]
    say = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    items = [(i, say(14)) for i in range(5)] + [(5, "short Item here"), (6, None), (7, "..."), (8, ""), (9, items0 := say(12)), (10, items0), (None, say(13))]
    docs = [t for t in AWKWARD if t is None or len(t) < 9999] + [say(60) for _ in range(30)]
    docs += [f"{say(5)}, {t} {say(3)}" for _, t in items if t] + ["a SHORT, item; here!", say(4).join([items0, items0, items0]), items0.replace(" ", "\n- ")]
    return docs, items


def test_against_brute_force(spark):
    docs, items = data()
    df = documents(spark, docs)
    got = suffix_array.digest(df, spark.createDataFrame(items, ITEMS)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute([(r.doc_id, r.text) for r in df.collect()], items)


def test_several_blocks_of_items(spark, monkeypatch):
    docs, items = data()
    df, tests = documents(spark, docs), spark.createDataFrame(items, ITEMS)
    one = sorted(map(tuple, suffix_array.digest(df, tests).collect()), key=repr)
    monkeypatch.setattr(suffix_array, "BLOCK_BYTES", 200)
    assert sorted(map(tuple, suffix_array.digest(df, tests).collect()), key=repr) == one


def test_empty_tables_and_clashing_columns(spark):
    docs, items = data()
    tests = spark.createDataFrame(items, ITEMS)
    assert suffix_array.digest(empty(spark), tests).collect() == []
    none = suffix_array.digest(documents(spark, docs), spark.createDataFrame([], ITEMS)).collect()
    assert len(none) == len(docs) + 2 and not any(r.contaminated for r in none)
    df = documents(spark, docs).withColumn("items", F.lit("own")).withColumn("item_id", F.lit(1))
    clean = suffix_array.clean(df.drop("items"), tests)
    assert clean.columns == df.drop("items").columns
    assert clean.count() == sum(not r[5] for r in brute([(r.doc_id, r.text) for r in df.collect()], items))


def found_in(text, items):
    tests = suffix_array.Tests.of([i for i, _ in items], [t for _, t in items])
    return tests, suffix_array.search(suffix_array.scan(pa.array([text]), suffix_array.ALPHANUMERIC), tests)[0]


def test_equal_windows_are_searched_once():
    line = " ".join(f"w{i}" for i in range(30))
    # 10,000 equal items, and as many that share all but the last word; the passage comes back 1,000 times.
    items = [(i, line) for i in range(10_000)] + [(10_000 + i, f"{line} t{i}") for i in range(10_000)]
    tests, row = found_in(f"{line} and on. " * 1000 + f"{line} t77", items)
    assert len(tests.which) == 21 + 10_000 and len(tests.sets) < 10_005
    assert len(row["items"]) == 20_000 and len(row["hits"]) == 1001
    assert row["longest"] == {"words": 31, "at": 32_000, "item_id": 10_077}


def test_longest_matches_are_followed_to_their_end():
    words = [f"w{i % 977}x{i}" for i in range(100_000)]
    other = " ".join([*words[40:60], "turn", *words[70:90]])
    _, row = found_in("begin " + " ".join(words) + " end", [(1, " ".join(words)), (2, other), (3, " ".join(words[5:90_000]))])
    assert row["longest"] == {"words": 100_000, "at": 1, "item_id": 1} and row["items"] == [1, 2, 3] and row["hits"] == [{"start": 1, "end": 100_001}]
    r = random.Random(8)
    for _ in range(60):
        items = [(i, " ".join(r.choice("ab") for _ in range(r.randrange(1, 40)))) for i in range(6)]
        text = " ".join(r.choice("ab") for _ in range(60))
        (want,) = brute([(0, text)], items)
        _, row = found_in(text, items)
        assert (row["longest"] or {"words": 0})["words"] == want[6] and len(row["items"]) == want[3] and sum(h["end"] - h["start"] for h in row["hits"]) == want[2]


def test_one_block_of_items_is_alive_at_a_time(spark, monkeypatch):
    docs, items = data()
    context, alive, most = type(spark.sparkContext), set(), []
    put = context.broadcast

    def broadcast(self, value):
        out = put(self, value)
        if isinstance(value, suffix_array.Tests):
            alive.add(id(out))
            most.append(len(alive))
            end = out.destroy
            out.destroy = lambda: (alive.discard(id(out)), end())
        return out

    monkeypatch.setattr(context, "broadcast", broadcast)
    monkeypatch.setattr(suffix_array, "BLOCK_BYTES", 100)
    got = suffix_array.digest(documents(spark, docs), spark.createDataFrame(items, ITEMS))
    assert got.count() == len(docs) + 2 and len(most) > 3 and set(most) == {1}


@pytest.mark.parametrize("depth", [1, 4, 16])
def test_suffixes_are_sorted(depth):
    h = np.random.default_rng(0).integers(0, 3, 400).astype(np.uint64)
    order = suffix_array.suffix_array(h, depth)
    assert sorted(order.tolist()) == list(range(400))
    keys = [tuple(h[i : i + depth].tolist()) for i in order]
    assert keys == sorted(keys)


def test_long_document(spark):
    words = [f"w{i}" for i in range(300_000)]
    df = documents(spark, [" ".join(words)])
    (row,) = suffix_array.digest(df.where("doc_id = 0"), spark.createDataFrame([(1, " ".join(words[250_000:250_050]))], ITEMS)).collect()
    assert (row.n_words, row.n_hit, row.longest_match) == (300_000, 50, 50)


def test_items_without_words_are_not_collected(spark, monkeypatch):
    items = spark.createDataFrame([(i, t) for i in range(300) for t in ("", " . ", None)] + [(900, "one two"), (901, "drei é")], ITEMS)
    blocks, block = suffix_array._blocks(items)
    seen, of = [], suffix_array.Tests.of
    monkeypatch.setattr(suffix_array.Tests, "of", lambda ids, texts: seen.append(ids) or of(ids, texts))
    block(0)
    assert blocks == 1 and sorted(seen[0]) == [900, 901]
    monkeypatch.setattr(suffix_array, "BLOCK_BYTES", 2 * suffix_array.ROW_BYTES)
    assert suffix_array._blocks(items.unionByName(spark.createDataFrame([(i, "a") for i in range(20)], ITEMS)))[0] == 12
