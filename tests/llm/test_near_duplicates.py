import collections
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import minhash
from tessera.operators.components import components

from .fixtures import AWKWARD, WORDS, documents, empty, lowered


def brute(docs, k):
    sets = {}
    for i, t in docs:
        w = WORDS.findall(lowered(t))
        sets[i] = frozenset(tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))) if w else frozenset()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = [i for i in sets if sets[i]]
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def families(seed=1):
    """Copies, chains of edits (so that ends aren't linked), texts of the same words, ties at the threshold."""
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    out = []
    for n in (30, 60, 150):
        base = [r.choice(words) for _ in range(n)]
        text = list(base)
        for step in range(25):
            out.append(" ".join(text))
            text[r.randrange(n)] = f"edit{step}"
        out += [" ".join(base)] * 5 + [" ".join(base).upper()]
    line = [f"v{i}" for i in range(43)]
    # 40 shingles and 40 of 50: exactly the threshold; one word more is below it.
    out += [" ".join(line), " ".join([*line, *[f"t{i}" for i in range(10)]]), " ".join([*line, *[f"u{i}" for i in range(11)]])]
    return out


@pytest.mark.parametrize("k", [4, 5])
def test_against_brute_force(spark, k, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 8)
    df = documents(spark, [*AWKWARD, *families()])
    known = {(r.doc_id, r.text) for r in df.where("doc_id IS NOT NULL").collect()}
    want = brute(sorted(known), k)
    got = minhash.near_duplicates(df.withColumn("node", F.lit(1)).withColumn("label", F.lit("x")), k).collect()
    assert len(got) == df.count()
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id) == want[r.doc_id] and r.kept == (r.doc_id == r.component_id), r


def test_one_document_of_each_group_stays(spark):
    df = documents(spark, [*AWKWARD, *families(2)])
    out = minhash.deduplicated(df.withColumn("label", F.lit(1)))
    assert out.columns == [*df.columns, "label"]
    want = brute(sorted({(r.doc_id, r.text) for r in df.where("doc_id IS NOT NULL").collect()}), 5)
    ids = [r.doc_id for r in out.collect()]
    assert collections.Counter(ids) == collections.Counter([None, *{c for _, c in want.values()}])


def test_rows_that_share_an_id_stay_or_go_by_themselves(spark):
    copy = "one text of eight words that comes back"
    near = " ".join(f"w{i}" for i in range(60))
    data = [
        (1, copy, "a"), (None, copy, "b"), (None, "this clean text has a null id", "c"), (None, "and so has this clean text", "d"),
        (2, copy, "e"), (2, "a clean text under the id of a copy", "f"),
        (3, near, "g"), (3, near + " more", "h"), (3, near, "i"),
        (None, "a pair of equal texts without ids", "j"), (None, "a pair of equal texts without ids", "k"),
        (4, None, "l"), (4, None, "l"), (4, " ", "m"), (None, None, "n"), (None, None, "n"),
    ]
    df = spark.createDataFrame(data, "doc_id long, text string, source string").selectExpr("*", "map(source, 1) AS extra", "0 AS `a.b`")
    got = minhash.deduplicated(df)
    assert got.columns == df.columns
    left = [r.source for r in got.select("source").collect()]
    assert sorted(x for x in left if x not in "ghijk") == list("acdflmn")
    assert len(left) == 9 and sum(x in "ghi" for x in left) == 1 and sum(x in "jk" for x in left) == 1
    flagged = minhash.near_duplicates(df).where("doc_id = 3").collect()
    assert {r.component_id for r in flagged} == {3} and sum(r.kept for r in flagged) in (1, 2)
    # The contract's kept is about ids: rows that share a component's id are all kept.
    assert all(r.kept == (r.doc_id == r.component_id) for r in minhash.digest(df).collect())


def test_null_ids_link_as_others_do(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 8)
    # Every third text has an id, and those of 60 words none at all.
    texts = list(dict.fromkeys(families(3)))
    data = [(i if i % 3 == 0 and len(t.split()) != 60 else None, t) for i, t in enumerate(texts)]
    want = brute(list(enumerate(texts)), 5)
    ids = collections.defaultdict(list)
    for n, (i, _) in enumerate(data):
        ids[want[n][1]].append(i)
    least = {c: min((i for i in own if i is not None), default=None) for c, own in ids.items()}
    assert None in least.values() and len(ids) < len(data) // 3
    df = spark.createDataFrame(data, "doc_id long, text string")
    got = collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in minhash.near_duplicates(df).collect())
    assert got == collections.Counter((i, want[n][0], least[want[n][1]]) for n, (i, _) in enumerate(data))
    assert collections.Counter(r.doc_id for r in minhash.deduplicated(df).collect()) == collections.Counter(least.values())


def test_a_percolating_chain_grows_linearly(spark):
    """Each text shares half its shingles with the next: none are links, but buckets tie all of them together."""

    def dealt(n):
        texts = [" ".join(f"w{j}" for j in range(15 * i, 15 * i + 100)) for i in range(n)]
        rows = minhash._described(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 5)
        members = rows.select("node", F.posexplode("bands").alias("band", "bucket")).select("bucket", "band", "node")
        labels = members.select("node", F.col("node").alias("label")).distinct()
        found = minhash._dealt(minhash._labelled(members, labels)).persist()
        pairs = found.groupBy("bucket", "x", "y").agg((F.sum(F.col("out").cast("int")) * F.sum((~F.col("out")).cast("int"))).alias("n")).agg(F.sum("n")).first()[0]
        return found.count(), pairs

    (few, few_pairs), (many, many_pairs) = dealt(100), dealt(800)
    assert few > 50 and many < 12 * few and many_pairs < 12 * few_pairs


def test_empty(spark):
    assert minhash.near_duplicates(empty(spark)).collect() == []
    assert minhash.deduplicated(empty(spark)).collect() == []


def test_posterior_bounds_keep_links():
    least = minhash.least_matches(80)
    for n, m in least.items():
        grid = (np.arange(200_000) + 0.5) / 200_000
        density = lambda x: np.exp(x * np.log(grid) + (n - x) * np.log1p(-grid) - n * np.log(0.9))  # noqa: E731,B023
        share = lambda x: density(x)[grid >= 0.8].sum() / density(x).sum()  # noqa: E731,B023
        assert share(m) >= minhash.MISS * 0.9 and (m == 0 or share(m - 1) < minhash.MISS * 1.1)
    a = minhash.shingle_sets(pa.array([" ".join(f"w{i}" for i in range(500)), " ".join(f"w{i}" for i in range(40, 520))]), 4)
    sig = minhash.signatures(a)
    both = np.intersect1d(*a).size
    assert abs((sig[0] == sig[1]).mean() - both / (len(a[0]) + len(a[1]) - both)) < 0.1


def test_components_of_long_paths_and_stars(spark):
    path = [(i, i + 1) for i in range(1000, 1100)]
    star = [(5, i) for i in range(6, 60)]
    got = {r.node: r.label for r in components(spark.createDataFrame([*path, *star, (7, 7)], "u long, v long")).collect()}
    assert got == {**{i: 1000 for i in range(1000, 1101)}, **{i: 5 for i in range(5, 60)}}
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []
