import collections
import math
import random
import unicodedata
import zlib

import duckdb
from pyspark.sql import functions as F

from tessera.llm import language_id
from tessera.llm.probe_table import ProbeTable

from .fixtures import AWKWARD, documents, empty


def test_code_lengths_are_those_of_method_c():
    samples = {"x": [b"abracadabra"], "y": [b"banana band"]}
    trees = language_id.ContextTrees.learn(samples, order=2)
    pad = b"\n\n"

    def cost(text, data):
        total = 0
        stream = pad + text
        data = pad + data
        for i in range(2, len(stream)):
            bits = 0
            for k in (2, 1, 0):
                context, s = stream[i - k : i], stream[i]
                after = [data[j + k] for j in range(len(data) - k) if data[j : j + k] == context]
                if not after:
                    continue
                kinds = len(set(after))
                if s in after:
                    bits += round(math.log2((len(after) + kinds) / after.count(s)) * language_id.BIT)
                    break
                bits += round(math.log2((len(after) + kinds) / kinds) * language_id.BIT)
            else:
                bits += 8 * language_id.BIT
            total += bits
        return total

    texts = [b"abra", b"banana", b"", b"zzz", b"bandana\nabra", b"q"]
    got = trees.lengths(texts)
    for t, row in zip(texts, got.tolist(), strict=True):
        # Separators between samples add contexts of their own; here each language has one sample.
        assert row == [cost(t, samples["x"][0]), cost(t, samples["y"][0])]


def test_query_against_brute_force(spark):
    r = random.Random(11)
    say = lambda letters, n: "".join(r.choice(letters) for _ in range(n)).strip() or "x"
    kinds = {"en": "the andof  ", "de": "deruüß nd  ", "xx": "中文の一 ", "aa": "TtHhEe  "}
    rows = [(i, say(kinds[lang], r.randrange(5, 60)), lang) for i, lang in enumerate(r.choice(sorted(kinds)) for _ in range(120))]
    rows += [(200, "²½ Ⅷ", "en"), (201, "ª", "en"), (202, "ⅷ 12", None), (203, "", "de"), (204, None, "de"), (205, "the and", "en"), (205, "the and", "en"), (None, "der und", None), (206, "\u0301 \u20dd", "de"), (207, "ǅ", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 4 == 2
    samples = language_id._sample(df, language_id.learned_rows())
    lettered = lambda t: any(unicodedata.category(c)[0] == "L" for c in t or "")
    want = collections.Counter((lang, t.lower().encode()) for i, t, lang in rows if lang and not held(i) and lettered(t))
    assert collections.Counter((lang, t) for lang, texts in samples.items() for t in texts) == want
    after = {}
    for lang, texts in samples.items():
        stream = b"\n\n\n" + b"\n\n\n".join(texts)
        seen = after[lang] = collections.defaultdict(collections.Counter)
        for k in range(4):
            for j in range(k, len(stream)):
                seen[stream[j - k : j]][stream[j]] += 1

    def cost(text, seen):
        stream, total = b"\n\n\n" + text, 0
        for j in range(3, len(stream)):
            for k in (3, 2, 1, 0):
                found = seen.get(stream[j - k : j])
                if not found:
                    continue
                n, kinds_ = sum(found.values()), len(found)
                if stream[j] in found:
                    total += round(math.log2((n + kinds_) / found[stream[j]]) * 4096)
                    break
                total += round(math.log2((n + kinds_) / kinds_) * 4096)
            else:
                total += 8 * 4096
        return total

    got = collections.Counter((x.doc_id, x.held_out, x.lang_pred, round(x.score, 9)) for x in language_id.digest(df).collect())
    brute = collections.Counter()
    for i, t, _ in rows:
        if not lettered(t):
            brute[(i, held(i), "und", 0.0)] += 1
            continue
        costs = {lang: cost(t.lower().encode(), seen) for lang, seen in after.items()}
        best = min(costs, key=lambda k: (costs[k], k))
        brute[(i, held(i), best, round(1 / sum(2 ** (-(c - costs[best]) / 4096) for c in costs.values()), 9))] += 1
    assert got == brute


def test_long_texts_do_not_depend_on_spans(monkeypatch):
    trees = language_id.ContextTrees.learn({"x": [b"some text to learn from"], "y": [b"ein anderer text"]})
    texts = [b"text " * 500, b"", b"einer", b"some " * 37]
    whole = trees.lengths(texts)
    monkeypatch.setattr(language_id, "_SPAN", 97)
    assert (trees.lengths(texts) == whole).all()


def test_probe_table():
    import numpy as np

    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 5000).astype(np.uint64))
    keys = np.append(keys, np.uint64(2**64 - 1))
    table = ProbeTable(keys)
    assert (table.find(keys) == np.arange(len(keys))).all()
    assert (table.find(keys[:-1] + np.uint64(1)) == np.where(np.isin(keys[:-1] + np.uint64(1), keys), 0, -1)).all()
    assert (ProbeTable(np.zeros(0, np.uint64)).find(keys) == -1).all()


def test_held_out_accuracy(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r for r in language_id.digest(df).collect()}
    truth = duckdb.sql("SELECT doc_id, lang FROM '/root/testdata/sf0.01/documents.parquet'").fetchall()
    held = [(got[i].lang_pred, lang) for i, lang in truth if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= got[i].score <= 1 for i, _ in truth)
    assert sum(a == b for a, b in held) >= 0.99 * len(held)


def test_every_language_is_learned_up_to_the_bound(spark, monkeypatch):
    monkeypatch.setattr(language_id, "SAMPLE_BYTES", 5000)
    texts = [("long", f"{k} " + "ab " * 300_000) for k in range(3)]
    texts += [(f"l{k}", f"{k} " + "some text " * 4000) for k in range(20) for _ in range(2)]
    texts += [("mixed", f"{k} " + "x" * 96) for k in range(300)] + [("mixed", "é" * 1_000_000)]
    texts += [("copies", "the same row")] * 1000 + [("few", "abc"), ("few", "de")]
    ids = [None if lang == "copies" else i for i, (lang, _) in enumerate(texts)]
    df = spark.createDataFrame([(i, t, lang) for i, (lang, t) in zip(ids, texts, strict=True)], "doc_id long, text string, lang string")
    got = language_id._sample(df, F.lit(True))
    assert set(got) == {lang for lang, _ in texts}
    for lang, found in got.items():
        size = sum(map(len, found))
        assert sorted(found) == [b"abc", b"de"] if lang == "few" else 5000 <= size <= 4 * 5000, (lang, size)
    again = language_id._sample(df.repartition(7), F.lit(True))
    assert again == got


def test_awkward_rows(spark):
    df = documents(spark).withColumn("lang_pred", F.col("source"))
    got = language_id.digest(df.drop("lang_pred")).collect()
    assert len(got) == df.count()
    by = {r.doc_id: r for r in got}
    assert [by[i].lang_pred for i in (0, 1, 2, 6)] == ["und"] * 4 and by[3].lang_pred == "en"
    assert language_id.digest(empty(spark)).collect() == []
    nothing = language_id.digest(documents(spark, AWKWARD).withColumn("lang", F.lit(None).cast("string"))).collect()
    assert len(nothing) == df.count()
    clash = language_id.identify(df, None)
    assert clash.columns.count("lang_pred") == 1 and {r.lang_pred for r in clash.collect()} == {"und"}
    kept = language_id.accepted(df.drop("lang_pred"), language_id.learn(df, language_id.learned_rows()))
    assert kept.columns == df.drop("lang_pred").columns and kept.where("doc_id = 3").count() == 2 and not kept.where("text IS NULL").count()


def test_samples_do_not_depend_on_prefixes(spark, monkeypatch):
    """Prefixes are narrowed until they hold few times the bound; the texts that are learned stay the same."""
    r = random.Random(5)
    rows = [(i, "".join(r.choice("abcd ") for _ in range(40)) + "x", "en" if i % 5 else "de") for i in range(3000)] + [(None, "the same text again", "en")] * 400
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    monkeypatch.setattr(language_id, "SAMPLE_BYTES", 600)
    found = []
    for bits in (1, 3, 12, 31):
        monkeypatch.setattr(language_id, "PREFIX_BITS", bits)
        found.append({k: sorted(v) for k, v in language_id._sample(df, language_id.learned_rows()).items()})
    assert found[0] == found[1] == found[2] == found[3] and all(600 <= sum(map(len, v)) < 700 for v in found[0].values())
