import hashlib

import duckdb
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tessera.llm import language_id, queries, secret_scan

from .fixtures import documents, empty
from .test_decontamination import brute as leaked
from .test_near_duplicates import brute as alike


def test_stages_against_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{small}/benchmark.parquet").select("item_id", "text").collect()]
    rows = {r.doc_id: r for r in docs.collect()}
    # The frozen trees are the stage's own; what follows is brute force over its decisions.
    trees = language_id.learn(docs, language_id.learned_rows())
    kept = {r.doc_id: rows[r.doc_id].text for r in language_id.identify(docs, trees).collect() if r.lang_pred != "und" and r.bits_per_byte < 8}
    assert all(any(c.isalpha() for c in t) for t in kept.values())
    groups = alike(sorted(kept.items()), 5)
    kept = {i: t for i, t in kept.items() if groups[i][1] == i}
    hit = {r[0] for r in leaked(sorted(kept.items()), items) if r[5]}
    kept = {i: secret_scan.redact(t, [s[1:] for s in secret_scan.spans_of(t)]) for i, t in kept.items() if i not in hit}
    library = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.TOKENIZER))
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, small).collect()}
    assert set(got) == set(kept)
    for i, t in kept.items():
        ids = library.encode(t, add_special_tokens=False).ids
        assert got[i].ids == ids and got[i].n_tokens == len(ids) and got[i].n_chars == len(t)
        assert got[i].decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


CLASHING = {"score": "7.5D", "lang_pred": "'own'", "bits_per_byte": "'b'", "items": "'x'", "hits": "1", "n_words": "'many'", "longest": "map(doc_id, 1)", "_null": "'n'", "_row": "2L", "row": "3", "row_key": "4", "key": "'k'", "node": "5", "kept": "false", "_text": "'t'", "c0": "'c'", "label": "6", "a.b": "array(7)"}


def test_extra_columns_keep_their_values(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(80).unionByName(documents(spark))
    docs = docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).selectExpr("*", *(f"{v} AS `{k}`" for k, v in CLASHING.items()))
    own = {r.doc_id: {k: r[k] for k in CLASHING} for r in docs.collect()}
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, small)
        got = docs.collect()
        assert got and all({k: r[k] for k in CLASHING} == own[r.doc_id] for r in got), name
    assert docs.columns == [*[c for c in names if c != "text"], "n_tokens", "ids", "decoded_sha256"]


def test_stages_take_awkward_tables(spark, small):
    for docs in (documents(spark), empty(spark), documents(spark).selectExpr("*", "1 AS label", "'x' AS items")):
        names = docs.columns
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, small)
            assert docs.columns == names, name
        out = corpus_pipeline.STAGES[-1][1](spark, docs, small)
        assert out.columns == [*[c for c in names if c not in ("text", "ids")], "n_tokens", "ids", "decoded_sha256"]
        out.collect()


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_equal_their_sql(spark, small, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    got, want = queries.queries()[name](spark, small), con.sql(queries.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert sorted(map(tuple, got.select(*columns).collect()), key=repr) == sorted(want.select(*columns).fetchall(), key=repr)


def test_every_query_is_registered():
    assert [int(n[2:].split("_")[0]) for n in queries.queries()] == list(range(1, 13))
    assert set(queries.oracle_sql()) <= set(queries.queries())
