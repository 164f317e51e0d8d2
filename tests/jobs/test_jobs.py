"""The jobs on copies: reruns, growing input, a batch that fails half way, and awkward rows."""

import json
import os
import subprocess
import sys

import duckdb
import pytest

from jobs import family_release, queries, settings, text_intake
from tests.conftest import ROOT

DOCS = "doc_id long, source string, text string, n_chars long"
LONG = "six words are in this text "


def docs(spark, path, rows, name="a"):
    """One more file (or several) in the table's folder."""
    spark.createDataFrame([(i, s, t, 0) for i, s, t in rows], DOCS).coalesce(1).write.mode("append").parquet(str(path))


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def decided(spark, out):
    return rows(text_intake.accepted(spark, str(out)), "batch", "doc_id", "reason", "rows")


def test_intake_takes_only_what_is_new(spark, tmp_path):
    table, out, mark = (str(tmp_path / n) for n in ("documents.parquet", "out", "checkpoint"))
    docs(spark, table, [(2, "s", LONG + "b"), (1, "s", LONG.upper() + "  A"), (3, "s", LONG + "a"), (4, None, None), (None, "s", LONG), (5, "s", "short"), (6, "s", ""), (2, "s", LONG + "b"), (2, "s", LONG + "b"), (7, None, LONG + "7"), (7, "s", LONG + "7")])
    text_intake.run(spark, table, out, mark)
    first = decided(spark, out)
    assert first == [(0, 1, "accepted", 1), (0, 2, "accepted", 1), (0, 2, "repeated_text", 2), (0, 3, "repeated_text", 1), (0, 4, "missing_text", 1), (0, 5, "too_short", 1), (0, 6, "too_short", 1), (0, 7, "accepted", 1), (0, 7, "repeated_text", 1), (0, None, "missing_id", 1)]
    text_intake.run(spark, table, out, mark)
    assert decided(spark, out) == first
    docs(spark, table, [(0, "s", LONG + "A"), (1, "s", LONG + "another"), (8, "s", LONG + "b "), (9, "s", LONG + "new")])
    text_intake.run(spark, table, out, mark)
    both = decided(spark, out)
    assert both[: len(first)] == first and both[len(first) :] == [(1, 0, "repeated_text", 1), (1, 1, "conflicting_id", 1), (1, 8, "repeated_text", 1), (1, 9, "accepted", 1)]
    text_intake.run(spark, table, out, mark)
    assert decided(spark, out) == both
    assert sum(r["rows"] for r in spark.read.json(f"{out}/report").collect()) == 15 == sum(r[3] for r in both)


def test_a_failed_batch_is_run_again(spark, tmp_path, monkeypatch):
    table, out, mark = (str(tmp_path / n) for n in ("documents.parquet", "out", "checkpoint"))
    docs(spark, table, [(1, "s", LONG + "a"), (2, "s", LONG + "b")])
    text_intake.run(spark, table, out, mark)
    docs(spark, table, [(3, "s", LONG + "a"), (4, "s", LONG + "c")])
    told = text_intake.log.info

    def fails(message, *values):
        if message.startswith("batch"):
            raise RuntimeError("lost after the rows were written")
        told(message, *values)

    monkeypatch.setattr(text_intake.log, "info", fails)
    with pytest.raises(Exception, match="lost after"):
        text_intake.run(spark, table, out, mark)
    monkeypatch.setattr(text_intake.log, "info", told)
    text_intake.run(spark, table, out, mark)
    assert decided(spark, out) == [(0, 1, "accepted", 1), (0, 2, "accepted", 1), (1, 3, "repeated_text", 1), (1, 4, "accepted", 1)]


def test_intake_in_small_batches_accepts_each_text_once(spark, tmp_path):
    table, out, mark = (str(tmp_path / n) for n in ("documents.parquet", "out", "checkpoint"))
    for k in range(5):
        docs(spark, table, [(10 * k + i, "s", LONG + str(i % 3)) for i in range(6)])
    text_intake.run(spark, table, out, mark, {"least_words": 5, "files_per_batch": 2})
    got = text_intake.accepted(spark, out)
    assert got.where("reason = 'accepted'").count() == 3 and got.where("reason = 'accepted'").select("digest").distinct().count() == 3
    assert got.select("batch").distinct().count() == 3 and got.agg({"rows": "sum"}).first()[0] == 30


def test_intake_of_a_hot_text_and_a_hot_id(spark, tmp_path, monkeypatch):
    from tessera.operators import components

    monkeypatch.setattr(components, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(components, "HEAVY", 4)
    table, out, mark = (str(tmp_path / n) for n in ("documents.parquet", "out", "checkpoint"))
    docs(spark, table, [(i, "s", LONG) for i in range(300)] + [(999, "s", LONG + str(i)) for i in range(300)] + [(2000 + i, "s", LONG + f"own {i}") for i in range(100)])
    text_intake.run(spark, table, out, mark)
    counts = {r[0]: r[1] for r in text_intake.accepted(spark, out).groupBy("reason").count().collect()}
    assert counts == {"accepted": 102, "repeated_text": 299, "conflicting_id": 299}


def test_intake_of_nothing(spark, tmp_path):
    table, out, mark = (str(tmp_path / n) for n in ("documents.parquet", "out", "checkpoint"))
    docs(spark, table, [])
    text_intake.run(spark, table, out, mark)
    assert decided(spark, out) == []


def release(spark, tmp_path, documents, labels):
    spark.createDataFrame(documents, "doc_id long, text string, source string").write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int").write.mode("overwrite").parquet(f"{tmp_path}/labels.parquet")
    out = family_release.run(spark, f"{tmp_path}/documents.parquet", f"{tmp_path}/labels.parquet", f"{tmp_path}/out")
    return spark.read.parquet(f"{out}/rows"), spark.read.json(f"{out}/report")


def corpus(n=60):
    return [(i, f"line {i}\n" + "word " * (3 + i % 17) + "x" * (i % 5), "s") for i in range(n)]


def test_release_refuses_with_reasons_and_keeps_families_whole(spark, tmp_path):
    documents = [*corpus(), (100, "line 1\nanother body of text", "s"), (101, corpus()[2][1], "s"), (102, "  \n", "s"), (103, None, "s"), (104, "one text", "s"), (104, "two texts", "s")]
    labels = [(i, i % 2) for i in range(60)] + [(100, 1), (101, 0), (102, 1), (103, 1), (104, 1), (105, 1), (3, None), (4, 0), (5, 0), (5, 0), (None, 1)]
    got, report = release(spark, tmp_path, documents, labels)
    reasons = {(r.doc_id, r.reason) for r in got.where("split = 'refused'").collect()}
    assert reasons == {(102, "blank_text"), (103, "blank_text"), (104, "ambiguous_document"), (105, "unknown_document"), (None, "unknown_document"), (3, "missing_label"), (5, "conflicting")}
    family = {r.doc_id: (r.family, r.split) for r in got.where("split <> 'refused'").collect()}
    assert family[100] == family[1] and family[101] == family[2] and family[100][0] == 1 and 3 in family
    assert {r.split for r in report.collect()} == {"train", "calibration", "test"} and not report.first().accuracy_validated
    before = rows(got, *got.columns)
    again, _ = release(spark, tmp_path, documents, labels)
    assert rows(again, *again.columns) == before


def test_too_few_families_are_refused(spark, tmp_path):
    with pytest.raises(ValueError, match="independent groups"):
        release(spark, tmp_path, corpus(5), [(i, i % 2) for i in range(5)])


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_registered_jobs_equal_their_sql(spark, small, name):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    got = queries.queries()[name](spark, small)
    want = con.sql(queries.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    plain = lambda rows: sorted(str([round(v, 5) if isinstance(v, float) else v for v in r]) for r in rows)
    assert plain(got.select(*sorted(got.columns)).collect()) == plain(want.select(*[f'"{c}"' for c in sorted(want.columns)]).fetchall())


def test_settings(tmp_path):
    own = tmp_path / "c.json"
    own.write_text(json.dumps({"seed": 7}))
    assert settings.settings("family_release", str(own))["seed"] == 7
    own.write_text(json.dumps({"sed": 7}))
    with pytest.raises(ValueError, match="sed"):
        settings.settings("family_release", str(own))


def test_command_lines(tmp_path, small):
    """A run of its own process, from files to files."""
    run = [sys.executable, "-m", "jobs.text_intake", "--documents", f"{small}/documents.parquet", "--out", f"{tmp_path}/out", "--checkpoint", f"{tmp_path}/mark"]
    env = {"PYSPARK_SUBMIT_ARGS": f"--conf spark.master=local[2] --conf spark.ui.enabled=false --conf spark.checkpoint.dir={tmp_path}/shared pyspark-shell"}
    done = subprocess.run(run, cwd=ROOT, env=os.environ | env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert "read 200 rows" in done.stderr and (tmp_path / "out/report/batch=0").is_dir()
    assert subprocess.run([sys.executable, "-m", "jobs.family_release"], cwd=ROOT, capture_output=True, timeout=60).returncode == 2


def test_jobs_import_no_training_operators():
    code = "import sys, jobs.queries; assert not [m for m in sys.modules if m.startswith(('tessera.llm', 'corpus_pipeline'))]"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_release_shuffles_no_texts(spark, small):
    from jobs.family_release import labelled

    plan = labelled(spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet"))._jdf.queryExecution().executedPlan().toString()
    # Under an exchange, no aggregate and no sort takes a text along.
    assert "partial_min(text" not in plan and "count(distinct" not in plan
