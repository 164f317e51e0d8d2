import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as driver
from tessera.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


def plain(rows):
    def one(v):
        if v is None or (isinstance(v, float) and v != v):
            return None
        return round(float(v), 6) if isinstance(v, float) else str(v) if not isinstance(v, (int, bool)) else v

    return sorted(repr(tuple(one(v) for v in r)) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query_equals_its_sql(spark, small, oracle, name):
    got = catalog.QUERIES[name](spark, small)
    columns = sorted(got.columns)
    want = oracle.sql(catalog.ORACLE[name])
    assert columns == sorted(want.columns)
    assert plain(got.select(*[f"`{c}`" for c in columns]).collect()) == plain(want.select(*[f'"{c}"' for c in columns]).fetchall())


def test_contract(spark):
    assert driver.entry(spark).count() == 5
    assert set(driver.oracle_sql()) <= set(driver.queries())
    assert os.path.isdir(driver.ROOT)


@pytest.mark.parametrize("missing", ["ahocorasick", "zstandard", "xxhash", "public_tokenizers", "regex"])
def test_core_queries_stay_without_third_party_modules(missing):
    """Where a module is missing that only the training-data operators need, the others are still registered."""
    code = f"""
import sys, warnings
sys.modules[{missing!r}] = None
warnings.simplefilter("ignore")
import __spark_entry__ as e
names = set(e.queries())
assert "group_metrics" in names and not any(n.startswith("op") and n[2].isdigit() for n in names) and "pipeline" not in names
assert set(e.oracle_sql()) <= names
"""
    subprocess.run([sys.executable, "-c", code], cwd=driver.ROOT, check=True)


@pytest.mark.parametrize("partitions", ["1", "7"])
def test_results_do_not_depend_on_partitions(spark, small, partitions):
    names = ["hash_folds", "alias_components", "conformal_radius", "dedupe_first_wins"]
    want = {n: plain(catalog.QUERIES[n](spark, small).collect()) for n in names}
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        assert {n: plain(catalog.QUERIES[n](spark, small).collect()) for n in names} == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
