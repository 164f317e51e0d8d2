"""Tables in the folder that all executors share: how lineage is cut."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path below spark.checkpoint.dir that nothing else uses; what is written there stays.

    Only where that setting is absent and all runs in one JVM (tests) is a temporary folder used and the setting made; on a
    cluster executors would not see such a folder, so there its absence is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below spark.checkpoint.dir, removed when the driver's JVM ends."""
    path = fresh_path(spark, name)
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.deleteOnExit(target)
    return fs.makeQualified(target).toString()


#: Parquet looks at the size of pages and row groups after 100 rows; rows of megabytes have to be looked at one by one.
LARGE_ROWS = {"parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1", "parquet.block.size.row.check.min": "1", "parquet.block.size.row.check.max": "1", "parquet.block.size": str(8 << 20)}


def stored(df: DataFrame, name: str, large: bool = False) -> DataFrame:
    """df written to the shared folder and reread: lineage is cut and lost executors lose nothing.

    large: rows of up to megabytes. They are written in row groups of about 8 MB, so that neither writers nor readers hold hundreds of them.
    """
    path = shared_folder(df.sparkSession, name)
    df.write.options(**(LARGE_ROWS if large else {})).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Deletes what stored() wrote for df, once nothing reads it any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
