"""Incremental intake of documents: each run takes only new files, and every row is accepted or refused with one reason.

A file stream with a checkpoint reads what has been added to the table's folder since the last run and stops (availableNow). Reasons,
the first that holds: missing_id, missing_text, too_short, conflicting_id (an earlier batch accepted the id with another text, or this
one has the id with a text of lesser digest), repeated_text (an earlier batch accepted the text, or this one has it with a lesser id,
then source, among the rows that are left; of equal rows one is accepted). Texts are equal in any case of A-Z and with any blanks.

Writes OUT/rows/batch=N (partitioned by reason; equal rows are one row, `rows` counts them) and OUT/report/batch=N (rows by source and
reason). Files that arrive together are judged together, whatever their order. A batch that failed is run again by the stream under
its number, overwrites its own folders and looks only at lesser batches, so the result is the same. Earlier batches never change.

    spark-submit --py-files ... jobs/text_intake.py --documents DIR --out DIR --checkpoint DIR [--config FILE]
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from jobs.settings import arguments, log, session, settings
from tessera.operators.components import looked_up
from tessera.operators.refuse import first_reason
from tessera.storage import stored

ROWS = "doc_id long, source string, n_words long, digest string, rows long, reason string"
#: What runs of blanks become, so that equal texts have equal digests.
_BLANKS = r"[\x20\x09-\x0D]+"


def digest_of(text: Column) -> Column:
    return F.sha2(F.trim(F.regexp_replace(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), _BLANKS, " ")), 256)


def judged(rows: DataFrame, earlier: DataFrame, least_words: int) -> DataFrame:
    """rows (doc_id, source, text) by id, source and digest, with their number and reason. earlier: doc_id and digest of what was accepted before."""
    words = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long"), F.lit(0).cast("long"))
    each = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), words.alias("n_words"), digest_of(F.col("text")).alias("digest"))
    slim = stored(each.groupBy("doc_id", "source", "n_words", "digest").agg(F.count(F.lit(1)).alias("rows")), "intake-slim")
    reason = first_reason([("missing_id", F.col("doc_id").isNull()), ("missing_text", F.col("digest").isNull()), ("too_short", F.col("n_words") < least_words)])
    checked = slim.withColumn("reason", reason)
    able = checked.where("reason IS NULL").drop("reason")
    # Of the past only what the batch asks for is joined; ids and texts that many rows share are looked up where the rows are.
    ids = able.groupBy("doc_id").agg(F.min("digest").alias("least"))
    held = earlier.join(ids.select("doc_id"), "doc_id").select("doc_id", F.col("digest").alias("held"))
    ids = stored(ids.join(held, "doc_id", "left").select("doc_id", F.coalesce("held", "least").alias("own")), "intake-ids")
    rest = looked_up(able, ids, "doc_id")
    texts = rest.where("digest = own").groupBy("digest").agg(F.min(F.struct("doc_id", F.coalesce("source", F.lit("")).alias("s"), F.col("source").isNull().alias("n"))).alias("head"))
    taken = earlier.join(texts.select("digest"), "digest").select("digest", F.lit(True).alias("taken"))
    texts = stored(texts.join(taken, "digest", "left"), "intake-texts")
    found = looked_up(rest, texts, "digest", "left")
    first = (F.col("head.doc_id") == F.col("doc_id")) & (F.col("head.s") == F.coalesce("source", F.lit(""))) & (F.col("head.n") == F.col("source").isNull()) & F.col("taken").isNull()
    said = F.when(F.col("digest") != F.col("own"), F.array(F.struct(F.lit("conflicting_id").alias("reason"), F.col("rows").alias("rows"))))
    said = said.when(~first, F.array(F.struct(F.lit("repeated_text").alias("reason"), F.col("rows").alias("rows"))))
    said = said.otherwise(F.array(F.struct(F.lit("accepted").alias("reason"), F.lit(1).cast("long").alias("rows")), F.struct(F.lit("repeated_text").alias("reason"), (F.col("rows") - 1).alias("rows"))))
    out = found.select("doc_id", "source", "n_words", "digest", F.explode(said).alias("s")).select("doc_id", "source", "n_words", "digest", "s.rows", "s.reason").where("rows > 0")
    return out.unionByName(checked.where("reason IS NOT NULL"))


def accepted(spark: SparkSession, out: str) -> DataFrame:
    """All rows of all batches, as they stand: doc_id, source, n_words, digest, batch, reason."""
    schema = f"{ROWS}, batch long"
    try:
        return spark.read.schema(schema).parquet(f"{out}/rows")
    except AnalysisException as e:
        # Before the first batch there is no folder; anything else is an error.
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def run(spark: SparkSession, documents: str, out: str, checkpoint: str, config: dict | None = None) -> str:
    """Takes the files that are new since the last run with this checkpoint, and returns OUT."""
    c = config or settings("text_intake")
    kinds = {f.name: f.dataType for f in spark.read.parquet(documents).schema}

    def take(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        before = accepted(session, out).where((F.col("batch") < number) & (F.col("reason") == "accepted"))
        rows = judged(batch, before, c["least_words"])
        rows.write.mode("overwrite").partitionBy("reason").parquet(f"{out}/rows/batch={number}")
        found = session.read.schema(ROWS).parquet(f"{out}/rows/batch={number}")
        found.groupBy("source", "reason").agg(F.sum("rows").alias("rows")).coalesce(1).write.mode("overwrite").json(f"{out}/report/batch={number}")
        counts = {r["reason"]: r["rows"] for r in found.groupBy("reason").agg(F.sum("rows").alias("rows")).collect()}
        log.info("batch %d of %s: read %d rows, wrote %s", number, documents, sum(counts.values()), counts)

    schema = StructType([StructField(n, kinds[n]) for n in ("doc_id", "source", "text")])
    # A pattern that names the path alone: it may be a folder that grows, or one file.
    path = documents.rstrip("/")
    files = spark.readStream.schema(schema).option("maxFilesPerTrigger", c["files_per_batch"]).parquet(f"{path[:-1]}[{path[-1]}]")
    query = files.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    log.info("%s is up to date", out)
    return out


def main() -> None:
    a = arguments(__doc__, "documents", "out", "checkpoint")
    spark = session("text-intake")
    try:
        run(spark, a.documents, a.out, a.checkpoint, settings("text_intake", a.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
