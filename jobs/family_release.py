"""Release of labelled documents: refused rows with reasons, splits by family, predictions with calibrated intervals.

What a group-aware evaluation needs before any figure may be quoted, as one batch job over the text tables:

1. Labels are refused with one named reason each: unknown_document, ambiguous_document (its id has several texts),
   missing_label, blank_text, nonfinite_target, conflicting (labels of one document differ). Equal labels of one document count once.
2. Documents that share a text or a first line, directly or through others, are one family. Whole families are dealt to
   train, calibration and test.
3. A ridge on two features of the text is fitted on training rows, families counting alike.
4. The interval's radius is the conformal rank of calibration families' largest errors; no radius where there are too few.
5. Test and other rows outside the training rows' ranges are out_of_domain.

Writes OUT/rows (partitioned by split, one row for each document with labels, refused ones under `refused`) and OUT/report (one row
for each split). Both are overwritten whole and depend on the input and the settings alone, so a rerun gives the same rows.

    spark-submit --py-files ... jobs/family_release.py --documents DIR --labels DIR --out DIR [--config FILE]
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.settings import arguments, log, session, settings
from tessera.operators import grouping, heads, metrics, prepare, refuse
from tessera.operators.components import looked_up
from tessera.storage import dropped, stored

FEATURES = ["log_words", "word_length"]
_WORD = r"[^\x20\x09-\x0D]+"


def first_line(text: Column) -> Column:
    return F.lower(F.substring_index(text, "\n", 1))


def labelled(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each document that has labels: doc_id, quality, reason (null where it is kept), features and aliases."""
    words = F.coalesce(F.regexp_count("text", F.lit(_WORD)).cast("long"), F.lit(0))
    digest = lambda text: F.unhex(F.sha2(text, 256))
    # Texts stay where they are read: what follows needs their digests and sizes. An id of several texts is refused, whichever text it has here.
    rows = documents.select("doc_id", digest("text").alias("whole"), digest(first_line(F.col("text"))).alias("line"), words.alias("words"), F.length("text").alias("length"))
    each = rows.groupBy("doc_id").agg(*[F.min(c).alias(c) for c in ("line", "words", "length")], F.min("whole").alias("whole"), F.max("whole").alias("other"), F.max(F.col("whole").isNull()).alias("blank"))
    several = (F.col("whole") != F.col("other")) | (F.col("blank") & F.col("whole").isNotNull())
    known = each.select(
        "doc_id", F.coalesce(several, F.lit(False)).alias("several"), "words", F.lit(True).alias("known"),
        F.log1p("words").alias(FEATURES[0]),
        F.when(F.col("words") > 0, F.col("length") / F.col("words")).alias(FEATURES[1]),
        F.array(F.concat(F.lit(b"t"), "whole"), F.concat(F.lit(b"l"), "line")).alias("aliases"),
    )
    marks = labels.groupBy("doc_id", F.col("quality").cast("double").alias("quality")).agg(F.count(F.lit(1)).alias("repeats"))
    rows = marks.join(known, "doc_id", "left")
    checks = [
        ("unknown_document", F.col("known").isNull()),
        ("ambiguous_document", F.col("several")),
        ("missing_label", F.col("quality").isNull()),
        ("blank_text", F.col("words") == 0),
    ]
    judged = prepare.solvation_rows(rows, "quality", "doc_id", ["quality"], checks)
    return judged.select("doc_id", "quality", "reason", *FEATURES, "aliases")


def run(spark: SparkSession, documents: str, labels: str, out: str, config: dict | None = None) -> str:
    """Reads the two tables, writes OUT/rows and OUT/report, and returns OUT."""
    c = config or settings("family_release")
    judged = stored(labelled(spark.read.parquet(documents), spark.read.parquet(labels)), "release-judged")
    log.info("read %s and %s: %s", documents, labels, {r["reason"]: r["n"] for r in prepare.accounting(judged).collect()})
    kept = judged.where("reason IS NULL")
    families = stored(grouping.alias_components(kept, "doc_id", F.col("aliases")).withColumnRenamed("group", "family"), "release-families")
    splits = grouping.group_split(families, "family", c["seed"], c["test"], c["calibration"], c["least_families"])
    dealt = stored(looked_up(kept.join(families, "doc_id"), splits, "family"), "release-dealt")
    if grouping.leaks(dealt, "family", "split").limit(1).count():
        raise ValueError("a family lies in several splits")
    train = dealt.where("split = 'train'")
    # Families weigh 1 each; sums that don't depend on the order of rows make reruns agree to the last bit.
    share = train.groupBy("family").agg((1.0 / F.count(F.lit(1))).alias("weight"))
    sums = heads.exact_gram(looked_up(train, share, "family"), [*FEATURES, "quality"], "weight")
    head = heads.LinearHead.solve(sums, FEATURES, ["quality"], c["ridge"] * sums.weight)
    bounds = train.agg(*[f(x).alias(f"{n}_{x}") for x in FEATURES for n, f in (("low", F.min), ("high", F.max))]).first()
    predicted = dealt.withColumn("predicted", head.predict()["quality"])
    error = F.col("quality") - F.col("predicted")
    radius = metrics.conformal_radius(predicted.where("split = 'calibration'"), "family", {"quality": error}, c["alpha"]).first()["radius"]
    outside = refuse.out_of_range([F.col(x) for x in FEATURES], [bounds[f"low_{x}"] for x in FEATURES], [bounds[f"high_{x}"] for x in FEATURES], 1e-8)
    status = refuse.prediction_status(F.lit(True), F.lit(False), outside, [F.col("predicted")], F.lit(c["label_kind"]))
    wide = F.lit(radius).cast("double")
    low, high = refuse.interval(F.col("predicted"), wide)
    rows = predicted.select("doc_id", "quality", "reason", "family", "predicted", low.alias("low"), high.alias("high"), status.alias("status"), "split")
    nothing = lambda kind: F.lit(None).cast(kind)
    refused = judged.where("reason IS NOT NULL").select("doc_id", "quality", "reason", nothing("long").alias("family"), *(nothing("double").alias(n) for n in ("predicted", "low", "high")), F.lit("unsupported").alias("status"), F.lit("refused").alias("split"))
    rows.unionByName(refused).write.mode("overwrite").partitionBy("split").parquet(f"{out}/rows")
    scores = metrics.component_metrics(rows, F.col("quality"), F.col("predicted"), ["split"])
    hit = (F.abs(error) <= wide).cast("int")
    covered = rows.groupBy("split", "family").agg(F.sum(hit).alias("hits"), F.count(F.lit(1)).alias("n"), F.min(hit).alias("all")).groupBy("split").agg((F.sum("hits") / F.sum("n")).alias("row_coverage"), F.avg("all").alias("family_coverage"), F.count(F.lit(1)).alias("families"))
    figures = {n: F.round(n, 9) for n in ("mae", "rmse", "r2", "row_coverage", "family_coverage")}
    report = scores.join(covered, "split").withColumns({**figures, "radius": wide, "accuracy_validated": F.lit(False)})
    report.coalesce(1).write.mode("overwrite").json(f"{out}/report")
    for table in (judged, families, dealt):
        dropped(table)
    log.info("wrote %s: %s", out, {r["split"]: r["count"] for r in spark.read.parquet(f"{out}/rows").groupBy("split").count().collect()})
    return out


def main() -> None:
    a = arguments(__doc__, "documents", "labels", "out")
    spark = session("family-release")
    try:
        run(spark, a.documents, a.labels, a.out, settings("family_release", a.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
