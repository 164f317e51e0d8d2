"""Families of rows: aliases, components, folds, splits, weights, leaks and embargoes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stored
from .components import components, looked_up


def alias_components(df: DataFrame, row: str, aliases: Column) -> DataFrame:
    """row and group: rows that share any alias, directly or through others, have one group, their least row id.

    Every alias is tied to its least row, a star, so an alias that most rows share costs as many links as rows.
    Rows without aliases are groups of their own.
    """
    tied = df.select(F.col(row).cast("long").alias("v"), F.explode(aliases).alias("alias")).where("alias IS NOT NULL").distinct()
    heads = tied.groupBy("alias").agg(F.min("v").alias("u"))
    # Most rows may share one alias: its head is looked up where they are.
    links = looked_up(stored(tied, "aliases"), stored(heads, "alias-heads"), "alias").where("u <> v").select("u", "v").distinct()
    found = components(links)
    return df.select(F.col(row).cast("long").alias(row)).distinct().join(found, F.col(row) == found["node"], "left").select(row, F.coalesce("label", row).alias("group"))


def hash_rank(df: DataFrame, keys: list[str], digest: Column, digits: int = 4) -> DataFrame:
    """df's distinct keys with `rank` (from 0) by (digest, keys).

    Ranks are local to a prefix of the hexadecimal digest plus the number of keys with lesser prefixes, so that no task
    sorts them all. digits: of the prefix; 16 ** digits counts are summed by one task.
    """
    each = df.select(*keys).distinct().withColumn("_digest", digest).withColumn("_prefix", F.substring("_digest", 1, digits))
    sizes = each.groupBy("_prefix").agg(F.count(F.lit(1)).alias("_n"))
    starts = sizes.select("_prefix", (F.sum("_n").over(Window.orderBy("_prefix")) - F.col("_n")).alias("_start"))
    local = F.row_number().over(Window.partitionBy("_prefix").orderBy("_digest", *keys)) - 1
    return each.withColumn("_local", local).join(F.broadcast(starts), "_prefix").select(*keys, (F.col("_start") + F.col("_local")).cast("long").alias("rank"))


def hash_folds(df: DataFrame, family: str, folds: int, seed: int, salt: str = "compatibility") -> DataFrame:
    """family and fold: families in order of sha256("salt-seed" NUL family), then family, dealt round."""
    key = F.sha2(F.concat(F.lit(f"{salt}-{seed}"), F.lit("\0"), F.col(family).cast("string")), 256)
    return hash_rank(df, [family], key).select(family, (F.col("rank") % folds).alias("fold"))


def group_split(df: DataFrame, group: str, seed: int, test: float = 0.2, calibration: float = 0.25, least: int = 8) -> DataFrame:
    """group and split: a share of all groups is `test`, a share of the rest `calibration`, the others `train`.

    Groups are ranked by hash (seed for the first cut, seed + 1 for the second); fewer than `least` groups are refused.
    """
    groups = df.select(group).distinct()
    n = groups.count()
    if n < least:
        raise ValueError(f"need at least {least} independent groups; no random-split fallback")
    digest = lambda s: F.sha2(F.concat(F.lit(f"{s}"), F.lit("\0"), F.col(group).cast("string")), 256)
    n_test = -int(-n * test // 1)
    first = hash_rank(groups, [group], digest(seed))
    rest = first.where(F.col("rank") >= n_test).select(group)
    n_calibration = -int(-(n - n_test) * calibration // 1)
    second = hash_rank(rest, [group], digest(seed + 1)).select(group, F.when(F.col("rank") < n_calibration, "calibration").otherwise("train").alias("split"))
    return first.where(F.col("rank") < n_test).select(group, F.lit("test").alias("split")).unionByName(second)


def ordered(df: DataFrame, by: list[Column]) -> DataFrame:
    """df with `position`, its place (from 0) in the order of the columns: places within ranges, and the sizes of lesser ranges."""
    placed = stored(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_place", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("_place", 33)
    # One row for each range.
    counts = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    starts = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_start"))
    return placed.withColumn("_part", part).join(F.broadcast(starts), "_part").withColumn("position", F.col("_start") + F.col("_place").bitwiseAND((1 << 33) - 1)).drop("_part", "_start", "_place")


def dealt_runs(counts: list[tuple[int, int]], folds: int) -> dict[int, list[tuple[int, list[int]]]]:
    """Per size the runs in which its groups are dealt: the first group of a run, and the folds that take turns from there on.

    counts: (size, number of groups). Largest sizes first; a group goes to the fold of the least load, the least number among equals. Folds
    whose loads lie within one size of each other take turns until the next fold's load is reached, so there are at most `folds` runs of a size.
    """
    load = [0] * folds
    out = {}
    for size, left in sorted(counts, reverse=True):
        runs, first = [], 0
        while left:
            order = sorted(range(folds), key=lambda j: (load[j], j))
            low = order[0]
            turns = [j for j in order if (load[j], j) < (load[low] + size, low)]
            n = left
            if len(turns) < folds:
                nearest = order[len(turns)]
                gap = load[nearest] - load[low]
                n = min(left, (gap // size - (gap % size == 0 and nearest < low)) * len(turns))
            runs.append((first, turns))
            for i, j in enumerate(turns):
                load[j] += size * (n // len(turns) + (i < n % len(turns)))
            first, left = first + n, left - n
        out[size] = runs
    return out


def size_balanced_folds(df: DataFrame, group: str, folds: int) -> DataFrame:
    """group, n (its rows) and fold: largest groups first (of equal ones that whose text is least), each to the fold with the fewest rows so far.

    Any number of groups: the driver has the distinct sizes alone, of which there are at most the root of twice the rows.
    """
    sizes = stored(df.groupBy(group).agg(F.count(F.lit(1)).alias("n")), "group-sizes")
    counts = [(r["n"], r["groups"]) for r in sizes.groupBy("n").agg(F.count(F.lit(1)).alias("groups")).collect()]
    runs = dealt_runs(counts, min(folds, max(1, sum(g for _, g in counts))))
    before, starts = 0, {}
    for n, g in sorted(counts, reverse=True):
        starts[n], before = before, before + g
    spark = df.sparkSession
    known = spark.createDataFrame([(n, starts[n], [f for f, _ in runs[n]], [t for _, t in runs[n]]) for n, _ in counts], "n long, start long, firsts array<long>, turns array<array<int>>")
    placed = ordered(sizes.withColumn("_text", F.col(group).cast("string")), [F.desc("n"), F.asc("_text")])
    rank = F.col("position") - F.col("start")
    at = F.size(F.filter("firsts", lambda f: f <= F.col("_rank")))
    found = looked_up(placed, known, "n", known=len(counts)).withColumn("_rank", rank).withColumn("_at", at).withColumn("_turn", F.element_at("turns", F.col("_at")))
    fold = F.element_at("_turn", ((F.col("_rank") - F.element_at("firsts", F.col("_at"))) % F.size("_turn") + 1).cast("int"))
    return found.select(group, "n", fold.cast("long").alias("fold"))


def split_report(df: DataFrame, split: str, group: str) -> DataFrame:
    return df.groupBy(split).agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(group).alias("groups"))


def family_pair_weights(df: DataFrame, family: str, pair: list[str]) -> DataFrame:
    """df with `weight` = 1 / families / pairs of the family / rows of the pair; weights sum to 1."""
    counts = df.groupBy(family, *pair).agg(F.count(F.lit(1)).alias("_rows"))
    pairs = counts.groupBy(family).agg(F.count(F.lit(1)).alias("_pairs"))
    total = pairs.agg(F.count(F.lit(1)).alias("_families"))
    known = counts.join(pairs, family).join(F.broadcast(total)).withColumn("weight", 1.0 / F.col("_families") / F.col("_pairs") / F.col("_rows"))
    return df.join(known.select(family, *pair, "weight"), [family, *pair])


def balanced_weights(df: DataFrame, family: str) -> DataFrame:
    """df with `weight` = 1 / (families * rows of the family)."""
    counts = df.groupBy(family).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.count(F.lit(1)).alias("_families"))
    return df.join(counts.join(F.broadcast(total)).select(family, (1.0 / (F.col("_families") * F.col("_n"))).alias("weight")), family)


def split_groups(df: DataFrame, expected: str, group: str) -> DataFrame:
    """Groups by `expected` that `group` splits: they may be merged, never split. Has to be empty."""
    return df.groupBy(expected).agg(F.count_distinct(group).alias("parts")).where("parts > 1")


def leaks(df: DataFrame, key: str, split: str) -> DataFrame:
    """Keys that occur in several splits. Has to be empty."""
    return df.groupBy(key).agg(F.count_distinct(split).alias("splits")).where("splits > 1")


def pairs_in_several_families(df: DataFrame, pair: str, family: str) -> DataFrame:
    return df.groupBy(pair).agg(F.count_distinct(family).alias("families")).where("families > 1")


def embargo(df: DataFrame, row: str, aliases: list[Column], reserved: list[DataFrame]) -> DataFrame:
    """Rows of df none of whose aliases is reserved. Aliases are tested one after another, the cheapest first."""
    out = df
    for alias, taken in zip(aliases, reserved, strict=True):
        keys = taken.toDF("_reserved").distinct()
        out = out.join(keys, alias == F.col("_reserved"), "left_anti")
    return out


def overlap(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys on both sides. Has to be empty where sides must be isolated."""
    return left.select(key).intersect(right.select(key))
