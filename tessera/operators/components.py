"""Connected components of a table of links, by minimum labels and pointer jumping; nothing is collected.

A component may hold any share of all nodes, so no join is dealt out by labels or hub nodes alone: see `looked_up`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import dropped, stored

#: Rows of two numbers that may be broadcast, after a count.
BROADCAST_ROWS = 1_000_000
#: Beyond, a value is heavy that more than one in HEAVY rows share; so there are fewer than HEAVY such values.
HEAVY = 1000


def looked_up(rows: DataFrame, table: DataFrame, on: str, how: str = "inner", known: int | None = None, most: int | None = None) -> DataFrame:
    """rows joined with table, which is unique in the column `on`, however many rows share one value (known: the table's count).

    A table of `most` (BROADCAST_ROWS) rows at most is broadcast. Of a larger one only what heavy values need is; all others shuffle.
    """
    if (table.count() if known is None else known) <= (BROADCAST_ROWS if most is None else most):
        return rows.join(F.broadcast(table), on, how)
    total = rows.count()
    heavy = stored(rows.groupBy(on).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") * HEAVY > total).select(on), "heavy")
    dense = table.join(F.broadcast(heavy), on, "left_semi")
    light = rows.join(F.broadcast(heavy), on, "left_anti").join(table, on, how)
    return light.unionByName(rows.join(F.broadcast(heavy), on, "left_semi").join(F.broadcast(dense), on, how))


def components(links: DataFrame) -> DataFrame:
    """node and label (the least node of its component) for every node of links (u, v); both are long.

    A round gives each node the least label among its neighbours and itself and then that label's own label, so a path
    of n nodes takes about log n rounds. Each round is written to the shared folder.
    """
    edges = stored(links.select("u", "v").union(links.select("v", "u")).where("u <> v").distinct().toDF("u", "v"), "edges")
    labels = stored(edges.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.least("u", "v").alias("label")), "labels")
    nodes = labels.count()
    while True:
        # Least labels are aggregated before they are shuffled, and hubs' labels are looked up where their edges are.
        near = looked_up(edges, labels.toDF("v", "label"), "v", known=nodes).groupBy("u").agg(F.min("label").alias("near"))
        lower = labels.join(near, labels["node"] == near["u"]).select("node", F.col("label").alias("before"), F.least("label", "near").alias("label"))
        jump = labels.toDF("label", "further")
        after = stored(looked_up(lower, jump, "label", "left", known=nodes).select("node", "before", F.least("label", F.coalesce("further", "label")).alias("label")), "labels")
        dropped(labels)
        labels = after.select("node", "label")
        if not after.where("before <> label").limit(1).count():
            dropped(edges)
            return labels
