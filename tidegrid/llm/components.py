"""Connected components over link tables, without collecting links anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.common import dropped, written

SALTS = 32


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) for links (a, b) of longs; component: the smallest node reachable.

    Hooking and pointer jumping: every round, each node and each node's current label take the smallest label that
    stands across a link, then labels jump to their label's label. The number of rounds follows the logarithm of a
    component's longest path. Minima are aggregated before the shuffle, and the jump reads only labels that have moved,
    salted, so a component with most of the nodes is no hot key. Self-links and repeated links change nothing; null ends
    are ignored; no links give no rows.
    """
    links = links.where("a is not null and b is not null and a <> b").select("a", "b").distinct()
    both = written(links.union(links.select("b", "a")).distinct(), "links")
    n = both.count()
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("label")), "labels", n)
    while True:
        across = both.join(labels.withColumnRenamed("node", "b"), "b").select("a", F.col("label").alias("low"))
        own = labels.withColumnRenamed("node", "a")
        seen = across.groupBy("a").agg(F.min("low").alias("low"))
        met = own.join(seen, "a").select(F.col("a").alias("node"), "label", "low")
        hooks = met.where("low < label").groupBy(F.col("label").alias("node")).agg(F.min("low").alias("hook"))
        nearer = met.join(hooks, "node", "left").select("node", F.col("label").alias("was"), F.expr("least(label, low, hook)").alias("label"))
        nearer = written(nearer, "nearer", n)
        moved = nearer.where("label <> node").select(F.col("node").alias("label"), F.col("label").alias("jump"))
        aimed = nearer.groupBy("label").agg(F.lit(1).alias("one")).select("label")
        jumps = aimed.join(moved, "label").where("jump < label").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        after = written(
            nearer.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))
            .join(jumps, ["label", "salt"], "left")
            .select("node", "was", F.expr("least(label, jump)").alias("label")),
            "labels",
            n,
        )
        done = after.where("label <> was").isEmpty()
        dropped(nearer)
        dropped(labels)
        labels = after
        if done:
            dropped(both)
            return labels.select("node", F.col("label").alias("component"))


def first_of_each(rows: DataFrame, roots: DataFrame, id_col: str) -> DataFrame:
    """Of the rows (with _node, and _mark: a hash of the whole row) of each component of roots (node, component) the one with
    the smallest id, a null one last, then the smallest node and hash. A node without a root is a component of its own.
    """
    order = F.struct(F.col(id_col).isNull().alias("nameless"), F.col(id_col).alias("id"), F.col("_node").alias("node"), F.col("_mark").alias("mark"))
    lowest = written(rows.groupBy("_node").agg(F.min(order).alias("row")), "lowest")
    of = F.coalesce("component", "_node")
    marks = lowest.join(roots.withColumnRenamed("node", "_node"), "_node", "left").groupBy(of.alias("of")).agg(F.min("row").alias("row")).select(F.col("row.mark").alias("_mark"))
    return rows.join(marks, "_mark", "left_semi").dropDuplicates(["_mark"])
