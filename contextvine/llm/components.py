"""Connected components by alternating large-star and small-star rounds, all in joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialise


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One round: every node links its larger (or its smaller and itself) neighbours to the least of all.

    ``edges`` are written and hold each link once, ``u > v``.  Both sides of the
    join are dealt by the node, so the links of one node may fill many tasks.
    """
    if large:
        both = edges.select(F.col("u").alias("n"), F.col("v").alias("m")).unionByName(edges.select(F.col("v").alias("n"), F.col("u").alias("m")))
        least = both.groupBy("n").agg(F.least(F.min("m"), F.col("n")).alias("least"))
        linked = both.where("m > n")
    else:
        linked = edges.select(F.col("u").alias("n"), F.col("v").alias("m"))
        least = linked.groupBy("n").agg(F.min("m").alias("least"))
        # the node itself joins the least of its smaller neighbours
        linked = linked.unionByName(least.select("n", F.col("n").alias("m")))
    # dealt by another key first, so that the join below deals both sides itself
    least = least.withColumnRenamed("n", "node").repartition(F.xxhash64("node")).hint("merge")
    return linked.join(least, F.col("n") == F.col("node")).select(F.col("m").alias("u"), F.col("least").alias("v")).where("u <> v").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """``node, component`` for every node of a link; the component is its least node.

    Loops, repeated links and either direction are allowed; null ends are ignored;
    no links give no rows.  Every round is written to the shared folder.
    """
    now = materialise(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).distinct(), "links")
    count = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).head(1)[0])
    state = count(now)
    for _ in range(most_rounds):
        if not state[0]:
            break
        after = materialise(_star(materialise(_star(now, True), "links"), False), "links")
        before, now, state = state, after, count(after)
        if state == before:
            break
    else:
        raise RuntimeError("components did not settle")
    # settled links are stars: every node but the least of its component points at it
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
