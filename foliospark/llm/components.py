"""Connected components of an edge table by hooking and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import forget, written


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node and root (smallest node that is reachable) of every node of ``edges`` (a long, b long).

    Each round points every node at its smallest neighbour, follows these pointers twice, and contracts the
    edges; rounds needed grow with the logarithm of the longest chain. Partial minima keep hubs spread out; results are
    written between rounds.
    """
    spark = edges.sparkSession
    live = written(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    roots = None
    for _ in range(rounds):
        if not live.take(1):
            break
        both = live.select(F.col("a").alias("node"), F.col("b").alias("to")).unionByName(live.select(F.col("b").alias("node"), F.col("a").alias("to")))
        direct = written(both.groupBy("node").agg(F.min("to").alias("to")).select("node", F.least("node", "to").alias("to")), "parents")
        up = direct
        for _ in range(2):
            above = up.select(F.col("node").alias("to"), F.col("to").alias("top"))
            up = up.join(above, "to").select("node", F.col("top").alias("to"))
        up = written(up, "parents")
        a_up, b_up = up.select(F.col("node").alias("a"), F.col("to").alias("a2")), up.select(F.col("node").alias("b"), F.col("to").alias("b2"))
        moved = live.join(a_up, "a").join(b_up, "b").where("a2 <> b2")
        step = up.select(F.col("node").alias("root"), F.col("to").alias("next"))
        reached = up.select("node", F.col("to").alias("root")) if roots is None else roots.join(step, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
        old = [direct, up, live, *([] if roots is None else [roots])]
        roots = written(reached, "roots")
        live = written(moved.select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).distinct(), "edges")
        forget(*old)
    else:
        raise RuntimeError(f"components are not complete after {rounds} rounds")
    return spark.createDataFrame([], "node long, root long") if roots is None else roots
