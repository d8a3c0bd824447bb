"""Connected components of an edge table, without edges or nodes on the driver.

Rounds of minimum labels with pointer jumping. Every message is reduced to its minimum before
the shuffle, so a hub costs each task one row. A hub's rows in a join are split by the adaptive
skew join. Each round is written to the shared folder, and a count of changed labels ends the loop.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cairn.runtime import materialize, release


def connected(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v longs); root is the smallest node of its component."""
    edges = edges.where(F.col("u").isNotNull() & F.col("v").isNotNull() & (F.col("u") != F.col("v")))
    current = materialize(edges.select(F.greatest("u", "v").alias("hi"), F.least("u", "v").alias("lo")).distinct(), "edges")
    both = current.select(F.col("hi").alias("node"), F.col("lo").alias("other")).unionAll(current.select(F.col("lo").alias("node"), F.col("hi").alias("other")))
    held = materialize(both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("root")), "labels")
    for _ in range(max_rounds):
        labels = held.select("node", "root")
        # neighbours send their labels
        sent = both.join(labels.select(F.col("node").alias("other"), F.col("root").alias("said")), "other").groupBy("node").agg(F.min("said").alias("said"))
        step = labels.join(sent, "node").select("node", F.least("root", "said").alias("root"), F.col("root").alias("was"))
        # hook: the old root learns the smallest label heard below it, then everyone jumps once
        hooks = step.groupBy(F.col("was").alias("at")).agg(F.min("root").alias("hook"))
        step = step.join(hooks, step["node"] == hooks["at"], "left").select("node", F.least("root", F.coalesce("hook", "root")).alias("root"), "was")
        step = materialize(step, "labels")
        jumped = step.join(step.select(F.col("node").alias("root"), F.col("root").alias("next")), "root").select("node", F.least("root", "next").alias("root"), "was")
        new = materialize(jumped, "labels")
        changed = new.where("root <> was").limit(1).count()
        release(step)
        release(held)
        held = new
        if not changed:
            release(current)
            return held.select("node", "root")
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
