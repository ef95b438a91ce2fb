"""Connected components of an edge table by distributed label passing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``edges`` (a, b: long) to (id, label): the smallest id that is reachable, for every id with an edge.

    Each round takes the smallest label among the neighbours (a grouped minimum, combined before the shuffle, so the
    centre of a star is no hot key), then jumps to the label's own label. A component of diameter d ends in about
    log d rounds. Loops and repeated edges do no harm; an empty table gives an empty one.
    """
    both = scratch.save(edges.where("a <> b").select("a", "b").union(edges.where("a <> b").select("b", "a")).distinct(), "edges")
    labels = scratch.save(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), F.col("label")), "b").groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near.withColumnRenamed("a", "id"), "id").select("id", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        up = labels.select(F.col("id").alias("label"), F.col("label").alias("up"))
        new = scratch.save(step.join(up, "label").select("id", "was", F.least("label", "up").alias("label")), "labels")
        changed = new.where("label <> was").limit(1).count()
        scratch.free(labels)
        labels = new
        if not changed:
            scratch.free(both)
            out = labels.select("id", "label")
            out.scratch_path = labels.scratch_path
            return out
