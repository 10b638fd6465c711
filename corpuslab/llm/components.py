"""Connected components of a link table, without gathering links anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import removed, written

#: Links of a file that a round writes: small rounds make few small files and tasks.
LINKS_A_FILE = 50_000
#: Pointer doublings of a round: chains of up to 2**JUMPS links collapse in it.
JUMPS = 3


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node`` and ``root`` (the smallest node of its component) of every node with a link.

    Each round points every node at its smallest neighbour, follows the pointers, and contracts
    the links to what remains between different targets. A round's tables are written, so lost
    executors cost a re-read. Null ends and loops are no links; no links give no rows.
    """
    links = links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    both = written(links.union(links.select("b", "a")).distinct(), "cc-links")
    labels = None
    while n_links := both.count():
        n_files = -(-n_links // LINKS_A_FILE)
        step = both.groupBy("a").agg(F.min("b").alias("least"))
        step = step.select(F.col("a").alias("node"), F.least("a", "least").alias("root"))
        for _ in range(JUMPS):
            step = written(step.coalesce(n_files), "cc-step")
            onward = step.select(F.col("node").alias("root"), F.col("root").alias("next"))
            step = step.join(onward, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
        step = written(step.coalesce(n_files), "cc-step")
        if labels is None:
            labels, n_label_files = step, n_files
        else:
            onward = step.select(F.col("node").alias("root"), F.col("root").alias("next"))
            labels = labels.join(onward, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
            labels = written(labels.coalesce(n_label_files), "cc-labels")
        of_a = step.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        of_b = step.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        left = both.join(of_a, "a").join(of_b, "b").where("ra <> rb")
        left = written(left.select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct().coalesce(n_files), "cc-links")
        removed(both)
        both = left
    if labels is None:
        return both.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return labels
