"""Connected components of a link table, by least-label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm.common import discard, materialise, work_dir


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of a link; root is the least node of its component.

    Each round takes the least label around every node and then that label's own label, so the rounds grow with the
    logarithm of the longest path. Every round is written to the shared folder, which cuts the lineage, and deleted once
    the next is there; the last stays, as the result reads it.
    """
    spark = links.sparkSession
    pairs, at = work_dir(spark), work_dir(spark)
    both = links.select(F.col(a).alias("x"), F.col(b).alias("y")).filter("x <> y")
    both = materialise(both.union(both.select("y", "x")).distinct(), pairs)
    labels = materialise(both.groupBy(F.col("x").alias("node")).agg(F.min("y").alias("m")).select("node", F.least("node", "m").alias("root")), at)
    while True:
        around = both.join(labels.withColumnRenamed("node", "y"), "y").groupBy(F.col("x").alias("node")).agg(F.min("root").alias("m"))
        nearer = labels.join(around, "node").select("node", F.least("root", "m").alias("root"), F.col("root").alias("was"))
        jump = labels.select(F.col("node").alias("root"), F.col("root").alias("further"))
        new = nearer.join(jump, "root", "left").select("node", F.least("root", F.coalesce("further", "root")).alias("root"), "was")
        last, at = at, work_dir(spark)
        new = materialise(new, at)
        discard(spark, last)
        labels = new.select("node", "root")
        if not new.filter("root <> was").limit(1).count():
            discard(spark, pairs)
            return labels
