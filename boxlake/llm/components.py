"""Connected components of a link table by joins and minima.

Labels only fall: every round takes the least label among the neighbours and
then the label of the label, so chains shorten by doubling. All steps are
joins and partially aggregated minima; no vertex's links are gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed


def connected_components(links: DataFrame) -> DataFrame:
    """``links`` has columns a and b of one type; gives (v, label), label the least vertex of v's component.

    Only vertices with a link to another vertex are returned; null ends are left out.
    """
    links = links.where(F.col("a") != F.col("b")).select("a", "b")
    both = checkpointed(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = checkpointed(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m")).select("v", F.least("v", "m").alias("label")))
    while True:
        offered = both.join(labels.withColumnRenamed("v", "b"), "b").groupBy(F.col("a").alias("v")).agg(F.min("label").alias("m"))
        hooked = labels.join(offered, "v").select("v", F.col("label").alias("was"), F.least("label", "m").alias("label"))
        up = labels.select(F.col("v").alias("label"), F.col("label").alias("up"))
        nxt = checkpointed(hooked.join(up, "label").select("v", "was", F.least("label", "up").alias("label")))
        changed = not nxt.where(F.col("was") != F.col("label")).isEmpty()
        labels = nxt.drop("was")
        if not changed:
            return labels
