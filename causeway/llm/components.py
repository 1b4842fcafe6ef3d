"""Connected components of a table of links, by joins and minima only.

Labels fall to the smallest label of a node's neighbours, then to the label of that label, until nothing changes. Each round writes
its labels to the shared folder; nothing but one count per round reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.llm.common import materialize


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component`` for every node that has a link; the component is its smallest node. Links have no direction; loops, copies and
    links with a null end do no harm (the latter are left out)."""
    both = links.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u IS NOT NULL AND v IS NOT NULL")
    both = materialize(both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "links")
    labels = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("label")), "labels")
    k = 0
    while True:
        near = both.join(labels, both["v"] == labels["node"]).groupBy("u").agg(F.min("label").alias("m"))
        lower = labels.join(near, labels["node"] == near["u"]).select("node", F.col("label").alias("was"), F.least("label", "m").alias("label"))
        lower = materialize(lower, f"lower{k}")
        jump = lower.select(F.col("node").alias("label"), F.col("label").alias("next"))
        after = materialize(lower.join(jump, "label").select("node", "was", F.col("next").alias("label")), f"labels{k}")
        labels = after.select("node", "label")
        if after.filter(F.col("was") != F.col("label")).isEmpty():
            return labels.select("node", F.col("label").alias("component"))
        k += 1
