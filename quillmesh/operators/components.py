"""Connected components of a link table, by least labels and pointer jumps, without a driver-side graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.session import materialise


def components(links: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """id, component: the least id that a chain of links reaches, for every id in a link.

    Each round hands every id the least label among its neighbours and then jumps to that label's
    label; it ends when no label changes, after about the logarithm of the longest chain. Labels and
    links lie in the shared folder between rounds. Links with a null end are ignored; repeated links,
    loops and both directions are allowed; an empty table gives no rows.
    """
    whole = links.filter(F.col(left).isNotNull() & F.col(right).isNotNull())
    both = whole.select(F.col(left).alias("id"), F.col(right).alias("to")).unionByName(whole.select(F.col(right).alias("id"), F.col(left).alias("to"))).distinct()
    edges = materialise(both, "component-edges")
    labels = materialise(edges.groupBy("id").agg(F.least(F.first("id"), F.min("to")).alias("component")), "component-labels")
    while True:
        near = edges.join(labels.withColumnRenamed("id", "to"), "to").groupBy("id").agg(F.min("component").alias("near"))
        step = labels.join(near, "id").select("id", F.col("component").alias("old"), F.least("component", "near").alias("via"))
        jump = labels.select(F.col("id").alias("via"), F.col("component").alias("far"))
        new = materialise(step.join(jump, "via").select("id", "old", F.least("via", "far").alias("component")), "component-labels")
        labels = new.select("id", "component")
        if new.filter("old <> component").isEmpty():
            return labels
