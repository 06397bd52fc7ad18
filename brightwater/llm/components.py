"""Connected components of a large graph by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brightwater.plans.scratch import written


def components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """(node, root) for every node of an edge; root is the smallest node of its component.

    In a round every node is renamed to its smallest neighbour, if that is smaller. Edges inside a
    new name disappear and equal ones become one, so each round works on a smaller graph, until no edge is
    left. Every round is written, which also cuts the lineage. Null ends are ignored; no edges
    give an empty result.
    """
    ends = edges.select(F.col(left).alias("a"), F.col(right).alias("b")).dropna()
    smaller, larger = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    links = written(ends.select(smaller, larger).distinct(), "edges")
    labels = None
    while True:
        both = links.union(links.select("b", "a"))
        names = written(
            both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near")).select(
                "node", F.least("node", "near").alias("name")
            ),
            "names",
        )
        if labels is None:
            labels = names.withColumnRenamed("name", "root")
        else:
            renamed = names.withColumnRenamed("node", "root")
            labels = written(
                labels.join(renamed, "root", "left").select("node", F.coalesce("name", "root").alias("root")), "labels"
            )
        links = written(
            links.join(names.select(F.col("node").alias("a"), F.col("name").alias("p")), "a")
            .join(names.select(F.col("node").alias("b"), F.col("name").alias("q")), "b")
            .where("p != q")
            .select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"))
            .distinct(),
            "edges",
        )
        if links.isEmpty():
            return labels
