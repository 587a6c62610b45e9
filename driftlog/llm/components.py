"""Connected components of an edge table, all on executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlog.llm.common import discard, materialize


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Return (node, root), root the smallest node of the component, for each node that has an edge to another, roots included.

    Edges point from the larger node to the smaller. A round links each node and its other parents to the node's
    smallest parent, then lets each parent's children jump to that parent's smallest parent. It ends when each node
    has one parent that is a root. Rounds grow with the logarithm of a component's diameter; each is written to the
    shared folder. Nothing but two counts reaches the driver. A hub only appears as a parent, so no group of its
    children is gathered: minima are taken by child and pre-aggregated. Null ends and loops are ignored; an empty
    table gives an empty result.
    """
    a, b = F.col(src), F.col(dst)
    e = edges.where(a.isNotNull() & b.isNotNull() & (a != b))
    e = materialize(e.select(F.greatest(a, b).alias("v"), F.least(a, b).alias("p")).distinct(), "cc")
    while True:
        low = e.groupBy("v").agg(F.min("p").alias("m"))
        small = e.join(low, "v")
        one = materialize(
            small.select("v", F.col("m").alias("p"))
            .unionByName(small.where("p <> m").select(F.col("p").alias("v"), F.col("m").alias("p")))
            .distinct(),
            "cc",
        )
        low = one.groupBy("v").agg(F.min("p").alias("m"), F.count("*").alias("n"))
        jump = one.join(low.select(F.col("v").alias("p"), "m"), "p", "left")
        two = materialize(jump.select("v", F.coalesce("m", "p").alias("p"), F.col("m").isNotNull().cast("int").alias("moved")), "cc")
        left = low.agg(F.sum(F.when(F.col("n") > 1, 1).otherwise(0))).first()[0] or 0
        moved = two.agg(F.sum("moved")).first()[0] or 0
        discard(e), discard(one)
        if not left and not moved:
            roots = two.select(F.col("p").alias("node"), F.col("p").alias("root")).distinct()
            return two.select(F.col("v").alias("node"), F.col("p").alias("root")).unionByName(roots)
        e = materialize(two.select("v", "p").distinct(), "cc")
        discard(two)
