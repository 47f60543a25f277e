"""Connected components as a distributed union-find.

Each round hooks every label to the least label next to it, follows pointers
twice, and contracts the edges. Labels of a component at least halve over two
rounds, so rounds grow with the logarithm of the longest chain. All state is in
tables of the shared folder: no link and no component reaches the driver, and
partial ``min`` aggregation takes hubs of any degree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import discard, materialize


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label) for every node of an edge; label is one node of its component.

    Loops, repeated and reversed edges are allowed; null ends are ignored. No
    edges give an empty table. The node type is any orderable atomic type.
    """
    e = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null")
    e = materialize(e.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc-edges")
    labels = e.select("a").union(e.select("b")).distinct().select(F.col("a").alias("node"), F.col("a").alias("label"))
    labels = materialize(labels, "cc-labels")
    first = e
    e = e.where("a <> b")
    old: DataFrame | None = first
    while not e.isEmpty():
        both = e.union(e.select("b", "a"))
        p = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("x"), F.least("a", "m").alias("p"))
        p = materialize(p, "cc-parents")
        for _ in range(2):
            up = p.select(F.col("x").alias("p"), F.col("p").alias("pp"))
            q = materialize(p.join(up, "p").select("x", F.col("pp").alias("p")), "cc-parents")
            discard(p)
            p = q
        pa, pb = p.select(F.col("x").alias("a"), F.col("p").alias("na")), p.select(F.col("x").alias("b"), F.col("p").alias("nb"))
        n = e.join(pa, "a").join(pb, "b").where("na <> nb")
        n = materialize(n.select(F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b")).distinct(), "cc-edges")
        new = labels.join(p.withColumnRenamed("x", "label"), "label", "left")
        new = materialize(new.select("node", F.coalesce("p", "label").alias("label")), "cc-labels")
        discard(old, labels, p)
        e = old = n
        labels = new
    discard(old)
    return labels
