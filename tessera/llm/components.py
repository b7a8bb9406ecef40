"""Connected components of a table of links, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.scratch import materialize


def components(links: DataFrame, one: str = "one", two: str = "two") -> DataFrame:
    """(node, component): every node of a link, and the smallest node that it reaches. Links of a node with itself give it alone.

    In each round every node joins its smallest neighbour (or stays, if it is smaller), and links join what they have become.
    A node that isn't the smallest around it disappears, so a component shrinks to its smallest node. Null ends don't count.
    """
    links = links.select(F.col(one).alias("a"), F.col(two).alias("b")).where("a is not null and b is not null")
    both = links.union(links.select("b", "a")).distinct()
    edges, found, rounds = materialize(both, "links"), None, 0
    while found is None or not edges.isEmpty():
        step = materialize(edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("to")), "links-step")
        if found is None:
            found = step.withColumnRenamed("to", "component")
        else:
            moved = step.select(F.col("node").alias("component"), "to")
            found = materialize(found.join(moved, "component", "left").select("node", F.coalesce("to", "component").alias("component")), "links-found")
        left = edges.join(step.select(F.col("node").alias("a"), F.col("to").alias("x")), "a").join(step.select(F.col("node").alias("b"), F.col("to").alias("y")), "b")
        edges = materialize(left.where("x != y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "links")
        rounds += 1
    return found
