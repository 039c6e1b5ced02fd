"""Connected components of a table of links by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import stage


def components(links: DataFrame) -> DataFrame:
    """(key, label) for every end of a link (columns a, b); the label is one end of the component.

    In each round every node moves to its smallest neighbour if that is smaller than itself, and links go along;
    links whose ends meet are gone. Keys are hashes, so their order is random and a constant share of the nodes
    left goes away in each round, also on long chains. The smallest neighbour of a node with very many links is
    found by partial minima before the shuffle. What rounds pass on are tables in the shared folder.
    """
    edges = stage(links.select("a", "b").where(F.col("a") != F.col("b")).distinct(), "component-links")
    named = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        moves = stage(both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.least("a", "low").alias("to")), "component-moves")
        if named is None:
            named = moves.select(F.col("node").alias("key"), F.col("to").alias("label"))
        else:
            named = stage(named.join(moves, named["label"] == moves["node"], "left").select("key", F.coalesce("to", "label").alias("label")), "component-names")
        one = edges.join(moves.select(F.col("node").alias("a"), F.col("to").alias("x")), "a")
        two = one.join(moves.select(F.col("node").alias("b"), F.col("to").alias("y")), "b")
        edges = stage(two.where("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "component-links")
    return named if named is not None else links.select(F.col("a").alias("key"), F.col("a").alias("label")).where(F.lit(False))
