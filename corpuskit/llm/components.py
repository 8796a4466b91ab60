"""Connected components of a table of links, by rounds of star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuskit.session import write_stage

_ROUNDS = 60


def components(links: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``links (a, b)`` but the roots; a root is the least node of its component.

    Every round hooks the neighbours of a node to the least one among them, first the larger neighbours, then the
    smaller ones, until only stars are left. Each round is written and the one before it deleted.
    """
    stars = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    stage = write_stage(stars, "links")
    seen = None
    for _ in range(_ROUNDS):
        edges = stage.df
        state = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = state
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        following = write_stage(small.unionByName(least.withColumnRenamed("m", "b")).distinct(), "links")
        stage.drop()
        stage = following
    raise RuntimeError(f"no stars after {_ROUNDS} rounds")
