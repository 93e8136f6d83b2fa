"""Connected components by alternating large-star and small-star steps (each cut off by a written table)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from scholia.llm.tables import written


def _star(edges: DataFrame) -> DataFrame:
    """Each node's neighbours (both ways, or the smaller ones) move to the least of them and itself."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return edges.join(least, "u")


def components(links: DataFrame) -> DataFrame:
    """links: (x, y). Returns (node, label): the least node of each linked node's component."""
    edges = links.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).where("u > v").distinct()
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        small = _star(large)
        moved = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        # Counted by the write itself; a count that a lost executor makes wrong costs another step, no link.
        state = Observation()
        marks = F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")
        edges = written(moved.where("u > v").distinct().observe(state, *marks), "stars")
        now = state.get or {"n": edges.count()}  # nothing is observed where the plan turns out empty
        if now == before:
            break
        before = now
    roots = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("label"))
    return written(edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(roots), "labels")
