"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import cut, remove_dir, shared_dir


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of ``edges(a, b)``; label is the component's smallest node.

    Each step is written as a table and the one before it is deleted; what is returned
    is a table too. A star's centre is met as a minimum, pre-aggregated before each
    shuffle, so no neighbourhood is ever collected. Edges from a node to itself count
    for nothing; no edges give no rows.
    """
    spark = edges.sparkSession
    folder, step = shared_dir(spark, "components"), 0
    before, now = None, cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{folder}/0")
    while True:
        step += 1
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # large-star: larger neighbours move to the smallest neighbour
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small-star: a node and its smaller neighbours meet at the smallest of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(low.select("a", F.col("m").alias("b"))).distinct()
        # distinct edges: an equal number and equal sums of two hashes, on a wide type, mean that nothing moved
        seen = Observation()
        sums = [F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("x"), F.sum(F.xxhash64("b", "a").cast("decimal(20,0)")).alias("y")]
        small.observe(seen, *sums).write.parquet(f"{folder}/{step}")
        now = spark.read.schema(small.schema).parquet(f"{folder}/{step}")
        remove_dir(spark, f"{folder}/{step - 1}")
        if seen.get == before:
            break
        before = seen.get
    out = now.groupBy("a").agg(F.min("b").alias("label")).select(F.col("a").alias("node"), "label").unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
    out = cut(out, f"{folder}-labels")
    remove_dir(spark, folder)
    return out
