"""Connected components of a distributed edge list."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import shared_dir


def saved(frame: DataFrame, what: str) -> DataFrame:
    """Writes a frame to the shared folder and reads it back: its lineage is cut and executors may be lost."""
    spark = frame.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) for every node of the edges (a long, b long).

    Alternating star steps: each node's neighbours are hung on the smallest one,
    above it and then below it, until nothing changes; about log(n) rounds of
    shuffles that never hold a node's neighbours in one task (the smallest one
    is a partial aggregate and comes back by a join that Spark splits when it
    is skewed).
    """
    now = saved(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        small = small.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        now = saved(small, "edges")
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if state == before:
            roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
        before = state
