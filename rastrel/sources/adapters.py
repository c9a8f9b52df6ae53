"""Rasters out of ordinary tables: a linear index becomes image, row and column.

The last image is filled up with zeros. Indices must be dense from 0, which an
aggregate of one row checks; others are an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def from_index(table: DataFrame, index: str, side: int, values: list[Column]) -> DataFrame:
    """Square images of ``side`` from a dense index; a channel for each value column."""
    area = side * side
    rows = table.select(F.col(index).cast("long").alias("__i"), F.array(*[v.cast("int") for v in values]).alias("vs"))
    facts = table.agg(F.count("*").alias("n"), F.min(index).cast("long").alias("first"), F.max(index).cast("long").alias("last"))
    dense = (F.col("first") == 0) & (F.col("last") == F.col("n") - 1)
    end = F.expr(f"(last div {area} + 1) * {area} - 1")
    rest = F.when(F.col("n") > 0, F.when(~dense | dense.isNull(), F.raise_error(F.lit(f"{index} must be dense from 0"))).when(F.col("last") < end, F.sequence(F.col("last") + 1, end)))
    zeros = facts.select(F.explode(rest).alias("__i"), F.array(*[F.lit(0)] * len(values)).alias("vs"))
    out = rows.unionByName(zeros).select(F.expr(f"cast(__i div {area} as int)").alias("image_id"), F.lit(side).alias("w"), F.lit(side).alias("h"), F.expr(f"cast(__i div {side} % {side} as int)").alias("y"), (F.col("__i") % side).cast("int").alias("x"), "vs")
    return out.select("image_id", "w", "h", "y", "x", F.posexplode("vs").alias("c", "v"))


#: Images that a document can have; its id times this is the id of its first.
TILES = 1 << 24


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _price() -> Column:
    return F.floor("o_totalprice").cast("long") % 256


def px_gray(spark: SparkSession, sf_dir: str) -> DataFrame:
    """32 x 32 x 1 from orders."""
    return from_index(table(spark, sf_dir, "orders"), "o_orderkey", 32, [_price()])


def px_rgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """32 x 32 x 3 from orders."""
    return from_index(table(spark, sf_dir, "orders"), "o_orderkey", 32, [_price(), F.col("o_custkey") % 256, (F.col("o_orderkey") * 7 + F.col("o_custkey") * 13) % 256])


def px_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """16 x 16 x 1 from events."""
    return from_index(table(spark, sf_dir, "events"), "event_id", 16, [F.floor("value").cast("long") % 256])


def px_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8 x 8 x 1 from embeddings."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "e"))
    v = F.least(F.lit(255), F.greatest(F.lit(0), F.floor((F.col("e").cast("double") + 0.5) * 255)))
    return rows.select(F.col("vec_id").cast("int").alias("image_id"), F.lit(8).alias("w"), F.lit(8).alias("h"), F.expr("cast(i div 8 as int)").alias("y"), (F.col("i") % 8).alias("x"), F.lit(0).alias("c"), v.cast("int").alias("v"))


def px_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """16 x 16 x 1 from each 256 code points of the texts, the last ones filled up with zeros; null and empty texts give none."""
    tiles = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit("(?s).{1,256}"), F.lit(0))).alias("tile", "t"))
    # one pass over a tile; substr for each sample would look for its place from the tile's start
    points = F.split(F.rpad("t", 256, "\0"), "")
    rows = tiles.select((F.col("doc_id") * TILES + F.col("tile")).alias("image_id"), F.posexplode(points).alias("i", "p"))
    return rows.select("image_id", F.lit(16).alias("w"), F.lit(16).alias("h"), F.expr("cast(i div 16 as int)").alias("y"), (F.col("i") % 16).alias("x"), F.lit(0).alias("c"), (F.ascii("p") % 256).cast("int").alias("v"))
