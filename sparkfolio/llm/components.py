"""Connected components of a distributed edge table: large-star and small-star steps in turn, each stored."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import delete, scratch_path


def _large_star(e: DataFrame) -> DataFrame:
    both = e.union(e.select("b", "a"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least).distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges: two columns of longs, a and b; loops and repeats are allowed, nulls are not links. Returns node
    and root, the smallest node it reaches, for every node that reaches a smaller one. Steps are minima by
    key, summed before the shuffle, and joins whose hot keys Spark splits; each step's edges go to the
    shared folder, so lineage stays short. Labels alone decide when to stop."""
    spark = edges.sparkSession
    a, b = edges.columns[:2]
    now = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct()
    old, mark = None, None
    while True:
        path = scratch_path(spark, "edges")
        _small_star(_large_star(now) if old else now).write.parquet(path)
        now = spark.read.schema("a long, b long").parquet(path)
        new = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if old:
            delete(spark, old)
        if new == mark:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        old, mark = path, new
