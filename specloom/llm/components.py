"""Connected components of an edge table by alternating large and small stars. DataFrame operations only.

Each round is written to the shared folder; no vertex's neighbours are gathered in one task: minima are pre-aggregated and joined
back, where a vertex with many edges can be split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _stars(edges: DataFrame, small: bool) -> DataFrame:
    """edges (a, b), a > b. Large star: every larger neighbour of a vertex to its least neighbour; small star: every smaller one."""
    both = edges if small else edges.union(edges.select("b", "a"))
    both = both.toDF("u", "v")
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).withColumnRenamed("u", "w")
    joined = both.join(least, F.col("u") == F.col("w"))
    if small:
        found = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).union(joined.select(F.col("u").alias("a"), F.col("m").alias("b")))
    else:
        found = joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    return found.filter(F.col("a") > F.col("b")).distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, component): for every id in edges (a, b), the least id that it is connected with. Ids are not null."""
    now = common.written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")

    def seen(df: DataFrame):
        return df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    state = seen(now)
    for _ in range(rounds if state[0] else 0):
        after = common.written(_stars(_stars(now, False), True), "edges")
        common.drop_table(now)
        now = after
        before, state = state, seen(now)
        if state == before:
            break
    else:
        if state[0]:
            raise RuntimeError("components did not settle")
    return now.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "id").union(now.select("b", F.col("b").alias("component")).distinct())
