"""Majority vote over independently reported inconsistencies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

AGENTS = 6
KEY = ("page_a", "page_b", "section_a", "section_b", "category")


def finding_key() -> list[Column]:
    """Two findings are the same if pages, sections and category agree, case and outer spaces aside."""
    return [F.col("page_a"), F.col("page_b"), *[F.lower(F.trim(F.coalesce(F.col(c), F.lit("")))).alias(c) for c in ("section_a", "section_b", "category")]]


def majority(findings: DataFrame, agents: int = AGENTS, description: str = "reason") -> DataFrame:
    """(key, votes, descriptions): findings (agent, …) that more than half of the agents report, an agent counting once.

    Descriptions stand in the order of agents; what has no description gives none."""
    rows = findings.select("agent", *finding_key(), F.col(description).alias("said"))
    votes = rows.groupBy(*KEY).agg(F.countDistinct("agent").alias("votes"), F.sort_array(F.collect_set(F.struct("agent", "said"))).alias("each"))
    return votes.filter(F.col("votes") >= agents // 2 + 1).select(*KEY, "votes", F.transform(F.filter("each", lambda x: x["said"].isNotNull()), lambda x: x["said"]).alias("descriptions"))


def merged(found: DataFrame) -> DataFrame:
    """Each majority finding with its first description: what stands where no model merges them."""
    return found.withColumn("description", F.coalesce(F.get("descriptions", F.lit(0)), F.lit("")))


def result_json(found: DataFrame) -> DataFrame:
    """merged() findings as rows (ord, line) that together are one JSON text, {"inconsistencies": [...]}; a line holds one finding."""
    fields = [*KEY, "description"]
    rows = found.withColumn("ord", F.row_number().over(Window.orderBy(*KEY)))  # what most agents agree on: few
    body = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    listed = rows.select("ord", F.concat(F.when(F.col("ord") == 1, "").otherwise(","), body).alias("line"))
    ends = found.sparkSession.createDataFrame([(0, '{"inconsistencies": ['), ((1 << 31) - 1, "]}")], "ord int, line string")
    return ends.union(listed)


def write_result(found: DataFrame, path: str) -> None:
    """The consensus as JSON; files in the order of their names are one text."""
    result_json(found).orderBy("ord").select("line").write.mode("overwrite").text(path)
