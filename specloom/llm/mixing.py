"""Operator 9, mixing sources to target weights along a time-varying curriculum. DataFrame operations only.

Each source gets a target number of words. Its weight over training time u in [0, 1] is ``1 + tilt * (2u - 1)``; the integral of
that schedule, times the target, is the source's cumulative demand. The documents of a source stand in a fixed pseudo-random order
and offer their words one after the other, twice at most; the demand, inverted at a document's offset, is the training position
of that copy. ``stream`` repeats documents by copy and range-sorts them by position.

Defined results: a null source is a source of its own, after the others; null and empty texts have size 0, take 0 words and have no
position; without any word all targets are 0. Rows with equal doc_id stand side by side; each counts. The last document that a
source gives is taken in part where the target ends inside it.

Prefix sums run in two levels, over BUCKETS parts of each source and then inside the parts, so that a source with a third of all
rows is spread over many tasks. The table of sources alone (one row each) is ordered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

WEIGHTS = (5, 2, 1)  # by rank of the source, repeating
TILTS = (-0.5, 0.0, 0.5)  # likewise: the first come early, the last late
SHARE = 1.5  # of all words
MOST = 2  # times a source's words, and a document's
BUCKETS = 4096
SPANS = 256  # of the training time, far fewer than parts, so that few parts meet two
SLACK = 1e-9  # of the training time, more than what rounding can move a position


def by_rank(values: tuple, rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (rank % len(values) + 1).cast("int"))


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, tilts: tuple = TILTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """One row a source: source, source_size, target, tilt.

    The budget, share of all words, goes to the sources by weight; a source stops at most times its size, and the excess is shared
    by weight among the others until none is above. In order of cap / weight the sources below the water level are full."""
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ordered = Window.partitionBy(F.lit(0)).orderBy(F.col("source").isNull(), "source")
    rank = F.row_number().over(ordered) - 1
    sources = sources.withColumn("rank", rank).withColumn("weight", by_rank(weights, F.col("rank"))).withColumn("tilt", by_rank(tilts, F.col("rank")))
    cap = most * F.col("source_size")
    up = Window.partitionBy(F.lit(0)).orderBy(cap / F.col("weight"), "rank")
    before, rest = up.rowsBetween(Window.unboundedPreceding, -1), up.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(0))
    budget = share * F.sum("source_size").over(everything)
    level = (budget - F.coalesce(F.sum(cap).over(before), F.lit(0))) / F.sum("weight").over(rest)
    sources = sources.withColumn("level", level).withColumn("open", F.col("level") * F.col("weight") <= cap)
    water = F.min_by(F.when(F.col("open"), F.col("level")), F.when(F.col("open"), F.struct(cap / F.col("weight"), F.col("rank")))).over(everything)
    target = F.least(cap.cast("double"), F.coalesce(water * F.col("weight"), cap.cast("double")))
    return sources.select("source", "source_size", target.alias("target"), "tilt")


def position(q: Column, tilt: Column) -> Column:
    """The time at which a share q of the demand has come: the inverse of u + tilt * (u * u - u)."""
    return F.lit(2.0) * q / ((F.lit(1.0) - tilt) + F.sqrt((F.lit(1.0) - tilt) * (F.lit(1.0) - tilt) + F.lit(4.0) * tilt * q))


def sized(docs: DataFrame, buckets: int, *more: str) -> DataFrame:
    """(doc_id, source, size, digest, part) and the columns more of docs; part tells the BUCKETS parts of a source."""
    size = F.coalesce(F.regexp_count("text", F.lit(common.WORD_CHARS)), F.lit(0)).cast("long")
    digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    return docs.select("doc_id", "source", size.alias("size"), digest.alias("digest"), (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") * buckets / (1 << 32)).cast("int").alias("part"), *more)


def summed(sizes: DataFrame) -> DataFrame:
    return sizes.groupBy("source", "part").agg(F.sum("size").alias("part_size"))


def parts_of(parts: DataFrame, most: int, **settings) -> DataFrame:
    """(part_source, part_part, start, part_size, source_size, target, tilt) for parts (source, part, part_size): where each part's words
    start in its source's order."""
    shares = targets(parts.withColumnRenamed("part_size", "size"), most=most, **settings)
    start = F.sum("part_size").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.withColumn("start", F.coalesce(start, F.lit(0)))
    shares = shares.withColumnRenamed("source", "share_source")
    return parts.join(shares, F.col("source").eqNullSafe(F.col("share_source"))).select(F.col("source").alias("part_source"), F.col("part").alias("part_part"), "start", "part_size", "source_size", "target", "tilt")


def in_part() -> Column:
    return F.col("source").eqNullSafe(F.col("part_source")) & (F.col("part") == F.col("part_part"))


def inside(*by: str) -> Column:
    """Words of a part up to a row, itself included."""
    return F.sum("size").over(Window.partitionBy(*by).orderBy("digest", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow))


def mix(docs: DataFrame, buckets: int = BUCKETS, most: int = MOST, **settings) -> DataFrame:
    """One row a document: doc_id, source, size, source_size, target, taken, positions (of its copies, in order)."""
    sizes = common.written(sized(docs, buckets), "sizes")
    one = sizes.join(parts_of(summed(sizes), most, **settings), in_part()).drop("part_source", "part_part", "part_size")
    one = one.withColumn("offset", F.col("start") + inside("source", "part") - F.col("size"))
    stop = F.round("target").cast("long")
    copies = [F.greatest(F.lit(0), F.least(F.col("size"), stop - (F.col("offset") + i * F.col("source_size")))) for i in range(most)]
    times = [F.when(c > 0, position((F.col("offset") + i * F.col("source_size")) / F.col("target"), F.col("tilt"))) for i, c in enumerate(copies)]
    return one.select("doc_id", "source", "size", "source_size", "target", sum(copies[1:], copies[0]).alias("taken"), F.filter(F.array(*times), lambda x: x.isNotNull()).alias("positions"))


def stream(docs: DataFrame, buckets: int = BUCKETS, most: int = MOST, spans: int = SPANS, **settings) -> DataFrame:
    """The rows of docs once for every copy that the mix takes, range-sorted by training position, of which mix() tells the same.

    Texts are dealt out once, to SPANS spans of the training time: a part's words, and so its copies' positions, lie between its start
    and end, which the table of parts gives (of bounded size but for the number of sources). Where a copy's part meets several spans its
    rows go to each; there the exact position is found, and the span that it lies in keeps the row."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    parts = parts_of(common.written(summed(sized(common.only(docs, "doc_id", "source", "text"), buckets)), "parts"), most, **settings)
    every = F.explode(F.sequence(F.lit(0), F.lit(most - 1))).alias("copy")
    places = parts.select("*", every).withColumn("ahead", F.col("start") + F.col("copy") * F.col("source_size")).withColumn("stop", F.round("target").cast("long")).filter("ahead < stop and part_size > 0")

    def span(at: Column) -> Column:
        return F.greatest(F.lit(0), F.least(F.lit(spans - 1), F.floor(at * spans))).cast("int")

    reach = lambda words: position(words / F.col("target"), F.col("tilt"))
    low, high = span(reach(F.col("ahead")) - SLACK), span(reach(F.least(F.col("ahead") + F.col("part_size"), F.col("stop"))) + SLACK)
    places = places.select("part_source", "part_part", F.struct("copy", "ahead", "stop", "target", "tilt", low.alias("low"), high.alias("high")).alias("place")).groupBy("part_source", "part_part").agg(F.collect_list("place").alias("places"))
    rows = sized(docs.select("doc_id", "source", "text", row), buckets, "row").filter("size > 0").join(F.broadcast(places), in_part()).drop("part_source", "part_part")
    rows = rows.select("*", F.explode("places").alias("place")).drop("places").select("*", F.explode(F.sequence("place.low", "place.high")).alias("span")).withColumn("copy", F.col("place.copy"))
    rows = rows.repartitionByRange("span").withColumn("before", F.col("place.ahead") + inside("span", "source", "part", "copy") - F.col("size"))
    at = position(F.col("before") / F.col("place.target"), F.col("place.tilt"))
    rows = rows.filter(F.col("before") < F.col("place.stop")).withColumn("at", at).filter(span(F.col("at")) == F.col("span"))
    return rows.sortWithinPartitions("at", "doc_id").select("row.*")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every row of documents, in the order of training positions (untaken rows last)."""
    mixed = mix(common.only(common.table(spark, sf_dir, "documents"), "doc_id", "source", "text"))
    first, last = F.get("positions", F.lit(0)), F.get("positions", F.lit(1))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", first.alias("first_position"), last.alias("second_position")).orderBy(F.col("first_position").asc_nulls_last(), "doc_id")


OP9_SQL = """
WITH sizes AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS digest
  FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         row_number() OVER (ORDER BY source IS NULL, source) - 1 AS rank
  FROM sizes GROUP BY source),
weighed AS (
  SELECT *, CASE rank % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight,
         CASE rank % 3 WHEN 0 THEN -0.5::DOUBLE WHEN 1 THEN 0::DOUBLE ELSE 0.5::DOUBLE END AS tilt
  FROM sources),
levels AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()
             - coalesce(sum(2 * source_size) OVER (ORDER BY 2 * source_size / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY 2 * source_size / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed),
water AS (SELECT min_by(level, 2 * source_size / weight * 1e6 + rank) AS w FROM levels WHERE level * weight <= 2 * source_size),
shares AS (
  SELECT source, source_size, tilt, least(CAST(2 * source_size AS DOUBLE), coalesce(w * weight, CAST(2 * source_size AS DOUBLE))) AS target
  FROM levels LEFT JOIN water ON true),
placed AS (
  SELECT s.doc_id, s.size, h.source_size, h.target, h.tilt,
         CAST(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.digest, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - s.size AS BIGINT) AS pos
  FROM sizes s JOIN shares h ON s.source IS NOT DISTINCT FROM h.source),
taken AS (
  SELECT *, greatest(0, least(size, CAST(round(target) AS BIGINT) - pos)) AS a,
         greatest(0, least(size, CAST(round(target) AS BIGINT) - pos - source_size)) AS b
  FROM placed)
SELECT doc_id, size, source_size, target, CAST(a + b AS BIGINT) AS taken,
       CASE WHEN a > 0 THEN 2 * (pos / target) / ((1 - tilt) + sqrt((1 - tilt) * (1 - tilt) + 4 * tilt * (pos / target))) END AS first_position,
       CASE WHEN b > 0 THEN 2 * ((pos + source_size) / target) / ((1 - tilt) + sqrt((1 - tilt) * (1 - tilt) + 4 * tilt * ((pos + source_size) / target))) END AS second_position
FROM taken
"""


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: each document once for every copy that the mix takes, range-sorted by training position.

    A copy that the target cuts keeps its whole text."""
    return stream(docs)
