"""Operator 5, MinHash near-dedup with odd sketches.

A text's set holds the 64-bit hashes of its distinct word shingles. Equal sets, known by a cryptographic digest of the whole sorted set,
form classes; one document stands for each. BANDS bands of
ROWS MinHash values propose pairs. In STARS rounds the documents outside a bucket's largest group each meet one document of it; then
whatever pair of a bucket is not yet connected is proposed. An odd sketch, the parity bitmap of all MinHash samples, tells from the population count of an exclusive or how
similar a proposed pair is; a second bitmap, of the whole set, has at most as many differing bits as the sets have differing shingles
and so rules pairs out for certain. Clearly dissimilar pairs end there, all others are confirmed on the full sets. Components of the
confirmed links are the groups; the least doc_id of each is kept.

At the similarity asked for, a pair of equal chance misses all bands with a probability of (1 - 0.8 ** 5) ** 40 = 1.3e-7.

Defined results: words are runs of ``[^\\x20\\x09-\\x0D]`` after lower-casing A-Z; a text with fewer words than a shingle is one
shingle; null and wordless texts have an empty set and are linked with nothing. Rows that share a doc_id are one document, in the
groups of all their texts; rows with null doc_id are linked with nothing. Other columns play no part.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import arrays, common
from .components import components

BANDS, ROWS = 40, 5
STARS = 2  # rounds
TRIED = 3  # of a document's proposals in such a round, the most similar ones
BITS = 1024  # of an odd sketch
PERCENT = 80
SLACK = 0.15  # how far below the similarity asked for a sketch's estimate may be: nearly five standard deviations
FEW_IDS = 2_000_000  # ids that are broadcast at most; more are joined by shuffling
U = np.uint64

_rng = np.random.default_rng(5)
_A = _rng.integers(1, 1 << 31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)


def shingle_sets(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes of all texts, text after text; bounds of each text's)."""
    w = arrays.Words(column, lower=True)
    n, count = len(w.bounds) - 1, np.diff(w.bounds)
    h = np.zeros(len(w.hashes), np.uint64)
    for k in range(width):  # the hash of what starts at each word and has up to width words in its text
        end = np.repeat(w.bounds[1:], count)
        at = np.arange(len(h)) + k
        inside = at < end
        h = arrays.mixed(h * U(0x9E3779B97F4A7C15) + np.where(inside, w.hashes[np.minimum(at, len(h) - 1)], U(0)) + U(1)) if len(h) else h
    text = np.repeat(np.arange(n), count)
    place = np.arange(len(h)) - np.repeat(w.bounds[:-1], count)
    real = (place <= (count[text] - width)) | (place == 0)
    h, text = h[real], text[real]
    key = (h >> U(24)) | (text.astype(np.uint64) << U(40)) if n < 1 << 24 else None
    order = np.argsort(key) if key is not None else np.lexsort((h, text))
    h, text = h[order], text[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    if key is not None and len(h) > 1:  # 40 bits decide the order: where they alone agree, sort the rest too
        k = key[order]
        tie = np.flatnonzero((k[1:] == k[:-1]) & (h[1:] != h[:-1]))
        if len(tie):
            order = np.lexsort((h, text))
            h, text = h[order], text[order]
            fresh[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    h, text = h[fresh], text[fresh]
    return h, np.searchsorted(text, np.arange(n + 1))


def signatures(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """MinHash values (text, function) of non-empty sets."""
    small = (h >> U(32)).astype(np.uint32)
    out = np.empty((BANDS * ROWS, len(bounds) - 1), np.uint32)
    work = np.empty_like(small)
    for j in range(BANDS * ROWS):
        np.multiply(small, _A[j], out=work)
        np.add(work, _B[j], out=work)
        np.bitwise_xor(work, work >> np.uint32(15), out=work)
        out[j] = np.minimum.reduceat(work, bounds[:-1])
    return out.T


def band_keys(mins: np.ndarray) -> np.ndarray:
    keys = np.zeros((len(mins), BANDS), np.uint64) + np.arange(BANDS, dtype=np.uint64)
    for r in range(ROWS):
        keys = arrays.mixed(keys * U(0x9E3779B97F4A7C15) + mins[:, r::ROWS].astype(np.uint64) + U(1))
    return keys.view(np.int64)


def odd_sketches(mins: np.ndarray) -> np.ndarray:
    """(text, BITS // 64) words: the parity of the samples that fall on each bit."""
    samples = arrays.mixed(mins.astype(np.uint64) * U(BANDS * ROWS) + np.arange(BANDS * ROWS, dtype=np.uint64))
    bit = (samples % U(BITS)).astype(np.int64) + BITS * np.arange(len(mins))[:, None]
    parity = np.bincount(bit.ravel(), minlength=BITS * len(mins)) & 1
    return np.packbits(parity.astype(np.uint8).reshape(len(mins), BITS), axis=1, bitorder="little").view("<i8")


def whole_sketches(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """(text, BITS // 64) words: the parity of the set's shingles that fall on each bit; bounds of non-empty sets."""
    n = len(bounds) - 1
    bit = (arrays.mixed(h ^ U(0xA0761D6478BD642F)) % U(BITS)).astype(np.int64) + BITS * np.repeat(np.arange(n), np.diff(bounds))
    parity = np.bincount(bit, minlength=BITS * n) & 1
    return np.packbits(parity.astype(np.uint8).reshape(n, BITS), axis=1, bitorder="little").view("<i8")


def differing_bits(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def sketch_similarity(a: Column, b: Column) -> Column:
    """The similarity that two sketches show: the odd sketch's size of a symmetric difference, over the number of samples."""
    share = F.least(differing_bits(a, b) * (2.0 / BITS), F.lit(0.999))
    return F.lit(1.0) + F.log1p(-share) * (BITS / 2 / (2.0 * BANDS * ROWS))


SIGNED = "id long, n_shingles long, low long, high long, bands array<long>, sketch array<long>, whole array<long>"


def signed(docs: DataFrame, width: int) -> DataFrame:
    """(id, n_shingles, low and high: the whole set's BLAKE2 digest, bands, sketch) of docs (id, text); no bands for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text"):
            h, bounds = shingle_sets(batch.column("text"), width)
            n = np.diff(bounds)
            full = np.flatnonzero(n)
            sizes, sketches = np.where(n > 0, BANDS, 0), np.where(n > 0, BITS // 64, 0)
            flat = [np.zeros(0, np.int64)] * 3
            if len(full):
                edges = np.append(bounds[:-1][full], bounds[-1])
                mins = signatures(h, edges)
                flat = [band_keys(mins).ravel(), odd_sketches(mins).ravel(), whole_sketches(h, edges).ravel()]
            digests = b"".join([hashlib.blake2b(h[a:b].data, digest_size=16).digest() for a, b in zip(bounds.tolist(), bounds[1:].tolist(), strict=False)])
            low, high = np.frombuffer(digests, "<u8").reshape(-1, 2).T
            low, high = np.ascontiguousarray(low), np.ascontiguousarray(high)
            lists = [pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(s))).astype(np.int32)), pa.array(f)) for s, f in zip((sizes, sketches, sketches), flat, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n.astype(np.int64)), pa.array(low.view(np.int64)), pa.array(high.view(np.int64)), *lists], names=["id", "n_shingles", "low", "high", "bands", "sketch", "whole"])

    return docs.mapInArrow(run, SIGNED)


def full_sets(docs: DataFrame, width: int) -> DataFrame:
    """(id, shingles) of docs (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text"):
            h, bounds = shingle_sets(batch.column("text"), width)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(h.view(np.int64)))], names=["id", "shingles"])

    return docs.mapInArrow(run, "id long, shingles array<long>")


def confirmed(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union."""
    ids = common.written(pairs.select(F.explode(F.array("a", "b")).alias("wanted")).distinct(), "wanted")
    wanted = F.broadcast(ids) if ids.count() <= FEW_IDS else ids
    # one text stands for an id that has several
    sets = full_sets(docs.join(wanted, F.col("id") == F.col("wanted"), "left_semi"), width)
    first, second = sets.toDF("ia", "sa"), sets.toDF("ib", "sb")
    both = pairs.join(first, F.col("a") == F.col("ia")).join(second, F.col("b") == F.col("ib"))
    common_size = F.size(F.array_intersect("sa", "sb"))
    union_size = F.size("sa") + F.size("sb") - common_size
    return both.filter(common_size * 100 >= union_size * percent).select("a", "b").distinct()


def near_groups(docs: DataFrame, width: int = 2, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs (doc_id, text)."""
    common.tidy(docs.sparkSession)
    named = docs.select(F.col("doc_id").alias("id"), "text")
    sigs = common.written(signed(named, width), "sigs")
    real = sigs.filter("id is not null and n_shingles > 0")
    keys = ["low", "high", "n_shingles"]
    classes = common.written(real.groupBy(*keys).agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")), "classes")
    # rows of an id stand for each other, classes for their members
    first = common.spread_join(real.select("id", *keys), classes.toDF("low2", "high2", "n2", "rep", "n"), keys, ["low2", "high2", "n2"], "n")
    members = common.written(first.select("id", "rep", "low", "high").distinct(), "members")
    own = classes.select(F.col("rep").alias("head"), F.col("low").alias("low2"), F.col("high").alias("high2"))
    heads = real.join(own, (F.col("id") == F.col("head")) & (F.col("low") == F.col("low2")) & (F.col("high") == F.col("high2"))).dropDuplicates(["id", "low", "high"])
    heads = common.written(heads.select("id", "n_shingles", "bands", F.struct("sketch", "whole").alias("sketch")), "heads")
    rows = heads.select("id", F.explode("bands").alias("band"))
    buckets = rows.groupBy("band").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("band").alias("bucket"))
    inside = rows.join(buckets, F.col("band") == F.col("bucket")).select("band", "id")
    short = heads.select(F.col("id").alias("sid"), F.col("n_shingles").alias("n"), "sketch")
    inside = common.written(inside.join(short, F.col("id") == F.col("sid")).drop("sid"), "buckets")

    text_of = named.filter("id is not null")
    least = percent / 100 - SLACK

    def allowed(na: str, nb: str, ka: str, kb: str) -> Column:
        """What sizes, the whole sets' bitmaps (both for certain) and the samples' allow."""
        possible = differing_bits(F.col(ka)["whole"], F.col(kb)["whole"]) * (100 + percent) <= (F.col(na) + F.col(nb)) * (100 - percent)
        return (F.least(na, nb) * 100 >= F.greatest(na, nb) * percent) & possible & (sketch_similarity(F.col(ka)["sketch"], F.col(kb)["sketch"]) >= least)

    def placed(groups: DataFrame | None) -> DataFrame:
        """inside with the group that each document is in so far."""
        if groups is None:
            return inside.withColumn("group", F.col("id"))
        return inside.join(groups.toDF("gid", "group"), F.col("id") == F.col("gid"), "left").drop("gid").withColumn("group", F.coalesce("group", "id"))

    def mains(now: DataFrame, turn: int) -> DataFrame:
        """Of each bucket with several groups the largest, and one of its documents, another in every turn."""
        first = F.struct(F.xxhash64("id", F.lit(turn)) if turn else F.lit(0).cast("long"), F.col("id"))
        each = now.groupBy("band", "group").agg(F.count(F.lit(1)).alias("size"), F.min_by(F.struct("id", "n", "sketch"), first).alias("pivot"))
        top = F.max_by(F.struct("group", "pivot"), F.struct(F.col("size"), -F.col("group")))
        found = each.groupBy("band").agg(F.count(F.lit(1)).alias("groups"), top.alias("top")).filter("groups > 1")
        return found.select(F.col("band").alias("bucket"), F.col("top.group").alias("main"), F.col("top.pivot.id").alias("pivot"), F.col("top.pivot.n").alias("pivot_n"), F.col("top.pivot.sketch").alias("pivot_sketch"))

    common.tidy(docs.sparkSession)
    groups, links = None, []
    for turn in range(STARS):
        now = placed(groups)
        met = now.join(mains(now, turn), (F.col("band") == F.col("bucket")) & (F.col("group") != F.col("main")) & allowed("n", "pivot_n", "sketch", "pivot_sketch"))
        stars = met.groupBy(F.col("pivot").alias("a"), F.col("id").alias("b")).agg(F.max(sketch_similarity(F.col("sketch.sketch"), F.col("pivot_sketch.sketch"))).alias("about"))
        rank = F.row_number().over(Window.partitionBy("b").orderBy(F.desc("about"), "a"))
        best = stars.withColumn("rank", rank).filter(F.col("rank") <= TRIED).select("a", "b")
        links.append(common.written(confirmed(common.written(best, "pairs"), text_of, width, percent), "links"))
        groups = components(functools.reduce(DataFrame.union, links))
    # what shares a bucket and is not connected, each pair in the first bucket that it shares
    now = placed(groups)
    mixed = now.join(mains(now, 0).select("bucket", "main"), F.col("band") == F.col("bucket")).drop("bucket")
    mixed = common.written(mixed.join(heads.select(F.col("id").alias("sid"), "bands"), F.col("id") == F.col("sid")).drop("sid"), "mixed")
    minor = mixed.filter(F.col("group") != F.col("main")).select(*[F.col(c).alias(f"{c}1") for c in ("band", "id", "group", "n", "sketch", "bands")])
    fresh = (F.col("group1") != F.col("group")) & ((F.col("group") == F.col("main")) | (F.col("id1") < F.col("id")))
    shared = F.filter(F.zip_with("bands1", "bands", lambda x, y: F.when(x == y, x)), lambda x: x.isNotNull())
    pairs = minor.join(mixed, (F.col("band1") == F.col("band")) & fresh & allowed("n1", "n", "sketch1", "sketch") & (F.get(shared, F.lit(0)) == F.col("band")))
    pairs = pairs.select(F.least("id1", "id").alias("a"), F.greatest("id1", "id").alias("b")).distinct()
    links.append(common.written(confirmed(common.written(pairs, "pairs"), text_of, width, percent), "links"))
    common.drop_table(inside, mixed, heads)
    same = members.filter("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    groups = common.written(components(functools.reduce(DataFrame.union, links).union(_bridges(same))).toDF("gid", "group"), "groups")
    joined = common.spread_join(members.select("id", "rep"), groups, ["rep"], ["gid"])
    groups = joined.select("id", "group").union(members.join(groups, F.col("rep") == F.col("gid"), "left_anti").select("id", "rep")).groupBy("id").agg(F.min("group").alias("component"))
    found = sigs.select("id", "n_shingles").join(groups.withColumnRenamed("id", "mid"), F.col("id") == F.col("mid"), "left")
    out = common.written(found.select(F.col("id").alias("doc_id"), "n_shingles", F.coalesce("component", "id").alias("component_id")), "groups")
    common.drop_table(sigs, classes, members, *links)
    return out


def _bridges(same: DataFrame) -> DataFrame:
    """Links between classes that an id with several texts belongs to."""
    several = same.groupBy("a").agg(F.min("b").alias("least"), F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("a").alias("id"), "least")
    return same.join(several, F.col("a") == F.col("id")).filter(F.col("b") != F.col("least")).select(F.col("b").alias("a"), F.col("least").alias("b"))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of near duplicates among all documents by their 2-word shingles."""
    groups = near_groups(common.only(common.table(spark, sf_dir, "documents"), "doc_id", "text"))
    return groups.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group of near duplicates (5-word shingles, similarity 0.8 or more) the least doc_id stays.

    Rows of null doc_id and rows without words stay; rows that share a doc_id stay or go together; other columns stay, whatever their
    names; an empty table gives an empty one."""
    groups = near_groups(common.only(docs, "doc_id", "text"), width=5)
    gone = groups.filter(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
