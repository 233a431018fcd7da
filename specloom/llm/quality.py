"""Operator 4, quality rules: repetition by word suffix arrays.

For a text, the suffixes of its word sequence are sorted by prefix doubling; the longest common prefixes of neighbours give, for
every word, the longest substring that starts there and occurs again in the text. The union of these spans, of at least
``min_repeat`` words, is the covered part. A text is rejected if the covered fraction or the longest repeat passes its limit, or
if the base rules (too few words, too many words in repeated 3-word windows) reject it.

Defined results: null and empty texts have no words and fail the base rules; words are runs of ``[^\\x20\\x09-\\x0D]``; repeated
rows are judged alike; other columns play no part. Whole texts are processed, one slice of rows at a time.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MIN_REPEAT = 5  # words of a repeat that counts for the method
MAX_COVERED = 0.4  # of the words in repeats
MAX_LONGEST = 100  # words of the longest repeat
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = "#*$%&|<>"

SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, covered_words long, longest_repeat long, kept boolean"
SLICE_BYTES = 1 << 18  # of text whose suffixes are sorted together; what is held for them is many times as much


def repeat_lengths(codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each word, the length of the longest substring starting there that occurs elsewhere in the same text.

    codes: the words of several texts, one after the other, as integers; ends: for each word, where its text ends."""
    n = len(codes)
    best = np.zeros(n, np.int64)
    if not n:
        return best
    levels: list[np.ndarray] = []
    position = np.arange(n)
    order = np.lexsort((codes, ends)) if codes.max(initial=0) >= 1 << 31 or n >= 1 << 31 else np.argsort(ends * (int(codes.max()) + 1) + codes, kind="stable")
    rank, moving, where = np.empty(n, np.int64), order, np.zeros(0)
    key = np.stack((ends[order], codes[order]))
    fresh = np.empty(n, bool)
    fresh[0] = True
    fresh[1:] = (key[:, 1:] != key[:, :-1]).any(0)
    start = np.maximum.accumulate(np.where(fresh, position, 0))
    rank[order] = start
    where = start
    k = 1
    while True:
        # moving: the suffixes in order of what is compared so far, where: the first place of each one's group
        same = np.empty(len(where), bool)
        same[:-1] = where[1:] == where[:-1]
        same[-1:] = False
        shared = same.copy()
        shared[1:] |= same[:-1]
        levels.append(rank.astype(np.int32) if n < 1 << 31 else rank.copy())
        moving, where = moving[shared], where[shared]
        if not len(moving):
            break
        after = moving + k
        inside = after < ends[moving]
        second = np.where(inside, rank[np.where(inside, after, 0)] + 1, 0)
        key = where * (n + 1) + second if n < 1 << 31 else None
        by = np.argsort(key, kind="stable") if key is not None else np.lexsort((second, where))
        moving, where, second = moving[by], where[by], second[by]
        at = np.arange(len(moving))
        old = np.empty(len(moving), bool)
        old[0] = True
        old[1:] = where[1:] != where[:-1]
        fresh = old.copy()
        fresh[1:] |= second[1:] != second[:-1]
        group = np.maximum.accumulate(np.where(old, at, 0))
        where = where + np.maximum.accumulate(np.where(fresh, at, 0)) - group
        rank[moving] = where
        k *= 2
    suffixes = np.empty(n, np.int64)
    suffixes[rank] = position
    # neighbours in the suffix array that share their first word
    first = levels[0]
    a, b = suffixes[:-1], suffixes[1:]
    near = first[a] == first[b]
    a, b = a[near], b[near]
    lcp = np.zeros(len(a), np.int64)
    for level in range(len(levels) - 1, -1, -1):
        i, j = a + lcp, b + lcp
        inside = (i < ends[a]) & (j < ends[b])
        same = inside & (levels[level][np.where(inside, i, 0)] == levels[level][np.where(inside, j, 0)])
        lcp += same * (1 << level)
    np.maximum.at(best, a, lcp)
    np.maximum.at(best, b, lcp)
    return best


def covered(lengths: np.ndarray, least: int) -> np.ndarray:
    """True for each word inside a repeat of at least so many words."""
    n = len(lengths)
    at = np.nonzero(lengths >= least)[0]
    edge = np.bincount(at, minlength=n + 1) - np.bincount(at + lengths[at], minlength=n + 1)
    return np.cumsum(edge)[:n] > 0


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values between consecutive bounds."""
    total = np.concatenate(([0], np.cumsum(values)))
    return total[bounds[1:]] - total[bounds[:-1]]


def maxima(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    out = np.zeros(len(bounds) - 1, np.int64)
    full = bounds[1:] > bounds[:-1]
    if full.any():
        out[full] = np.maximum.reduceat(values, bounds[:-1][full])
    return out


def dup_lines(data: bytes) -> int:
    lines = data.split(b"\n")
    if len(lines) < 2:
        return 0
    lines = [x for x in lines if x.strip()]
    return len(lines) - len(set(lines))


def measure(texts: list[bytes], min_repeat: int, max_covered: float, max_longest: int) -> list[np.ndarray]:
    """The columns of SCHEMA for UTF-8 texts."""
    words = [x.split() for x in texts]
    bounds = np.concatenate(([0], np.cumsum([len(x) for x in words]))).astype(np.int64)
    number: dict[bytes, int] = defaultdict(lambda: len(number))
    codes = np.fromiter((c for x in words for c in map(number.__getitem__, x)), np.int64, int(bounds[-1]))
    ends = np.repeat(bounds[1:], np.diff(bounds))
    lengths = repeat_lengths(codes, ends)
    n_words = np.diff(bounds)
    repeated = sums(covered(lengths, 3), bounds)
    cover = sums(covered(lengths, min_repeat), bounds)
    longest = maxima(lengths, bounds)
    longest = np.where(longest >= min_repeat, longest, 0)
    strings = [x.decode("utf-8", "surrogatepass") for x in texts]
    chars = np.array([len(s) - sum(map(s.count, " \t\n\v\f\r")) for s in strings], np.int64)
    symbols = np.array([sum(map(s.count, SYMBOLS)) for s in strings], np.int64)
    lines = np.array([dup_lines(x) for x in texts], np.int64)
    failed = (n_words < MIN_WORDS) | (100 * repeated > MAX_REPEAT_PERCENT * n_words)
    kept = ~failed & (cover <= max_covered * n_words) & (longest <= max_longest)
    return [n_words, chars, symbols, lines, repeated, failed, cover, longest, kept]


def quality(df: DataFrame, text: str = "text", min_repeat: int = MIN_REPEAT, max_covered: float = MAX_COVERED, max_longest: int = MAX_LONGEST, prefix: str = "") -> DataFrame:
    """df with the columns of SCHEMA (names prefixed); a column of df of the same name gives way."""
    from pyspark.sql import types as T

    added = [T.StructField(prefix + f.name, f.dataType) for f in T._parse_datatype_string(SCHEMA).fields]
    base = df.drop(*[f.name for f in added])
    schema = T.StructType([*base.schema.fields, *added])
    kinds = [pa.bool_() if f.dataType == T.BooleanType() else pa.int64() for f in added]

    def run(batches):
        for batch in common.slices(batches, text, SLICE_BYTES):
            found = measure(common.utf8(batch.column(text)), min_repeat, max_covered, max_longest)
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(x, k) for x, k in zip(found, kinds, strict=True)]], names=[f.name for f in schema])

    return base.mapInArrow(run, schema)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word counts, base counts and the verdict for every text of documents."""
    return quality(common.only(common.table(spark, sf_dir, "documents"), "doc_id", "text")).drop("text")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the rules reject go; the rest keep all their columns."""
    mark = "__quality_"
    judged = quality(docs, prefix=mark)
    return judged.filter(F.col(f"{mark}kept")).select(*[F.col(f"`{c}`") for c in docs.columns])
