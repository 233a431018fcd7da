"""Operator 8, substring dedup: paragraphs that repeat across documents, found by MinHash banding and removed but for their first place.

Paragraphs are of two kinds. Lines of at least LINE_WORDS words have BANDS bands of ROWS MinHash values, which miss a pair of similarity
0.8 with a probability of (1 - 0.8 ** 2) ** 6 = 0.002. And every run of SPAN words in a text is a paragraph with one band of one value,
the least hash of KEY words on end in it: neighbouring runs mostly share it, so it is kept once, and two
texts that share any SPAN equal words in a row collide for certain, wherever in a line these stand. In each bucket paragraphs meet the
first one. Pairs of lines are verified by exact Jaccard similarity of their shingles; those that the first one leaves unlinked meet the
first of them once more. Then, in buckets whose lines are not all connected, a task finds by their rarest shingles all pairs of lines
that link what is not connected, so no link inside a bucket is lost and no pair that is none leaves the task; components of the links
are clusters, and what is in a cluster repeats its first paragraph (least doc_id, then place). A run repeats its bucket's first one.

Repeats of the same document that follow one another in both texts, at most GAP words apart, form a chain. Every chain's words are then
compared with those of its source: shared shingles and the words beside them, EDGE at most, must be equal word by word; of a line those
words count that lie in a shingle which its source has. Of a chain the parts that do repeat are removals if they have MIN_WORDS words and
the span over them has a Jaccard similarity of at least PERCENT / 100 with its source; else the chain is cut at its widest gap and both
sides are judged. Words between the parts, which repeat nowhere, stay. Every run carries bytes of the hashes of 6, 12, 18 and 24 words
on either side; they only rule out chains that can't be long enough.

Keys that hold far more rows than others (at most four times as many keys as there are partitions can) are spread over tasks.

Defined results: words are compared after lower-casing A-Z; null texts stay null, empty ones empty; a text without removals is
unchanged to the byte; of equal texts the one of least doc_id stays; rows that share a doc_id are told apart by their texts, rows equal
in both are one; rows with null doc_id are unchanged. doc_id may be of any type that has an order.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import arrays, common
from .components import components
from .near_dedup import FEW_IDS

SHINGLE = 5  # words, for similarities
KEY = 8  # words that a run and its source must share somewhere
WINDOW = 24  # places of which the one with the least hash stands for a run
SPAN = WINDOW + KEY - 1
PERCENT = 80
LINE_WORDS = 45
BANDS, ROWS = 6, 2
TURNS = 2  # first paragraphs of a bucket that its lines meet before all that are left meet each other
MET_SHINGLES = 2_000_000  # of whole buckets that a task takes at once; a larger bucket is taken by itself
GAP = 24
EDGE = 48  # words beside a chain that are compared; more than MIN_WORDS
MIN_WORDS = 45  # passages of 50 and more words, less what the edges can hide
SIDE = 6  # words that each of SIDES bytes adds
SIDES = 4
U = np.uint64

_SEEDS = arrays.mixed(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * U(0xD1342543DE82EF95))


def window_min(v: np.ndarray, n: int) -> np.ndarray:
    """The least of v[i : i + n] for each i (to the end of v where it ends before)."""
    top, out, have = np.array(np.iinfo(v.dtype).max, v.dtype), v, 1
    while have < n:
        step = min(have, n - have)
        after = np.full(len(v), top)
        after[: max(0, len(v) - step)] = out[step:]
        out = np.minimum(out, after)
        have += step
    return out


def shingles(w: arrays.Words, size: int) -> np.ndarray:
    """Hash of so many words from each word on, whatever texts they are in; pairs of runs are mixed, so few steps do."""
    n = len(w.hashes)
    out, have, whole, length = np.zeros(n, np.uint64), 0, w.hashes, 1
    while True:
        if size & length:
            out[: n - have] = arrays.mixed(out[: n - have] * arrays.MULTIPLIER + whole[have:])
            have += length
        if 2 * length > size:
            return out
        longer = whole.copy()
        longer[: n - length] = arrays.mixed(whole[: n - length] * arrays.MULTIPLIER + whole[length:])
        whole, length = longer, 2 * length


def runs_of(w: arrays.Words) -> tuple[np.ndarray, np.ndarray]:
    """(first words of the KEY words that stand for the runs of SPAN words, text after text; their hashes)."""
    n = len(w.hashes)
    if n < SPAN:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    ends = np.repeat(w.bounds[1:], np.diff(w.bounds))
    left = ends - np.arange(n)  # words from each on
    h = shingles(w, KEY)
    v = (h >> U(1)).view(np.int64)
    v[left < KEY] = np.iinfo(np.int64).max
    least = window_min(v, WINDOW)
    least[left < SPAN] = -1  # no whole run begins here
    # a place has the least hash of a run that begins at one of the WINDOW places up to it
    greatest = -window_min(-least[::-1], WINDOW)[::-1]
    chosen = (greatest == v) & (left >= KEY)
    chosen[1:] &= v[1:] != v[:-1]  # of one word on and on, the first
    chosen = np.flatnonzero(chosen)
    return chosen, h[chosen]


def lines(w: arrays.Words) -> tuple[np.ndarray, np.ndarray]:
    """(first word, end) of the lines with at least LINE_WORDS words."""
    n = len(w.hashes)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.zeros(n + 1, bool)
    cut[np.searchsorted(w.starts, np.flatnonzero(w.data == 10))] = True  # the first word after a break
    cut[w.bounds[:-1]] = True
    cut = cut[:n]
    first = np.flatnonzero(cut)
    end = np.append(first[1:], n)
    long = end - first >= LINE_WORDS
    return first[long], end[long]


def owner(w: arrays.Words, first: np.ndarray) -> np.ndarray:
    return np.searchsorted(w.bounds, first, side="right") - 1


def span_words(first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words of all spans, one span after the other; where each span's begin among them)."""
    n = end - first
    begin = np.cumsum(n) - n
    return np.arange(int(n.sum())) + np.repeat(first - begin, n), begin


def sides(w: arrays.Words, at: np.ndarray, before: bool) -> np.ndarray:
    """SIDES bytes for each place: byte k tells the SIDE * (k + 1) words before (or from) the place on; 0 where the text has fewer."""
    out = np.zeros(len(at), np.uint32)
    text = np.searchsorted(w.bounds, at if before else at - 1, side="right") - 1
    edge = w.bounds[text] if before else w.bounds[text + 1]
    h, inside = np.zeros(len(at), np.uint64), np.ones(len(at), bool)
    for k in range(SIDES * SIDE):
        place = at - 1 - k if before else at + k
        inside &= place >= edge if before else place < edge
        h = arrays.mixed(h * arrays.MULTIPLIER + np.where(inside, w.hashes[np.where(inside, place, 0)], U(0)))
        if k % SIDE == SIDE - 1:
            out |= np.where(inside, (h % U(255)).astype(np.uint32) + np.uint32(1), np.uint32(0)) << np.uint32(8 * (k // SIDE))
    return out.view(np.int32)


def line_sets(w: arrays.Words, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(shingle hashes of the lines, one line after the other; where each line's begin among them)."""
    h = shingles(w, SHINGLE)
    at, begin = span_words(first, end - SHINGLE + 1)
    return h[at], begin


def line_bands(w: arrays.Words, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    h, begin = line_sets(w, first, end)
    keys = np.zeros((len(first), BANDS), np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64)
    for j in range(BANDS * ROWS):
        x = (h ^ _SEEDS[j]) * arrays.MULTIPLIER
        x ^= x >> U(32)
        least = np.minimum.reduceat(x * U(0xBF58476D1CE4E5B9), begin)
        keys[:, j // ROWS] = arrays.mixed(keys[:, j // ROWS] * arrays.MULTIPLIER + least)
    return keys


def line_sums(w: arrays.Words, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Two 32-bit numbers for each line, equal where the shingles are."""
    h, begin = line_sets(w, first, end)
    return np.add.reduceat(arrays.mixed(h), begin).view(np.int32).reshape(-1, 2)


def kind_of(docs: DataFrame) -> str:
    return docs.schema["id"].dataType.simpleString()


def fingerprints(docs: DataFrame) -> DataFrame:
    """(id, first, size, key, line, before, after): a row for each band of each paragraph of docs (id, text); size of lines only, whose
    before and after are their line_sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text"):
            w = arrays.Words(batch.column("text"), lower=True)
            f, key = runs_of(w)
            x, y = sides(w, f, True), sides(w, f + KEY, False)
            g, e = lines(w)
            own = np.concatenate((owner(w, f), np.repeat(owner(w, g), BANDS)))
            if not len(own):
                continue
            first, size = np.concatenate((f, np.repeat(g, BANDS))), np.concatenate((np.zeros(len(f), np.int64), np.repeat(e - g, BANDS)))
            sums = np.repeat(line_sums(w, g, e), BANDS, axis=0) if len(g) else np.zeros((0, 2), np.int32)
            key = np.concatenate((key, line_bands(w, g, e).ravel() if len(g) else np.zeros(0, np.uint64)))
            values = [first - w.bounds[own], size, key.view(np.int64), size > 0, np.concatenate((x, sums[:, 0])), np.concatenate((y, sums[:, 1]))]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(own)), *[pa.array(v).cast(k) for v, k in zip(values, kinds, strict=True)]], names=["id", "first", "size", "key", "line", "before", "after"])

    return docs.mapInArrow(run, f"id {kind_of(docs)}, first int, size int, key long, line boolean, before int, after int")


def sets_of_lines(docs: DataFrame) -> DataFrame:
    """(id, first, size, shingles) of all lines of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text"):
            w = arrays.Words(batch.column("text"), lower=True)
            f, e = lines(w)
            if len(f):
                h, begin = line_sets(w, f, e)
                own = owner(w, f)
                lists = pa.ListArray.from_arrays(pa.array(np.append(begin, len(h)).astype(np.int32)), pa.array(h.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(own)), pa.array((f - w.bounds[own]).astype(np.int32)), pa.array((e - f).astype(np.int32)), lists], names=["id", "first", "size", "shingles"])

    return docs.mapInArrow(run, f"id {kind_of(docs)}, first int, size int, shingles array<long>")


def shingles_at(at: DataFrame, docs: DataFrame) -> DataFrame:
    """(place, s): the different shingles of the lines at (at), a written table of structs (id, first, size)."""
    ids = at.select(F.col("at.id").alias("wanted")).distinct()
    ids = F.broadcast(ids) if at.count() <= FEW_IDS else ids
    sets = sets_of_lines(docs.join(ids, F.col("id") == F.col("wanted"), "left_semi"))
    return sets.select(F.struct("id", "first", "size").alias("place"), F.array_distinct("shingles").alias("s")).join(at, F.col("place") == F.col("at"), "left_semi").dropDuplicates(["place"])


def verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Pairs (a, b) of lines, structs (id, first, size), with a Jaccard similarity of at least PERCENT / 100."""
    at = common.written(pairs.select(F.explode(F.array("a", "b")).alias("at")).distinct(), "lines")
    sets = shingles_at(at, docs)
    both = common.spread_join(pairs, sets.toDF("at1", "s1"), ["a"], ["at1"])
    both = both.join(sets.toDF("at2", "s2"), F.col("b") == F.col("at2"))
    same = F.size(F.array_intersect("s1", "s2"))
    return both.filter(same * 100 >= (F.size("s1") + F.size("s2") - same) * PERCENT).select("a", "b").distinct()


def line_clusters(rows: DataFrame, docs: DataFrame) -> DataFrame | None:
    """(id, component) of lines, structs (id, first, size), in clusters of several, from their bands rows (key, at, sums)."""
    links, met_pairs, spent, members = [], [], [], None
    for _ in range(TURNS):
        buckets = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("at", "sums")).alias("least")).filter("n > 1").select(F.col("key").alias("bucket"), "n", F.col("least.at").alias("pivot"), F.col("least.sums").alias("pivot_sums"))
        buckets = common.written(buckets, "buckets")
        met = common.written(common.spread_join(rows, buckets, ["key"], ["bucket"], "n").filter("at <> pivot").select("key", "at", "sums", "pivot"), "met")
        spent += [buckets, met]
        if met.isEmpty():
            break
        if members is None:
            members = met.select("key", "at", "sums").union(buckets.select("bucket", "pivot", "pivot_sums"))
        pairs = common.written(met.select(F.col("pivot").alias("a"), F.col("at").alias("b")).distinct(), "pairs")
        found = common.written(verified(pairs, docs), "links")
        met_pairs.append(pairs)
        links.append(found)
        # what its bucket's first paragraph leaves unlinked meets the first of these
        rows = met.join(found, (F.col("pivot") == F.col("a")) & (F.col("at") == F.col("b")), "left_anti").select("key", "at", "sums")
    if not links:
        common.drop_table(*spent)
        return None
    out = common.written(components(functools.reduce(DataFrame.union, links)), "clusters")
    rest = common.written(apart(members, out), "apart")
    spent.append(rest)
    if not rest.isEmpty():
        more = common.written(linked(rest, docs), "links")
        links.append(more)
        if not more.isEmpty():
            spent.append(out)
            out = common.written(components(functools.reduce(DataFrame.union, links)), "clusters")
    common.drop_table(*links, *met_pairs, *spent)
    return out


def apart(members: DataFrame, clusters: DataFrame) -> DataFrame:
    """(key, part, at): the lines of buckets that clusters (id, component) leave apart; of equal lines of a cluster the first stands for
    all. members: (key, at, sums)."""
    known = members.join(clusters, F.col("at") == F.col("id"), "left").select("key", "at", "sums", F.coalesce("component", "at").alias("part"))
    several = known.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high")).filter("low <> high").select("key")
    return known.join(several, "key", "left_semi").groupBy("key", "part", "sums").agg(F.min("at").alias("at")).select("key", F.xxhash64("part").alias("part"), "at")


def linked(rest: DataFrame, docs: DataFrame) -> DataFrame:
    """Pairs (a, b) of lines of a bucket, in rest (key, part, at), with a Jaccard similarity of at least PERCENT / 100, enough of them to
    connect whatever parts such pairs connect.

    Whole buckets meet in tasks, which look for pairs by the rarest shingles of each line; only links leave a task."""
    at = common.written(rest.select("at").distinct(), "lines")
    sets = shingles_at(at, docs)
    rows = rest.withColumnRenamed("at", "line").join(sets, F.col("line") == F.col("place")).select("key", "part", "line", "s").repartition("key").sortWithinPartitions("key")

    def met(table: pa.Table) -> pa.RecordBatch:
        table = table.combine_chunks()
        s = common.one_chunk(table.column("s"))
        pairs = like_pairs(np.asarray(table.column("key")), np.asarray(table.column("part")), np.asarray(s.value_lengths()).astype(np.int64), np.asarray(s.flatten()).view(np.uint64))
        lines_ = common.one_chunk(table.column("line"))
        return pa.RecordBatch.from_arrays([lines_.take(pa.array([p[k] for p in pairs], pa.int64())) for k in (0, 1)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(pa.Table.from_batches([batch]))
            n += len(batch.column("s").flatten())
            if n > MET_SHINGLES:
                table = pa.concat_tables(held).combine_chunks()
                key = np.asarray(table.column("key"))
                whole = int(np.searchsorted(key, key[-1]))  # the last bucket may go on
                if whole:
                    yield met(table.slice(0, whole))
                held = [table.slice(whole)]
                n = len(common.one_chunk(held[0].column("s")).flatten())
        if held:
            yield met(pa.concat_tables(held))

    kind = rest.schema["at"].dataType.simpleString()
    return rows.mapInArrow(run, f"a {kind}, b {kind}").distinct()


def like_pairs(key: np.ndarray, part: np.ndarray, size: np.ndarray, values: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of rows with equal key whose sets (of so many values, one set after the other) have a Jaccard similarity of at least
    PERCENT / 100; none between rows that have a part in common or that pairs before connect.

    Two such sets share a value among the first of each in any order of values, up to the place from which fewer than PERCENT of a
    set are left; in order of frequency these are rare ones. All that share one are compared on their whole sets."""
    n = len(size)
    row = np.repeat(np.arange(n), size)
    _, code, count = np.unique(arrays.mixed(values + arrays.mixed(key.view(np.uint64) * arrays.MULTIPLIER)[row]), return_inverse=True, return_counts=True)
    order = np.lexsort((code, count[code], row))
    code = code[order]
    at = np.append(0, np.cumsum(size))
    early = np.arange(len(code)) - at[row] <= (size - (size * PERCENT + 99) // 100)[row]
    early &= count[code] > 1
    by_code = np.lexsort((row[early], code[early]))
    having = row[early][by_code]  # rows by their first values
    begin = np.append(0, np.cumsum(np.bincount(code[early], minlength=len(count))))
    first, first_at = code[early], np.append(0, np.cumsum(np.bincount(row[early], minlength=n)))
    group = np.unique(part, return_inverse=True)[1]
    mark, out = np.zeros(len(count), bool), []
    for i in np.flatnonzero(np.diff(first_at)).tolist():
        found = [having[begin[c] : begin[c + 1]] for c in first[first_at[i] : first_at[i + 1]].tolist()]
        found = np.concatenate(found)
        js = found[(found < i) & (group[found] != group[i])]
        if not len(js):
            continue
        js = np.unique(js)
        js = js[np.minimum(size[js], size[i]) * 100 >= np.maximum(size[js], size[i]) * PERCENT]
        mark[code[at[i] : at[i + 1]]] = True
        for k in range(0, len(js), 4096):
            some = js[k : k + 4096]
            places, starts = span_words(at[some], at[some + 1])
            same = np.add.reduceat(mark[code[places]].astype(np.int64), starts)
            for j in some[same * 100 >= (size[some] + size[i] - same) * PERCENT].tolist():
                if group[j] != group[i]:
                    out.append((i, j))
                    group[group == group[j]] = group[i]
        mark[code[at[i] : at[i + 1]]] = False
    return out


SEED = "struct<first: int, size: int, of: int, words: int, before: int, after: int, line: boolean>"


def chains(seeds: DataFrame, gap: int, least: int) -> DataFrame:
    """Chains of the repeats seeds (id, pid, seeds): the words [lo, hi) of id that are compared with [plo, phi) of pid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for one, other, found in zip(*[batch.column(c).to_pylist() for c in ("id", "pid", "seeds")], strict=True):
                made: list[list[dict]] = []
                open_: list[list] = []  # [end, end at the source, offset, chain]
                for x in sorted(found, key=lambda x: (x["first"], x["of"], x["size"])):
                    offset = x["first"] - x["of"]
                    open_ = [c for c in open_ if x["first"] <= c[0] + gap]
                    near = [c for c in open_ if abs(offset - c[2]) <= gap and x["of"] <= c[1] + gap and x["of"] >= c[3][-1]["of"]]
                    if near:
                        c = min(near, key=lambda c: abs(offset - c[2]))
                        c[3].append(x)
                        c[:3] = max(c[0], x["first"] + x["size"]), max(c[1], x["of"] + x["words"]), offset
                    else:
                        made.append([x])
                        open_.append([x["first"] + x["size"], x["of"] + x["words"], offset, made[-1]])
                for c in made:
                    # where all bytes agree any number of words may be equal; else up to SIDE - 1 more
                    before = [0 if x["line"] else EDGE if x["before"] >= SIDES * SIDE else x["before"] + SIDE - 1 for x in c]
                    after = [0 if x["line"] else EDGE if x["after"] >= SIDES * SIDE else x["after"] + SIDE - 1 for x in c]
                    lo = max(0, min(x["first"] - n for x, n in zip(c, before, strict=True)))
                    hi = max(x["first"] + x["size"] + n for x, n in zip(c, after, strict=True))
                    if hi - lo >= least:
                        plo = max(0, min(x["of"] - n for x, n in zip(c, before, strict=True)))
                        rows.append((one, lo, hi, other, plo, max(x["of"] + x["words"] + n for x, n in zip(c, after, strict=True)), c))
            if rows:
                kinds = [batch.schema.field("id").type, pa.int32(), pa.int32()] * 2 + [batch.schema.field("seeds").type]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["id", "lo", "hi", "pid", "plo", "phi", "seeds"])

    return seeds.mapInArrow(run, f"id {kind_of(seeds)}, lo int, hi int, pid {kind_of(seeds)}, plo int, phi int, seeds array<{SEED}>")


def cut_out(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(of, from, to, words): the words [from, to) of the texts of docs (id, text), as text, for wanted (of, spans)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text"):
            w = arrays.Words(batch.column("text"), hashes=False)
            lists = batch.column("spans")
            row = np.repeat(np.arange(batch.num_rows), np.asarray(lists.value_lengths()))
            spans = lists.flatten()
            lo, hi = (np.asarray(spans.field(c), np.int64) for c in ("lo", "hi"))
            for k in range(0, len(row), 1000):
                own, a, b = row[k : k + 1000], lo[k : k + 1000], hi[k : k + 1000]
                base, n = w.bounds[own], w.bounds[own + 1] - w.bounds[own]
                first, end = np.minimum(a, n), np.minimum(b, n)
                words = [w.data[w.starts[i] : w.ends[j - 1]].tobytes().decode("utf-8", "surrogatepass") if i < j else "" for i, j in zip((base + first).tolist(), (base + end).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("of").take(pa.array(own)), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(words, pa.string())], names=["of", "from", "to", "words"])

    joined = docs.join(wanted, F.col("id") == F.col("of")).select("of", "spans", "text")
    return joined.mapInArrow(run, f"of {kind_of(docs)}, from int, to int, words string").dropDuplicates(["of", "from", "to"])


def shingled(h: np.ndarray) -> np.ndarray:
    """Hash of the SHINGLE words from each word on (all of fewer words)."""
    n, out = max(1, len(h) - SHINGLE + 1), U(0)
    for k in range(min(SHINGLE, len(h))):
        out = arrays.mixed(out * arrays.MULTIPLIER + h[k : k + n] + U(1))
    return out


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the shingles of two spans of word hashes have a Jaccard similarity of at least PERCENT / 100."""
    a, b = np.unique(shingled(a)), np.unique(shingled(b))
    same = len(np.intersect1d(a, b, assume_unique=True))
    return same * 100 >= (len(a) + len(b) - same) * PERCENT


def covered_runs(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """(first, end) of the words of a that lie in shingles of b."""
    if min(len(a), len(b)) < SHINGLE:
        return []
    at = np.flatnonzero(np.isin(shingled(a), shingled(b)))
    cuts = np.flatnonzero(np.diff(at) > SHINGLE)
    return [(int(i), int(j) + SHINGLE) for i, j in zip(at[np.append(0, cuts + 1)], at[np.append(cuts, len(at) - 1)], strict=True)] if len(at) else []


def equal_words(a: np.ndarray, b: np.ndarray) -> int:
    """In how many words from the first on two spans agree."""
    n = min(len(a), len(b))
    differ = a[:n] != b[:n]
    return int(differ.argmax()) if differ.any() else n


def confirmed(one: np.ndarray, other: np.ndarray, seeds: list[tuple[int, int, int, int, bool]], least: int) -> list[tuple[int, int]]:
    """(first, end) of what of a chain's words repeats its source's; seeds: (first, size, first and words at the source, line)."""
    pieces: list[tuple[int, int, int, int]] = []
    for i, n, j, m, line in seeds:
        if line:
            pieces += [(i + a, i + b, j, j + m) for a, b in covered_runs(one[i : i + n], other[j : j + m])]
        elif not any(a <= i and i + n <= b and i - j == a - c for a, b, c, _ in pieces[-2:]) and equal_words(one[i : i + n], other[j : j + n]) == n:
            back, on = equal_words(one[:i][::-1], other[:j][::-1]), equal_words(one[i + n :], other[j + n :])
            pieces.append((i - back, i + n + on, j - back, j + n + on))
    out: list[tuple[int, int]] = []
    left = [sorted(pieces)]
    while left:
        part = left.pop()
        total, end, gaps = 0, -1, []
        for k, (a, b, _, _) in enumerate(part):
            if k:
                gaps.append((a - end, -abs(2 * k - len(part)), k))
            total, end = total + max(0, b - max(a, end)), max(end, b)
        if total < least:
            continue
        if len(part) == 1 or alike(one[part[0][0] : end], other[min(x[2] for x in part) : max(x[3] for x in part)]):
            out += [(a, b) for a, b, _, _ in part]
        else:
            k = max(gaps)[2]
            left += [part[:k], part[k:]]
    return out


def removals(docs: DataFrame, gap: int = GAP, least: int = MIN_WORDS) -> DataFrame:
    """(id, spans array<struct<first, size>>): what of docs (id, text) repeats an earlier place."""
    common.tidy(docs.sparkSession)
    rows = common.written(fingerprints(docs), "paragraphs")
    keyed = rows.filter("not line").select("id", "first", "key", "before", "after")
    buckets = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "first", "before", "after")).alias("pivot")).filter("n > 1")
    buckets = common.written(buckets.withColumnRenamed("key", "bucket"), "buckets")
    met = common.spread_join(keyed, buckets, ["key"], ["bucket"], "n").filter((F.col("id") != F.col("pivot.id")) | (F.col("first") != F.col("pivot.first")))

    def shared(side: str):
        """Words on that side that both places may have: SIDE for each byte in which they agree, from the lowest on."""
        other = F.col(side).bitwiseXOR(F.col(f"pivot.{side}"))
        found = F.lit(SIDES * SIDE)
        for k in range(SIDES - 1, -1, -1):
            found = F.when(F.shiftrightunsigned(other, 8 * k).bitwiseAND(F.lit(255)) != 0, F.lit(SIDE * k)).otherwise(found)
        return found.cast("int")

    same = met.select("id", F.col("pivot.id").alias("pid"), F.struct("first", F.lit(KEY).alias("size"), F.col("pivot.first").alias("of"), F.lit(KEY).alias("words"), shared("before").alias("before"), shared("after").alias("after"), F.lit(False).alias("line")).alias("seed"))
    near = line_clusters(rows.filter("line").select("key", F.struct("id", "first", "size").alias("at"), F.struct("before", "after").alias("sums")), docs)
    if near is not None:
        at = near.filter(F.col("id") != F.col("component")).select(F.col("id").alias("at"), F.col("component").alias("pivot"))
        at = at.select("at.id", F.col("pivot.id").alias("pid"), F.struct("at.first", "at.size", F.col("pivot.first").alias("of"), F.col("pivot.size").alias("words"), F.lit(0).alias("before"), F.lit(0).alias("after"), F.lit(True).alias("line")).alias("seed"))
        same = same.union(at)
    found = common.written(chains(same.groupBy("id", "pid").agg(F.collect_set("seed").alias("seeds")), gap, least), "chains")
    wanted = found.select(F.explode(F.array(F.struct("id", "lo", "hi"), F.struct(F.col("pid").alias("id"), F.col("plo").alias("lo"), F.col("phi").alias("hi")))).alias("x")).distinct()
    wanted = wanted.groupBy(F.col("x.id").alias("of")).agg(F.collect_list(F.struct("x.lo", "x.hi")).alias("spans"))
    spans = common.written(cut_out(docs, wanted), "spans")
    both = common.spread_join(found, spans.toDF("of2", "from2", "to2", "words2"), ["pid", "plo", "phi"], ["of2", "from2", "to2"])
    one = spans.toDF("of1", "from1", "to1", "words1")
    both = both.join(one, (F.col("id") == F.col("of1")) & (F.col("lo") == F.col("from1")) & (F.col("hi") == F.col("to1")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b for a in common.slices(batches, "words1") for b in common.slices([a], "words2")):
            v, w = (arrays.Words(batch.column(c), lower=True) for c in ("words1", "words2"))
            row, out = [], []
            for i, (lo, plo, seeds) in enumerate(zip(*[batch.column(c).to_pylist() for c in ("lo", "plo", "seeds")], strict=True)):
                seeds = sorted((x["first"] - lo, x["size"], x["of"] - plo, x["words"], x["line"]) for x in seeds)
                made = confirmed(v.hashes[v.bounds[i] : v.bounds[i + 1]], w.hashes[w.bounds[i] : w.bounds[i + 1]], seeds, least)
                out += [(a + lo, b - a) for a, b in made]
                row += [i] * len(made)
            if out:
                yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(row, pa.int64())), *[pa.array(x, pa.int32()) for x in zip(*out, strict=True)]], names=["id", "first", "size"])

    sure = both.select("id", "lo", "plo", "seeds", "words1", "words2").mapInArrow(run, f"id {kind_of(docs)}, first int, size int")
    out = common.written(sure.groupBy("id").agg(F.collect_set(F.struct("first", "size")).alias("spans")), "removals")
    common.drop_table(rows, buckets, found, spans, *([near] if near is not None else []))
    return out


def runs(first: list[int], size: list[int], words: int) -> list[tuple[int, int]]:
    """(first, end) of the runs of spans that touch, inside a text of so many words."""
    out: list[list[int]] = []
    for a, n in sorted(zip(first, size, strict=True)):
        b = min(a + n, words)
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        elif a < b:
            out.append([a, b])
    return [(a, b) for a, b in out]


def dedup(docs: DataFrame, gap: int = GAP, min_words: int = MIN_WORDS, mark: str = "") -> DataFrame:
    """docs (with doc_id, text) with text cleaned, and n_words, n_removed (words), removed (array of struct first, size), changed."""
    several = common.written(docs.filter("doc_id is not null").groupBy(F.col("doc_id").alias("id")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("id"), "ids")
    names = [f"{mark}{x}" for x in ("n_words", "n_removed", "removed", "changed")]
    columns = [c for c in docs.columns if c not in names]
    rest = [c for c in columns if c not in ("doc_id", "text")]
    base = docs.select("doc_id", "text", F.struct(F.lit(0).alias("none"), *[F.col(f"`{c}`") for c in rest]).alias("rest"))
    if several.isEmpty():
        base = base.withColumn("key", F.col("doc_id"))
    else:  # rows that share a doc_id go by their texts too
        base = base.join(several, F.col("doc_id") == F.col("id"), "left").withColumn("key", F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", F.when(F.col("id").isNotNull(), F.xxhash64("text")).otherwise(0).alias("by_text")))).drop("id")
    cuts = removals(base.filter("doc_id is not null and text is not null").select(F.col("key").alias("id"), "text"), gap, min_words)
    joined = base.join(cuts, F.col("key") == F.col("id"), "left").select("doc_id", "text", "rest", "spans")
    added = T._parse_datatype_string("a long, b long, c array<struct<first: int, size: int>>, d boolean").fields
    schema = T.StructType([*[docs.schema[c] for c in columns], *[T.StructField(n, f.dataType) for n, f in zip(names, added, strict=True)]])
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.struct([("first", pa.int32()), ("size", pa.int32())])), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text"):
            w = arrays.Words(batch.column("text"), hashes=False)
            n = np.diff(w.bounds)
            texts = batch.column("text").to_pylist()
            gone, found = [0] * len(texts), [[] for _ in texts]
            for i, spans in enumerate(batch.column("spans").to_pylist()):
                if spans and texts[i] is not None:
                    data, a0, w0 = texts[i].encode(), int(w.texts[i]), int(w.bounds[i])
                    found[i] = runs([x["first"] for x in spans], [x["size"] for x in spans], int(n[i]))
                    kept, last = [], 0
                    for a, b in found[i]:
                        kept.append(data[last : int(w.starts[w0 + a]) - a0])
                        last = int(w.starts[w0 + b]) - a0 if w0 + b < w.bounds[i + 1] else len(data)
                        gone[i] += b - a
                    if found[i]:
                        texts[i] = b"".join([*kept, data[last:]]).decode()
            others = dict(zip(rest, batch.column("rest").flatten()[1:], strict=True))
            own = [pa.array(texts, pa.string()) if c == "text" else batch.column("doc_id") if c == "doc_id" else others[c] for c in columns]
            values = [n, gone, [[{"first": a, "size": b - a} for a, b in x] for x in found], [x > 0 for x in gone]]
            yield pa.RecordBatch.from_arrays([*own, *[pa.array(v, k) for v, k in zip(values, kinds, strict=True)]], names=[f.name for f in schema])

    return joined.mapInArrow(run, schema)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the passages removed that repeat an earlier one."""
    return dedup(common.only(common.table(spark, sf_dir, "documents"), "doc_id", "text"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: repeated passages go from the texts; a document of which no word is left goes.

    Null and wordless texts and rows of null doc_id stay as they are; n_chars, if there, follows the text. Other columns stay, whatever
    their names; an empty table gives an empty one."""
    cleaned = dedup(docs, mark="__passages_")
    left = cleaned.filter((F.col("__passages_n_removed") == 0) | (F.col("__passages_n_words") > F.col("__passages_n_removed")))
    n_chars = [F.when(F.col("__passages_changed"), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")).alias("n_chars")] if "n_chars" in docs.columns else []
    return left.select(*[n_chars[0] if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])
