"""Operator 3, byte-level BPE encoding and decoding by a table of ranks.

Texts are cut into pieces by the tokenizer's pattern. Rows are taken in blocks; the distinct pieces of a block that are no tokens
themselves go, as byte arrays, through Spark's higher-order functions: ``aggregate`` folds over the merge steps, each taking the
adjacent pair of lowest rank from a literal rank map. The map is a row-displaced table: the merge of ids (a, b) stands at
``base[a] + b`` and carries a, so one look tells the rank or that there is none. Its arrays come into the plan as a constant one-row
subquery: as literals in the plan's text its megabytes would be in every description of the plan that the driver keeps. The ids of
the pieces are then put together for each text; decoding concatenates the ids' byte strings. Texts are neither shuffled nor
collected; blocks bound the memory, and a task folds a piece once while it remembers it. Of a larger table the pieces that are
frequent in a bounded sample (FREQUENT of them at most, SAMPLE rows) are encoded once and broadcast; they save work alone, every
other piece is encoded in its block. Pieces are found by hashes and told apart by their bytes.

The fold is quadratic in a piece's length; pieces of over LONG bytes (a long run without a break) are merged by a heap instead.

Defined results: a null or empty text has no ids and decodes to no bytes; repeated rows have equal results; other columns of the
input stay (but for clashing output names).
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import arrays, common
from .binary_ids import tokenizer_path

LONG = 256  # bytes of a piece beyond which a heap merges it
BLOCK_BYTES = 1 << 20  # UTF-8 bytes of text whose distinct pieces are encoded together
SLICE_BYTES = 1 << 20  # of them at a time
MET = 600_000  # pieces that a task remembers between blocks
IDS = 1 << 16  # more than any id
NONE = IDS - 1  # no id and no rank
TWICE = (1 << 32) + 1  # puts an id beside itself, 32 bits up
SAMPLE = 16_000  # rows in which frequent pieces are counted
FREQUENT = 500_000  # of them, and so of the broadcast table


@functools.cache
def load_ranks(name: str) -> dict[bytes, int]:
    with open(tokenizer_path(name), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    if max(ranks.values()) >= IDS - 1:
        raise ValueError(f"ids of {IDS - 1} and more are not supported")
    return ranks


def merge(piece: bytes, ranks: dict[bytes, int], below: int = IDS) -> list[bytes]:
    """The parts that are left when no adjacent pair has a rank below the given one, the lowest (leftmost) merged first. Linear memory,
    n log n steps."""
    n = len(piece)
    part: list[bytes | None] = [piece[i : i + 1] for i in range(n)]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(ranks[x], i, x) for i in range(n - 1) if ranks.get(x := piece[i : i + 2], below) < below]
    heapq.heapify(heap)
    while heap:
        _, i, both = heapq.heappop(heap)
        j = after[i] if part[i] is not None else n
        if j >= n or part[i] + part[j] != both:
            continue
        part[i], part[j] = both, None
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
        for a in (before[i], i):
            if a >= 0 and after[a] < n and ranks.get(x := part[a] + part[after[a]], below) < below:
                heapq.heappush(heap, (ranks[x], a, x))
    return [x for x in part if x is not None]


@functools.cache
def rank_table(name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids of the single bytes, base, table): table[base[a] + b] is a * 2**16 + rank of the merge of a and b."""
    ranks = load_ranks(name)
    rows: dict[int, list[tuple[int, int]]] = {}
    for token, rank in ranks.items():
        if len(token) > 1:
            parts = merge(token, ranks, rank)
            if len(parts) == 2:
                rows.setdefault(ranks[parts[0]], []).append((ranks[parts[1]], rank))
    top = max(ranks.values()) + 2  # one more than all ids: what stands before and after a piece
    base, used = np.zeros(top, np.int64), np.full(4 * len(ranks) + top, -1, np.int64)
    rng = np.random.default_rng(0)
    for a, row in sorted(rows.items(), key=lambda x: (-len(x[1]), x[0])):
        b = np.array([x for x, _ in row])
        at = -1
        while at < 0:  # the first of many places where the row fits
            tried = rng.integers(0, 2 * len(ranks) + 1, 512 if len(b) > 4 else 8)
            for k in range(0, len(b), 16):
                tried = tried[(used[b[k : k + 16] + tried[:, None]] < 0).all(1)]
            at = int(tried[0]) if len(tried) else -1
        base[a], used[b + at] = at, a * IDS + np.array([r for _, r in row])
    single = np.array([ranks[bytes([i])] for i in range(256)])
    return single, base, used[: int(base.max()) + top + 1]


def constant_tables(spark: SparkSession, name: str) -> Column:
    """The rank map as a constant of the plan: struct of start, bases, merges. It has one row.

    merges: at bases[a] + b stands a * 2**32 + rank * 2**16 of the merge of a and b; where no merge is, what belongs to no id. start: for
    each byte and the byte after it (signed; 128: none), at 257 * (byte + 128) + next + 128, its first part in a fold's state."""
    single, base, table = rank_table(name)
    merges = np.where(table < 0, NONE * IDS + NONE, table) * IDS
    a, b = np.roll(single, 128)[:, None], np.append(np.roll(single, 128), len(base) - 1)
    start = merges[base[a] + b] ^ (a * TWICE)
    one = spark.createDataFrame(pa.table([pa.array([x.ravel().tolist()], pa.list_(pa.int64())) for x in (start, base, merges)], names=["start", "bases", "merges"]))
    return one.select(F.struct("start", "bases", "merges")).scalar()


def let(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fold(piece: Column, start: Column, bases: Column, merges: Column, edge: int) -> Column:
    """Ids of a piece (array of signed bytes): the merges as a fold over the array, one for each step; edge: an id that merges with
    nothing.

    The state is an array with one integer for each part, its pair's rank above its id: the least one is the pair to merge. What a looked-up
    merge has of another left id stays above both and makes the integer larger than that of any pair that merges. Every expression in
    here is interpreted once a step, so few of them do the work."""
    low, none, all_ = F.lit(IDS - 1), F.lit(IDS * IDS), F.lit(1 << 20)
    end = F.array(F.lit((IDS * IDS + 1) * edge + IDS**3))

    def pair(a: Column, b: Column) -> Column:
        return merges[bases[a] + b].bitwiseXOR(a * F.lit(TWICE))

    def merged(state: Column, p: Column) -> Column:
        both = F.shiftright(state[p - 1], 16)
        left, right = state[p - 2].bitwiseAND(low), state[p + 1].bitwiseAND(low)
        return F.concat(F.slice(state, F.lit(1), p - 2), F.array(pair(left, both), pair(both, right)), F.slice(state, p + 2, all_))

    def step(state: Column, _: Column) -> Column:
        # a fold over one place binds it to a variable
        place = F.array(F.array_position(state, F.array_min(state)).cast("int"))
        return F.when(F.array_min(state) >= none, state).otherwise(F.aggregate(place, state, merged))

    first = F.zip_with(piece, F.slice(piece, F.lit(2), all_), lambda a, b: start[a * F.lit(257) + F.coalesce(b, F.lit(128)) + F.lit(128 * 258)])
    return F.aggregate(piece, F.concat(end, first, end), step, lambda e: F.transform(F.slice(e, F.lit(2), F.size(e) - 2), lambda x: x.bitwiseAND(low).cast("int")))


class Pieces:
    """Piece codes of texts: an id itself, IDS + number of a frequent piece, or beyond these the number of a piece met before.

    fresh: the pieces that got a number since it was last emptied."""

    def __init__(self, name: str, pattern: str, base: arrays.Store | None = None, first: int = IDS):
        import regex

        self.name, self.find = name, regex.compile(pattern).findall
        self.base, self.first = base or base_codes(name), first
        self.start_over()

    def start_over(self) -> None:
        self.known, self.own, self.fresh, self.met = arrays.Store("<i4", 1 << 40), arrays.Store("<i4", 1 << 40), [], 0

    def number(self, pieces: list[str], text: str) -> np.ndarray:
        """The codes of pieces, which together are text."""
        data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        chars = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ends = np.cumsum(size)
        starts, ends = chars[ends - size], chars[ends]
        hashes = arrays.span_hashes(data, starts, ends)
        one, inverse = arrays.distinct(hashes)
        # pieces that share the hash of another are no hits: each gets a number of its own
        twice = np.flatnonzero(one[inverse] != np.arange(len(hashes)))
        other = one[inverse[twice]]
        same = np.flatnonzero((ends - starts)[twice] == (ends - starts)[other])
        odd = np.ones(len(twice), bool)
        odd[same] = ~arrays.equal_spans(data, starts[twice[same]], data, starts[other[same]], (ends - starts)[twice[same]])
        odd = twice[odd]
        keys = hashes[one]
        codes = np.full(len(keys), -1, np.int64)
        clash = np.zeros(len(keys), bool)
        for store in (self.base, self.own):
            at, there, others = store.find(keys, data, starts[one], ends[one])
            codes[there] = store.flat[store.first[at[there]]]
            clash |= others
        new = np.flatnonzero(codes < 0)
        out = codes[inverse]
        if len(new) or len(odd):
            codes[new] = self.first + self.met + np.arange(len(new))
            out = codes[inverse]
            out[odd] = self.first + self.met + len(new) + np.arange(len(odd))
            self.met += len(new) + len(odd)
            raw = data.tobytes()
            made = np.concatenate((one[new], odd))
            self.fresh += [raw[a:b] for a, b in zip(starts[made].tolist(), ends[made].tolist(), strict=True)]
            new = new[~clash[new]]
            self.own.add(keys[new], codes[new].astype(np.int32), np.ones(len(new), np.int64), data, starts[one[new]], ends[one[new]])
        return out.astype("<i4")

    def codes(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(codes of all texts, number of each)."""
        found = [self.find(x) for x in texts]
        return self.number([x for y in found for x in y], "".join(texts)), np.fromiter(map(len, found), np.int64, len(found))

    def words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes, number of each) of words with the space before them: a piece that begins with a space begins the next word."""
        alone = arrays.WHITE[data[ends - 1]]
        safe = np.flatnonzero(~alone)
        text = arrays.take(data, starts[safe] - 1, ends[safe] - starts[safe] + 1).tobytes().decode("utf-8", "surrogatepass")
        pieces = self.find(text)
        opens = np.flatnonzero(np.fromiter([x[0] == " " for x in pieces], bool, len(pieces)))
        if len(opens) != len(safe):
            raise ValueError("the pattern does not cut before single spaces")
        codes = self.number(pieces, text)
        counts = np.zeros(len(starts), np.int64)
        counts[safe] = np.diff(np.append(opens, len(pieces)))
        rest = np.flatnonzero(alone)
        if not len(rest):
            return codes, counts
        more, counts[rest] = self.codes([data[a - 1 : b].tobytes().decode("utf-8", "surrogatepass") for a, b in zip(starts[rest].tolist(), ends[rest].tolist(), strict=True)])
        out = np.empty(int(counts.sum()), "<i4")
        of_rest = np.repeat(alone, counts)
        out[of_rest], out[~of_rest] = more, codes
        return out, counts

    def of(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(codes of all texts one after the other, number of each); cut before single spaces, where the pattern cuts too."""
        w = arrays.Words(column, arrays.BLANK)
        whole = arrays.split_forbidden(w.data, w.texts)
        n = len(whole)
        text = np.repeat(np.arange(n), np.diff(w.bounds))
        first = w.starts == w.texts[text]
        while True:
            plain = np.flatnonzero(~first & ~whole[text])
            one, number = arrays.distinct(w.hashes[plain])
            one = plain[one]
            keys, a, b = w.hashes[one], w.starts[one], w.ends[one]
            _, there, clash = self.known.find(keys, w.data, a, b)
            # words that share a hash with others: their texts are cut by the pattern alone
            bad = np.concatenate((plain[w.differ(plain, one[number])], plain[clash[number]]))
            if not len(bad):
                break
            whole[text[bad]] = True
        if not there.all():
            new = one[~there]
            self.known.add(keys[~there], *self.words(w.data, w.starts[new], w.ends[new]), w.data, w.starts[new], w.ends[new])
        at, _, _ = self.known.find(keys, w.data, a, b)
        stops = w.texts[:-1].copy()
        at_first = np.flatnonzero(first)
        stops[text[at_first]] = w.ends[at_first]
        stops[whole] = w.texts[1:][whole]
        heads, head_n = self.codes([w.data[a:b].tobytes().decode("utf-8", "surrogatepass") for a, b in zip(w.texts.tolist(), stops.tolist(), strict=False)])
        owner = text[plain]
        spans_first, spans_size = np.empty(n + len(plain), np.int64), np.empty(n + len(plain), np.int64)
        head_at, word_at = np.arange(n) + np.searchsorted(owner, np.arange(n)), np.arange(len(plain)) + owner + 1
        base = self.known.used
        spans_first[head_at], spans_size[head_at] = base + np.cumsum(head_n) - head_n, head_n
        spans_first[word_at], spans_size[word_at] = self.known.first[at][number], self.known.size[at][number]
        codes = arrays.take(np.concatenate((self.known.flat[:base], heads)), spans_first, spans_size)
        return codes, head_n + np.bincount(owner, spans_size[word_at], n).astype(np.int64)

    def column(self) -> pa.Array:
        """The fresh pieces as structs."""
        return structs(self.fresh, self.name)


def structs(pieces: list[bytes], name: str) -> pa.Array:
    """Pieces as structs of bytes, or of ids for those that are long."""
    ranks = load_ranks(name)
    small = [b"" if len(x) > LONG else x for x in pieces]
    stops = np.concatenate(([0], np.cumsum([len(x) for x in small]))).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(stops), pa.array(np.frombuffer(b"".join(small), np.int8), pa.int8()))
    large = pa.array([[ranks[y] for y in merge(x, ranks)] if len(x) > LONG else None for x in pieces], pa.list_(pa.int32()))
    return pa.StructArray.from_arrays([lists, large], names=["bytes", "ids"])


@functools.cache
def base_codes(name: str) -> arrays.Store:
    """The ids of all tokens."""
    ranks = load_ranks(name)
    size = np.fromiter(map(len, ranks), np.int64, len(ranks))
    data, ends = np.frombuffer(b"".join(ranks), np.uint8), np.cumsum(size)
    keys, ids = arrays.span_hashes(data, ends - size, ends), np.array(list(ranks.values()), np.int32)
    order = np.argsort(keys)
    if (keys[order][1:] == keys[order][:-1]).any():
        raise ValueError("two tokens share a hash")
    out = arrays.Store("<i4", 1 << 40)
    out.add(keys[order], ids[order], np.ones(len(ids), np.int64), data, (ends - size)[order], ends[order])
    return out


def with_frequent(name: str, data: np.ndarray, bounds: np.ndarray) -> arrays.Store:
    """base_codes and the codes of frequent pieces, which lie one after the other in data."""
    out = base_codes(name).copy()
    keys = np.zeros(len(bounds) - 1, np.uint64)
    for k in range(0, len(keys), 1 << 16):
        some = bounds[k : k + (1 << 16) + 1]
        keys[k : k + (1 << 16)] = arrays.span_hashes(data[some[0] : some[-1]], some[:-1] - some[0], some[1:] - some[0])
    order = np.unique(keys, return_index=True)[1]  # of pieces that share a hash one is known
    order = order[~out.find(keys[order], data, bounds[order], bounds[order + 1])[2]]
    out.add(keys[order], IDS + order.astype(np.int32), np.ones(len(order), np.int64), data, bounds[order], bounds[order + 1])
    return out


#: What a worker's tasks have in common, by a name of their run; of the last one alone.
_shared: dict[str, arrays.Store] = {}


def shared_codes(run: str, name: str, frequent) -> arrays.Store:
    """with_frequent of a broadcast table, made once in a worker."""
    if run not in _shared:
        _shared.clear()
        _shared[run] = with_frequent(name, *frequent.value)
        common.give_back()
    return _shared[run]


PIECE = "struct<bytes: array<tinyint>, ids: array<int>>"


def with_ids(df: DataFrame, name: str) -> DataFrame:
    """df (with a column pieces, arrays of pieces) with the ids of each instead."""
    edge = len(rank_table(name)[1]) - 1
    rest = [F.col(c) for c in df.columns if c != "pieces"]

    def of(start: Column, bases: Column, merges: Column) -> Column:
        return F.transform("pieces", lambda x: F.when(x["ids"].isNotNull(), x["ids"]).otherwise(fold(x["bytes"], start, bases, merges, edge)))

    # each array is bound to a variable once a row
    ids = let(F.col("map.start"), lambda start: let(F.col("map.bases"), lambda bases: let(F.col("map.merges"), lambda merges: of(start, bases, merges))))
    return df.withColumn("map", constant_tables(df.sparkSession, name)).select(*rest, ids.alias("ids"))


def frequent_pieces(df: DataFrame, name: str, sample: int = SAMPLE, most: int = FREQUENT):
    """The pieces that come most often in a bounded sample of the rows, one after the other, with their bounds, their ids one after the
    other, and the number of each's."""
    import public_tokenizers

    pattern, n = public_tokenizers.PATTERN, df.count()
    if n <= sample:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64), np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, count = Pieces(name, pattern), np.zeros(0, np.int64)
        for batch in common.slices(batches, "text", SLICE_BYTES):
            codes, _ = p.of(batch.column("text"))
            more = np.bincount(codes, minlength=IDS + p.met)[IDS:]
            more[: len(count)] += count
            count = more
            if p.met > MET:
                yield pa.RecordBatch.from_arrays([pa.array(p.fresh, pa.binary()), pa.array(count, pa.int64())], names=["piece", "n"])
                p.start_over()
                count = np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(p.fresh, pa.binary()), pa.array(count, pa.int64())], names=["piece", "n"])

    some = df.select("text").sample(sample / n, 3)  # of rows, not texts: copies are drawn one by one
    counts = some.mapInArrow(run, "piece binary, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    top = counts.orderBy(F.desc("n"), "piece").limit(most).select("piece").repartition(max(8, df.sparkSession.sparkContext.defaultParallelism))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bounds, piece = pa.array([0, batch.num_rows], pa.int32()), batch.column("piece")
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(bounds, x) for x in (piece, structs(piece.to_pylist(), name))], names=["piece", "pieces"])

    found = with_ids(top.mapInArrow(packed, f"piece array<binary>, pieces array<{PIECE}>"), name).toArrow()
    data, bounds = arrays.raw(found.column("piece").combine_chunks().flatten())
    ids = found.column("ids").combine_chunks().flatten()
    return data, bounds, np.asarray(ids.flatten(), np.uint32), np.asarray(ids.value_lengths(), np.int64)


def blocks(df: DataFrame, name: str, frequent, block_bytes: int = BLOCK_BYTES, most_met: int = MET) -> DataFrame:
    """One row a block: its rows (Arrow IPC) with each text's piece codes, and the pieces first met in it.

    Numbers of pieces go on from block to block of a partition, until more than most_met are met; before tells how many there were."""
    import public_tokenizers

    pattern, key, n_frequent = public_tokenizers.PATTERN, uuid.uuid4().hex, len(frequent.value[1]) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = Pieces(name, pattern, shared_codes(key, name, frequent), IDS + n_frequent)
        for batch in common.slices(batches, "text", block_bytes):
            if p.met > most_met:
                p.start_over()
            before, p.fresh = p.met, []
            sink = pa.BufferOutputStream()
            writer = None
            for part in common.slices([batch], "text", SLICE_BYTES):
                codes, n = p.of(part.column("text"))
                stops = np.concatenate(([0], np.cumsum(n))).astype(np.int32)
                rest = part.drop_columns(["text"])
                # the codes come last, whatever the names of other columns
                rest = pa.RecordBatch.from_arrays([*rest.columns, pa.ListArray.from_arrays(pa.array(stops), pa.array(codes))], names=[*rest.schema.names, "codes of pieces"])
                writer = writer or pa.ipc.new_stream(sink, rest.schema)
                writer.write_batch(rest)
            writer.close()
            yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary()), pa.array([before], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(p.fresh)], pa.int32()), p.column())], names=["rest", "before", "pieces"])
        del p
        common.give_back()  # a worker that waits for its next task keeps what it shares

    return df.mapInArrow(run, f"rest binary, before long, pieces array<{PIECE}>")


def encode(df: DataFrame, name: str = "byte_bpe_50k.tiktoken", finish: tuple | None = None, sample: int = SAMPLE, block_bytes: int = BLOCK_BYTES, most_met: int = MET) -> DataFrame:
    """df (with a column text) without text, with ids binary: each text's ids as little-endian unsigned 32-bit integers.

    finish: instead, (columns' schema, function of the ids of many texts and their numbers to lists of values), for what needs no
    ids afterwards."""
    added = T._parse_datatype_string(finish[0] if finish else "ids binary")
    make = finish[1] if finish else lambda ids, n: [cut(ids, n)]
    df = df.drop(*[f.name for f in added])
    schema = T.StructType([*df.drop("text").schema.fields, *added.fields])
    kinds = [{"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}[f.dataType.simpleString()] for f in added]
    common.tidy(df.sparkSession)
    found, broadcast = frequent_pieces(df, name, sample), df.sparkSession.sparkContext.broadcast
    frequent, their_ids = broadcast(found[:2]), broadcast(found[2:])  # FREQUENT pieces at most
    del found
    coded = with_ids(blocks(df, name, frequent, block_bytes, most_met), name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, sizes = their_ids.value
        # lists of ids as byte strings, four bytes an id
        head = arrays.strings(np.append(np.arange(IDS, dtype=np.uint32), made), 4 * np.append(np.ones(IDS, np.int64), sizes))
        known = head
        for batch in batches:
            for k in range(batch.num_rows):
                # a task's rows come in order, so what earlier blocks met is here
                if batch.column("before")[k].as_py() == 0:
                    known = head
                lists = batch.column("ids").slice(k, 1).flatten()
                known = pa.concat_arrays([known, arrays.strings(np.asarray(lists.flatten(), np.uint32), 4 * np.asarray(lists.value_lengths(), np.int64))])
                for rest in pa.ipc.open_stream(batch.column("rest")[k].as_py()):
                    codes = rest.column(rest.num_columns - 1)
                    ids, stops = arrays.chosen(known, codes.flatten(), np.asarray(codes.value_lengths(), np.int64))
                    ids, n = ids.view(np.uint32), np.diff(stops) // 4
                    found = make(ids, n)
                    yield pa.RecordBatch.from_arrays([*rest.columns[:-1], *[pa.array(x, kind) for x, kind in zip(found, kinds, strict=True)]], names=[f.name for f in schema])
        common.give_back()

    return coded.mapInArrow(run, schema)


def cut(ids: np.ndarray, n: np.ndarray) -> list[bytes]:
    """The ids of each text as little-endian unsigned 32-bit integers."""
    raw, stops = ids.astype("<u4").tobytes(), (4 * np.cumsum([0, *n])).tolist()
    return [raw[a:b] for a, b in zip(stops, stops[1:], strict=False)]


@functools.cache
def token_bytes(name: str) -> pa.Array:
    """The byte strings of all ids."""
    out = [b""] * IDS
    for token, rank in load_ranks(name).items():
        out[rank] = token
    return pa.array(out, pa.large_binary())


def decode_ids(ids: np.ndarray, n: np.ndarray, name: str) -> list[bytes]:
    """The byte strings of each text's ids, concatenated."""
    data, stops = arrays.chosen(token_bytes(name), pa.array(ids), n)
    raw, stops = data.data, stops.tolist()
    return [bytes(raw[a:b]) for a, b in zip(stops, stops[1:], strict=False)]


def decode(df: DataFrame, ids: str = "ids", out: str = "decoded", name: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """df with column out (binary): the bytes that ids (little-endian unsigned 32-bit integers; null: none) stand for."""
    df = df.drop(out)
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.BinaryType())])

    def run(batches):
        for batch in batches:
            raw = [x or b"" for x in batch.column(ids).to_pylist()]
            found = decode_ids(np.frombuffer(b"".join(raw), "<u4"), np.array([len(x) // 4 for x in raw], np.int64), name)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.binary())], names=[f.name for f in schema])

    return df.mapInArrow(run, schema)


DIGESTS = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def digests(ids: np.ndarray, n: np.ndarray, name: str) -> list:
    """Lengths, digests of the decimal ids, and digests of the bytes they decode to."""
    data, stops = arrays.chosen(decimals(), pa.array(ids), n)
    raw, stops = data.data, stops.tolist()
    # but for the space after a text's last id
    return [n, [hashlib.sha256(raw[a : max(a, b - 1)]).hexdigest() for a, b in zip(stops, stops[1:], strict=False)], [hashlib.sha256(x).hexdigest() for x in decode_ids(ids, n, name)]]


@functools.cache
def decimals() -> pa.Array:
    """All ids as decimal numbers with a space behind each."""
    return pa.array([b"%d " % x for x in range(IDS)], pa.large_binary())


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of documents encoded by the ranks, and decoded again; digests of both."""
    name = "byte_bpe_50k.tiktoken"
    docs = common.only(common.table(spark, sf_dir, "documents"), "doc_id", "text")
    return encode(docs, name, (DIGESTS, lambda ids, n: digests(ids, n, name)))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every document's ids and their number instead of its text."""
    return encode(docs, finish=("ids binary, n_tokens long", lambda ids, n: [cut(ids, n), n]))
