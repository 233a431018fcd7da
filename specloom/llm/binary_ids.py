"""Operator 2, token-ID output as directly addressable codes.

An id sequence is split into levels of ``width`` bits. Level 0 holds the low bits of every id and a continuation bitmap that tells
which ids go on; level 1 holds the next bits of those ids alone, and so on. The rank directory of each bitmap (ones before each
block of 512 bits) leads from a position in one level to the position in the next, so any id is read without decoding others.

A file row holds one block: ``doc_id`` and ``n_tokens`` of its documents in ascending doc_id order, and ``codes``, the levels
of all their ids one after the other. ``write`` range-partitions the texts by doc_id, encodes each partition in that order and
writes blocks of bounded size with their partition and number; ``read`` decodes whole blocks; ``access`` reads single ids.

Defined results: a null or empty text has the end id alone; rows with equal doc_id are neighbours in a defined order (by text); a
null doc_id comes first. Texts are encoded whole.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import arrays, common

END = 0  # the id appended to each document
WIDTH = 8  # bits of an id in each level
RANK_BITS = 512  # bits of a bitmap between entries of its rank directory
BLOCK_BYTES = 4 << 20  # UTF-8 bytes of text in a block; one longer text makes a block of its own
CACHED = 3_000_000  # words whose ids a worker remembers, some 30 bytes each

JOINED = 400  # words in a text for the library

BLOCK = "first_id long, doc_id array<long>, n_tokens array<long>, n_ids long, codes binary"


def pack(ids: np.ndarray, width: int = WIDTH) -> bytes:
    """Directly addressable codes of ids (non-negative integers)."""
    ids = np.asarray(ids)
    rest, levels = ids.astype(np.uint32 if ids.max(initial=0) < 1 << 32 else np.uint64), []
    while True:
        low, high = rest & rest.dtype.type((1 << width) - 1), rest >> rest.dtype.type(width)
        more = high > 0
        bits = np.packbits(more, bitorder="little")
        bits = np.concatenate((bits, np.zeros(-len(bits) % (RANK_BITS // 8), np.uint8)))
        ones = np.bitwise_count(bits).reshape(-1, RANK_BITS // 8).sum(1, dtype=np.int64)
        ranks = np.concatenate(([0], np.cumsum(ones)[:-1])) if len(ones) else ones
        chunks = low.astype(np.uint8 if width <= 8 else np.uint16)
        levels.append((len(rest), chunks.tobytes(), bits.tobytes(), ranks.astype("<u4").tobytes()))
        rest = high[more]
        if not len(rest):
            break
    head = struct.pack("<4sBB", b"DAC1", width, len(levels)) + b"".join(struct.pack("<IIII", n, len(c), len(b), len(r)) for n, c, b, r in levels)
    return head + b"".join(x for level in levels for x in level[1:])


class Codes:
    """Access to packed ids."""

    def __init__(self, data: bytes):
        magic, self.width, n = struct.unpack_from("<4sBB", data)
        if magic != b"DAC1":
            raise ValueError("not directly addressable codes")
        at, self.levels = 6 + 16 * n, []
        for i in range(n):
            size, c, b, r = struct.unpack_from("<IIII", data, 6 + 16 * i)
            kind = np.uint8 if self.width <= 8 else np.uint16
            self.levels.append((size, np.frombuffer(data, kind, size, at), np.frombuffer(data, np.uint8, b, at + c), np.frombuffer(data, "<u4", r // 4, at + c + b)))
            at += c + b + r

    def __len__(self) -> int:
        return self.levels[0][0]

    def __getitem__(self, i: int) -> int:
        """The id at one place: a chunk, a bit and a rank in each level it goes through."""
        if not 0 <= i < len(self):
            raise IndexError(i)
        value = 0
        for level, (_, chunks, bits, ranks) in enumerate(self.levels):
            value |= int(chunks[i]) << (self.width * level)
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            block = i // RANK_BITS
            inner = bits[block * RANK_BITS // 8 : i >> 3]
            i = int(ranks[block]) + int(np.bitwise_count(inner).sum()) + int(bits[i >> 3] & ((1 << (i & 7)) - 1)).bit_count()
        return value

    def all(self) -> np.ndarray:
        out = None
        for _, chunks, bits, _ in reversed(self.levels):
            low = chunks.astype(np.uint32)
            if out is not None:
                more = np.unpackbits(bits, count=len(low), bitorder="little").astype(bool)
                low[more] |= out << np.uint32(self.width)
            out = low
        return out


class Encoder:
    """Ids of texts by the tokenizers library; it encodes each distinct word once while the worker remembers it."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True  # their strings in a text are ordinary text
        self.known = arrays.Store("<u4", CACHED)  # by the hash of a word with a space before it
        vocab = self.model.get_vocab()
        self.opens = np.zeros(max(vocab.values()) + 1, bool)  # ids of tokens that begin with a space
        self.opens[[i for t, i in vocab.items() if t.startswith("\u0120")]] = True

    def ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, "<u4").tobytes() for x in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        raw = self.ids(texts)
        return np.frombuffer(b"".join(raw), "<u4"), np.fromiter(map(len, raw), np.int64, len(raw)) // 4

    def words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of each) of the words at these places, with the space before each.

        JOINED words make a text for the library: a token that begins with a space begins the next word. Where the numbers don't
        agree, and for words that end in white space, each is encoded alone."""
        alone = arrays.WHITE[data[ends - 1]]
        safe = np.flatnonzero(~alone)
        size = ends[safe] - starts[safe] + 1
        joined = arrays.take(data, starts[safe] - 1, size).tobytes()
        stops = np.concatenate(([0], np.cumsum(size)))[::JOINED].tolist()
        stops += [len(joined)] * (stops[-1] != len(joined))
        ids, each = self.flat([joined[a:b].decode("utf-8", "surrogatepass") for a, b in zip(stops, stops[1:], strict=False)])
        opens = self.opens[ids]
        made = arrays.sums(opens.astype(np.int64), np.concatenate(([0], np.cumsum(each))))
        asked = np.diff(np.append(np.arange(0, len(safe), JOINED), len(safe)))
        begins = opens[np.cumsum(each) - each] if len(each) else np.zeros(0, bool)
        good = (made == asked) & begins
        counts = np.zeros(len(starts), np.int64)
        right = np.repeat(good, asked)
        alone[safe[~right]] = True
        kept = np.repeat(good, each)
        ids = ids[kept]
        at = np.flatnonzero(opens[kept])
        counts[safe[right]] = np.diff(np.append(at, len(ids)))
        rest = np.flatnonzero(alone)
        if not len(rest):
            return ids, counts
        more, n = self.flat([data[a - 1 : b].tobytes().decode("utf-8", "surrogatepass") for a, b in zip(starts[rest].tolist(), ends[rest].tolist(), strict=True)])
        counts[rest] = n
        out = np.empty(int(counts.sum()), "<u4")
        of_rest = np.repeat(alone, counts)
        out[of_rest], out[~of_rest] = more, ids
        return out, counts

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, number of ids of each).

        Texts are cut before single spaces, where the pre-tokenizer cuts too; texts with other white space beside a space go to the
        library whole, and so does the first word of each text, which has no space before it."""
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
            at, there, clash = self.known.find(keys, w.data, a, b)
            # words that share a hash with others: their texts go to the library whole
            bad = np.concatenate((plain[w.differ(plain, one[number])], plain[clash[number]]))
            if not len(bad):
                break
            whole[text[bad]] = True
        if not there.all():
            if len(self.known.keys) + len(keys) > CACHED:
                self.known.clear()
                there[:] = False
            new = one[~there]
            self.known.add(keys[~there], *self.words(w.data, w.starts[new], w.ends[new]), w.data, w.starts[new], w.ends[new])
            at, there, _ = self.known.find(keys, w.data, a, b)
        assert there.all()
        # what each text begins with: its first word, or all of it
        stops = w.texts[:-1].copy()
        at_first = np.flatnonzero(first)
        stops[text[at_first]] = w.ends[at_first]
        stops[whole] = w.texts[1:][whole]
        heads, head_n = self.flat([w.data[a:b].tobytes().decode("utf-8", "surrogatepass") for a, b in zip(w.texts.tolist(), stops.tolist(), strict=False)])
        # the lists in order: each text's head, then its words
        owner = text[plain]
        spans_first, spans_size = np.empty(n + len(plain), np.int64), np.empty(n + len(plain), np.int64)
        head_at, word_at = np.arange(n) + np.searchsorted(owner, np.arange(n)), np.arange(len(plain)) + owner + 1
        base = self.known.used
        spans_first[head_at], spans_size[head_at] = base + np.cumsum(head_n) - head_n, head_n
        spans_first[word_at], spans_size[word_at] = self.known.first[at][number], self.known.size[at][number]
        ids = arrays.take(np.concatenate((self.known.flat[:base], heads)), spans_first, spans_size)
        return ids, head_n + np.bincount(owner, spans_size[word_at], n).astype(np.int64)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def write(docs: DataFrame, path: str, tokenizer: str = "byte_bpe_50k.json", end: int = END, width: int = WIDTH) -> None:
    """Encode docs (doc_id, text) and write their ids to path in ascending doc_id order, end after each document."""
    from pyspark.sql import types as T

    ordered = common.only(docs, "doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = encoder(tokenizer_path(tokenizer))
        for batch in common.slices(batches, "text", BLOCK_BYTES):
            ids, counts = work.encode(batch.column("text"))
            ids = np.insert(ids, np.cumsum(counts), end)
            counts = counts + 1
            doc = batch.column("doc_id")
            yield pa.RecordBatch.from_arrays(
                [doc.slice(0, 1), pa.array([doc.to_pylist()], pa.list_(pa.int64())), pa.array([counts.tolist()], pa.list_(pa.int64())), pa.array([len(ids)], pa.int64()), pa.array([pack(ids, width)], pa.binary())],
                names=["first_id", "doc_id", "n_tokens", "n_ids", "codes"],
            )

    blocks = ordered.mapInArrow(run, T._parse_datatype_string(BLOCK))
    # the partition number and the place in it stay with the block whatever file it is in
    blocks.withColumn("at", F.monotonically_increasing_id()).write.option("compression", "zstd").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Every document from the files: doc_id, block (at), place, n_tokens, ids_crc32, and ids as little-endian 32-bit integers."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids = Codes(row["codes"]).all().astype("<u4")
                stops = np.cumsum([0, *row["n_tokens"]])
                raw = [ids[a:b].tobytes() for a, b in zip(stops, stops[1:], strict=False)]
                n = len(raw)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_id"], pa.int64()), pa.array([row["at"]] * n, pa.int64()), pa.array(stops[:-1], pa.int64()), pa.array(row["n_tokens"], pa.int64()), pa.array([zlib.crc32(x) for x in raw], pa.int64()), pa.array(raw, pa.binary())],
                    names=["doc_id", "at", "place", "n_tokens", "ids_crc32", "ids"],
                )

    return spark.read.parquet(path).select("at", "doc_id", "n_tokens", "codes").mapInArrow(run, "doc_id long, at long, place long, n_tokens long, ids_crc32 long, ids binary")


def starts(spark: SparkSession, path: str) -> DataFrame:
    """Ids before each block: at, before. Two levels: within the partitions of the writer, and over these partitions."""
    sizes = spark.read.parquet(path).select("at", "n_ids").withColumn("part", F.shiftright("at", 33))
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("ids"))
    parts = parts.select("part", F.coalesce(F.sum("ids").over(Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    inside = F.sum("n_ids").over(Window.partitionBy("part").orderBy("at").rowsBetween(Window.unboundedPreceding, -1))
    return sizes.withColumn("inside", F.coalesce(inside, F.lit(0))).join(parts, "part").select("at", (F.col("ahead") + F.col("inside")).alias("before"))


def access(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """wanted (doc_id, place) with column id: the id at that place of that document, null beyond its end. Blocks aren't decoded."""

    def run(batches):
        for batch in batches:
            rows = batch.to_pylist()
            ids = [None if r["i"] is None else Codes(r["codes"])[r["i"]] for r in rows]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("place"), pa.array(ids, pa.int64())], names=["doc_id", "place", "id"])

    blocks = spark.read.parquet(path)
    heads = blocks.select("at", F.posexplode("doc_id").alias("k", "found"), "n_tokens")
    heads = heads.select("at", "found", F.get("n_tokens", F.col("k")).alias("n"), F.aggregate(F.slice("n_tokens", F.lit(1), F.col("k")), F.lit(0).cast("long"), lambda a, b: a + b).alias("skip"))
    at = wanted.select("doc_id", "place").join(heads, F.col("doc_id") == F.col("found"), "left")
    at = at.withColumn("i", F.when((F.col("place") >= 0) & (F.col("place") < F.col("n")), F.col("skip") + F.col("place")))
    return at.select("doc_id", "place", "i", "at").join(blocks.select("at", "codes"), "at", "left").select("doc_id", "place", "i", "codes").mapInArrow(run, "doc_id long, place long, id long")


def op2_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded, written as directly addressable codes in doc_id order, and read back."""
    path = common.new_path(spark, "ids")
    write(common.table(spark, sf_dir, "documents"), path)
    found = read(spark, path).select("doc_id", "at", "place", "n_tokens", "ids_crc32")
    return found.join(starts(spark, path), "at").select("doc_id", (F.col("before") + F.col("place")).alias("start"), "n_tokens", "ids_crc32")
