"""Operator 10, media columns: ISO base media files written, walked and described without decoding samples.

``to_media`` stores a byte payload as 8-bit PCM audio in an ISO container; ``probe_media`` walks the nested boxes of any such
file, decodes the sample tables and reports codec, duration and the byte ranges of the key (sync) samples.
Nulls count as empty payloads; an unreadable container gives a null description. Rows with equal payloads have equal files.
"""

from __future__ import annotations

import hashlib
import itertools
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SAMPLE_BYTES = 64  # one media sample: 64 8-bit values
RATE = 8000  # values a second
PER_CHUNK = 1024  # samples in a chunk
SYNC_EVERY = 256  # every so many samples one is a sync sample

#: Boxes that hold boxes, and how many bytes precede the first of them.
CONTAINERS = {b"moov": 0, b"trak": 0, b"mdia": 0, b"minf": 0, b"stbl": 0, b"dinf": 0, b"edts": 0, b"udta": 0}


DEEPEST = 16  # box types of a path that are told


def box(kind: bytes, *parts: bytes) -> bytes:
    n = 8 + sum(map(len, parts))
    if n < 1 << 32:
        return b"".join((struct.pack(">I4s", n, kind), *parts))
    return b"".join((struct.pack(">I4sQ", 1, kind, n + 8), *parts))


def full(kind: bytes, flags: int, *parts: bytes) -> bytes:
    return box(kind, struct.pack(">I", flags), *parts)


def padded(data: bytes) -> bytes:
    """data with bytes 0 appended up to a positive multiple of SAMPLE_BYTES."""
    return data + bytes(-len(data) % SAMPLE_BYTES or (0 if data else SAMPLE_BYTES))


def build(payload: bytes) -> bytes:
    """An ISO file of one 8-bit PCM track whose samples are the payload in order."""
    n = len(payload) // SAMPLE_BYTES
    chunks = -(-n // PER_CHUNK)
    ftyp = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2mp41")
    unity = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    entry = box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHHHI", 1, 8, 0, 0, (RATE << 16) & 0xFFFFFFFF))
    runs = [(1, PER_CHUNK)] if n >= PER_CHUNK else []
    if n % PER_CHUNK:
        runs.append((chunks, n % PER_CHUNK))
    sync = range(1, n + 1, SYNC_EVERY)

    def moov(base: int) -> bytes:
        offsets = [base + i * PER_CHUNK * SAMPLE_BYTES for i in range(chunks)]
        large = offsets[-1] >= 1 << 32
        stbl = box(
            b"stbl",
            full(b"stsd", 0, struct.pack(">I", 1), entry),
            full(b"stts", 0, struct.pack(">III", 1, n, SAMPLE_BYTES)),
            full(b"stss", 0, struct.pack(f">I{len(sync)}I", len(sync), *sync)),
            full(b"stsc", 0, struct.pack(">I", len(runs)), *(struct.pack(">III", a, k, 1) for a, k in runs)),
            full(b"stsz", 0, struct.pack(">II", SAMPLE_BYTES, n)),
            full(b"co64" if large else b"stco", 0, struct.pack(f">I{chunks}{'Q' if large else 'I'}", chunks, *offsets)),
        )
        dref = full(b"dref", 0, struct.pack(">I", 1), full(b"url ", 1))
        minf = box(b"minf", full(b"smhd", 0, bytes(4)), box(b"dinf", dref), stbl)
        length = len(payload)
        mdhd = full(b"mdhd", 0, struct.pack(">IIIIHH", 0, 0, RATE, min(length, 0xFFFFFFFF), 0x55C4, 0))
        hdlr = full(b"hdlr", 0, bytes(4), b"soun", bytes(12), b"sound\0")
        tkhd = full(b"tkhd", 7, struct.pack(">IIIII", 0, 0, 1, 0, min(length, 0xFFFFFFFF)), bytes(8), struct.pack(">HHHH", 0, 0, 0x100, 0), unity, bytes(8))
        mvhd = full(b"mvhd", 0, struct.pack(">IIIIIH", 0, 0, RATE, min(length, 0xFFFFFFFF), 0x10000, 0x100), bytes(10), unity, bytes(24), struct.pack(">I", 2))
        return box(b"moov", mvhd, box(b"trak", tkhd, box(b"mdia", mdhd, hdlr, minf)))

    head = 16 if len(payload) + 8 >= 1 << 32 else 8
    first = moov(0)
    base = len(ftyp) + len(first) + head
    real = moov(base)
    if len(real) != len(first):  # 64-bit offsets made it longer
        real = moov(len(ftyp) + len(real) + head)
    return b"".join((ftyp, real, box(b"mdat", payload)))


def walk(data: bytes, start: int = 0, end: int | None = None) -> Iterator[tuple[tuple, int, int]]:
    """(path of box types, first byte of the content, end) of every box, parents first. The path of boxes nested deeper than DEEPEST
    is cut to the outermost ones; a stack holds the open ones, so depth costs no recursion."""
    open_: list[tuple[int, int, tuple]] = [(start, len(data) if end is None else end, ())]
    while open_:
        start, end, path = open_.pop()
        if start + 8 > end:
            continue
        n, kind = struct.unpack_from(">I4s", data, start)
        head = 8
        if n == 1:
            n, head = struct.unpack_from(">Q", data, start + 8)[0], 16
        elif n == 0:
            n = end - start
        if n < head or start + n > end:
            raise ValueError(f"box {kind!r} at {start} passes its parent's end")
        inner = (*path, kind)
        yield inner, start + head, start + n
        open_.append((start + n, end, path))
        if kind in CONTAINERS:
            open_.append((start + head + CONTAINERS[kind], start + n, inner[:DEEPEST]))


def tracks(data: bytes) -> list[dict]:
    """One description for each track: codec, timescale, duration, samples and their byte ranges by the sample tables."""
    found: list[dict] = []
    for path, a, b in walk(data):
        kind = path[-1]
        if kind == b"trak":
            found.append({"codec": "", "timescale": 0, "duration": 0, "handler": "", "sync": None})
        if path[:2] != (b"moov", b"trak") or not found:
            continue
        t = found[-1]
        if kind == b"mdhd":
            wide = data[a] == 1
            t["timescale"], t["duration"] = struct.unpack_from(">IQ" if wide else ">II", data, a + (20 if wide else 12))
        elif kind == b"hdlr":
            t["handler"] = data[a + 8 : a + 12].decode("latin-1")
        elif kind == b"stsd":
            t["codec"] = data[a + 12 : a + 16].decode("latin-1")
        elif kind == b"stsz":
            fixed, n = struct.unpack_from(">II", data, a + 4)
            t["sizes"] = (fixed, n, (0,) if fixed else (0, *itertools.accumulate(struct.unpack_from(f">{n}I", data, a + 12))))
        elif kind in (b"stco", b"co64"):
            n = struct.unpack_from(">I", data, a + 4)[0]
            t["chunks"] = struct.unpack_from(f">{n}{'I' if kind == b'stco' else 'Q'}", data, a + 8)
        elif kind == b"stsc":
            n = struct.unpack_from(">I", data, a + 4)[0]
            t["runs"] = [struct.unpack_from(">III", data, a + 8 + 12 * i)[:2] for i in range(n)]
        elif kind == b"stss":
            n = struct.unpack_from(">I", data, a + 4)[0]
            t["sync"] = struct.unpack_from(f">{n}I", data, a + 8)
    return found


def chunk_ranges(track: dict) -> list[tuple[int, int, int]]:
    """(first sample, number of samples, byte offset) of each chunk."""
    out, sample, runs = [], 0, track["runs"]
    for i, offset in enumerate(track["chunks"], 1):
        while len(runs) > 1 and runs[1][0] <= i:
            runs = runs[1:]
        out.append((sample, runs[0][1], offset))
        sample += runs[0][1]
    return out


def sample_bytes(track: dict, first: int, count: int) -> int:
    fixed, n, before = track["sizes"]
    return fixed * count if fixed else before[min(n, first + count)] - before[min(n, first)]


def read_payload(data: bytes) -> bytes:
    """All samples of the first track, in order, found by its tables."""
    t = tracks(data)[0]
    return b"".join(data[o : o + sample_bytes(t, s, n)] for s, n, o in chunk_ranges(t))


def key_ranges(track: dict) -> list[tuple[int, int]]:
    """(offset, length) of each sync sample; all samples are sync samples if the file lists none."""
    chunks = chunk_ranges(track)
    wanted = iter(track["sync"] if track["sync"] is not None else range(1, track["sizes"][1] + 1))
    out, s = [], next(wanted, None)
    for first, n, offset in chunks:
        while s is not None and s - 1 < first + n:
            out.append((offset + sample_bytes(track, first, s - 1 - first), sample_bytes(track, s - 1, 1)))
            s = next(wanted, None)
    return out


def describe(data: bytes) -> str:
    """codec, handler, duration in ms, samples, sync samples, and a digest of the sync samples' byte ranges."""
    parts = []
    for t in tracks(data):
        keys = key_ranges(t)
        digest = zlib.crc32(repr(keys).encode())
        first = "-".join(map(str, keys[0])) if keys else ""
        parts.append(f"codec={t['codec'].strip()};handler={t['handler']};ms={t['duration'] * 1000 // max(1, t['timescale'])};samples={t['sizes'][1]};keys={len(keys)};first_key={first};keys_crc32={digest}")
    return "|".join(parts)


def to_media(df: DataFrame, payload: str = "payload", out: str = "media") -> DataFrame:
    """Adds column out: each row's payload (binary, null as empty), padded and stored as an ISO file."""
    schema = df.drop(out).schema.add(out, "binary")
    names = [f.name for f in schema][:-1]

    def run(batches):
        for batch in common.slices(batches, payload, 16 << 20):
            files = pa.array([build(padded(x or b"")) for x in batch.column(payload).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], files], names=[*names, out])

    return df.drop(out).mapInArrow(run, schema)


PROBE = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, key_ranges array<struct<offset:long,length:long>>"


def probe_media(df: DataFrame, media: str = "media", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns and what the stored bytes show: digests of the samples read back, of the file, and its description.

    A null or unreadable file gives nulls."""
    from pyspark.sql import types as T

    kept = df.select(*keep, media)
    schema = T.StructType([*df.select(*keep).schema.fields, *T._parse_datatype_string(PROBE).fields])

    def one(data: bytes | None):
        try:
            payload = read_payload(data)
            keys = [{"offset": o, "length": n} for t in tracks(data) for o, n in key_ranges(t)]
            return (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-SAMPLE_BYTES:]), len(data), hashlib.sha256(data).hexdigest(), describe(data), keys)
        except (TypeError, ValueError, IndexError, KeyError, struct.error):
            return (None,) * 7

    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64())]))]

    def run(batches):
        for batch in common.slices(batches, media, 16 << 20):
            rows = list(zip(*map(one, batch.column(media).to_pylist()), strict=True))
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in keep], *[pa.array(x, k) for x, k in zip(rows, kinds, strict=True)]], names=[f.name for f in schema])

    return kept.mapInArrow(run, schema)


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of documents as an ISO media file, read back. See the module for nulls and broken files."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("payload"))
    docs = docs.withColumn("n_bytes", F.length("payload").cast("long"))
    return probe_media(to_media(docs), keep=("doc_id", "n_bytes")).drop("key_ranges")
