"""Texts of an Arrow string column as arrays: word bounds, 64-bit word hashes, and gathers by word, without Python strings."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

U = np.uint64
MULTIPLIER = U(0x9E3779B97F4A7C15)
INVERSE = U(pow(int(MULTIPLIER), -1, 1 << 64))

#: Space and \t \n \v \f \r.
WHITE = np.zeros(256, bool)
WHITE[[32, 9, 10, 11, 12, 13]] = True
#: Space alone.
BLANK = np.zeros(256, bool)
BLANK[32] = True
#: A-Z to a-z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: dict[str, np.ndarray] = {}


def powers(kind: str, n: int) -> np.ndarray:
    """The first n powers of the multiplier ('up') or of its inverse ('down'), modulo 2**64."""
    have = _powers.get(kind)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 20), MULTIPLIER if kind == "up" else INVERSE)
        steps[0] = 1
        _powers[kind] = have = np.multiply.accumulate(steps)
    return have[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (splitmix64)."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)  # in place: fewer arrays pass through memory
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes of all texts, bounds of each text in them); nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pa.compute.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bounds = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[bounds[0] : bounds[-1]], bounds - bounds[0]


#: Bytes of a span that are hashed and compared eight at a time; longer spans go as wholes.
EIGHTS = 64
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as an integer (beyond the end: 0)."""
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    return np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of byte spans: equal spans have equal hashes wherever they are. Eight bytes at a time are mixed in; beyond EIGHTS bytes
    a span's hash is its BLAKE2 digest."""
    size = ends - starts
    out = mixed(size.astype(np.uint64) + MULTIPLIER)
    view, at = eights(data), np.flatnonzero(size <= EIGHTS)
    for k in range(0, EIGHTS, 8):
        at = at[size[at] > k]
        if not len(at):
            break
        out[at] = mixed((out[at] ^ (view[starts[at] + k] & _MASK[np.minimum(size[at] - k, 8)])) * MULTIPLIER + U(k))
    for i in np.flatnonzero(size > EIGHTS).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].data, digest_size=8).digest(), "little")
    return out


def equal_spans(a: np.ndarray, a_first: np.ndarray, b: np.ndarray, b_first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether size bytes of a and b from these places on are the same."""
    out = np.ones(len(size), bool)
    va, vb, at = eights(a), eights(b), np.flatnonzero(size <= EIGHTS)
    for k in range(0, EIGHTS, 8):
        at = at[size[at] > k]
        if not len(at):
            break
        out[at] &= ((va[a_first[at] + k] ^ vb[b_first[at] + k]) & _MASK[np.minimum(size[at] - k, 8)]) == 0
    for i in np.flatnonzero(size > EIGHTS).tolist():
        n = int(size[i])
        out[i] = np.array_equal(a[a_first[i] : a_first[i] + n], b[b_first[i] : b_first[i] + n])
    return out


class Words:
    """starts and ends of all words in the bytes, hashes (if asked for) and bounds: the words of text i are bounds[i]:bounds[i + 1]."""

    def __init__(self, column: pa.Array, white: np.ndarray = WHITE, lower: bool = False, hashes: bool = True):
        self.data, self.texts = raw(column)
        if lower:
            self.data = LOWER[self.data]
        n = len(self.data)
        blank = white[self.data]
        before, after = np.ones(n, bool), np.ones(n, bool)
        before[1:], after[:-1] = blank[:-1], blank[1:]
        full = self.texts[1:] > self.texts[:-1]
        before[self.texts[:-1][full]] = True
        after[self.texts[1:][full] - 1] = True
        solid = ~blank
        self.starts = np.flatnonzero(solid & before)
        self.ends = np.flatnonzero(solid & after) + 1
        self.bounds = np.searchsorted(self.starts, self.texts)
        if hashes:
            self.hashes = span_hashes(self.data, self.starts, self.ends)
            self.heads = eights(self.data)[self.starts] & _MASK[np.minimum(self.ends - self.starts, 8)]

    def differ(self, some: np.ndarray, others: np.ndarray) -> np.ndarray:
        """Whether the bytes of some words are not those of others."""
        size = self.ends - self.starts
        same = (size[some] == size[others]) & (self.heads[some] == self.heads[others])
        at = np.flatnonzero(same & (size[some] > 8) & (some != others))
        same[at] = equal_spans(self.data, self.starts[some[at]], self.data, self.starts[others[at]], size[some[at]])
        return ~same

    def string(self, k: int) -> str:
        return self.data[self.starts[k] : self.ends[k]].tobytes().decode("utf-8", "surrogatepass")


def distinct(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of one occurrence of each distinct hash, number of each word's hash)."""
    if not len(hashes):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.argsort(hashes)
    fresh = np.ones(len(hashes), bool)
    ordered = hashes[order]
    fresh[1:] = ordered[1:] != ordered[:-1]
    inverse = np.empty(len(hashes), np.int64)
    inverse[order] = np.cumsum(fresh) - 1
    return order[fresh], inverse


TAKEN = 1 << 17  # values that take() copies at once: their places take eight bytes each


def take(flat: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The spans of flat that begin at first and are size long, one after the other."""
    stops = np.cumsum(size)
    shift = first - (stops - size)
    out = np.empty(int(stops[-1]) if len(stops) else 0, flat.dtype)
    a = done = 0
    while done < len(out):
        b = max(a + 1, int(np.searchsorted(stops, done + TAKEN, side="right")))
        end = int(stops[b - 1])
        out[done:end] = flat[np.arange(done, end) + np.repeat(shift[a:b], size[a:b])]
        a, done = b, end
    return out


def strings(flat: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """The byte strings of so many bytes that lie in flat in order."""
    stops = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(stops), pa.py_buffer(np.ascontiguousarray(flat))])


def chosen(values: pa.Array, at: pa.Array, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the bytes of the values at these places, one after the other; the bounds in them of runs of n places)."""
    data, bounds = raw(values.take(at))
    return data, bounds[np.concatenate(([0], np.cumsum(n))).astype(np.int64)]


class Store:
    """Lists of integers by byte string, in arrays: sorted 64-bit hashes, for each where its list lies in one flat array and where its
    bytes lie in another. A hash alone is no hit: the bytes are compared."""

    def __init__(self, kind: str, most: int):
        self.kind, self.most = kind, most
        self.clear()

    def clear(self) -> None:
        self.keys, self.first, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.flat, self.used = np.zeros(1 << 16, self.kind), 0
        self.place, self.length = np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.bytes, self.filled = np.zeros(1 << 16, np.uint8), 0

    def copy(self) -> Store:
        out = Store(self.kind, self.most)
        out.keys, out.first, out.size, out.flat, out.used = self.keys, self.first, self.size, self.flat.copy(), self.used
        out.place, out.length, out.bytes, out.filled = self.place, self.length, self.bytes.copy(), self.filled
        return out

    def find(self, keys: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place of each key, whether it is there with the bytes of the span, whether it is there with others)."""
        at = np.searchsorted(self.keys, keys)
        hit = np.zeros(len(keys), bool)
        inside = at < len(self.keys)
        hit[inside] = self.keys[at[inside]] == keys[inside]
        there = hit.copy()
        k, size = np.flatnonzero(hit), ends - starts
        there[k] = self.length[at[k]] == size[k]
        k = np.flatnonzero(there)
        there[k] = equal_spans(self.bytes, self.place[at[k]], data, starts[k], size[k])
        return at, there, hit & ~there

    def add(self, keys: np.ndarray, flat: np.ndarray, size: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        """Add lists under new, ascending keys of the spans' bytes."""
        if len(self.keys) + len(keys) > self.most:
            self.clear()
        at = np.searchsorted(self.keys, keys)
        first = self.used + np.cumsum(size) - size
        self.flat, self.used = extended(self.flat, self.used, flat)
        length = ends - starts
        place = self.filled + np.cumsum(length) - length
        self.bytes, self.filled = extended(self.bytes, self.filled, take(data, starts, length))
        self.keys, self.first, self.size = np.insert(self.keys, at, keys), np.insert(self.first, at, first), np.insert(self.size, at, size)
        self.place, self.length = np.insert(self.place, at, place), np.insert(self.length, at, length)


def extended(values: np.ndarray, used: int, more: np.ndarray) -> tuple[np.ndarray, int]:
    """values with more after the used ones (in a larger array if need be), and how many are used."""
    if used + len(more) > len(values):
        values = np.concatenate((values[:used], np.zeros(used + 2 * len(more), values.dtype)))
    values[used : used + len(more)] = more
    return values, used + len(more)


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values between consecutive bounds."""
    total = np.concatenate((np.zeros(1, values.dtype if values.dtype.kind == "f" else np.int64), np.cumsum(values)))
    return total[bounds[1:]] - total[bounds[:-1]]


#: Lead bytes of white space beyond ASCII.
_LEAD = np.zeros(256, bool)
_LEAD[[0xC2, 0xE1, 0xE2, 0xE3]] = True
_LEAD[0x1C:0x20] = True


def split_forbidden(data: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """For each text, whether white space stands beside a space, at its end, or is none of ASCII's: there a pre-tokenizer that cuts
    before single spaces may cut otherwise."""
    n, out = len(data), np.zeros(len(texts) - 1, bool)
    if not n:
        return out
    at = np.flatnonzero(data == 32)
    white = WHITE[data]
    last = np.zeros(n, bool)
    last[texts[1:][texts[1:] > texts[:-1]] - 1] = True
    first = np.zeros(n, bool)
    first[texts[:-1][texts[1:] > texts[:-1]]] = True
    bad = last[at] | (white[np.minimum(at + 1, n - 1)] & ~last[at]) | (white[np.maximum(at - 1, 0)] & ~first[at])
    hits = [at[bad]]
    lead = np.flatnonzero(_LEAD[data])
    if len(lead):
        a, b, c = data[lead], data[np.minimum(lead + 1, n - 1)], data[np.minimum(lead + 2, n - 1)]
        rare = (a < 32) | ((a == 0xC2) & ((b == 0x85) | (b == 0xA0))) | ((a == 0xE1) & (b == 0x9A) & (c == 0x80)) | ((a == 0xE3) & (b == 0x80) & (c == 0x80))
        rare |= (a == 0xE2) & (b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF)) | (a == 0xE2) & (b == 0x81) & (c == 0x9F)
        hits.append(lead[rare])
    out[np.searchsorted(texts, np.concatenate(hits), side="right") - 1] = True
    return out
