"""Word arrays, directly addressable codes and BPE against plain Python, the libraries and brute force."""

import random
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from specloom.llm import arrays, binary_ids, bpe, common, passages, quality

TRICKY = ["a  b", " a", "a ", "a\n b", "a \nb", "a\n  b", "  ", "", None, "don't  'll x", "a\t b", "é 3.5 x!? ,", "x\x1c y", "a b", " ", "a b c a", "x y\n", "\n x", "w \x1f e", "\na b", "　a b", "the the the"]


def test_words_and_hashes():
    texts = ["Ab  c\nd", None, "", "d Ab", "\t x"]
    w = arrays.Words(pa.array(texts))
    words = [w.string(k) for k in range(len(w.starts))]
    assert words == ["Ab", "c", "d", "d", "Ab", "x"]
    assert w.bounds.tolist() == [0, 3, 3, 3, 5, 6]
    assert w.hashes[0] == w.hashes[4] and w.hashes[2] == w.hashes[3] and len(set(w.hashes.tolist())) == 4
    assert arrays.Words(pa.array(["A"]), lower=True).hashes[0] == arrays.Words(pa.array(["a"])).hashes[0]


@pytest.mark.parametrize("n", [0, 1, 5, 513, 3000])
def test_codes_round_trip(n):
    rng = random.Random(n)
    x = np.array([rng.choice([0, 3, 255, 256, 50256, 70000, 2**31]) for _ in range(n)], np.int64)
    c = binary_ids.Codes(binary_ids.pack(x))
    assert (c.all() == x).all()
    assert all(c[i] == x[i] for i in range(0, n, 7))


def test_encoder_equals_library():
    e = binary_ids.Encoder(binary_ids.tokenizer_path("byte_bpe_50k.json"))
    for texts in (TRICKY, TRICKY[:7], ["one two three"] * 3):
        ids, n = e.encode(pa.array(texts, pa.string()))
        stops = np.cumsum([0, *n])
        for i, t in enumerate(texts):
            assert ids[stops[i] : stops[i + 1]].astype("<u4").tobytes() == e.ids([t or ""])[0], t


def test_heap_merge_equals_library():
    import public_tokenizers
    import tiktoken

    ranks = bpe.load_ranks("byte_bpe_50k.tiktoken")
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(1)
    for n in (1, 2, 9, 300):
        piece = "".join(rng.choice("abtheinré") for _ in range(n))
        assert [ranks[x] for x in bpe.merge(piece.encode(), ranks)] == lib.encode_ordinary(piece)


def test_encode_decode(spark):
    import public_tokenizers
    import tiktoken

    from specloom.session import ready

    ready(spark)
    ranks = bpe.load_ranks("byte_bpe_50k.tiktoken")
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = [*TRICKY, "x" * 700, "Ünïcödé wörds " * 20]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, ids string").withColumn("__codes", F.lit(1)).repartition(3)
    out = {r["doc_id"]: (bytes(r["ids"]), bytes(r["decoded"])) for r in bpe.decode(bpe.encode(df)).collect()}
    for i, t in enumerate(texts):
        ids = np.array(lib.encode_ordinary(t or ""), "<u4").tobytes()
        assert out[i] == (ids, (t or "").encode()), t
    assert bpe.encode(df.limit(0)).count() == 0


def morse(n, letters):
    """The Thue-Morse sequence: with its complement it collides under polynomial hashes modulo powers of two."""
    return "".join(letters[k.bit_count() & 1] for k in range(n))


def test_equal_hashes_are_no_hits():
    """Words that share a hash are told apart by their bytes, in the encoders of both tokenizers."""
    import public_tokenizers
    import tiktoken

    ranks = bpe.load_ranks("byte_bpe_50k.tiktoken")
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = ["x alpha beta gamma delta", "y beta beta zeta alpha qqqq", "alpha gamma", "z qqqq zeta wort"]
    e = binary_ids.Encoder(binary_ids.tokenizer_path("byte_bpe_50k.json"))
    real = arrays.span_hashes
    try:
        arrays.span_hashes = lambda data, starts, ends: real(data, starts, ends) % np.uint64(3)  # nearly all collide
        for _ in range(2):
            ids, n = e.encode(pa.array(texts))
            stops = np.cumsum([0, *n])
            assert [ids[a:b].astype("<u4").tobytes() for a, b in zip(stops, stops[1:])] == e.ids(texts)
    finally:
        arrays.span_hashes = real
    base = bpe.base_codes("byte_bpe_50k.tiktoken")
    p = bpe.Pieces("byte_bpe_50k.tiktoken", public_tokenizers.PATTERN)
    try:
        arrays.span_hashes = lambda data, starts, ends: real(data, starts, ends) % np.uint64(3)
        for _ in range(2):
            codes, n = p.of(pa.array(texts))
            named = {v: k for k, v in ranks.items()} | {p.first + k: x for k, x in enumerate(p.fresh)}
            stops = np.cumsum([0, *n])
            assert [b"".join(named[c] for c in codes[a:b].tolist()).decode() for a, b in zip(stops, stops[1:])] == texts
    finally:
        arrays.span_hashes = real
    assert len(base.keys) == len(ranks) and lib.decode(lib.encode_ordinary(texts[0])) == texts[0]


@pytest.mark.parametrize("n", [1024, 4096, 8192])
def test_thue_morse_words(n):
    a, b = morse(n, "ab"), morse(n, "ba")
    w = arrays.Words(pa.array([a, b, a]))
    assert w.hashes[0] == w.hashes[2] != w.hashes[1]
    e = binary_ids.Encoder(binary_ids.tokenizer_path("byte_bpe_50k.json"))
    texts = [f"q {a}", f"q {b}"]
    ids, k = e.encode(pa.array(texts))
    assert [ids[: k[0]].astype("<u4").tobytes(), ids[k[0] :].astype("<u4").tobytes()] == e.ids(texts)


def test_encode_blocks_and_frequent_pieces(spark):
    """Frequent pieces from a sample, several blocks in a task, and a task that starts over, against the library."""
    import public_tokenizers
    import tiktoken

    from specloom.session import ready

    ready(spark)
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks("byte_bpe_50k.tiktoken"), special_tokens={})
    rng = random.Random(4)
    words = ["".join(rng.choice("abdeghilmnorstuwzéß") for _ in range(rng.randrange(1, 14))) for _ in range(900)]
    texts = [" ".join(rng.choices(words, k=rng.randrange(0, 120))) for _ in range(300)] + [morse(2048, "ab"), morse(2048, "ba")] + ["same words here qzxj " * 3] * 150
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    for sample in (100, 1 << 20):
        out = {r["doc_id"]: bytes(r["ids"]) for r in bpe.encode(df, sample=sample, block_bytes=8000, most_met=400).collect()}
        assert all(out[i] == np.array(lib.encode_ordinary(t), "<u4").tobytes() for i, t in enumerate(texts))


def brute(words):
    n, out = len(words), [0] * len(words)
    for i in range(n):
        for j in range(n):
            k = 0
            while i != j and max(i, j) + k < n and words[i + k] == words[j + k]:
                k += 1
            out[i] = max(out[i], k)
    return out


def test_repeat_lengths_equal_brute_force():
    rng = random.Random(2)
    for _ in range(150):
        docs = [[rng.randrange(rng.choice([1, 2, 5])) for _ in range(rng.randrange(14))] for _ in range(rng.randrange(1, 5))]
        bounds = np.concatenate(([0], np.cumsum([len(d) for d in docs])))
        got = quality.repeat_lengths(np.array([c for d in docs for c in d], np.int64), np.repeat(bounds[1:], np.diff(bounds)))
        assert got.tolist() == sum((brute(d) for d in docs), [])


def test_quality_cases(spark):
    from specloom.session import ready

    ready(spark)
    plain = " ".join(f"w{i}" for i in range(80))
    rows = [(1, None), (2, ""), (3, plain), (4, "spam eggs " * 60), (5, plain + "\n" + plain), (3, plain), (6, "# # $ a\nb\nb\n\n")]
    df = spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id long, text string, kept int")
    out = {r["doc_id"]: r for r in quality.quality(df).collect()}
    assert not out[1]["kept"] and out[1]["n_words"] == 0 and not out[2]["kept"]
    assert out[3]["kept"] and out[3]["n_repeat_words"] == 0
    assert out[4]["base_failed"] and out[5]["base_failed"] and out[5]["longest_repeat"] == 80
    assert (out[6]["n_symbols"], out[6]["n_dup_lines"], out[6]["word_chars"]) == (3, 1, 6)
    assert quality.quality(df.limit(0)).count() == 0


def test_fold_has_few_expressions():
    """Each is interpreted, most of them once a step; there were 99 by this count."""
    made = str(bpe.fold(F.col("x"), F.col("s"), F.col("b"), F.col("m"), 7))
    assert len(re.findall(r"\w+\(|[\[+*&^-] ?|>=", made)) < 75, made


def test_chosen_values():
    values = arrays.strings(np.arange(6, dtype=np.uint32), 4 * np.array([1, 0, 3, 2]))
    data, stops = arrays.chosen(values, pa.array([2, 0, 1, 3, 2], pa.int32()), np.array([2, 0, 3]))
    assert data.view(np.uint32).tolist() == [1, 2, 3, 0, 4, 5, 1, 2, 3] and stops.tolist() == [0, 16, 16, 36]
    none, stops = arrays.chosen(values, pa.array([], pa.int32()), np.array([0, 0]))
    assert len(none) == 0 and stops.tolist() == [0, 0, 0]


def test_encoder_memory_is_bounded():
    """What a slice takes while its pieces are found; slices of 2 MB took 38 MB here."""
    import tracemalloc

    rng = np.random.default_rng(5)
    words = ["".join(x) for x in rng.choice(list("abcdefghijklmnop"), (20000, 6))]
    batch = pa.RecordBatch.from_arrays([pa.array([" ".join(rng.choice(words, 700)) for _ in range(900)])], names=["text"])
    p = bpe.Pieces("byte_bpe_50k.tiktoken", public_tokenizers.PATTERN)
    p.of(batch.column("text").slice(0, 200))
    tracemalloc.start()
    for part in common.slices([batch], "text", bpe.SLICE_BYTES):
        p.of(part.column("text"))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 28 << 20, peak


def test_take_equals_slices():
    rng = np.random.default_rng(2)
    flat, first = rng.integers(0, 99, 5000), rng.integers(0, 2000, 700)
    size = rng.choice([0, 1, 7, 3000], 700)
    assert np.array_equal(arrays.take(flat, first, size), np.concatenate([flat[a : a + n] for a, n in zip(first, size, strict=True)]))
    assert len(arrays.take(flat, first[:0], size[:0])) == len(arrays.take(flat, first[:2], np.zeros(2, np.int64))) == 0


def test_lines_equal_brute_force():
    rng = random.Random(4)
    texts = ["".join(rng.choice(["w ", "w", " ", "\n", "\n\n"]) * rng.choice([1, 60]) for _ in range(rng.randrange(12))) for _ in range(200)]
    w = arrays.Words(pa.array(texts), lower=True)
    first, end = passages.lines(w)
    sizes = [len(x.split()) for t in texts for x in t.split("\n") if len(x.split()) >= passages.LINE_WORDS]
    assert (end - first).tolist() == sizes and len(sizes) > 9


def test_workers_use_small_arrays_again(spark):
    """With a trim threshold alone every array of 128 KB and more was mapped anew: 3.4 seconds for what takes 1.2 now."""
    env = common.ready(spark).sparkContext.environment
    assert int(env["MALLOC_MMAP_THRESHOLD_"]) >= 4 << 20 and int(env["MALLOC_TRIM_THRESHOLD_"]) >= 4 << 20
