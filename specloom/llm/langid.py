"""Operator 1, language ID by interpolated Kneser-Ney character language models.

For each language a character n-gram model of order ORDER is trained on lower-cased words with a space on both sides; contexts
end at the space before the word, so a text's log probability is the sum over its words and each distinct word is scored once a
block. The models of all languages share sorted arrays of n-gram hashes: one binary search gives the interpolated log
probabilities of all languages at once, or else the back-off weights of the context and a look one order lower.

A text gets the language of the lowest cross-entropy a character. The score is a softmax of the negative cross-entropies, its
temperature fitted on labelled rows that the models have not seen; ``rejected`` tells that the best cross-entropy is above nearly
all of those rows'.

Training takes a bounded sample: about SAMPLE rows a language, drawn at random, written once, and of each at most the words that make
WORDS_EACH distinct ones a language go to the driver, most frequent first; the model is a table of bounded size. Runs of over LONGEST
characters (languages without spaces) are learned in windows of as many, which overlap by the order of the model. What calibrates is
computed where the texts are, from whole texts: a few numbers a row go to the driver.

Defined results: null, empty and letterless texts are ``und`` with score 0; without training rows every text is ``und``; rows with
null lang are never learned from; equal texts are treated alike.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import arrays, common

ORDER = 5
SAMPLE = 2000  # rows a language to train on
WORDS_EACH = 50_000  # distinct words a language
LONGEST = 64  # characters of a window of a longer run
HELD_BACK = 8  # one of so many training rows calibrates instead
REJECT_QUANTILE = 0.999
LETTER = re.compile(r"[^\W\d_]")
U = np.uint64


def gram_hashes(codes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-grams that end at each place."""
    out = np.full(len(codes), n, np.uint64)
    for k in range(n - 1, -1, -1):
        shifted = np.zeros(len(codes), np.uint64)
        shifted[k:] = codes[: len(codes) - k]
        out = (out ^ shifted) * U(0x9E3779B97F4A7C15)
        out ^= out >> U(29)
    return arrays.mixed(out)


def lay_out(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code points of all words, each with a space on both sides; number of characters before each in its word; word of each)."""
    text = "".join([f" {w} " for w in words])
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    word = np.repeat(np.arange(len(words)), sizes)
    return codes, np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes), word


class Model:
    """Sorted hash arrays: grams[n] -> log probabilities (a column a language), contexts[n] -> back-off log weights."""

    def __init__(self, langs: list[str], words: dict[str, list[tuple[str, int]]], order: int = ORDER):
        self.langs, self.order = langs, order
        self.grams: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.uint64), np.zeros((0, len(langs)), np.float32))] * (order + 1)
        self.contexts = list(self.grams)
        self.temperature, self.limit = 1.0, np.inf
        if langs:
            self.fit(words)

    def fit(self, words: dict[str, list[tuple[str, int]]]) -> None:
        number = len(self.langs)
        tokens = [words[x] for x in self.langs]
        codes, place, word = lay_out([w for part in tokens for w, _ in part])
        weight = np.array([c for part in tokens for _, c in part], np.float64)[word]
        lang = np.repeat(np.arange(number), [len(x) for x in tokens])[word]
        hashes = {0: np.zeros(len(codes), np.uint64), 1: gram_hashes(codes, 1)}
        symbols = len(np.unique(codes)) + 1  # and an unseen one
        below = np.full((1, number), 1 / symbols)  # interpolated probabilities of the order below, by gram
        below_keys = np.zeros(0, np.uint64)
        for n in range(1, self.order + 1):
            if n < self.order:
                hashes[n + 1] = gram_hashes(codes, n + 1)
            hashes.pop(n - 2, None)
            # grams that end at a character which isn't a word's first space, with their whole context in the word or cut by its start
            at = np.flatnonzero(place >= n - 1 if n > 1 else place >= 1)
            keys, inverse = np.unique(hashes[n][at], return_inverse=True)
            count = np.zeros((len(keys), number))
            if n == self.order:
                np.add.at(count, (inverse, lang[at]), weight[at])
            else:  # continuation counts: distinct characters before; a word's start is one
                wide = np.where(place[at] > n - 1, hashes[n + 1][at], hashes[n][at] ^ U(1))
                _, first = np.unique(arrays.mixed(wide + lang[at].astype(np.uint64) * arrays.MULTIPLIER), return_index=True)
                starts = place[at] == n - 1  # nothing can stand before: as in training, raw counts
                once = np.zeros(len(at), bool)
                once[first] = True
                np.add.at(count, (inverse[once & ~starts], lang[at][once & ~starts]), 1.0)
                np.add.at(count, (inverse[starts], lang[at][starts]), weight[at][starts])
            context = (hashes[n - 1][np.maximum(at - 1, 0)] if n > 1 else np.zeros(len(at), np.uint64))
            context_keys, context_of = np.unique(context, return_inverse=True)
            of = np.zeros(len(keys), np.int64)
            of[inverse] = context_of
            total = np.zeros((len(context_keys), number))
            np.add.at(total, of, count)
            kinds = np.zeros((len(context_keys), number))
            np.add.at(kinds, of, (count > 0).astype(float))
            ones, twos = (count == 1).sum(0), (count == 2).sum(0)
            discount = np.clip(ones / np.maximum(1, ones + 2 * twos), 0.1, 0.95)
            back = np.where(total > 0, discount * kinds / np.maximum(total, 1e-9), 1.0)
            # the same gram one character shorter
            if n == 1:
                lower = np.broadcast_to(below[:1], (len(keys), number))
            else:
                short = np.zeros(len(keys), np.uint64)
                short[inverse] = hashes[n - 1][at]
                lower = below[np.searchsorted(below_keys, short)]
            p = np.maximum(count - discount, 0) / np.maximum(total[of], 1e-9) + back[of] * lower
            below, below_keys = p, keys
            self.grams[n] = (keys, np.log(p).astype(np.float32))
            self.contexts[n] = (context_keys, np.log(back).astype(np.float32))
        self.unseen = np.log(1 / symbols)

    def word_scores(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(log probability of each word by language, its characters)."""
        codes, place, word = lay_out(words)
        out = self.char_scores(codes, place)
        sums = np.zeros((len(words), len(self.langs)))
        bounds = np.concatenate(([0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 2)))
        for j in range(len(self.langs)):
            sums[:, j] = arrays.sums(out[:, j].astype(np.float64), bounds)
        return sums, np.diff(bounds) - 1

    def char_scores(self, codes: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Log probability of each character in its word by language; 0 for the space before a word."""
        scored = np.flatnonzero(place >= 1)
        out = np.zeros((len(codes), len(self.langs)), np.float32)
        open_ = scored
        for n in range(self.order, 0, -1):
            now = open_[place[open_] >= n - 1] if n > 1 else open_
            if not len(now):
                continue
            keys, logs = self.grams[n]
            h = gram_hashes(codes, n)
            at = np.minimum(np.searchsorted(keys, h[now]), len(keys) - 1)
            hit = keys[at] == h[now]
            out[now[hit]] += logs[at[hit]]
            miss = now[~hit]
            keys, logs = self.contexts[n]
            context = gram_hashes(codes, n - 1)[miss - 1] if n > 1 else np.zeros(len(miss), np.uint64)
            at = np.minimum(np.searchsorted(keys, context), len(keys) - 1)
            there = keys[at] == context
            out[miss[there]] += logs[at[there]]
            left = np.ones(len(codes), bool)
            left[now[hit]] = False
            open_ = open_[left[open_]]
        out[open_] += self.unseen
        return out

    def entropies(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(cross-entropy a character of each text by language, whether it has a letter)."""
        w = arrays.Words(column)
        one, number = arrays.distinct(w.hashes)
        words = [w.string(k).lower() for k in one.tolist()]
        has = np.fromiter((LETTER.search(x) is not None for x in words), bool, len(words))
        n = len(w.bounds) - 1
        if not self.langs or not words:
            letters = arrays.sums(has[number].astype(np.int64), w.bounds) > 0 if words else np.zeros(n, bool)
            return np.zeros((n, len(self.langs))), letters
        scores, chars = self.word_scores(words)
        scores, chars = np.where(has[:, None], scores, 0), np.where(has, chars, 0)  # words without a letter tell nothing
        total = np.maximum(1, arrays.sums(chars[number], w.bounds))
        found = np.stack([-arrays.sums(scores[:, j][number], w.bounds) / total for j in range(len(self.langs))], axis=1)
        return found, arrays.sums(has[number].astype(np.int64), w.bounds) > 0

    def calibrate(self, h: np.ndarray, y: np.ndarray) -> None:
        """Fit the temperature by likelihood over a grid, and the limit of rejection as a quantile, by rows' cross-entropies by language
        and the numbers of their languages."""
        if not len(h):
            return
        grid = np.geomspace(0.5, 64, 29)
        loss = [-np.log(softmax(-h * t)[np.arange(len(y)), y] + 1e-12).mean() for t in grid]
        self.temperature = float(grid[int(np.argmin(loss))])
        self.limit = float(np.quantile(h[np.arange(len(y)), y], REJECT_QUANTILE))


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def train(rows: DataFrame, sample: int = SAMPLE, words_each: int = WORDS_EACH, order: int = ORDER) -> Model:
    """A model of the labelled rows (text, lang), from a bounded sample of them."""
    rows = rows.select("text", "lang").filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(x for x in sizes if x != "und")
    if not langs:
        return Model([], {})
    share = F.lit(0.0)
    for x in langs:
        share = F.when(F.col("lang") == x, F.lit(min(1.0, sample / sizes[x]))).otherwise(share)
    # drawn row by row, so that copies of a text are not in or out together
    chosen = common.written(rows.filter(F.rand(17) < share).withColumn("back", F.rand(18) < 1 / HELD_BACK), "sample")
    step = LONGEST - order
    windows = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.length("run") - order - 1), F.lit(step)), lambda i: F.substring(F.col("run"), i + 1, F.lit(LONGEST)))
    runs = chosen.filter("not back").select("lang", F.explode(F.split(F.lower("text"), r"[\x20\x09-\x0D]+")).alias("run")).filter("run <> ''")
    windows = F.when(F.length("run") > LONGEST, windows).otherwise(F.array("run"))
    counts = runs.select("lang", F.explode(windows).alias("word")).groupBy("lang", "word").count()
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("count"), "word"))  # of a bounded sample's words
    top = counts.withColumn("rank", rank).filter(F.col("rank") <= words_each).select("lang", "word", "count").toArrow()
    words: dict[str, list[tuple[str, int]]] = {x: [] for x in langs}
    for lang, word, n in zip(*[top.column(c).to_pylist() for c in ("lang", "word", "count")], strict=True):
        if LETTER.search(word):
            words[lang].append((word, n))
    model = Model([x for x in langs if words[x]], {x: sorted(v) for x, v in words.items() if v}, order)
    if model.langs:
        held = entropies(chosen.filter("back").select("text", "lang"), model).toArrow()
        pairs = [(h, model.langs.index(x)) for h, x, ok in zip(*[held.column(c).to_pylist() for c in ("entropies", "lang", "letters")], strict=True) if ok and x in model.langs]
        model.calibrate(np.array([h for h, _ in pairs]), np.array([k for _, k in pairs], np.int64))
    common.drop_table(chosen)
    return model


def entropies(df: DataFrame, model: Model) -> DataFrame:
    """(lang, entropies by language, letters) of df (text, lang)."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # of bounded size: see train

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text", 2 << 20):
            h, letters = shared.value.entropies(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(h.tolist(), pa.list_(pa.float64())), pa.array(letters)], names=["lang", "entropies", "letters"])

    return df.mapInArrow(run, "lang string, entropies array<double>, letters boolean")


def predict(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """df without text, with lang_pred, score, cross_entropy (nats a character) and rejected."""
    from pyspark.sql import types as T

    added = T._parse_datatype_string("lang_pred string, score double, cross_entropy double, rejected boolean")
    base = df.drop(*[f.name for f in added])
    schema = T.StructType([*base.drop(text).schema.fields, *added.fields])
    shared = df.sparkSession.sparkContext.broadcast(model)  # of bounded size: see train

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in common.slices(batches, text, 2 << 20):
            h, letters = model.entropies(batch.column(text))
            if model.langs:
                best = h.argmin(1)
                score = np.where(letters, softmax(-h * model.temperature)[np.arange(len(h)), best], 0.0)
                lang = [model.langs[k] if ok else "und" for k, ok in zip(best.tolist(), letters.tolist(), strict=True)]
                low = pa.array(np.where(letters, h.min(1), 0.0), mask=~letters)
                rejected = ~letters | (h.min(1) > model.limit)
            else:
                score, lang, low, rejected = np.zeros(len(h)), ["und"] * len(h), pa.nulls(len(h), pa.float64()), np.ones(len(h), bool)
            rest = batch.drop_columns([text])
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64()), low, pa.array(rejected)], names=[f.name for f in schema])

    return base.mapInArrow(run, schema)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every text of documents, by models of the rows that are not held out."""
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    docs = common.only(common.table(spark, sf_dir, "documents"), "doc_id", "text", "lang").withColumn("held_out", held_out)
    model = train(docs.filter(~F.col("held_out")))
    return predict(docs.select("doc_id", "held_out", "text"), model)
