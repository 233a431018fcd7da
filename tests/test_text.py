"""Unit strings whose results are known."""

import pytest
from pyspark.sql import functions as F

from specloom.functions import lexicon as lx
from specloom.functions import text as tx
from specloom.functions import udfs


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("given", "wanted"), [("5 apples", ["5 a"]), ("32 bits", ["32 bit"]), ("10 ms", ["10 ms"]), ("RV32", ["32"]), ("3-5", ["3", "-5"]), ("1.2.3", ["1.2", "3"])])
def test_numbers(spark, given, wanted):
    assert one(spark, tx.numbers("t"), t=given) == wanted


@pytest.mark.parametrize(("given", "wanted"), [("must not", ["must"]), ("may not", ["may not"]), ("shall not", ["shall"]), ("cannot", [])])
def test_strength(spark, given, wanted):
    assert one(spark, tx.strength_words("t"), t=given) == wanted


def test_clean(spark):
    assert one(spark, tx.clean("t"), t="a - b\n - c") == "a-b-c"
    assert one(spark, tx.clean("t"), t=None) == ""
    assert one(spark, tx.stable_hash("t"), t="A - b") == one(spark, tx.stable_hash("t"), t="a-B")


def test_feature(spark):
    assert one(spark, tx.is_feature("t"), t="hello world") is True
    assert one(spark, tx.is_feature("t"), t="...") is False


@pytest.mark.parametrize(("word", "hit"), [("ARVALID", True), ("RRVALID", True), ("rid", True), ("ACLK", False)])
def test_bus_signals(spark, word, hit):
    assert one(spark, F.col("t").rlike("(?U)" + lx.AXI_SIGNAL), t=word) is hit


def test_section_patterns(spark):
    assert one(spark, F.col("t").rlike(lx.SECTION), t="A3.1. Handshake") is False
    assert one(spark, F.col("t").rlike(lx.SECTION_DOTTED), t="A3.1. Handshake") is True
    assert one(spark, F.col("t").rlike(lx.SECTION), t="3 ms") is True


def test_percent_text_half_even(spark):
    assert one(spark, tx.percent_text(F.col("t").cast("double")), t="0.125") == "12%"


def test_sentences(spark):
    assert one(spark, tx.sentences("t"), t="e.g. foo. Bar") == ["e.g.", "foo.", "Bar"]


def test_category_is_a_substring_test(spark):
    assert one(spark, tx.category("t"), t="the interface") == "Protocol"
    assert one(spark, tx.category("t"), t="nothing here") == "Functional"


def test_ratio():
    assert udfs.ratio("", "") == 1.0
    assert udfs.ratio("a", "") == 0.0
    assert udfs.ratio("tide", "diet") == 0.25
    assert udfs.ratio("diet", "tide") == 0.5
    old = "the manager must hold valid until ready is asserted. " * 8
    assert udfs.ratio(old, old.replace("must", "shall")) == 0.028


def test_protected_tokens():
    import re

    found = {w: [m[0] for m in re.finditer(lx.TECHNICAL_TOKEN, w)] for w in ("mstatus", "satp", "pmpcfg0", "FENCE.I", "RV64GC", "e.g.")}
    assert found == {"mstatus": [], "satp": [], "pmpcfg0": ["pmpcfg0"], "FENCE.I": ["FENCE.I"], "RV64GC": ["RV64GC"], "e.g.": ["e.g"]}


def test_phrase_counts():
    assert len(lx.REQUIREMENT_PHRASES) == 18
    assert len(lx.REQUIRED_FIELDS) == 12


def test_matched_is_the_sequence_matchers():
    import difflib
    import random

    chance = random.Random(5)
    for n in (1, 3, 30, 199, 200, 201, 700, 3000):
        for letters in ("ab", "abcdefgh", "etaoin shrdlu .ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"):
            a = "".join(chance.choices(letters, [9, *[1] * (len(letters) - 1)], k=n))
            for b in (a, a[::-1], a[n // 3 :] + a[: n // 2], "".join(chance.choices(letters, k=n)), a[: n // 2] + "Q" + a[n // 2 :]):
                want = sum(m.size for m in difflib.SequenceMatcher(None, a, b).get_matching_blocks())
                assert udfs.matched(a, b) == udfs.stepped(a, b, udfs.places(b)) == want
