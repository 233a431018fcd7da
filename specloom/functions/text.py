"""Text functions as Column expressions. Nothing here runs Python on executors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon as lx

#: Python's white space: Unicode's and the separators \x1c-\x1f.
WS = r"[\s\x1c-\x1f]"
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value evaluated once, however often use has it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(x: Column | str) -> Column:
    return F.regexp_replace(col(x), rf"(?U)\A{WS}+|{WS}+\z", "")


def squash(x: Column | str) -> Column:
    """Every run of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(col(x), rf"(?U){WS}+", " "))


def clean(x: Column | str) -> Column:
    """Null as '', no white space about hyphens, then squashed."""
    return squash(F.regexp_replace(F.coalesce(col(x).cast("string"), F.lit("")), rf"(?U){WS}*-{WS}*", "-"))


def normalised(x: Column | str) -> Column:
    return F.lower(clean(x))


def stable_hash(x: Column | str) -> Column:
    return F.substring(F.sha1(normalised(x)), 1, 12)


def quality_text(x: Column | str) -> Column:
    """The checker's form: U+F05A as a space, squashed, lower case."""
    return F.lower(squash(F.regexp_replace(F.coalesce(col(x).cast("string"), F.lit("")), "", " ")))


def bare(x: Column | str) -> Column:
    """Letters and digits alone, lower case."""
    return F.lower(F.regexp_replace(col(x), r"(?U)[\W_]+", ""))


def requirement_key(x: Column | str) -> Column:
    """White space squashed, lower case: the key of a requirement's first occurrence."""
    return F.lower(squash(col(x)))


def lines(x: Column | str) -> Column:
    """Lines of a text; a final line break opens no line."""
    parts = F.split(col(x), LINE_BREAK)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def stripped_lines(x: Column | str) -> Column:
    return F.transform(lines(x), strip)


def sentences(x: Column | str) -> Column:
    """Sentences: squashed, a space put between a small and a capital letter, split after . ! ?"""
    spaced = F.regexp_replace(squash(x), r"([a-z])([A-Z])", "$1 $2")
    return F.filter(F.transform(F.split(spaced, r"(?U)(?<=[.!?])\s+"), strip), lambda s: s != "")


def matches(x: Column | str, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(col(x), F.lit(pattern), F.lit(group))


def category(x: Column | str, categories: dict[str, list[str]] | None = None) -> Column:
    """The first category with a keyword in the text, as a substring."""
    low = F.lower(col(x))
    out = F.lit(lx.DEFAULT_CATEGORY)
    for name, words in reversed((categories or lx.CATEGORIES).items()):
        any_of = low.contains(words[0])
        for w in words[1:]:
            any_of = any_of | low.contains(w)
        out = F.when(any_of, F.lit(name)).otherwise(out)
    return out


def scored_category(x: Column | str) -> Column:
    """The category with most keywords; bus signals and registers count two; ties by priority."""
    low = F.lower(col(x))
    best = []
    for name, words in lx.CATEGORIES.items():
        hits = sum((low.contains(w).cast("int") for w in words[1:]), low.contains(words[0]).cast("int"))
        if name == "Protocol":
            hits = hits + F.when(col(x).rlike("(?U)" + lx.AXI_SIGNAL), 2).otherwise(0)
        if name == "Architecture":
            hits = hits + F.when(col(x).rlike("(?U)" + lx.RISCV_CSR), 2).otherwise(0)
        best.append(F.struct(hits.alias("hits"), F.lit(-lx.PRIORITY.index(name)).alias("prio"), F.lit(name).alias("name")))
    top = F.array_max(F.array(*best))
    return F.when(top["hits"] > 0, top["name"]).otherwise(F.lit(lx.DEFAULT_CATEGORY))


def is_requirement(x: Column | str) -> Column:
    return col(x).rlike(lx.REQUIREMENT)


def is_specification(x: Column | str) -> Column:
    return col(x).rlike(lx.SPECIFICATION)


def is_feature(x: Column | str) -> Column:
    """True wherever there is a word: the feature phrases end in an empty alternative."""
    return col(x).rlike(r"(?U)\b")


def is_relevant(x: Column | str) -> Column:
    """The verification-plan test: no figure, no lead-in, and a requirement phrase."""
    return relevant(squash(x))


def relevant(s: Column) -> Column:
    """is_relevant of a squashed text."""
    return (s != "") & ~s.rlike("(?U)" + lx.FIGURE_MENTION) & ~s.rlike(lx.LEAD_IN) & is_specification(s)


def valid_section(x: Column | str) -> Column:
    return F.coalesce(col(x).rlike(lx.VALID_SECTION), F.lit(False))


def parent_section(x: Column | str) -> Column:
    return F.when(col(x).contains("."), F.regexp_replace(col(x), r"\.[^.]*$", ""))


def numbers(x: Column | str) -> Column:
    return F.transform(matches(clean(x), "(?U)" + lx.NUMBER), lambda m: F.lower(clean(m)))


def strength_words(x: Column | str) -> Column:
    return F.transform(matches(clean(x), "(?U)" + lx.STRENGTH, 1), lambda m: F.lower(clean(m)))


def references(x: Column | str) -> Column:
    return F.transform(matches(clean(x), "(?U)" + lx.REFERENCE), lambda m: F.lower(clean(m)))


def tokens(x: Column | str) -> Column:
    """Significant tokens in the order of first occurrence."""
    stop = F.array(*[F.lit(w) for w in lx.COMMON_TOKENS])
    found = F.array_distinct(matches(F.lower(col(x)), r"[a-z0-9_]+"))
    return F.filter(found, lambda t: (F.length(t) >= 3) & ~F.array_contains(stop, t))


def acronyms(x: Column | str) -> Column:
    stop = F.array(*[F.lit(w) for w in lx.ACRONYM_STOPLIST])
    return F.array_sort(F.array_except(matches(x, "(?U)" + lx.ACRONYM, 1), stop))


def signals(x: Column | str) -> Column:
    return F.array_sort(F.array_distinct(matches(x, "(?U)" + lx.SIGNAL)))


def cross_references(x: Column | str, figures: bool = True) -> Column:
    """Section references, then figures (the first generation alone), then tables."""
    kinds = [("section", lx.SECTION_REF), *([("figure", lx.FIGURE_REF)] if figures else []), ("table", lx.TABLE_REF)]
    return F.concat(*[_kind(x, k, p) for k, p in kinds])


def _kind(x: Column | str, kind: str, pattern: str) -> Column:
    return F.transform(matches(x, "(?U)" + pattern), lambda m: F.struct(F.lit(kind).alias("kind"), m.alias("ref")))


def visual_hints(caption: Column | str, ocr: Column | str) -> Column:
    both = F.lower(F.concat_ws("\n", F.coalesce(col(caption), F.lit("")), F.coalesce(col(ocr), F.lit(""))))
    words = F.array(*[F.lit(w) for w in sorted(lx.VISUAL_HINTS)])
    return F.transform(F.filter(words, lambda w: F.contains(both, w)), F.upper)


def percent(part: Column, whole: Column, empty: float = 100.0) -> Column:
    return F.when(whole == 0, F.lit(empty)).otherwise(F.least(F.lit(100.0), F.greatest(F.lit(0.0), 100.0 * part / whole)))


def slug(x: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(strip(F.lower(col(x))), r"(?U)[^a-z0-9\s-]", ""), r"(?U)\s+", "-")


def section_slug(x: Column | str) -> Column:
    s = F.regexp_replace(F.regexp_replace(F.coalesce(col(x), F.lit("")), r"[^A-Za-z0-9]+", "_"), r"^_+|_+$", "")
    return F.when(s == "", F.lit("UNKNOWN")).otherwise(s)


def percent_text(x: Column | str) -> Column:
    """A share as a whole percentage, halves to even."""
    return F.format_string("%.0f%%", F.bround(col(x).cast("double") * 100, 0))


def preview(x: Column | str) -> Column:
    c = clean(x)
    return F.when(F.length(c) <= 120, c).otherwise(F.concat(F.substring(c, 1, 117), F.lit("...")))


def page_range(low: Column | str, high: Column | str) -> Column:
    a, b = col(low), col(high)
    return F.when(a.isNull(), F.lit("")).when(a == b, a.cast("string")).otherwise(F.concat(a.cast("string"), F.lit("–"), b.cast("string")))


def code_block(x: Column | str) -> Column:
    fence = F.when(col(x).contains("```"), F.lit("````")).otherwise(F.lit("```"))
    return F.concat(fence, F.lit("\n"), col(x), F.lit("\n"), fence)


def human_size(n: Column | str) -> Column:
    """Bytes whole, larger units with two decimals, steps of 1024."""
    v = col(n).cast("double")
    out = F.format_string("%.2f TB", F.bround(v / 1024**4, 2))
    for k, unit in ((3, "GB"), (2, "MB"), (1, "KB")):
        out = F.when(v < 1024.0 ** (k + 1), F.format_string(f"%.2f {unit}", F.bround(v / 1024.0**k, 2))).otherwise(out)
    return F.when(v < 1024, F.format_string("%.0f B", F.bround(v, 0))).otherwise(out)


def score_label(x: Column | str) -> Column:
    v = col(x)
    return F.when(v >= 90, "Excellent").when(v >= 75, "Good").when(v >= 60, "Fair").otherwise("Poor")


def status(x: Column | str, threshold: float = 95.0) -> Column:
    return F.when(col(x) >= threshold, "pass").otherwise("fail")


def requirement_id_key(index: Column | str, *fields: Column | str) -> Column:
    """REQ: and the first field that isn't empty, else the index. A record's fields in their order: requirement_id, id, identifier,
    name, req_id, requirement."""
    named = [F.nullif(clean(x), F.lit("")) for x in fields]
    return F.concat(F.lit("REQ:"), F.coalesce(*named, col(index).cast("string")))


def page_key(number: Column | str, index: Column | str) -> Column:
    return F.coalesce(col(number).cast("string"), col(index).cast("string"))


def timestamp(x: Column | None = None) -> Column:
    """A time, now if none is given, in ISO form to the second."""
    return F.date_format(F.current_timestamp() if x is None else x, "yyyy-MM-dd'T'HH:mm:ss")


def score_name(x: Column | str) -> Column:
    return F.initcap(F.regexp_replace(F.regexp_replace(col(x), "_score$", ""), "_", " "))
