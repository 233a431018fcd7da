"""Extraction: pages (keys, page_number, text) to headings, requirements, notes, references, sections and chunks.

``by`` names the columns that tell one document from another. Generators are narrow; what needs a document's order is a window over
it, one shuffle by document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..functions import text as tx

BY = ("spec", "version")


def _explode(pages: DataFrame, by: tuple, values: Column, name: str) -> DataFrame:
    return pages.select(*by, "page_number", F.posexplode(values).alias("pos", name))


def page_lines(pages: DataFrame, by: tuple = BY) -> DataFrame:
    """(by, page_number, pos, line): stripped lines."""
    return _explode(pages, by, tx.stripped_lines("text"), "line")


def _heading(line: Column, pattern: str) -> Column:
    """Whether a line is a heading by the common rules."""
    title = F.regexp_extract(line, pattern, 2)
    return (
        (line != "")
        & ~F.lower(line).startswith("chapter")
        & ~line.rlike(r"\.{3,}\s*\d+$")
        & ~line.rlike(r"^\d+$")
        & line.rlike(pattern)
        & (F.length(tx.strip(title)) >= 3)
    )


def marked_lines(pages: DataFrame, by: tuple = BY) -> DataFrame:
    """The page_lines that headings, notes, figures and table_captions are made of: few, so that they can be kept for all of them."""
    line = F.col("line")
    return page_lines(pages, by).filter(line.rlike("(?U)" + lx.NOTE) | line.rlike("(?U)" + lx.FIGURE_CAPTION) | line.rlike(lx.TABLE_CAPTION) | _heading(line, lx.SECTION))


def headings(pages: DataFrame, by: tuple = BY, lines: DataFrame | None = None) -> DataFrame:
    """First generation: every heading line of a page, font_size null. lines: the pages' lines, or their marked_lines."""
    found = (page_lines(pages, by) if lines is None else lines).filter(_heading(F.col("line"), lx.SECTION))
    return found.select(*by, "page_number", "pos", F.regexp_extract("line", lx.SECTION, 1).alias("section_id"), tx.strip(F.regexp_extract("line", lx.SECTION, 2)).alias("title"), F.lit(None).cast("double").alias("font_size"))


def first_heading(pages: DataFrame, by: tuple = BY, most: int = 80) -> DataFrame:
    """Third generation: the first heading in the first lines of a page; its id is lettered or dotted."""
    found = F.filter(F.slice(tx.stripped_lines("text"), 1, most), lambda x: _heading(x, lx.SECTION_DOTTED) & F.regexp_extract(x, lx.SECTION_DOTTED, 1).rlike(r"^(?:[A-C]\d+(?:\.\d+)*|\d+(?:\.\d+)+)$"))
    line = F.get(found, F.lit(0))
    return pages.select(*by, "page_number", line.alias("line")).filter("line is not null").select(*by, "page_number", F.regexp_extract("line", lx.SECTION_DOTTED, 1).alias("section_id"), tx.strip(F.regexp_extract("line", lx.SECTION_DOTTED, 2)).alias("title"))


def layout_headings(blocks: DataFrame, by: tuple = BY) -> DataFrame:
    """Headings of layout blocks (by, page_number, pos, type, spans array<struct<text, size>>): text blocks alone, size of the largest span."""
    line = tx.strip(F.array_join(F.transform("spans", lambda s: s["text"]), ""))
    size = F.array_max(F.transform("spans", lambda s: s["size"].cast("double")))
    found = blocks.filter("type = 0").withColumn("line", line).withColumn("font_size", size).filter(_heading(F.col("line"), lx.SECTION))
    return found.select(*by, "page_number", "pos", F.regexp_extract("line", lx.SECTION, 1).alias("section_id"), tx.strip(F.regexp_extract("line", lx.SECTION, 2)).alias("title"), "font_size")


def page_headings(pages: DataFrame, layout: DataFrame | None = None, by: tuple = BY) -> DataFrame:
    """Third-generation precedence: the text heading, else the layout's, else the first in twenty lines."""
    found = first_heading(pages, by).withColumn("rank", F.lit(0)).withColumn("pos", F.lit(0)).withColumn("font_size", F.lit(None).cast("double"))
    cols = [*by, "page_number", "pos", "section_id", "title", "font_size", "rank"]
    found = found.select(*cols)
    if layout is not None:
        found = found.union(layout_headings(layout, by).withColumn("rank", F.lit(1)).select(*cols))
    last = headings(pages, by).filter("pos < 20").withColumn("rank", F.lit(2)).withColumn("n", F.row_number().over(Window.partitionBy(*by, "page_number").orderBy("pos"))).filter("n = 1")
    found = found.union(last.select(*cols))
    best = F.min("rank").over(Window.partitionBy(*by, "page_number"))
    return found.withColumn("best", best).filter("rank = best").drop("best", "rank")


def page_sections(pages: DataFrame, found: DataFrame | None = None, by: tuple = BY) -> DataFrame:
    """(by, page_number, section): the last heading's section on or before each page, Unknown before any."""
    found = headings(pages, by) if found is None else found
    last = found.groupBy(*by, "page_number").agg(F.max_by("section_id", "pos").alias("own"))
    w = Window.partitionBy(*by).orderBy("page_number").rowsBetween(Window.unboundedPreceding, 0)
    return pages.select(*by, "page_number").join(last, [*by, "page_number"], "left").select(*by, "page_number", F.coalesce(F.last("own", True).over(w), F.lit("Unknown")).alias("section"))


def section_tree(found: DataFrame, by: tuple = BY) -> DataFrame:
    """Headings with their parent's id."""
    return found.select(*by, "page_number", "pos", F.col("section_id").alias("id"), "title", tx.parent_section("section_id").alias("parent"))


def requirements(pages: DataFrame, by: tuple = BY) -> DataFrame:
    """First generation: sentences with a requirement phrase, and their category."""
    found = _explode(pages, by, tx.sentences("text"), "text").filter(tx.is_requirement("text"))
    return found.select(*by, "page_number", "pos", tx.category("text").alias("category"), "text")


def notes(pages: DataFrame, by: tuple = BY, lines: DataFrame | None = None) -> DataFrame:
    """Lines that open with a note word; the type is all before the first colon, in capitals."""
    found = (page_lines(pages, by) if lines is None else lines).filter(F.col("line").rlike("(?U)" + lx.NOTE))
    return found.select(*by, "page_number", "pos", tx.strip(F.upper(F.split_part("line", F.lit(":"), F.lit(1)))).alias("type"), F.col("line").alias("text"))


def acronyms(pages: DataFrame, by: tuple = BY) -> DataFrame:
    """Distinct acronyms of each document."""
    return pages.select(*by, F.explode(tx.acronyms("text")).alias("acronym")).distinct()


def signals(pages: DataFrame, by: tuple = BY) -> DataFrame:
    return pages.select(*by, "page_number", F.explode(tx.signals("text")).alias("signal"))


def cross_references(pages: DataFrame, by: tuple = BY, figures: bool = True) -> DataFrame:
    return _explode(pages, by, tx.cross_references("text", figures), "x").select(*by, "page_number", "pos", "x.kind", "x.ref")


def table_captions(pages: DataFrame, by: tuple = BY, lines: DataFrame | None = None) -> DataFrame:
    return (page_lines(pages, by) if lines is None else lines).filter(F.col("line").rlike(lx.TABLE_CAPTION)).withColumnRenamed("line", "caption")


def figures(pages: DataFrame, by: tuple = BY, headings: DataFrame | None = None, lines: DataFrame | None = None) -> DataFrame:
    """Figure caption lines with the page's section."""
    found = (page_lines(pages, by) if lines is None else lines).filter(F.col("line").rlike("(?U)" + lx.FIGURE_CAPTION)).withColumnRenamed("line", "caption")
    return found.join(page_sections(pages, headings, by), [*by, "page_number"])


def semantic_chunks(pages: DataFrame, found: DataFrame | None = None, by: tuple = BY) -> DataFrame:
    """Gaps and islands: a page with headings opens a chunk; pages before the first are left out."""
    found = headings(pages, by) if found is None else found
    last = found.groupBy(*by, "page_number").agg(F.max_by("section_id", "pos").alias("own"))
    w = Window.partitionBy(*by).orderBy("page_number").rowsBetween(Window.unboundedPreceding, 0)
    marked = pages.join(last, [*by, "page_number"], "left").withColumn("chunk", F.sum(F.col("own").isNotNull().cast("int")).over(w)).filter("chunk > 0")
    parts = F.sort_array(F.collect_list(F.struct("page_number", "text")))
    chunks = marked.groupBy(*by, "chunk").agg(F.max("own").alias("section"), parts.alias("parts"))
    return chunks.select(*by, "chunk", "section", F.transform("parts", lambda x: x["page_number"]).alias("pages"), tx.strip(F.array_join(F.transform("parts", lambda x: x["text"]), "\n")).alias("text"))


def first_occurrences(found: DataFrame, by: tuple = BY) -> DataFrame:
    """Of requirements with the same key in a document the first by page and place."""
    w = Window.partitionBy(*by, "key").orderBy("page_number", "pos")
    return found.withColumn("key", tx.requirement_key("text")).withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n", "key")


def with_ids(found: DataFrame, by: tuple = BY, section: str = "section") -> DataFrame:
    """REQ_<section>_<number>: numbered by page and place in each section of a document."""
    w = Window.partitionBy(*by, "slug").orderBy("page_number", "pos")
    out = found.withColumn("slug", tx.section_slug(section)).withColumn("n", F.row_number().over(w))
    return out.withColumn("id", F.format_string("REQ_%s_%03d", "slug", "n")).drop("slug", "n")


#: The ordered clean-up of the third generation: (kind, pattern, replacement); R replaces, S skips the sentence, P skips where a part is found.
CLEANUP = [
    ("R", r"^[A-Z][A-Za-z0-9\- ]{2,80}\s*[–-]\s*(?=(?:If|When|The|A|An|For|It)\b)", ""),
    ("R", r"(?i)^(?:Name\s+Width\s+Default\s+Description\s+)+", ""),
    ("S", r"(?i)^[A-Z0-9_, ]+\s+(?:are|is)\s+(?:present|not present)\.?$", None),
    ("R", r"•\s*", ""),
    ("R", r"(?i)^.*?The required behavior .*?:\s*", ""),
    ("R", r"^[A-Z0-9_, ]+\s+\d+\s+0x[0-9A-Fa-f]+\s+", ""),
    ("S", r"^$|:$", None),
    ("S", r"^(?:Name|Width|Default|Description)(?:\s+\w+){2,}$|This section describes ", None),
    ("S", r"^\[\d+\]\s+|^Table ", None),
    ("S", r"^[A-C]\d+(?:\.\d+)*\s+", None),
    ("S", r"^In this specification", None),
    ("S", r"^[A-Z][A-Za-z ]+\s+[A-C]\d+(?:\.\d+)*\.?$|^Chapter\s+[A-Z]\d+\.?$", None),
    ("S", r"^ARM IHI|Copyright|^All rights reserved\.$|^Non-confidential\s+\d+$", None),
    ("S", r"^See |^(?i:however,)", None),
]
#: Words from which on a sentence that ends in a colon is the parent of the bullets after it.
PARENT_START = r"(?iU)\b(?:Must not|Must|Shall|Should|Cannot|Can|May|If|When|The)\b.*$"


def specification_sentences(pages: DataFrame, by: tuple = BY) -> DataFrame:
    """Third generation: sentences and bullets after the ordered clean-up, with a requirement phrase. A page is a row and is done with in
    one expression over arrays: as columns and filters of their own, the steps would be put into one another and run again and again."""
    kept = F.array_join(F.filter(F.split("text", tx.LINE_BREAK), lambda x: ~x.rlike(r"(?iU)^\s*(?:Figure|Table)\s+")), "\n")
    # runs of white space that aren't one space already
    whole = F.trim(F.regexp_replace(kept, rf"(?U)(?! ){tx.WS}{tx.WS}*+| {tx.WS}++", " "))
    for p in (r"(?iU)Figure\s+[A-Za-z]?\d+(?:\.\d+)*:\s*[^\n.]*", r"(?iU)Table\s+[A-Za-z]?\d+(?:\.\d+)*:\s*[^\n.]*", r"(?:\b\d+\s+){3,}[A-Z][A-Z\s]{10,}"):
        whole = F.regexp_replace(whole, p, "")
    whole = F.regexp_replace(whole, r":\s*•", ": •")
    # squashed texts have no white space but spaces
    parts = F.filter(F.transform(F.split(whole, r"(?U)(?=•)|(?<=[.!?])\s+"), lambda s: F.trim(s)), lambda s: s != "")
    rows = F.filter(tx.bound(parts, _with_parents), lambda x: x["text"].contains("•") | x["text"].rlike(lx.SPECIFICATION_NEAR))
    replaced = lambda p, new: lambda x: F.struct(x["pos"].alias("pos"), tx.strip(F.regexp_replace(x["text"], p, new)).alias("text"))
    without = lambda p: lambda x: ~x["text"].rlike(p)
    for kind, pattern, new in CLEANUP:
        rows = F.transform(rows, replaced(pattern, new)) if kind == "R" else F.filter(rows, without(pattern))
    rows = F.filter(rows, lambda x: tx.bound(tx.squash(x["text"]), tx.relevant))
    return pages.select(*by, "page_number", F.explode(rows).alias("x")).select(*by, "page_number", "x.pos", "x.text")


def _with_parents(parts: Column) -> Column:
    """array<struct<pos, text>> of a page's sentences but for those that open bullets, which go before each bullet up to the next such."""
    opens = lambda s: s.endswith(":") & ~s.startswith("•") & tx.is_specification(s)
    start = lambda s: F.coalesce(F.nullif(F.regexp_extract(s, PARENT_START, 0), F.lit("")), s)
    plain = F.transform(parts, lambda s, k: F.struct(k.alias("pos"), s.alias("text")))
    numbered = F.transform(parts, lambda s, k: F.struct(k.alias("pos"), s.alias("text"), F.when(opens(s), start(s)).alias("parent")))

    def runs(rows: Column) -> Column:
        """Sentences between two that open bullets, with the first one's text."""
        none = F.struct(F.lit(-1).alias("pos"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("parent"))
        openers = F.filter(rows, lambda x: x["parent"].isNotNull())
        run = lambda o: lambda x, k: F.struct(x["parent"].alias("parent"), F.slice(rows, x["pos"] + 2, F.coalesce(F.get(o, k)["pos"], F.size(rows)) - x["pos"] - 1).alias("rows"))
        return tx.bound(openers, lambda o: F.transform(F.concat(F.array(none), o), run(o)))

    def told(run: Column) -> Column:
        text = lambda x: F.when(x["text"].startswith("•") & run["parent"].isNotNull(), F.concat_ws(" ", run["parent"], x["text"])).otherwise(x["text"])
        return F.transform(run["rows"], lambda x: F.struct(x["pos"].alias("pos"), text(x).alias("text")))

    return F.when(F.exists(parts, opens), F.flatten(F.transform(tx.bound(numbered, runs), told))).otherwise(plain)


def encoding_rules(pages: DataFrame, by: tuple = BY) -> DataFrame:
    """Rows ``code | operation | meaning`` of encoding tables in running text; a meaning ends at the next row, at a section number, a
    table or a page's foot."""
    pattern = "(?U)" + lx.ENCODING_RULE
    found = F.arrays_zip(F.regexp_extract_all("text", F.lit(pattern), F.lit(1)).alias("code"), F.regexp_extract_all("text", F.lit(pattern), F.lit(2)).alias("op"), F.regexp_extract_all("text", F.lit(pattern), F.lit(3)).alias("meaning"))
    rows = _explode(pages, by, found, "x").select(*by, "page_number", "pos", "x.code", "x.op", tx.squash(F.regexp_replace("x.meaning", r"([a-z])([A-Z])", "$1 $2")).alias("meaning"))
    rows = rows.filter(tx.is_specification("meaning") | tx.is_feature("meaning"))
    return rows.select(*by, "page_number", "pos", F.concat_ws(" | ", "code", "op", "meaning").alias("text"), F.lit("encoding_rule").alias("type"))


def with_record(found: DataFrame, kind: str | None = None) -> DataFrame:
    """Requirements (…, text, section) with the rest of a record: source_section, signals and type (kind where there is none)."""
    out = found.withColumn("source_section", F.col("section")).withColumn("signals", tx.signals("text"))
    return out if "type" in found.columns else out.withColumn("type", F.lit(kind))


def table_row_requirements(cells: DataFrame) -> DataFrame:
    """Rows of tables (…, cells array<string>) with two filled cells or more and a requirement or feature, joined."""
    filled = F.filter(F.transform("cells", tx.clean), lambda x: x != "")
    return cells.withColumn("text", F.array_join(filled, " ")).filter((F.size(filled) >= 2) & (tx.is_specification("text") | tx.is_feature("text")))


def without_headings(pages: DataFrame, found: DataFrame, by: tuple = BY) -> DataFrame:
    """Pages without the lines that open with a section id of theirs or equal a heading's title."""
    mine = found.groupBy(*by, "page_number").agg(F.collect_set("section_id").alias("ids"), F.collect_set("title").alias("titles"))
    line_of = lambda ids, titles: lambda x: ~(F.exists(ids, lambda i: tx.strip(x).startswith(i)) | F.array_contains(titles, tx.strip(x)))
    joined = pages.join(mine, [*by, "page_number"], "left")
    none = F.array().cast("array<string>")
    kept = F.array_join(F.filter(tx.lines("text"), line_of(F.coalesce("ids", none), F.coalesce("titles", none))), "\n")
    return joined.withColumn("text", kept).drop("ids", "titles")


def uncovered(found: DataFrame, of_tables: DataFrame, by: tuple = BY) -> DataFrame:
    """Page requirements that no table requirement of the page covers; pages without table requirements keep all."""
    mine = of_tables.groupBy(*by, "page_number").agg(F.collect_set(tx.bare("text")).alias("rows"))
    b = tx.bare("text")
    covered = F.exists("rows", lambda r: b.contains(r) | r.contains(b)) | F.col("text").contains("as shown in Table") | F.col("text").contains("Operation Meaning") | F.col("text").startswith("0b")
    return found.join(mine, [*by, "page_number"], "left").filter(F.col("rows").isNull() | ~covered).drop("rows")


def is_cover(text: Column | str) -> Column:
    """A chapter's cover page: its title first, no section next, and at least three section lines."""
    found = F.filter(tx.stripped_lines(text), lambda x: x != "")
    entries = F.filter(found, lambda x: x.rlike(r"^•?\s*[A-Z]\d+\.\d+"))
    return F.coalesce(F.get(found, F.lit(0)).rlike(r"^Chapter\s+[A-Z]\d+") & ~F.coalesce(F.get(found, F.lit(1)), F.lit("")).startswith("A") & (F.size(entries) >= 3), F.lit(False))


def expected_captions(pages: DataFrame, pattern: str, by: tuple = BY) -> DataFrame:
    """(by, key page:line, n): caption lines of the source pages."""
    found = page_lines(pages, by).filter(F.col("line").rlike("(?U)" + pattern))
    return found.groupBy(*by, F.concat_ws(":", F.col("page_number").cast("string"), tx.quality_text("line")).alias("key")).agg(F.count(F.lit(1)).alias("n"))


def token_counts(rows: DataFrame, pattern: str, by: tuple = BY) -> DataFrame:
    """(by, key, n): the tokens of a pattern in text, in capitals."""
    return rows.select(*by, F.explode(tx.matches("text", "(?U)" + pattern)).alias("m")).groupBy(*by, F.upper("m").alias("key")).agg(F.count(F.lit(1)).alias("n"))
