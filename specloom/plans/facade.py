"""Whole runs: extraction of pages, comparison of two versions, the verification-plan filter."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import compare, extract, reports
from ..session import kept


def extract_pages(pages: DataFrame, by: tuple = extract.BY, lines: DataFrame | None = None) -> dict[str, DataFrame]:
    """The child tables of every document of pages (by, page_number, text). lines: the pages' marked_lines, if they are there."""
    found = extract.headings(pages, by, lines)
    return {
        "headings": found,
        "sections": extract.section_tree(found, by),
        "requirements": extract.requirements(pages, by).join(extract.page_sections(pages, found, by), [*by, "page_number"]),
        "notes": extract.notes(pages, by, lines),
        "acronyms": extract.acronyms(pages, by),
        "cross_references": extract.cross_references(pages, by),
        "table_captions": extract.table_captions(pages, by, lines),
        "figures": extract.figures(pages, by, found, lines),
        "semantic_chunks": extract.semantic_chunks(pages, found, by),
    }


def extract_specification(pages: DataFrame, layout: DataFrame | None = None, by: tuple = extract.BY) -> dict[str, DataFrame]:
    """The third generation's run over pages (by, page_number, text), with layout blocks (by, page_number, pos, type, spans) if there are
    any: headings by precedence, sections carried forward, requirements (by, page_number, pos, section, text, type, source_section,
    signals, id) of pages that are no chapter's cover, without heading lines; sentences that rules of encoding tables cover give way to
    these, texts count once in a document, ids run by section."""
    found = extract.page_headings(pages, layout, by)
    body = extract.without_headings(pages.filter(~extract.is_cover("text")), found, by)
    rules = extract.encoding_rules(body, by)
    said = extract.uncovered(extract.specification_sentences(body, by), rules, by)
    rows = said.select(*by, "page_number", F.struct(F.lit(0).alias("k"), "pos").alias("pos"), "text", F.lit("protocol_rule").alias("type"))
    rows = rows.union(rules.select(*by, "page_number", F.struct(F.lit(1).alias("k"), "pos").alias("pos"), "text", "type"))
    rows = extract.first_occurrences(rows, by).join(extract.page_sections(pages, found, by), [*by, "page_number"])
    rows = extract.with_record(extract.with_ids(rows, by))
    place = F.row_number().over(Window.partitionBy(*by, "page_number").orderBy("pos")) - 1
    return {
        "headings": found,
        "sections": extract.section_tree(found, by),
        "requirements": rows.withColumn("pos", place),
        "notes": extract.notes(pages, by),
        "acronyms": extract.acronyms(pages, by),
        "cross_references": extract.cross_references(pages, by),
        "table_captions": extract.table_captions(pages, by),
        "semantic_chunks": extract.semantic_chunks(pages, found, by),
    }


def items(rows: DataFrame, content: str, by: tuple = ("spec",), label: str | None = None) -> DataFrame:
    """Rows (by, page_number, pos, …) as items of a comparison, numbered by page and place."""
    w = Window.partitionBy(*by).orderBy("page_number", "pos")
    section = F.col("section") if "section" in rows.columns else F.lit(None).cast("string")
    shown = tx.preview(content) if label is None else F.coalesce(F.nullif(tx.preview(content), F.lit("")), F.lit(label))
    return rows.select(*by, (F.row_number().over(w) - 1).alias("idx"), F.col(content).alias("content"), shown.alias("preview"), F.col("page_number").alias("page"), section.alias("section"))


def section_keys(sections: DataFrame, by: tuple = ("spec",)) -> DataFrame:
    """Sections (by, index from 1, id, title) with key: the id, or one made of title and index; a key that came before gets the index."""
    made = F.concat_ws(":", F.lit("title"), tx.stable_hash("title"), F.col("index").cast("string"))
    w = Window.partitionBy(*by, "key").orderBy("index")
    keyed = sections.withColumn("key", F.coalesce(F.nullif(tx.clean("id"), F.lit("")), made)).withColumn("n", F.row_number().over(w))
    return keyed.withColumn("key", F.when(F.col("n") > 1, F.concat_ws(":", "key", F.col("index").cast("string"))).otherwise(F.col("key"))).drop("n")


def version_tables(pages: DataFrame, by: tuple = ("spec",), lines: DataFrame | None = None) -> dict[str, DataFrame]:
    """What a comparison needs of one version's pages (by, page_number, text)."""
    made = extract_pages(pages, by, lines)
    w = Window.partitionBy(*by).orderBy("page_number", "pos")
    sections = section_keys(made["sections"].withColumn("index", F.row_number().over(w)), by)
    return {
        "section": sections.select(*by, "key", "title"),
        "requirement": items(made["requirements"], "text", by),
        "note": items(made["notes"], "text", by),
        "figure": items(made["figures"], "caption", by, "Figure"),
        "table": items(made["table_captions"], "caption", by, "Table"),
        "page": pages.select(*by, (F.row_number().over(Window.partitionBy(*by).orderBy("page_number")) - 1).alias("idx"), F.col("page_number").alias("page"), F.col("text").alias("content")),
    }


def compare_pages(old: DataFrame, new: DataFrame, by: tuple = ("spec",)) -> DataFrame:
    """All changes between two versions of pages (by, page_number, text)."""
    old, new = (kept(x.select(*by, "page_number", "text"), "pages") for x in (old, new))
    made = [version_tables(x, by, kept(extract.marked_lines(x, by), "lines")) for x in (old, new)]
    return compare.compare(*made, by)


def compare_and_write(old: DataFrame, new: DataFrame, folder: str, by: tuple = ("spec",)) -> DataFrame:
    changes = compare_pages(old, new, by).cache()
    write_reports(changes, folder)
    return changes


def write_reports(changes: DataFrame, folder: str, header: dict[str, str | None] | None = None) -> None:
    """The three reports in folders of their own."""
    reports.write_csv(changes, f"{folder}/version_differences.csv")
    reports.write_json(changes, f"{folder}/version_differences.json", header)
    reports.write_markdown(changes, f"{folder}/version_differences.md")


def write_results(results: dict[str, DataFrame], folder: str) -> None:
    """Results (the two extractions, the plan's material, the changes, the quality report) as JSON lines, each in a folder of its name."""
    for name, df in results.items():
        df.write.mode("overwrite").option("ignoreNullFields", False).json(f"{folder}/{name}.json")


def plan_filter(sections: DataFrame, by: tuple = extract.BY, hook: Callable[[DataFrame], DataFrame] | None = None, most: int = 5, fallback: int = 3) -> DataFrame:
    """(by, section, content): the first sections of a valid form, else the first ones; hook replaces the choice.

    Sections are rows (by, page_number, pos, id, title)."""
    if hook is not None:
        return hook(sections)
    w = Window.partitionBy(*by).orderBy("page_number", "pos")
    rows = sections.withColumn("ok", tx.valid_section("id"))
    ranked = rows.withColumn("n", F.row_number().over(Window.partitionBy(*by, "ok").orderBy("page_number", "pos"))).withColumn("place", F.row_number().over(w)).withColumn("any", F.max("ok").over(Window.partitionBy(*by)))
    chosen = ranked.filter((F.col("any") & F.col("ok") & (F.col("n") <= most)) | (~F.col("any") & (F.col("place") <= fallback)))
    return chosen.select(*by, F.col("id").alias("section"), F.substring("title", 1, 80).alias("content"))
