"""Quality of an extraction against its source or a gold reference: counters, F1 scores, coverage and the three scores."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..functions import text as tx
from ..functions import udfs
from ..session import ready

BY = ("spec",)


def counter(rows: DataFrame, key: Column, by: tuple = BY) -> DataFrame:
    """(by, key, n)."""
    return rows.groupBy(*by, key.alias("key")).agg(F.count(F.lit(1)).alias("n"))


def requirement_counter(found: DataFrame, by: tuple = BY) -> DataFrame:
    """Counts of category|text, both in the checker's form; empty texts don't count."""
    text = tx.quality_text("text")
    return counter(found.filter(text != ""), F.concat_ws("|", tx.quality_text("category"), text), by)


def f1(expected: DataFrame, captured: DataFrame, by: tuple = BY) -> DataFrame:
    """(by, f1) of two counters (by, key, n): 100 if both are empty, 0 if one is, else of the common counts."""
    a = expected.select(*by, "key", F.col("n").alias("a"))
    b = captured.select(*by, "key", F.col("n").alias("b"))
    both = a.join(b, [*by, "key"], "full_outer").na.fill(0, ["a", "b"])
    sums = both.groupBy(*by).agg(F.sum(F.least("a", "b")).alias("tp"), F.sum("a").alias("a"), F.sum("b").alias("b"))
    value = F.when((F.col("a") == 0) & (F.col("b") == 0), 100.0).when((F.col("a") == 0) | (F.col("b") == 0), 0.0).otherwise(200.0 * F.col("tp") / (F.col("a") + F.col("b")))
    return sums.select(*by, F.round(value, 6).alias("f1"))


def counters_equal(a: DataFrame, b: DataFrame, by: tuple = BY) -> DataFrame:
    """(by, equal): whether two counters agree in every key."""
    both = a.select(*by, "key", F.col("n").alias("a")).join(b.select(*by, "key", F.col("n").alias("b")), [*by, "key"], "full_outer")
    return both.groupBy(*by).agg(F.bool_and(F.col("a").eqNullSafe(F.col("b"))).alias("equal"))


def requirement_recall(source: DataFrame, found: DataFrame, by: tuple = BY) -> DataFrame:
    """(by, expected, found, recall): requirements to source lines with a requirement phrase; 100 without any."""
    n = F.size(F.filter(tx.lines("text"), tx.is_specification))
    expected = source.groupBy(*by).agg(F.sum(n).cast("bigint").alias("expected"))
    got = found.groupBy(*by).agg(F.count(F.lit(1)).alias("found"))
    both = expected.join(got, list(by), "left").na.fill(0, ["found"])
    return both.select(*by, "expected", "found", F.round(tx.percent(F.col("found"), F.col("expected")), 6).alias("recall"))


def reference_recall(expected: DataFrame, captured: DataFrame, by: tuple = BY) -> DataFrame:
    """(by, expected, captured, recall) of distinct references (by, ref)."""
    a = expected.select(*by, "ref").distinct()
    b = captured.select(*by, "ref").distinct().withColumn("hit", F.lit(1))
    both = a.join(b, [*by, "ref"], "left").groupBy(*by).agg(F.count(F.lit(1)).alias("expected"), F.count("hit").alias("captured"))
    return both.select(*by, "expected", "captured", F.round(tx.percent(F.col("captured"), F.col("expected")), 6).alias("recall"))


def references_resolve(refs: DataFrame, found: DataFrame, captions: DataFrame, by: tuple = BY) -> DataFrame:
    """(by, total, resolved, ok): section references to sections of requirements, table references to caption numbers; figures don't count."""
    parts = refs.select(*by, F.lower(F.regexp_extract(tx.strip("ref"), lx.CROSS_REFERENCE, 1)).alias("kind"), tx.quality_text(F.regexp_extract(tx.strip("ref"), lx.CROSS_REFERENCE, 2)).alias("number")).filter("kind in ('section', 'table')")
    sections = found.filter("section is not null and section <> ''").select(*by, F.lit("section").alias("kind"), tx.quality_text("section").alias("number"))
    tables = captions.select(*by, F.lit("table").alias("kind"), tx.quality_text(F.regexp_extract(tx.strip("caption"), lx.TABLE_NUMBER, 1)).alias("number")).filter("number <> ''")
    known = sections.union(tables).distinct().withColumn("hit", F.lit(1))
    each = parts.join(known, [*by, "kind", "number"], "left").groupBy(*by).agg(F.count(F.lit(1)).alias("total"), F.count("hit").alias("resolved"))
    return each.withColumn("ok", F.col("total") == F.col("resolved"))


def traceability(source: DataFrame, found: DataFrame, by: tuple = BY) -> DataFrame:
    """(by, total, traced, share): requirements whose text stands in the source's whole text; an empty one never does.

    The source's text is one row of a document, joined by its key; each different text is looked for once."""
    parts = F.sort_array(F.collect_list(F.struct("page_number", "text")))
    whole = source.groupBy(*by).agg(tx.quality_text(F.array_join(F.transform(parts, lambda x: x["text"]), "\n")).alias("whole"))
    text = tx.quality_text("text")
    asked = found.groupBy(*by, text.alias("t")).agg(F.count(F.lit(1)).alias("n"))
    each = asked.join(whole, list(by), "left").withColumn("ok", (F.col("t") != "") & F.coalesce(F.contains("whole", "t"), F.lit(False)))
    sums = each.groupBy(*by).agg(F.sum("n").alias("total"), F.coalesce(F.sum(F.when(F.col("ok"), F.col("n"))), F.lit(0)).cast("long").alias("traced"))
    return sums.withColumn("share", F.round(tx.percent(F.col("traced"), F.col("total")), 6))


def page_fidelity(source: DataFrame, output: DataFrame, by: tuple = BY) -> DataFrame:
    """(by, fidelity): mean similarity of the texts at equal places, a missing one empty; 100 without source pages."""
    ready(source.sparkSession)
    w = Window.partitionBy(*by).orderBy("page_number")

    def placed(df: DataFrame, name: str) -> DataFrame:
        return df.select(*by, F.row_number().over(w).alias("place"), tx.quality_text("text").alias(name))

    both = placed(source, "a").join(placed(output, "b"), [*by, "place"], "left").na.fill("", ["b"])
    scored = both.withColumn("r", F.when(F.col("a") == F.col("b"), 1.0)).filter("r is not null").unionByName(both.filter("a <> b").withColumn("r", udfs._ratio("a", "b")))
    return scored.groupBy(*by).agg(F.round(F.avg(F.col("r") * 100), 6).alias("fidelity"))


def covered_pages(chunks: DataFrame, by: tuple = BY) -> DataFrame:
    """(by, covered): distinct pages of chunks (by, pages and, where given, page, page_start, page_end), from 1 on."""
    none = F.array().cast("array<int>")
    every = F.coalesce("pages", none)
    if "page" in chunks.columns:
        every = F.concat(every, F.when(F.col("page").isNotNull(), F.array("page")).otherwise(none))
    if {"page_start", "page_end"} <= set(chunks.columns):
        every = F.concat(every, F.when(F.col("page_start") <= F.col("page_end"), F.sequence("page_start", "page_end")).otherwise(none))
    return chunks.select(*by, F.explode(every).alias("p")).filter("p >= 1").groupBy(*by).agg(F.countDistinct("p").alias("covered"))


def category_consistency(found: DataFrame, by: tuple = BY, scored: bool = False) -> DataFrame:
    """(by, checks, matches, share): categories against the text's; rows with text and a category count."""
    own = tx.scored_category("text") if scored else tx.category("text")
    rows = found.filter((F.coalesce("category", F.lit("")) != "") & (F.coalesce("text", F.lit("")) != "")).groupBy(*by).agg(F.count(F.lit(1)).alias("checks"), F.count_if(F.col("category") == own).alias("matches"))
    return rows.withColumn("share", F.round(tx.percent(F.col("matches"), F.col("checks")), 6))


def page_accuracy(total: DataFrame, output: DataFrame, by: tuple = BY) -> DataFrame:
    """(by, share): how many of the pages 1..n (by, n) the output has."""
    have = output.select(*by, "page_number").distinct().join(total, list(by)).filter("page_number between 1 and n").groupBy(*by).agg(F.count(F.lit(1)).alias("have"))
    return total.join(have, list(by), "left").select(*by, F.round(tx.percent(F.coalesce("have", F.lit(0)), F.col("n")), 6).alias("share"))


def section_formats(found: DataFrame, by: tuple = BY) -> DataFrame:
    """(by, ok): whether all sections given are of the valid form."""
    ok = F.bool_and(F.when(F.coalesce("section", F.lit("")) != "", tx.valid_section("section")))
    return found.groupBy(*by).agg(F.coalesce(ok, F.lit(True)).alias("ok"))


def field_completeness(rows: DataFrame, fields: list[str], by: tuple = BY) -> DataFrame:
    """(by, filled, total, share): fields that are neither null nor empty."""
    filled = functools.reduce(lambda a, b: a + b, [(F.col(f).isNotNull() & (F.col(f).cast("string") != "")).cast("int") for f in fields])
    sums = rows.groupBy(*by).agg(F.sum(filled).alias("filled"), (F.count(F.lit(1)) * len(fields)).alias("total"))
    return sums.withColumn("share", F.round(tx.percent(F.col("filled"), F.col("total")), 6))


def required_fields(keys: DataFrame) -> DataFrame:
    """Documents (…, keys array) with the share of required top-level fields."""
    need = F.array(*[F.lit(x) for x in lx.REQUIRED_FIELDS])
    return keys.withColumn("required_json_field", tx.percent(F.size(F.array_intersect("keys", need)), F.lit(len(lx.REQUIRED_FIELDS))))


def score(components: DataFrame, by: tuple = BY) -> DataFrame:
    """(by, score, percentage, details) of components (by, score, component, value): means, details by name."""
    entries = F.map_from_entries(F.array_sort(F.collect_list(F.struct("component", F.round("value", 2)))))
    return components.groupBy(*by, "score").agg(F.avg("value").alias("percentage"), entries.alias("details"))


def report(scores: DataFrame, by: tuple = BY, threshold: float = 95.0) -> DataFrame:
    """(by, overall, status, scores): the mean of the unrounded scores; rounded for the report."""
    each = F.array_sort(F.collect_list(F.struct("score", F.round("percentage", 2).alias("percentage"), tx.status("percentage", threshold).alias("status"))))
    whole = scores.groupBy(*by).agg(F.avg("percentage").alias("p"), each.alias("scores"))
    return whole.select(*by, F.round("p", 2).alias("overall"), tx.status("p", threshold).alias("status"), "scores")


#: What a report says of how its scores are made.
FORMULAS = {
    "completeness": "mean(required_json_field, page_coverage, text_coverage, semantic_chunk_coverage, record_field_completeness)",
    "completeness_extended": "mean(required_json_field, page_coverage, text_coverage, semantic_chunk_coverage, record_field_completeness, cross_reference_recall, requirement_recall)",
    "accuracy": "mean(page_text_fidelity, requirement_traceability, category_consistency, page_number_accuracy, json_internal_consistency)",
    "accuracy_extended": "mean(page_text_fidelity, requirement_traceability, category_consistency, page_number_accuracy, json_internal_consistency, category_consistency_priority, axi_signal_fidelity, riscv_csr_fidelity)",
    "accuracy_gold": "mean(requirement_f1, figure_caption_f1, table_caption_f1, page_text_fidelity, json_internal_consistency)",
    "table_figure_capture": "mean(table_detection_f1, table_caption_f1, table_file_existence, figure_caption_f1, image_capture_f1)",
}


def formula() -> Column:
    """The formula of a score (score, details), by its parts."""
    said = lambda k: F.lit(FORMULAS[k])
    many = F.size("details") > 5
    gold = F.map_contains_key("details", "requirement_f1_score")
    made = F.when(F.col("score") == "completeness", F.when(many, said("completeness_extended")).otherwise(said("completeness")))
    made = made.when(F.col("score") == "accuracy", F.when(gold, said("accuracy_gold")).when(many, said("accuracy_extended")).otherwise(said("accuracy")))
    return made.when(F.col("score") == "table_figure_capture", said("table_figure_capture"))


def report_json(scores: DataFrame, inputs: Column, by: tuple = BY, threshold: float = 95.0) -> DataFrame:
    """(by, value): the report of each document as JSON, its scores by name with percentage, status, formula and details. inputs: a struct
    of columns that scores has by document."""
    one = F.struct(F.round("percentage", 2).alias("percentage"), tx.status("percentage", threshold).alias("status"), formula().alias("formula"), "details")
    by_name = lambda x, y: F.when(x["score"] < y["score"], -1).when(x["score"] > y["score"], 1).otherwise(0)  # noqa: E731  # maps in the values have no order
    rows = scores.withColumn("inputs", inputs).groupBy(*by).agg(F.first("inputs").alias("inputs"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("score", one.alias("value"))), by_name)).alias("scores"), F.avg("percentage").alias("p"))
    whole = F.struct("inputs", "scores", F.round("p", 2).alias("overall_percentage"), tx.status("p", threshold).alias("overall_status"))
    return rows.select(*by, F.to_json(whole, {"ignoreNullFields": "false", "pretty": "true"}).alias("value"))


def report_text(scores: DataFrame, inputs: DataFrame, by: tuple = BY, threshold: float = 95.0) -> DataFrame:
    """(by, value): the report of each document in lines; inputs: (by, json, pdf, gold_json)."""
    details = F.array_join(F.transform(F.array_sort(F.map_entries("details")), lambda x: F.format_string("  %s: %.2f%%\n", x["key"], x["value"])), "")
    one = F.concat(F.format_string("%s: %.2f%% - %s\n  formula: ", "score", "percentage", tx.status("percentage", threshold)), F.coalesce(formula(), F.lit("")), F.lit("\n"), details)
    rows = scores.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("score", one.alias("text")))).alias("each"), F.avg("percentage").alias("p")).join(inputs, list(by))
    head = F.concat(F.lit("Extractor Quality Check\n=======================\nJSON: "), F.coalesce("json", F.lit("")), F.lit("\nPDF:  "), F.coalesce("pdf", F.lit("not supplied/found")), F.coalesce(F.concat(F.lit("\nGold: "), "gold_json"), F.lit("")), F.lit("\n\n"))
    last = F.format_string("overall: %.2f%% - %s", F.col("p"), tx.status("p", threshold))
    return rows.select(*by, F.concat(head, F.array_join(F.transform("each", lambda x: x["text"]), "\n"), F.lit("\n"), last).alias("value"))


def completeness(source: DataFrame, output: DataFrame, found: DataFrame, chunks: DataFrame, by: tuple = BY) -> DataFrame:
    """Components of completeness (by, score, component, value) for the core variant, without the required fields (they need the JSON)."""
    n = source.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))
    m = output.groupBy(*by).agg(F.count(F.lit(1)).alias("pages"), F.sum(F.length("text")).alias("got"))
    cov = covered_pages(chunks, by)
    fields = field_completeness(found, ["text", "category"], by).select(*by, F.col("share").alias("record_field_completeness"))
    wide = n.join(m, list(by), "left").join(cov, list(by), "left").join(fields, list(by), "left").na.fill(0, ["pages", "got", "covered"]).na.fill(100.0, ["record_field_completeness"])
    values = {
        "page_coverage": tx.percent(F.col("pages"), F.col("n")),
        "text_coverage": tx.percent(F.least("got", "chars"), F.col("chars")),
        "semantic_chunk_coverage": tx.percent(F.col("covered"), F.col("n")),
        "record_field_completeness": F.col("record_field_completeness"),
    }
    return wide.select(*by, F.explode(F.map_from_arrays(F.array(*[F.lit(k) for k in values]), F.array(*values.values()))).alias("component", "value")).select(*by, F.lit("completeness").alias("score"), "component", F.round("value", 6).alias("value"))


# The three scores of a document. A document is a dict of tables, each with the columns ``by``: pages (page_number, text), requirements
# and page_requirements (text, category, section), figures and page_figures (caption, page_figures with page_number), tables (page,
# csv_file, caption), table_captions (page_number, caption), cross_references (ref), chunks (pages, …), images (page), keys (keys: the
# JSON's top-level names).


def components(base: DataFrame, name: str, values: dict[str, tuple[DataFrame, str, float]], by: tuple = BY) -> DataFrame:
    """(by, score, component, value) for every document of base (by): of each table a column, or a default where it has no row."""
    wide = base.select(*by).distinct()
    for component, (df, column, default) in values.items():
        wide = wide.join(df.select(*by, F.col(column).cast("double").alias(component)), list(by), "left").na.fill(default, [component])
    parts = F.map_from_arrays(F.array(*[F.lit(k) for k in values]), F.array(*[F.col(k) for k in values]))
    return wide.select(*by, F.explode(parts).alias("component", "value")).select(*by, F.lit(name).alias("score"), "component", "value")


def record_completeness(document: dict[str, DataFrame], by: tuple = BY) -> DataFrame:
    """(by, share): mean of the filled shares of requirements, figures and tables, of those that a document has."""
    fields = {"requirements": ["text", "category"], "figures": ["caption"], "tables": ["page", "csv_file"]}
    each = [field_completeness(document[k], f, by).select(*by, "share") for k, f in fields.items() if k in document]
    return functools.reduce(DataFrame.unionByName, each).groupBy(*by).agg(F.avg("share").alias("share"))


def expected_references(source: DataFrame, by: tuple = BY) -> DataFrame:
    """(by, ref): distinct section and table references of the source's pages."""
    every = F.concat(tx.matches("text", lx.SECTION_REF), tx.matches("text", lx.TABLE_REF))
    return source.select(*by, F.explode(every).alias("m")).select(*by, tx.quality_text("m").alias("ref")).distinct()


def score_completeness(source: DataFrame, document: dict[str, DataFrame], by: tuple = BY, extended: bool = False) -> DataFrame:
    """The five parts of completeness, extended by two recalls."""
    n = source.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))
    m = document["pages"].groupBy(*by).agg(F.count(F.lit(1)).alias("pages"), F.sum(F.length("text")).alias("got"))
    wide = n.join(m, list(by), "left").join(covered_pages(document["chunks"], by), list(by), "left").na.fill(0, ["pages", "got", "covered"])
    wide = wide.select(*by, tx.percent(F.col("pages"), F.col("n")).alias("page"), tx.percent(F.least("got", "chars"), F.col("chars")).alias("text"), tx.percent(F.col("covered"), F.col("n")).alias("chunk"))
    values = {
        "required_json_field_score": (required_fields(document["keys"]), "required_json_field", 0.0),
        "page_coverage_score": (wide, "page", 100.0),
        "text_coverage_score": (wide, "text", 100.0),
        "semantic_chunk_coverage_score": (wide, "chunk", 100.0),
        "record_field_completeness_score": (record_completeness(document, by), "share", 100.0),
    }
    if extended:
        captured = document["cross_references"].select(*by, tx.quality_text("ref").alias("ref"))
        values["cross_reference_recall_score"] = (reference_recall(expected_references(source, by), captured, by), "recall", 100.0)
        values["requirement_recall_score"] = (requirement_recall(source, document["requirements"], by), "recall", 100.0)
    return components(document["keys"], "completeness", values, by)


def internal_checks(document: dict[str, DataFrame], by: tuple = BY) -> DataFrame:
    """(by, five checks, share): whether a document agrees with itself."""
    caption = tx.quality_text("caption")
    named = lambda df: counter(df.filter(F.coalesce("caption", F.lit("")) != ""), caption, by)
    numbers = document["pages"].select(*by, F.col("page_number").alias("page")).distinct().withColumn("there", F.lit(True))
    valid = document["tables"].select(*by, "page").join(numbers, [*by, "page"], "left").groupBy(*by).agg(F.bool_and(F.coalesce("there", F.lit(False))).alias("ok"))
    refs = references_resolve(document["cross_references"], document["requirements"], document["tables"], by)
    checks = {
        "requirements_match_page_aggregation": counters_equal(requirement_counter(document["requirements"], by), requirement_counter(document["page_requirements"], by), by).withColumnRenamed("equal", "ok"),
        "section_format_valid": section_formats(document["requirements"], by),
        "cross_references_resolve": refs.select(*by, "ok"),
        "figures_match_page_aggregation": counters_equal(named(document["figures"]), named(document["page_figures"]), by).withColumnRenamed("equal", "ok"),
        "tables_have_valid_pages": valid,
    }
    wide = document["keys"].select(*by).distinct()
    for name, df in checks.items():
        wide = wide.join(df.select(*by, F.col("ok").alias(name)), list(by), "left").na.fill(True, [name])
    passed = functools.reduce(lambda a, b: a + b, [F.col(c).cast("int") for c in checks])
    return wide.withColumn("share", passed * (100.0 / len(checks)))


def token_fidelity(source: DataFrame, found: DataFrame, pattern: str, by: tuple = BY) -> DataFrame:
    """(by, f1) of a pattern's tokens in the source and in the requirements; documents whose source has none are left out."""
    from . import extract

    expected = extract.token_counts(source, pattern, by)
    return f1(expected, extract.token_counts(found, pattern, by), by).join(expected.select(*by).distinct(), list(by), "left_semi")


def score_accuracy(source: DataFrame, document: dict[str, DataFrame], gold: dict[str, DataFrame] | None = None, by: tuple = BY, extended: bool = False) -> DataFrame:
    """The five parts of accuracy, extended by three; against a gold document its five."""
    found = document["requirements"]
    fidelity = (page_fidelity(source, document["pages"], by), "fidelity", 100.0)
    consistency = (internal_checks(document, by), "share", 100.0)
    if gold is not None:
        caption = tx.quality_text("caption")
        named = lambda df: counter(df.filter(F.coalesce("caption", F.lit("")) != ""), caption, by)
        values = {
            "requirement_f1_score": (f1(requirement_counter(gold["requirements"], by), requirement_counter(found, by), by), "f1", 100.0),
            "figure_caption_f1_score": (f1(named(gold["figures"]), named(document["figures"]), by), "f1", 100.0),
            "table_caption_f1_score": (f1(named(gold["tables"]), named(document["tables"]), by), "f1", 100.0),
            "page_text_fidelity_score": fidelity,
            "json_internal_consistency_score": consistency,
        }
        return components(document["keys"], "accuracy", values, by)
    total = source.groupBy(*by).agg(F.count(F.lit(1)).cast("int").alias("n"))
    values = {
        "page_text_fidelity_score": fidelity,
        "requirement_traceability_score": (traceability(source, found, by), "share", 100.0),
        "category_consistency_score": (category_consistency(found, by), "share", 100.0),
        "page_number_accuracy_score": (page_accuracy(total, document["pages"], by), "share", 100.0),
        "json_internal_consistency_score": consistency,
    }
    if extended:
        values["category_consistency_priority_score"] = (category_consistency(found, by, scored=True), "share", 100.0)
        values["axi_signal_fidelity_score"] = (token_fidelity(source, found, lx.AXI_SIGNAL, by), "f1", 100.0)
        values["riscv_csr_fidelity_score"] = (token_fidelity(source, found, lx.RISCV_CSR, by), "f1", 100.0)
    return components(document["keys"], "accuracy", values, by)


def score_capture(source: DataFrame, document: dict[str, DataFrame], expected_tables: DataFrame, expected_images: DataFrame, by: tuple = BY) -> DataFrame:
    """The five parts of the table and figure capture. expected_tables, expected_images: (by, key: page as text, n) of the source;
    tables of the document may have a column exists (whether their file is there; without it none is)."""
    from . import extract

    tables = document["tables"] if "exists" in document["tables"].columns else document["tables"].withColumn("exists", F.lit(False))
    per_page = lambda df: counter(df.filter("page is not null"), F.col("page").cast("string"), by)
    shown = lambda df: counter(df.filter(F.coalesce("caption", F.lit("")) != ""), F.concat_ws(":", F.col("page_number").cast("string"), tx.quality_text("caption")), by)
    asked = expected_tables.groupBy(*by).agg(F.sum("n").alias("expected"))
    files = tables.groupBy(*by).agg(F.count(F.lit(1)).alias("records"), F.count_if(F.col("exists") & (F.coalesce("csv_file", F.lit("")) != "")).alias("there"))
    files = document["keys"].select(*by).distinct().join(files, list(by), "left").join(asked, list(by), "left").na.fill(0, ["records", "there", "expected"])
    share = F.when(F.col("records") == 0, F.when(F.col("expected") == 0, 100.0).otherwise(0.0)).otherwise(tx.percent(F.col("there"), F.col("records")))
    values = {
        "table_detection_f1_score": (f1(expected_tables, per_page(document["tables"]), by), "f1", 100.0),
        "table_caption_f1_score": (f1(extract.expected_captions(source, lx.TABLE_CAPTION, by), shown(document["table_captions"]), by), "f1", 100.0),
        "table_file_existence_score": (files.withColumn("share", share), "share", 100.0),
        "figure_caption_f1_score": (f1(extract.expected_captions(source, lx.FIGURE_CAPTION, by), shown(document["page_figures"]), by), "f1", 100.0),
        "image_capture_f1_score": (f1(expected_images, per_page(document["images"]), by), "f1", 100.0),
    }
    return components(document["keys"], "table_figure_capture", values, by)
