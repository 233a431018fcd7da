"""Page-local extraction on streams: requirements, notes and references need no other page, so they run on a stream as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import extract


def stream_requirements(pages: DataFrame, by: tuple = extract.BY) -> DataFrame:
    """Requirements of a streaming DataFrame of pages (by, page_number, text); stateless, in append mode."""
    return extract.requirements(pages, by)


def stream_notes(pages: DataFrame, by: tuple = extract.BY) -> DataFrame:
    return extract.notes(pages, by)


def stream_cross_references(pages: DataFrame, by: tuple = extract.BY) -> DataFrame:
    return extract.cross_references(pages, by)
