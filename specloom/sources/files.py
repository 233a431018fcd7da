"""Files beside documents: images, table files, metadata, and the writers of nested documents and results."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..session import ready
from .corpus import read_documents

METADATA = {"title": "title", "author": "author", "subject": "subject", "keywords": "keywords", "creator": "creator", "producer": "producer", "creation_date": "creationDate", "modification_date": "modDate"}


def metadata(info: DataFrame, column: str = "info") -> DataFrame:
    """info (…, map of a file's properties) with the struct metadata of eight nullable strings."""
    return info.withColumn("metadata", F.struct(*[F.col(column)[key].alias(name) for name, key in METADATA.items()]))


def metadata_items(documents: DataFrame, by: tuple = ("document_name",)) -> DataFrame:
    """(by, key, value) of title, version and revision, where given."""
    keys = ("title", "version", "revision")
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), F.col(f"metadata.{k}").alias("value")) for k in keys])
    return documents.select(*by, F.explode(pairs).alias("x")).select(*by, "x.key", "x.value").filter("value is not null")


def content_paths(path: Column, source_dir: Column) -> Column:
    """Where a file that a document names may be, in the order to try: as it is, beside the document, one folder up."""
    p = tx.clean(path)
    up = F.regexp_replace(source_dir, r"/[^/]*$", "")
    return F.when(p == "", F.array().cast("array<string>")).when(p.startswith("/"), F.array(p)).otherwise(F.array(p, F.concat_ws("/", source_dir, p), F.concat_ws("/", up, p)))


def source_candidates(json_dir: Column, document_name: Column) -> Column:
    """Where the source of a document may be: its name, then the folder's, each in the folder and the two above it."""
    up = F.regexp_replace(json_dir, r"/[^/]*$", "")
    stem = F.regexp_replace(F.regexp_extract(json_dir, r"([^/]*)$", 1), r"\.json$", "")
    folders = F.array(json_dir, up, F.regexp_replace(up, r"/[^/]*$", ""))
    named = F.when(F.coalesce(document_name, F.lit("")) != "", F.transform(folders, lambda d: F.concat_ws("/", d, document_name))).otherwise(F.array().cast("array<string>"))
    return F.concat(named, F.when(stem != "", F.transform(folders, lambda d: F.concat(d, F.lit("/"), stem, F.lit(".pdf")))).otherwise(F.array().cast("array<string>")))


def listing(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, length) of the files under a folder; contents aren't read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder).select(F.regexp_replace("path", r"^file:(?://)?", "").alias("path"), "length")


def first_existing(rows: DataFrame, candidates: str, files: DataFrame, by: tuple) -> DataFrame:
    """(by, found): the first candidate path that the listing has; rows without one are left out."""
    each = rows.select(*by, F.posexplode(candidates).alias("rank", "path")).join(files.select("path"), "path")
    return each.groupBy(*by).agg(F.min_by("path", "rank").alias("found"))


def table_file_existence(tables: DataFrame, files: DataFrame, by: tuple = ("spec",)) -> DataFrame:
    """(by, total, existing, share): table records (by, csv_file, base_dir) whose file is there; relative names start at base_dir."""
    path = F.when(F.col("csv_file").startswith("/"), F.col("csv_file")).otherwise(F.concat_ws("/", "base_dir", "csv_file"))
    joined = tables.withColumn("path", path).join(files.select("path").withColumn("hit", F.lit(1)), "path", "left")
    sums = joined.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("hit").isNotNull() & (F.col("csv_file") != "")).alias("existing"))
    return sums.withColumn("share", tx.percent(F.col("existing"), F.col("total")))


def named_images(images: DataFrame, by: tuple = ("spec",)) -> DataFrame:
    """Images (by, page_number, pos, ext) with their running number in the document and file name."""
    w = Window.partitionBy(*by).orderBy("page_number", "pos")
    return images.withColumn("n", F.row_number().over(w)).withColumn("file", F.format_string("image_%04d.%s", "n", "ext"))


def page_images(pages: DataFrame, images: DataFrame, by: tuple = ("spec",)) -> DataFrame:
    """Pages with the array of their images (by, page_number, file)."""
    mine = images.groupBy(*by, "page_number").agg(F.sort_array(F.collect_list("file")).alias("images"))
    return pages.join(mine, [*by, "page_number"], "left").withColumn("images", F.coalesce("images", F.array().cast("array<string>")))


def table_files(tables: DataFrame) -> DataFrame:
    """Tables (…, page_number, table_idx) with the name of their CSV file."""
    return tables.withColumn("csv_file", F.format_string("table_p%d_%d.csv", "page_number", "table_idx"))


def no_description(image: bytes, prompt: str) -> str:
    return ""


def described(images: DataFrame, describe: Callable[[bytes, str], str] = no_description, prompt: str = "Describe the image.") -> DataFrame:
    """Images (…, content binary) with accessibility_description by a caller's function; a failure describes nothing."""
    ready(images.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for content in frame["content"]:
                try:
                    out.append(describe(bytes(content), prompt))
                except Exception:  # a provider's failure is an empty description, as for the caller's own errors
                    out.append("")
            frame["accessibility_description"] = out
            yield frame

    return images.mapInPandas(run, images.drop("accessibility_description").schema.add("accessibility_description", "string"))


def layout_text(spans: DataFrame, x0: float, y0: float, x1: float, y1: float) -> DataFrame:
    """Spans (…, text, x, y) inside a rectangle."""
    return spans.filter(F.col("x").between(x0, x1) & F.col("y").between(y0, y1))


def documents(tables: dict[str, DataFrame], pages: DataFrame, by: tuple = ("spec", "version")) -> DataFrame:
    """One nested row a document from its child tables (as of plans.facade.extract_pages), lists in page order."""
    keys = pages.groupBy(*by).agg(F.count(F.lit(1)).alias("total_pages"), F.sort_array(F.collect_list(F.struct("page_number", "text"))).alias("pages"))
    for name, df in tables.items():
        order = [c for c in ("page_number", "pos", "chunk") if c in df.columns]
        rest = [c for c in df.columns if c not in (*by, *order)]
        rows = F.sort_array(F.collect_list(F.struct(*order, *rest)))
        keys = keys.join(df.groupBy(*by).agg(rows.alias(name)), list(by), "left")
    return keys


def write_json(df: DataFrame, path: str, by: tuple = ()) -> None:
    """Rows as indented JSON texts, one file a partition; by partitions the folder."""
    body = df.select(*by, F.to_json(F.struct(*[c for c in df.columns]), {"pretty": "true"}).alias("value"))
    writer = body.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).text(path)


def chunk_pages(chunks: DataFrame, by: tuple = ("spec", "version")) -> DataFrame:
    """Distinct pages that chunks cover, in order."""
    return chunks.select(*by, F.explode("pages").alias("page")).distinct().orderBy(*by, "page")


def encoded(images: DataFrame) -> DataFrame:
    """Images (…, content binary) with base64, as text without line breaks."""
    return images.withColumn("base64", F.regexp_replace(F.base64("content"), r"[\r\n]+", ""))


def read_any(spark: SparkSession, path: str, pdf: Callable[[SparkSession, str], DataFrame] | None = None) -> DataFrame:
    """Documents of a path by its ending: of a PDF by the caller's reader, of anything else as document JSON."""
    if path.lower().endswith(".pdf"):
        if pdf is None:
            raise ValueError("a reader of PDF files must be given")
        return pdf(spark, path)
    return read_documents(spark, path)


def exit_code(report: DataFrame) -> int:
    """0 if every document of a quality report passes, else 1."""
    return int(report.filter("status <> 'pass'").limit(1).count() > 0)
