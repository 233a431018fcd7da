"""Inputs: the specification view of documents, document JSON, table CSV, agent answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx

#: A source's documents numbered in order of doc_id: in parts of 4,096 ids, and over the parts' sizes, so that no task orders a source.
NUMBERED = """
WITH parts AS (
  SELECT source, doc_id - doc_id % 4096 AS part, count(*) AS n FROM {documents} GROUP BY source, doc_id - doc_id % 4096),
ahead AS (
  SELECT source, part, coalesce(sum(n) OVER (PARTITION BY source ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM parts),
inside AS (
  SELECT source, doc_id, text, doc_id - doc_id % 4096 AS part,
         row_number() OVER (PARTITION BY source, doc_id - doc_id % 4096 ORDER BY doc_id) AS place FROM {documents}),
base AS (
  SELECT i.source AS spec, i.doc_id, coalesce(i.text, '') AS text, CAST(a.before + i.place AS INT) AS pn
  FROM inside i JOIN ahead a ON i.source = a.source AND i.part = a.part),
"""
#: The same numbers in one step, for the oracle.
NUMBERED_PLAINLY = """
WITH base AS (
  SELECT source AS spec, doc_id, coalesce(text, '') AS text,
         CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) AS INT) AS pn
  FROM documents),
"""
#: A source as a specification, its documents as whole pages, version 2 as a fixed edit of version 1. The same in Spark and DuckDB. A
#: document is missing from one version at most.
CORPUS_SQL = """
v AS (SELECT 1 AS version UNION ALL SELECT 2 AS version),
p AS (
  SELECT b.spec, v.version, b.doc_id,
         CASE WHEN v.version = 2 THEN b.pn + 1 ELSE b.pn END AS page_number,
         CONCAT(
           CASE WHEN b.pn % 3 = 1 THEN CONCAT('A', CAST(1 + b.pn % 9 AS STRING), '.', CAST(b.pn % 5 AS STRING), ' Channel signals', chr(10)) ELSE '' END,
           b.text, '.', chr(10),
           'The manager ', CASE WHEN v.version = 2 AND b.doc_id % 11 = 0 THEN 'should' ELSE 'must' END,
           ' hold AWVALID for ', CAST(b.doc_id % 17 + CASE WHEN v.version = 2 AND b.doc_id % 7 = 0 THEN 1 ELSE 0 END AS STRING),
           ' cycles. See Section 2.', CAST(b.doc_id % 4 AS STRING), ' and Table A', CAST(1 + b.pn % 9 AS STRING), '-1.', chr(10),
           CASE WHEN b.doc_id % 5 = 0 THEN CONCAT('NOTE: page ', CAST(b.doc_id AS STRING), ' is informative.', chr(10)) ELSE '' END,
           CASE WHEN b.doc_id % 4 = 0 THEN CONCAT('Table A', CAST(1 + b.pn % 9 AS STRING), '-1: Signal list', chr(10)) ELSE '' END) AS text
  FROM base b CROSS JOIN v
  WHERE NOT (v.version = 2 AND b.doc_id % 13 = 0) AND NOT (v.version = 1 AND b.doc_id % 19 = 0 AND b.doc_id % 13 <> 0))
SELECT spec, version, page_number, text FROM p
"""

ITEM = "struct<page: int, page_number: int, source_page: int, section: string, source_section: string, category: string, text: string, id: string, type: string, signals: array<string>>"
DOCUMENT = f"""document_name string, total_pages int,
metadata struct<title: string, author: string, subject: string, keywords: string, creator: string, producer: string, creation_date: string, modification_date: string, version: string, revision: string>,
sections array<struct<id: string, title: string, parent: string>>, requirements array<{ITEM}>,
figures array<struct<page: int, section: string, caption: string, ocr_text: string>>,
tables array<struct<page: int, csv_file: string, caption: string, title: string, text: string, ocr_text: string, accessibility_description: string>>,
notes array<struct<type: string, text: string, source_page: int, page: int, section: string>>,
acronyms array<string>, cross_references array<string>,
semantic_chunks array<struct<section: string, pages: array<int>, text: string, page: int, page_start: int, page_end: int>>,
pages array<struct<page_number: int, text: string, headings: array<struct<section_id: string, title: string, font_size: double>>, requirements: array<{ITEM}>,
  figures: array<struct<page: int, section: string, caption: string>>, table_captions: array<struct<caption: string>>, tables: array<struct<page: int, csv_file: string>>,
  images: array<struct<page: int, file: string, accessibility_description: string>>>>"""


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages(spec, version, page_number, text) of the two versions."""
    return spark.sql(NUMBERED + CORPUS_SQL, documents=spark.read.parquet(f"{sf_dir}/documents.parquet").select("source", "doc_id", "text"))


def corpus_sql() -> str:
    return NUMBERED_PLAINLY + CORPUS_SQL


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Document JSON files (or folders of them) with source_path and source_dir; missing fields are null, a file that holds no object fails."""
    df = spark.read.schema(DOCUMENT).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return df.withColumn("source_path", F.col("_metadata.file_path")).withColumn("source_dir", F.regexp_replace("source_path", r"/[^/]*$", ""))


def read_document_keys(spark: SparkSession, path: str) -> DataFrame:
    """(source_path, keys): the top-level keys that each file has, null values included."""
    df = spark.read.text(path, wholetext=True)
    return df.select(F.col("_metadata.file_path").alias("source_path"), F.json_object_keys("value").alias("keys"))


#: A record of a CSV file: line breaks inside quotes belong to it.
RECORD = r'((?:[^"\r\n]++|"(?:[^"]++|"")*+(?:"|\z))++)'
CELL = r',("(?:[^"]++|"")*+"[^,]*|[^,]*)'


def read_tables(spark: SparkSession, path: str) -> DataFrame:
    """(source_path, row_idx, cells): rows of CSV files in order, cells cleaned, rows without a filled cell left out."""
    df = spark.read.text(path, wholetext=True)
    records = F.regexp_extract_all(F.regexp_replace("value", "\\A\ufeff", ""), F.lit(RECORD), F.lit(1))
    rows = df.select(F.col("_metadata.file_path").alias("source_path"), F.posexplode(records).alias("row_idx", "line"))
    cells = F.transform(split_csv(F.col("line")), tx.clean)
    return rows.select("source_path", "row_idx", cells.alias("cells")).filter(F.exists("cells", lambda x: x != ""))


def split_csv(line: Column) -> Column:
    """Cells of a CSV record with quotes; doubled quotes inside quotes stand for one."""
    raw = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(CELL), F.lit(1))
    return F.transform(raw, lambda x: F.when(x.startswith('"') & x.endswith('"') & (F.length(x) >= 2), F.regexp_replace(F.substring(x, F.lit(2), F.length(x) - 2), '""', '"')).otherwise(x))


FINDING = """array<struct<title: string, category: string, severity: string, page_a: int, page_b: int, section_a: string, section_b: string,
statement_a: string, statement_b: string, reason: string, confidence: string>>"""


def read_findings(spark: SparkSession, path: str) -> DataFrame:
    """Findings of agent answers (JSON files with a list ``inconsistencies``), one row each; answers that are none are left out."""
    df = spark.read.text(path, wholetext=True).withColumn("agent", F.regexp_extract(F.col("_metadata.file_path"), r"agent_(\d+)\.json$", 1).cast("int"))
    answers = df.select("agent", F.from_json("value", f"inconsistencies {FINDING}")["inconsistencies"].alias("found")).filter("found is not null")
    return answers.select("agent", F.posexplode("found").alias("pos", "f")).select("agent", "pos", "f.*")
