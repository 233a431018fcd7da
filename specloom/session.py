"""Session helpers."""

from __future__ import annotations

import re
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


#: Bytes of an Arrow batch between Spark and its Python workers, where the session names none: long texts count by size, not by row.
BATCH_BYTES = "8m"


def ready(spark: SparkSession) -> SparkSession:
    """Let Python workers on this machine import the package from where the driver has it (where it is installed, nothing changes),
    and bound the batches they get and the memory they keep."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    env = spark.sparkContext.environment
    env.setdefault("ARROW_DEFAULT_MEMORY_POOL", "system")  # idle workers give memory back
    env.setdefault("MALLOC_ARENA_MAX", "2")
    # blocks of up to 4 MB are used again; with glibc's least sizes each array's pages are asked for anew
    env.setdefault("MALLOC_MMAP_THRESHOLD_", "4194304")
    env.setdefault("MALLOC_TRIM_THRESHOLD_", "4194304")
    if ROOT not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)
    return spark


def kept(df: DataFrame, label: str = "kept") -> DataFrame:
    """df as a Parquet table in the folder of ``spark.checkpoint.dir``, so that what reads it several times makes it once. Sessions of
    several processes that name no such folder get df itself."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        return df
    path = f"{(folder or '/tmp/checkpoints').rstrip('/')}/specloom-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
