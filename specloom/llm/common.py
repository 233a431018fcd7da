"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import re
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ready

#: Where tables go if the cluster names no shared folder (tests, a single machine).
DEFAULT_SHARED = "/tmp/checkpoints"

#: The word pattern of all operators: runs of anything but space and \t \n \v \f \r.
WORD_CHARS = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session. Only a session in one process may leave it
    unset; on a cluster a folder of one machine would lose tables."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (named or DEFAULT_SHARED).rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/specloom-{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage of df with a Parquet table in the shared folder."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def tidy(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the driver's broadcasts and the shuffle files that nothing refers to any more, and give back what the
    driver's JVM has freed outside its heap.

    The cleaner learns of them when the driver collects garbage; operators of many small joins would otherwise keep their broadcasts
    until the heap has grown, since Spark itself asks for a collection only every 30 minutes (spark.cleaner.periodicGC.interval)."""
    gc.collect()  # Python objects that hold Java ones
    spark.sparkContext._jvm.System.gc()
    trim(spark)


def trim(spark: SparkSession) -> str:
    """Have the C library of the driver's JVM return its free memory to the system; what the JVM says of it, '' if it has no such command.

    Compiling the code of many plans leaves over 100 MB of freed pieces, which the C library keeps for its threads otherwise."""
    jvm, new = spark.sparkContext._jvm, spark.sparkContext._gateway.new_array
    name_of = jvm.java.lang.Class.forName
    kinds, values = new(jvm.java.lang.Class, 4), new(jvm.java.lang.Object, 4)
    try:
        for k, kind in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
            kinds[k] = name_of(kind)
        values[0], values[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        values[2], values[3] = new(jvm.java.lang.Object, 0), new(jvm.java.lang.String, 0)
        invoke = name_of("javax.management.MBeanServer").getMethod("invoke", kinds)  # the server's own class is not open to calls
        return str(invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), values))
    except Py4JError:  # another JVM or C library
        return ""


def drop_table(*tables: DataFrame) -> None:
    """Delete tables made by written() that nothing reads any more, and what was broadcast to make what replaces them."""
    for df in tables:
        spark = df.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._written_at)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    if tables:
        tidy(tables[0].sparkSession)


def give_back() -> None:
    """Have the C library of this Python process return its free memory to the system, where it can."""
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):  # another C library
        pass


SALTS = 32  # parts of a key that holds far more rows than others


def spread_join(many: DataFrame, one: DataFrame, left: list[str], right: list[str], n: str | None = None) -> DataFrame:
    """many joined with one (few rows a key) where columns left equal columns right, however many rows of many a key has.

    Keys of more than a quarter of an even partition are spread over SALTS parts, one's rows copied to each. Such keys are at most four
    times as many as partitions, which bounds what is broadcast. Both are written tables; n: the column of one with the key's rows in
    many, if it is known."""
    spark = many.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counts = one.select(*[F.col(c).alias(f"hot{k}") for k, c in enumerate(right)], F.col(n).alias("rows")) if n else many.groupBy(*[F.col(c).alias(f"hot{k}") for k, c in enumerate(left)]).agg(F.count(F.lit(1)).alias("rows"))
    total = counts.agg(F.sum("rows")).first()[0] if n else many.count()
    hot = written(counts.filter((F.col("rows") > 1000) & (F.col("rows") * (4 * parts) > (total or 0))).drop("rows").distinct(), "hot")
    if hot.isEmpty():
        drop_table(hot)
        return many.join(one, [F.col(a) == F.col(b) for a, b in zip(left, right, strict=True)])
    hot = F.broadcast(hot.withColumn("is_hot", F.lit(True)))

    def marked(df: DataFrame, keys: list[str]) -> DataFrame:
        return df.join(hot, [F.col(c) == F.col(f"hot{k}") for k, c in enumerate(keys)], "left").drop(*[f"hot{k}" for k in range(len(keys))])

    salt = F.when(F.col("is_hot"), F.pmod(F.xxhash64(*[F.col(c) for c in many.columns]), F.lit(SALTS)).cast("int")).otherwise(0)
    copies = F.when(F.col("is_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    many = marked(many, left).withColumn("salt", salt).drop("is_hot")
    one = marked(one, right).withColumn("other_salt", F.explode(copies)).drop("is_hot")
    return many.join(one, [F.col(a) == F.col(b) for a, b in zip([*left, "salt"], [*right, "other_salt"], strict=True)]).drop("salt", "other_salt")


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns; others, whatever their names, play no part."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def utf8(texts: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """The values of a string column as bytes; null gives b''."""
    return [b"" if x is None else x for x in texts.cast(pa.binary()).to_pylist()]


def one_chunk(column: pa.ChunkedArray) -> pa.Array:
    """A table's column as one array."""
    found = column.combine_chunks()
    return pa.concat_arrays(found.chunks) if isinstance(found, pa.ChunkedArray) else found


def slices(batches: Iterable[pa.RecordBatch], column: str, most_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the values of a string column stay near most_bytes together; one long row stays whole.

    After each batch that comes from Spark (not in a list) the process gives its free memory back."""
    import numpy as np

    for batch in batches:
        if batch.num_rows == 0:
            continue
        size = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0), dtype=np.int64)
        part = np.cumsum(size) // most_bytes
        cuts = [0, *(np.nonzero(np.diff(part))[0] + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield batch.slice(a, b - a)
        if not isinstance(batches, list):
            give_back()
