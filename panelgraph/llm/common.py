"""What the corpus operators share: table access, the shared folder and hashes."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The separators between words: space, tab, newline, vertical tab, form feed, return.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"

_fallback: dict[str, str] = {}


#: Rows of a batch between the JVM and Python: texts can be long, and a batch is held several times.
BATCH = 1000


def modest_batches(spark: SparkSession) -> None:
    """Lowers the session's rows a batch to BATCH; a smaller setting stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH:
        spark.conf.set(name, str(BATCH))


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run for mapInArrow, after which the worker gives back what it has freed.

    Workers live on from task to task and from one operator to the next; without this each keeps the
    peak of all tasks before.
    """

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
            if trim:
                trim(0)

    return whole


#: Share of the driver's largest heap from which on a written table is followed by a collection.
HEAP = 0.5


def tidy_driver(spark: SparkSession) -> None:
    """Collects the driver's garbage when its heap has grown large.

    A job of hundreds of small plans leaves much garbage behind, and the collector would rather take more memory from the
    system than stop for it; a whole collection shrinks the heap. Shuffle files and broadcasts that
    nothing refers to are removed on it, too.
    """
    gc.collect()  # Python's references to the JVM's objects
    runtime = spark._jvm.java.lang.Runtime.getRuntime()
    if runtime.totalMemory() > HEAP * runtime.maxMemory():
        spark._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    modest_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where it is unset a temporary one, in local mode (tests) only."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _fallback:
        _fallback[app] = "file://" + tempfile.mkdtemp(prefix="corpus-")
    return _fallback[app]


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back, which cuts the lineage.

    The files survive the loss of executors; Spark repeats only unfinished tasks.
    """
    spark = df.sparkSession
    modest_batches(spark)
    path = f"{shared_dir(spark).rstrip('/')}/tables/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    tidy_driver(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out._table_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the files behind a materialized table that nothing reads any more."""
    path = getattr(df, "_table_path", None)
    if path:
        spark = df.sparkSession
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def join_skewed(left: DataFrame, right: DataFrame, key: str, size: str, least: int = 256) -> DataFrame:
    """left joined (inner) to right, a materialized table with one row a key and in `size` its number of rows in left.

    Keys with over a thousandth of the rows, at most 1000 of them, are broadcast, so that no task
    gets all rows of one; the others are joined by shuffle. left is read twice where there are such keys.
    """
    total, most = right.agg(F.sum(size), F.max(size)).first()
    limit = max((total or 0) // 1000, least)
    if (most or 0) <= limit:
        return left.join(right, key)
    hot = right.where(F.col(size) > limit)
    cold = left.join(F.broadcast(hot.select(key)), key, "left_anti").join(right.where(F.col(size) <= limit), key)
    return left.join(F.broadcast(hot), key).unionByName(cold)


def is_held_out(doc_id: Column) -> Column:
    """The fold no classifier learns from: crc32 of the id as text, mod 5, is 0.

    A null id counts as the text ''; its remainder is 0, so it is held out.
    """
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def hash_long(*parts: Column | str) -> Column:
    """60 bits of an md5 as a bigint, so that any SQL engine can recompute it."""
    text = F.concat_ws(":", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")
