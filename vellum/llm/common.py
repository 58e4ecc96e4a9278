"""What the training-data operators share: scratch tables, word rules, and bounded draws of labelled rows."""

from __future__ import annotations

import ctypes
import math
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: ASCII white space, as a Java regular expression. Words are the runs between.
WS = r"[\x20\x09-\x0D]+"


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names. Where the session names none: on one machine a folder of its own, on a cluster
    one in the warehouse, which executors and driver share; never a machine-local folder there."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    return _own_dir() if spark.sparkContext.master.split("[")[0] == "local" else f"{spark.conf.get('spark.sql.warehouse.dir')}/vellum-scratch"


@cache
def _own_dir() -> str:
    return tempfile.mkdtemp(prefix="vellum-")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path for a scratch table; it names the session, so that sessions which share the folder tell theirs apart."""
    return f"{scratch_dir(spark)}/vellum-{spark.sparkContext.applicationId}-{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str = "t") -> DataFrame:
    """Write df once to the shared scratch folder and read it back: lineage ends there, and a lost executor
    costs a reread, not a recomputation."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def dealt(df: DataFrame) -> DataFrame:
    """df as a side of a join that deals both sides by the key. The planner takes exploded rows and what Python returns for as
    small as what they come from, and would have the driver build a broadcast table of them."""
    return df.hint("merge")


class Bucketed:
    """A scratch table whose rows lie in buckets by a key: joins on the key do not shuffle it. `name` is its entry in the
    session's catalog, to be dropped once nothing is planned over it any more."""

    def __init__(self, df: DataFrame, key: str, label: str):
        self.spark = df.sparkSession
        self.name = f"vellum_{label}_{uuid.uuid4().hex}"
        self.path = scratch_path(self.spark, label)
        buckets = max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        df.write.format("parquet").bucketBy(buckets, key).option("path", self.path).saveAsTable(self.name)

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        _delete(self.spark, self.path)


def clear_scratch(spark: SparkSession) -> None:
    """Delete every scratch table that this session has written, those of results not yet read as well."""
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    top = jvm.org.apache.hadoop.fs.Path(scratch_dir(spark))
    fs = top.getFileSystem(conf)
    for found in fs.globStatus(jvm.org.apache.hadoop.fs.Path(top, f"vellum-{spark.sparkContext.applicationId}-*")) or []:
        fs.delete(found.getPath(), True)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def discard(*tables: DataFrame) -> None:
    """Delete scratch tables that nothing reads any more."""
    for df in tables:
        if path := getattr(df, "_scratch", None):
            _delete(df.sparkSession, path)


@cache
def _trim():
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):  # another C library
        return None


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The Arrow batches of a task, a part at a time, so that what a part becomes in Python is soon free again. After each batch
    the memory goes back to the system: workers live on from stage to stage, and their executor has a fixed amount."""
    for b in batches:
        for i in range(0, max(1, b.num_rows), rows):
            yield b.slice(i, rows)
        pa.default_memory_pool().release_unused()
        if trim := _trim():
            trim(0)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """What runs inside hands Python at most so many rows at a time: whole texts and their shingles are large rows, and Arrow's
    buffers for them lie outside the heap of an executor. The session's own setting holds again afterwards."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, min(rows, int(before)) if int(before) > 0 else rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def keep_batches_small(spark: SparkSession, rows: int = 500) -> None:
    """small_batches() for the rest of the session: for rows that are planned now and run by the caller later."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = int(spark.conf.get(name))
    spark.conf.set(name, min(rows, before) if before > 0 else rows)


def crc_fold(id_col: Column, folds: int = 3) -> Column:
    """crc32 of the id as text, modulo folds (null ids: null)."""
    return F.crc32(id_col.cast("string").cast("binary")) % folds


def words_of(text: Column) -> Column:
    """The words of a text as an array (null or blank text: empty)."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WS), lambda w: w != "")


def drawn(rows: DataFrame, by: str, key: str, per_class: int, counts: dict) -> DataFrame:
    """At most per_class rows of each class, those with the smallest hash of key: the same rows at any partitioning.

    counts: the rows of each class. They give a bound on the hash under which some per_class rows of the class lie, six standard
    deviations more; only those are shuffled and ranked, whatever the number of rows and of tasks."""
    wide = F.lit(None).cast("double")
    for c, n in sorted(counts.items(), key=str):
        share = min(1.0, (per_class + 6 * math.sqrt(per_class) + 50) / max(1, n))
        wide = F.when(F.col(by) == c, F.lit(share)).otherwise(wide)
    h = F.xxhash64(F.col(key))
    low = rows.where(F.shiftrightunsigned(h, 11) / F.lit(float(1 << 53)) < wide)
    w = Window.partitionBy(by).orderBy(h, F.col(key))
    return low.withColumn("__vellum_rn", F.row_number().over(w)).where(F.col("__vellum_rn") <= per_class).drop("__vellum_rn")
