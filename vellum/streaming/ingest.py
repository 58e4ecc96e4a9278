"""Files that arrive in a folder, converted as they come.  [SURVEY §2.10]"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vellum.functions import text as T
from vellum.operators.archive import archive_names
from vellum.operators.render import release
from vellum.sources.convert import convert

SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def refusal(size: Column) -> Column:
    """[FLT6] Why a file is not converted, from its size alone; null: it is."""
    return F.when(size > T.MAX_UPLOAD_BYTES, F.lit("File too large (200 MB max)"))


def events(converted: DataFrame, taken: DataFrame | None = None) -> DataFrame:
    """[PRJ3, WIN3] An event for each file (path, text, error): saved under a free name of its stem, in the order of paths, or the
    reason why not. taken (filename): names that are in use."""
    c = converted.withColumn("name", F.regexp_extract("path", r"([^/]*)$", 1))
    taken = c.sparkSession.createDataFrame([], "filename string") if taken is None else taken
    saved = archive_names(c.where("error is null").withColumn("stem", T.safe_stem(F.col("name"))), taken, order="path")
    good = saved.select(F.col("name").alias("filename"), F.lit("ok").alias("status"), F.col("filename").alias("saved_as"), F.lit(None).cast("string").alias("detail"), "text", "path")
    bad = c.where("error is not null").select(F.col("name").alias("filename"), F.lit("error").alias("status"), F.lit(None).cast("string").alias("saved_as"), F.col("error").alias("detail"), "text", "path")
    return good.unionByName(bad)


def responses(converted: DataFrame) -> DataFrame:
    """[PRJ2] Converted files -> (filename, content, tokens: before, unit, units, after): what a caller gets for each file."""
    tokens = F.struct(F.col("tokens_before").alias("before"), "unit", "units", F.col("tokens_after").alias("after"))
    return converted.where("error is null").select(F.regexp_extract("path", r"([^/]*)$", 1).alias("filename"), F.col("text").alias("content"), tokens.alias("tokens"))


def ingest(spark: SparkSession, folder: str, out: str, checkpoint: str, files_per_batch: int = 1000, ranks: str | None = None, once: bool = False) -> StreamingQuery:
    """Convert each new file of the folder and append its event to `out`. Files over the size limit are refused unread, a file
    that fails is an event like any other, and a batch holds at most files_per_batch files. Every batch writes its own folder
    of `out`, so one that is repeated after a failure replaces itself; names that earlier batches gave are not given again."""
    files = spark.readStream.format("binaryFile").schema(SCHEMA).option("maxFilesPerTrigger", files_per_batch).load(folder)

    def write(batch: DataFrame, number: int) -> None:
        why = refusal(F.col("length"))
        small = batch.where(why.isNull())
        large = batch.where(why.isNotNull()).select("path", F.lit(None).cast("string").alias("text"), why.alias("error"))
        done = convert(small, ranks)
        held, done = done, done.select("path", "text", "error").unionByName(large)
        earlier = spark.read.schema("saved_as string").parquet(*[f"{out}/batch={k}" for k in range(number)]) if number else None
        taken = None if earlier is None else earlier.where("saved_as is not null").select(F.col("saved_as").alias("filename"))
        events(done, taken).write.mode("overwrite").parquet(f"{out}/batch={number}")
        release(held)

    writer = files.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="10 seconds")).start()
