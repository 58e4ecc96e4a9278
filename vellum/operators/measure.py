"""The measurement of a corpus of PDFs: folders -> files -> texts of two selections -> scores -> report.  [CMP7, CMP8]"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.operators import corpus
from vellum.sources import convert, pdf

#: The selections that are held against each other: the engine's, and tables without validation.
ENGINES = {"own": "rowfill", "stock": "legacy"}


def analyse(decoded: DataFrame) -> DataFrame:
    """[CMP7] Decoded files -> (doc_id, base, grids, notext): all digits of the pages' own text, of neither engine's making;
    the number of ruled grids; the number of pages without a character. Pages are summed first, so a long file is spread."""
    digit = (F.col("kind") == "char") & F.regexp_like("text", F.lit(r"\p{Nd}"))
    pages = decoded.where(F.col("kind").isin("page", "char", "cell")).groupBy("doc_id", "page_no").agg(
        F.array_join(F.collect_list(F.when(digit, F.regexp_replace("text", r"\P{Nd}", ""))), "").alias("base"),
        F.coalesce(F.max(F.when(F.col("kind") == "cell", F.col("grid_id") + 1)), F.lit(0)).alias("grids"),
        F.count_if(F.col("kind") == "char").alias("chars"),
    )
    return pages.groupBy("doc_id").agg(F.array_join(F.collect_list("base"), "").alias("base"), F.sum("grids").cast("int").alias("grids"), F.count_if(F.col("chars") == 0).cast("int").alias("notext"))


def measure_files(files: DataFrame, ranks: str | None = None) -> DataFrame:
    """[CMP7, CMP6] files (path, length, content) -> (file, bytes, base, grids, notext, unreadable, and for each engine a struct
    of its metrics), a row for each file; one that cannot be read has its reason and no metrics. Each file is parsed once and
    rendered by both selections where it is parsed; only texts and numbers leave the task, in no shuffle."""
    rows = pdf.texts(files.select(F.col("path").alias("doc_id"), F.col("length").alias("bytes"), "content"), list(ENGINES.values()))
    rows = rows.select("doc_id", "bytes", "base", "grids", "notext", F.col("error").alias("unreadable"), *[F.col(mode).alias(engine) for engine, mode in ENGINES.items()])
    for engine in ENGINES:
        rows = rows.withColumns({f"{engine}_tokens": convert.count_tokens(F.col(engine), ranks).cast("long"), f"{engine}_s": F.lit(None).cast("double"), f"{engine}_error": F.col("unreadable")})
    for engine in ENGINES:
        rows = corpus.score(rows, engine)
    return rows.withColumnRenamed("doc_id", "file").drop(*[f"{e}_{x}" for e in ENGINES for x in ("tokens", "s")])


def measure(spark: SparkSession, roots: list[str], *, ranks: str | None = None, limit: int = corpus.DEFAULT_LIMIT, sample: int | None = None, seed: int = 0) -> DataFrame:
    """[CMP8: SRC4, SET1, SET2, LIM1, CMP7, CMP6] Every PDF under the roots, those of limit bytes or more and repeated ones left
    out, or a sample of so many of them -> a scored row for each file. What is chosen travels as paths; contents are read again
    where they are parsed."""
    files = corpus.scan(spark, roots, limit)
    kept = corpus.without_duplicates(files.select("path", "name", "length", "content")).select("path")
    if sample is not None:
        kept = corpus.seeded_sample(kept, sample, seed, "path")
    return measure_files(files.join(kept, "path", "left_semi"), ranks)


def report(rows: DataFrame) -> DataFrame:
    """[FLT9, FLT10, AGG6-AGG9, SNK5] Scored files -> a row for each engine; aggregates alone."""
    return corpus.report(rows, tuple(ENGINES), "stock")
