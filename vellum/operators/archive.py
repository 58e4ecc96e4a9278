
from __future__ import annotations

import io
import os
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellum.functions import text as T


def archive_names(arrivals: DataFrame, taken: DataFrame, stem: str = "stem", order: str = "seq") -> DataFrame:
    """[WIN3, SC9] The k-th arrival of a stem takes the k-th free name of stem.md, stem (2).md, ... arrivals: (stem, order);
    taken: (filename). -> arrivals with filename.

    Free numbers come without generating candidates: of a stem's sorted taken numbers t, the k-th free one is k plus how many
    t stand at or below it, i.e. how many t_i have t_i - i < k. One shuffle by stem; taken numbers of a stem travel as one
    array, as long as its files."""
    named = taken.select(
        F.regexp_replace("filename", r"(?s)( \([0-9]+\))?\.md$", "").alias(stem),
        F.coalesce(F.regexp_extract("filename", r"(?s) \(([0-9]{1,9})\)\.md$", 1).try_cast("int"), F.lit(1)).alias("__k"), "filename",
    ).where(F.col("filename") == T.candidate_name(F.col(stem), F.col("__k")))
    used = named.groupBy(stem).agg(F.sort_array(F.collect_set("__k")).alias("__t"))
    ranked = arrivals.withColumn("__n", F.row_number().over(Window.partitionBy(stem).orderBy(order)))
    below = F.size(F.filter(F.transform("__t", lambda t, i: t - i - 1), lambda x: x < F.col("__n")))
    k = F.col("__n") + F.coalesce(F.when(F.col("__t").isNotNull(), below), F.lit(0))
    return ranked.join(used, stem, "left").withColumn("filename", T.candidate_name(F.col(stem), k)).drop("__n", "__t")


def search(archive: DataFrame, q: str = "") -> DataFrame:
    """[FLT8, SRT2] Case-insensitive substring of the file name (no wildcards; empty: all), newest first."""
    hits = archive if not q else archive.where(F.contains(F.lower("filename"), F.lit(q.lower())))
    return hits.orderBy(F.desc("modified"), "filename")


def scan_archive(spark: SparkSession, folder: str) -> DataFrame:
    """[SRC6] (filename, size, modified) of the *.md files in a folder, not below it; file contents are never read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").load(folder)
    return files.select(F.regexp_extract("path", r"([^/]*)$", 1).alias("filename"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


class Refused(Exception):
    """A file name that is not in the archive: 400 outside of it, 404 not there."""

    def __init__(self, code: int, detail: str):
        super().__init__(detail)
        self.code, self.detail = code, detail


def safe_path(folder: Path | str, filename: str) -> Path:
    """[FLT7] The path of a file of the archive; anything that resolves elsewhere is refused."""
    top = Path(folder).resolve()
    path = (top / filename).resolve()
    if not path.is_relative_to(top) or path == top:
        raise Refused(400, "Invalid filename")
    if not path.exists():
        raise Refused(404, "Not found")
    return path


def save_unique(folder: Path | str, stem: str, text: str) -> str:
    """[SNK2] Write to the first free name, atomically: of two writers each gets its own."""
    k = 1
    while True:
        name = f"{stem}.md" if k == 1 else f"{stem} ({k}).md"
        try:
            with open(Path(folder) / name, "x", encoding="utf-8", newline="") as f:
                f.write(text)
            return name
        except FileExistsError:
            k += 1


def zip_files(folder: Path | str, names: list[str]) -> bytes:
    """[SNK3] A deflated zip of named files, each checked. Driver side: for what a user picked, not for a corpus."""
    paths = [safe_path(folder, n) for n in names]
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, path in zip(names, paths):
            z.write(path, arcname=name)
    return out.getvalue()


def delete(folder: Path | str, filename: str) -> None:
    """[SNK6]"""
    os.unlink(safe_path(folder, filename))


def batch_guard(names: list[str], most: int = 10) -> None:
    """[FLT16]"""
    if len(names) > most:
        raise Refused(400, f"At most {most} files")
