"""Files of any kind to Markdown with token counts.  [CMP5, SRC1-SRC3, SRC9, SC1-SC3]"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from vellum.functions import text as T
from vellum.sources import html, office, pdf

#: Word pattern of the byte-pair encoding that counts are made with (a fixed public value).
PATTERN = r"""(?i:'s|'t|'re|'ve|'m|'ll|'d)|[^\r\n\p{L}\p{N}]?\p{L}+|\p{N}{1,3}| ?[^\s\p{L}\p{N}]+[\r\n]*|\s*[\r\n]+|\s+(?!\S)|\s+"""


@cache
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("counts", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(text: Column, ranks: str | None) -> Column:
    """[SC1, SC2] Tokens of each text by the byte-pair table at `ranks`; null where there is no table, or it fails: a count is
    never estimated, and never in the way of the text."""
    if not ranks:
        return F.lit(None).cast("int")

    @F.pandas_udf("int")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def one(t):
            try:
                return len(_encoding(ranks).encode_ordinary(t))
            except Exception:  # noqa: BLE001
                return None

        for b in batches:
            yield b.map(one).astype("Int32")

    return run(text)


def _generic(suffix: str, data: bytes) -> str:
    kinds = {".docx": office.docx, ".pptx": office.pptx, ".xlsx": office.xlsx, ".epub": office.epub}
    if suffix in kinds:
        return kinds[suffix](data)
    if data[:4] in (b"PK\x03\x04", b"\xd0\xcf\x11\xe0") or suffix in (".msg", ".xls", ".doc", ".ppt"):
        raise ValueError(f"no reader for {suffix or 'this file'}")
    text = data.decode("utf-8-sig", "replace")
    return html.to_markdown(text) if suffix in (".html", ".htm") or text.lstrip()[:15].lower().startswith(("<!doctype html", "<html")) else text


@F.pandas_udf(StructType().add("text", "string").add("error", "string"))
def _other(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    def one(suffix, data):
        try:
            return _generic(suffix, bytes(data)), None
        except Exception as e:  # noqa: BLE001  one bad file is one error row
            return None, f"{type(e).__name__}: {e}"[:500]

    for suffixes, contents in batches:
        yield pd.DataFrame([one(*x) for x in zip(suffixes, contents)], columns=["text", "error"])


@F.pandas_udf(IntegerType())
def _units(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    def one(suffix, data):
        try:
            return {".pdf": pdf.page_count, ".pptx": office.slide_count}[suffix](bytes(data))
        except Exception:  # noqa: BLE001  an estimate that fails is missing, no more
            return None

    for suffixes, contents in batches:
        yield pd.Series([one(*x) for x in zip(suffixes, contents)], dtype="Int32")


def convert(files: DataFrame, ranks: str | None = None) -> DataFrame:
    """[CMP5, FLT1] files (path, content[, suffix]) -> (path, text, error, tokens_after, tokens_before, unit, units).

    PDFs by suffix and magic go through the page engine; all else through the generic readers. Both branches read each file
    once more than the routing, which looks at its first kilobyte alone. A file is parsed once and rendered where it is parsed;
    nothing is shuffled or kept. A file that fails keeps its row, with the error."""
    f = files if "suffix" in files.columns else files.withColumn("suffix", T.suffix_of(F.col("path")))
    f = f.select("path", F.lower("suffix").alias("suffix"), "content")
    own = T.is_own_pdf(F.col("suffix"), F.col("content"))
    pdfs, others = f.where(own), f.where(~own)
    left = pdf.texts(pdfs, ["rowfill"])
    left = left.select("path", "suffix", F.when(F.col("error").isNull(), F.coalesce("rowfill", F.lit(""))).alias("text"), "error", "units")
    right = others.withColumn("o", _other("suffix", "content"))
    right = right.select("path", "suffix", F.col("o.text").alias("text"), F.col("o.error").alias("error"), _units("suffix", "content").alias("units"))
    out = left.unionByName(right)
    units = F.when(F.col("suffix").isin(".pdf", ".pptx"), F.col("units"))
    return out.select("path", "text", "error", count_tokens(F.col("text"), ranks).alias("tokens_after"), T.tokens_before(F.col("suffix"), units).alias("tokens_before"), F.when(units.isNotNull(), T.unit_of(F.col("suffix"))).alias("unit"), units.alias("units"))


def convert_path(spark: SparkSession, path: str, ranks: str | None = None) -> DataFrame:
    """[SRC1] A file, a folder or a pattern."""
    return convert(spark.read.format("binaryFile").load(path), ranks)


def convert_bytes(spark: SparkSession, data: bytes, suffix: str, ranks: str | None = None) -> DataFrame:
    """[SRC2]"""
    return convert(spark.createDataFrame([("bytes", bytearray(data), suffix)], "path string, content binary, suffix string"), ranks)
