"""Document fingerprints (10): one-permutation MinHash, optimal densification, packed low-order bits, bias correction.

Every distinct word shingle is hashed once: high bits choose a bin, the rest compete for the bin's minimum. An empty bin
copies the bin that a fixed random walk reaches first. Four low-order bits of each bin are kept, one hexadecimal digit; the
share of equal digits, less what chance gives, estimates the Jaccard likeness of the shingle sets.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BINS, BITS, SHINGLE = 512, 4, 5
#: The fingerprint of a text without a word.
EMPTY = "empty"
_U = np.uint64
_STEP = _U(0x9E3779B97F4A7C15)
_HEX = np.frombuffer(b"0123456789abcdef", np.uint8)


def _mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser (fixed public constants)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _walk(bins: int, tries: int) -> np.ndarray:
    """walk[t, i]: the bin that empty bin i asks at its t-th try, the same for every text."""
    i = np.arange(bins, dtype=np.uint64)
    with np.errstate(over="ignore"):
        return np.stack([_mix((i + _U(t * bins + 1)) * _STEP) % _U(bins) for t in range(tries)]).astype(np.int64)


_WALK = _walk(BINS, 4096)


def shingle_set_hashes(text: bytes, k: int = SHINGLE) -> np.ndarray:
    """A 64-bit hash of each k-word shingle, A-Z lower-cased (fewer words: of the whole sequence; none: no hash)."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh3_64_intdigest
    h = np.fromiter((digest(w) for w in words), np.uint64, len(words))
    n = max(1, len(h) - k + 1)
    with np.errstate(over="ignore"):
        out = np.full(n, _U(min(k, len(h))))
        for j in range(min(k, len(h))):
            out = _mix(out + h[j : j + n] * _STEP + _U(j))
    return out


def bins_of(hashes: np.ndarray) -> np.ndarray | None:
    """The densified minimum of every bin; None for no hashes."""
    if not len(hashes):
        return None
    least = np.full(BINS, np.iinfo(np.uint64).max, np.uint64)
    at = (hashes >> _U(64 - BINS.bit_length() + 1)).astype(np.int64)
    value = hashes & _U((1 << 48) - 1)
    order = np.argsort(value)[::-1]
    least[at[order]] = value[order]  # the last write to a bin is its least value
    filled = np.zeros(BINS, bool)
    filled[at] = True
    empty, out = np.nonzero(~filled)[0], least
    for t in range(len(_WALK)):
        if not len(empty):
            return out
        goal = _WALK[t, empty]
        hit = filled[goal]
        out[empty[hit]] = least[goal[hit]]
        empty = empty[~hit]
    out[empty] = least[np.nonzero(filled)[0][0]]  # a walk that never arrives: chance (1 - 1/512) ** 4096
    return out


def fingerprint(text: bytes) -> str:
    """One hexadecimal digit for each bin: four low-order bits of its minimum, hashed with the bin's number. Bins of a short
    text hold copies of a few values; hashed so, their chance matches are independent, as the bias correction supposes."""
    b = bins_of(shingle_set_hashes(text))
    if b is None:
        return EMPTY
    with np.errstate(over="ignore"):
        b = _mix(b + np.arange(1, BINS + 1, dtype=np.uint64) * _STEP)
    return _HEX[(b & _U((1 << BITS) - 1)).astype(np.int64)].tobytes().decode()


def likeness(a: str, b: str) -> float:
    """The estimate of the Jaccard likeness, 0 to 1. Two texts without words are alike, such a text and another are not."""
    if a == b:
        return 1.0
    if EMPTY in (a, b):
        return 0.0
    same = np.count_nonzero(np.frombuffer(a.encode(), np.uint8) == np.frombuffer(b.encode(), np.uint8)) / BINS
    chance = 2.0**-BITS
    return float(min(1.0, max(0.0, (same - chance) / (1 - chance))))


def with_fingerprint(docs: DataFrame, name: str = "fingerprint", text_col: str = "text") -> DataFrame:
    """docs with the fingerprint of every whole text; no shuffle. Null text counts as empty."""
    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([fingerprint(t or b"") for t in texts], dtype="object")

    return docs.withColumn(name, run(F.col(text_col).cast("binary")))


def in_descending_order(docs: DataFrame, tasks: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, packed, part, ahead): rows in partitions that hold whole runs of the descending order of ids, sorted. At the end
    of each run stands, with ahead = 1, the row that follows it in the next run (after the last run: the very first row).

    Texts are shuffled once, each packed by zstandard, which takes a third off what the shuffle's own compression of blocks
    leaves. The runs' bounds are quantiles of the ids, found in a pass over the ids alone; what is broadcast
    has a row for each run, of which there are four for each task."""
    spark = docs.sparkSession
    runs = 4 * tasks

    def pack(batches):
        packer = zstandard.ZstdCompressor(level=3)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([packer.compress(t) for t in b.column(2).to_pylist()], pa.binary())], ["doc_id", "h", "packed"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), text.cast("binary").alias("t")).mapInArrow(pack, "doc_id long, h long, packed binary")
    ids = docs.select(F.col(id_col).cast("long").alias("doc_id"))
    cuts = ids.agg(F.percentile_approx("doc_id", [k / runs for k in range(1, runs)], 100 * runs)).first()[0] or []
    cuts = sorted(set(cuts))
    # a binary search over the cuts: how many are below the id
    steps = [1 << k for k in reversed(range(len(cuts).bit_length()))]
    constant = lambda xs, kind: F.from_json(F.lit(json.dumps(xs)), f"array<{kind}>")  # noqa: E731  folded to one literal
    array = constant(cuts, "bigint")
    below = F.aggregate(constant(steps, "int"), F.lit(0), lambda lo, s: F.when(F.get(array, lo + s - 1) < F.col("doc_id"), lo + s).otherwise(lo))
    part = F.when(F.col("doc_id").isNull(), F.lit(len(cuts) + 1)).otherwise(F.lit(len(cuts)) - below).cast("int")

    first = ids.withColumn("part", part).groupBy("part").agg(F.max("doc_id").alias("doc_id")).orderBy("part").collect()
    ahead = [(r["doc_id"], first[i - 1]["part"]) for i, r in enumerate(first)]
    heads = spark.createDataFrame(ahead, "head long, dest int")  # a row for each run
    marked = rows.withColumn("part", part).join(F.broadcast(heads), F.col("doc_id").eqNullSafe(F.col("head")), "left")
    both = F.when(F.col("dest").isNull(), F.array("part")).otherwise(F.array("part", F.col("dest") + (1 << 30)))
    out = marked.select("doc_id", "packed", "h", F.explode(both).alias("p"))
    out = out.select("doc_id", "packed", "h", (F.col("p") % (1 << 30)).alias("part"), (F.col("p") >= (1 << 30)).cast("int").alias("ahead"))
    return out.repartition(tasks, "part").sortWithinPartitions("part", "ahead", F.desc_nulls_last("doc_id"), "h").drop("h")


def neighbour_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document's fingerprint and that of its edited text, the last half of whose code points gives way to the first as
    many of the next document in descending order of id, with the likenesses of the two and of the two documents.

    -> (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next). Null text counts as empty;
    rows with equal ids follow in the order of their texts' hashes, null ids come last; a lone document follows itself; an
    empty table gives no rows."""
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)

    def run(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        held, done = None, None  # the last row not yet given out, and the run whose following row has been used
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        for b in batches:
            out = []
            for doc_id, packed, part, ahead in zip(*(b.column(i).to_pylist() for i in range(4))):
                if ahead and done == part:
                    continue  # further rows with the id of the one that follows
                raw = unpack(packed)
                text, own = raw.decode(), fingerprint(raw)
                if held is not None:
                    was_id, was, print_ = held
                    half = len(was) // 2
                    edited = (was[: len(was) - half] + text[:half]).encode()
                    near = fingerprint(edited)
                    out.append((was_id, len(was), hashlib.sha256(edited).hexdigest(), print_, near, likeness(print_, near), likeness(print_, own)))
                held, done = (None, part) if ahead else ((doc_id, text, own), done)
            columns = list(zip(*out)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    rows = in_descending_order(docs, tasks, id_col, text_col)
    return rows.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op10_fingerprints(spark, sf_dir: str) -> DataFrame:
    return neighbour_fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
