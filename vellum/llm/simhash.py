"""SimHash near-dedup (1): segment-popcount embedding, grid range-join under Manhattan distance, exact verification.

A 64-bit fingerprint is mapped to the bit counts of its 32 two-bit segments. The Manhattan distance of two such embeddings
never exceeds the Hamming distance of the fingerprints, so a range join at radius r over the embedding loses no link. The
grid: segments are dealt to `slabs` slabs; two points within distance r differ in at most r slabs and therefore share the
cell of at least one sub-grid made of slabs - r slabs. Fingerprints join on the cell, are held against the Manhattan bound,
and are verified by the exact Hamming distance.

Equal fingerprints are one point. Inside a cell every point is first held against the cell's least and greatest point; the
components of those links are then known, and the join proper emits only pairs of different ones. A group of n near copies so costs about n links, not n * n, and no link that joins two components
is lost. A cell with very many points is not searched pair by pair: its points are dealt anew to a finer grid, whose
cells are smaller, which finds all of their links.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dealt, materialize, slices, small_batches
from .components import connected_components

SEGMENTS = 32
_EVERY_OTHER = 0x5555555555555555
_CHUNK = 1 << 15
#: What it costs to shuffle and sort a point's row of a sub-grid, in comparisons of two points of a cell: 19 for a row of the
#: join, as measured on one machine (0.51 against 0.027 microseconds), and about as much again for the cells' ends.
_ROW = 40
#: Slabs at least: 35 sub-grids serve up to some 35 million points, so what is measured on small tables holds for those.
_SLABS = 7
#: Points of a cell beyond which they go to a grid of so many more slabs, and the finest grid there is.
CELL, FINER, FINEST = 2_000, 3, 16


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _bits(hashes: np.ndarray) -> np.ndarray:
    """How many of the 64-bit hashes have each bit, most significant first."""
    out = np.zeros(64, np.int64)
    for i in range(0, len(hashes), _CHUNK):
        out += np.unpackbits(hashes[i : i + _CHUNK].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return out


def majority(hashes: np.ndarray) -> int:
    """The fingerprint: a bit is 1 if over half of the hashes have it; no hashes: zero. Unsigned."""
    if not len(hashes):
        return 0
    return int.from_bytes(np.packbits(_bits(hashes) * 2 > len(hashes)).tobytes(), "big")


def shingle_hashes(text: bytes | None, k: int) -> np.ndarray:
    """XXH64 (seed 42) of every space-joined k-word shingle of the text, A-Z lower-cased, repeats included. Fewer than k
    words: the whole sequence; no words or null: none."""
    words = (text or b"").lower().split()  # bytes: A-Z alone, and ASCII white space alone
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= k:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - k + 1]
    ends, digest, out = ends[k - 1 :], xxhash.xxh64_intdigest, np.empty(len(starts), np.uint64)
    for i in range(0, len(starts), _CHUNK):
        out[i : i + _CHUNK] = [digest(joined[a:b], 42) for a, b in zip(starts[i : i + _CHUNK].tolist(), ends[i : i + _CHUNK].tolist())]
    return out


def fingerprints(docs: DataFrame, shingle_words: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """-> (doc_id, fp long). Whole texts, one pass, no shuffle. Null and blank texts: zero."""

    def run(batches):
        for b in slices(batches):
            fps = [_signed(majority(shingle_hashes(t, shingle_words))) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("t"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def embedding(fp: Column) -> Column:
    """The bit counts of the 32 two-bit segments, packed in place: two bits hold a count of 0 to 2."""
    other, low = F.shiftrightunsigned(fp, 1), F.lit(_EVERY_OTHER)
    both = F.shiftleft(fp.bitwiseAND(other).bitwiseAND(low), 1)  # no sum: it could overflow
    return fp.bitwiseXOR(other).bitwiseAND(low).bitwiseOR(both)


def _slab_masks(slabs: int) -> list[int]:
    edges = [round(SEGMENTS * i / slabs) for i in range(slabs + 1)]
    return [sum(3 << 2 * s for s in range(a, b)) for a, b in zip(edges, edges[1:])]


def grid_masks(radius: int, slabs: int) -> list[int]:
    """For each sub-grid the bits of its slabs."""
    return [_signed(sum(g)) for g in combinations(_slab_masks(slabs), slabs - radius)]


def grid_cells(points: DataFrame, radius: int, slabs: int, fp: str = "fp") -> DataFrame:
    """points with (grid, cell): one row for each sub-grid of slabs - radius slabs. The masks are one literal, so that the plan
    is as small for hundreds of sub-grids as for a few."""
    e = "__vellum_embedding"
    cells = F.posexplode(F.transform(F.lit(grid_masks(radius, slabs)), lambda m: F.col(e).bitwiseAND(m)))
    return points.withColumn(e, embedding(F.col(fp))).select("*", cells.alias("grid", "cell")).drop(e)


def manhattan(a: Column, b: Column, slabs: int) -> Column:
    """The Manhattan distance of the slabs' bit counts: a lower bound of the segments' and so of the Hamming distance."""
    terms = [F.abs(F.bit_count(a.bitwiseAND(F.lit(_signed(m)))) - F.bit_count(b.bitwiseAND(F.lit(_signed(m))))) for m in _slab_masks(slabs)]
    return sum(terms[1:], terms[0])


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def slabs_for(points: int, radius: int) -> int:
    """The number of slabs that makes grid rows and expected pairs in cells together fewest. A two-bit segment's count of
    two unrelated fingerprints agrees with probability 3/8. Any number gives the same links."""

    def cost(s: int) -> float:
        return comb(s, radius) * (_ROW + points * 0.375 ** (SEGMENTS * (s - radius) / s))

    return min(range(max(_SLABS, radius + 2), FINEST + 1), key=cost)


def _celled(points: DataFrame, radius: int, slabs: int) -> DataFrame:
    """points with one cell number for each sub-grid. Cells whose numbers happen to be equal only add pairs to be refused."""
    return grid_cells(points, radius, slabs).withColumn("cell", F.xxhash64("grid", "cell")).drop("grid")


def _links(rooted: DataFrame, radius: int, slabs: int, most: int) -> DataFrame:
    """(a, b): roots of all pairs of points (fp, root) within the radius that have different roots. Cells of more than `most`
    points are left out of the join; of those, the ones with several roots have their points dealt to a finer grid."""
    cells, finest = _celled(rooted, radius, slabs), slabs >= FINEST
    large = cells.groupBy("cell").agg(F.count("*").alias("points"), F.min("root").alias("p"), F.max("root").alias("q")).where(F.col("points") > most)
    large = materialize(large.where("p = q") if finest else large, "large")
    if found := large.limit(1).count():
        joined = cells.join(large.select("cell"), "cell", "left_anti")
    else:
        joined = cells
    x, y = joined.alias("x"), joined.alias("y")
    near = (
        (F.col("x.cell") == F.col("y.cell")) & (F.col("x.fp") < F.col("y.fp")) & (F.col("x.root") != F.col("y.root"))
        & (manhattan(F.col("x.fp"), F.col("y.fp"), slabs) <= radius) & (hamming(F.col("x.fp"), F.col("y.fp")) <= radius)
    )
    links = x.join(dealt(y), near).select(F.col("x.root").alias("a"), F.col("y.root").alias("b"))
    if finest or not found:
        return links
    hot = materialize(cells.join(large.where("p <> q").select("cell"), "cell", "left_semi").select("fp", "root").distinct(), "hot")
    return links.unionAll(_links(hot, radius, min(FINEST, slabs + FINER), most)) if hot.limit(1).count() else links


def fingerprint_components(fps: DataFrame, radius: int = 4, slabs: int | None = None, most: int = CELL) -> DataFrame:
    """Distinct (fp) -> (fp, root): root is the same for all fingerprints that links of at most radius bits connect.

    Cells of more than `most` points go to finer grids; at any number of slabs and of points to a cell the result is the same."""
    points = materialize(fps.select("fp").distinct(), "points")
    slabs = slabs or slabs_for(points.count(), radius)

    cells = _celled(points, radius, slabs).alias("x")
    ends = _celled(points, radius, slabs).groupBy("cell").agg(F.min("fp").alias("p"), F.max("fp").alias("q")).alias("e")
    linked = lambda end: (F.col("x.fp") != F.col(end)) & (hamming(F.col("x.fp"), F.col(end)) <= radius)
    stars = cells.join(dealt(ends), (F.col("x.cell") == F.col("e.cell")) & (linked("e.p") | linked("e.q")))
    stars = stars.select(F.col("x.fp").alias("b"), F.explode(F.array(F.when(linked("e.p"), F.col("e.p")), F.when(linked("e.q"), F.col("e.q")))).alias("a")).where("a is not null")
    roots = connected_components(stars.select("a", "b"))
    rooted = materialize(points.join(dealt(roots.withColumnRenamed("node", "fp")), "fp", "left").select("fp", F.coalesce("component", "fp").alias("root")), "rooted")
    across = connected_components(_links(rooted, radius, slabs, most))
    return rooted.join(dealt(across.withColumnRenamed("node", "root")), "root", "left").select("fp", F.coalesce("component", "root").alias("root"))


def simhash_components(docs: DataFrame, shingle_words: int = 4, radius: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """-> (doc_id, fingerprint, component_id): every document, its fingerprint as 16 hex digits, and the least doc_id that
    links of at most radius differing bits reach, itself included.

    Null and blank texts have fingerprint zero and link like any other. Repeated rows give repeated rows. A component whose
    ids are all null has a null component_id. An empty table gives no rows. Other columns are not read."""
    with small_batches(docs.sparkSession):
        fps = materialize(fingerprints(docs, shingle_words, id_col, text_col), "fps")
    least = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = fingerprint_components(fps, radius)
    named = roots.join(dealt(least), "fp")
    named = named.join(dealt(named.groupBy("root").agg(F.min("least").alias("component_id"))), "root").select("fp", "component_id")
    out = fps.join(dealt(named), "fp")
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op1_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return simhash_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), shingle_words=4, radius=4)
