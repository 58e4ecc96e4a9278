"""Near-dedup of a corpus with SimHash (1): one document of each group of near copies stays.

Near copies are texts whose sets of five-word shingles are alike by at least 0.8 (Jaccard). A 64-bit fingerprint of the
shingles themselves is too coarse for that: two texts at 0.8 differ in some nine of its bits. Fingerprints of the texts' word
sets move far less by a few changed words. Several of them are searched by the grid of the SimHash operator at four bits: each
cell's texts are verified against one of them, drawn by the cell's own order, which connects most of a group at a cost in
proportion to its texts.

Fingerprints miss copies with a block added, cut off or replaced. So what the first step leaves unconnected is searched exactly,
by prefixes: with the shingles of every text in one common order, rare ones first, two near copies share one among the first
fifth of the larger text and the first ninth of the smaller. The texts that share such a shingle are first held against the
least of them, which connects what is left of large groups; then all pairs that are still apart are compared. Pairs are refused
inside the joins only by bounds that no near copy exceeds (sizes, places of the shared shingle, parity bits); all others are
verified on all shingles. No pair of near copies is left out.

What moves: the shingles of each distinct text once, into buckets by the text's digest, where later steps find them without
another shuffle; after that narrow rows, and the shingles of texts that stand in a pair.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Bucketed, discard, materialize, slices, small_batches
from .components import connected_components
from .simhash import grid_cells, grid_masks, hamming, majority

VIEWS, RADIUS, SIMILARITY, SHINGLE = 2, 4, 0.8, 5
#: Slabs of the grid, the same at any number of texts: a cell's texts are held against one of them only, so large cells cost
#: nothing, and each text has 15 rows a view.
SLABS = 6
#: Parity bits of a text's shingles: two texts have at least as many shingles not in common as they have bits that differ. So
#: many stand in the rows of a join; a text has a power of two of at least so many for each shingle besides, at least BITS.
BITS, BITS_EACH = 1024, 2
#: Bytes kept of a shingle's hash. Pairs are verified on all shingles of both texts.
WIDTH = 5
#: Texts drawn to learn which shingles are common, and how many of those are known. They order the shingles; any order is exact.
SAMPLE, COMMON = 20_000, 50_000
#: The rows of a shingle known to be common are dealt to so many tasks while the shingles of single texts are sorted out.
SALTS = 64
#: Of how many of its shared shingles, the most common ones, a text is held against the least text that has them.
HELD = 8
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser (fixed public constants)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _packed(shingles: np.ndarray) -> bytes:
    """Ascending hashes, first the highest bytes of all, then the next: the first plane hardly changes and compresses well."""
    return shingles.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - WIDTH :].T.tobytes()


def unpacked(packed: bytes) -> np.ndarray:
    wide = np.zeros((len(packed) // WIDTH, 8), np.uint8)
    wide[:, 8 - WIDTH :] = np.frombuffer(packed, np.uint8).reshape(WIDTH, -1).T
    return wide.view(">u8").ravel().astype(np.uint64)


def folded(parity: np.ndarray, size: int) -> np.ndarray:
    """Parity bytes of a set for a smaller power of two."""
    while len(parity) > size:
        parity = parity[: len(parity) // 2] ^ parity[len(parity) // 2 :]
    return parity


def may_be_alike(p: bytes, q: bytes, n: int, m: int, similarity: float) -> bool:
    """False only for sets of n and m shingles whose parities p and q differ in more bits than those of near copies can."""
    a, b = np.frombuffer(p, np.uint8), np.frombuffer(q, np.uint8)
    size = min(len(a), len(b))
    apart = int(np.bitwise_count(folded(a, size) ^ folded(b, size)).sum())
    return apart <= n + m - 2 * math.ceil((n + m) * (similarity / (1 + similarity)) - 1e-9)


def profile(text: bytes | None, views: int = VIEWS, k: int = SHINGLE) -> tuple[list[int], int, bytes, list[int], bytes]:
    """(fingerprints of the word set, number of distinct shingles, their hashes in order, WIDTH bytes each, BITS parity
    bits as long numbers, all parity bits). Words are the runs without ASCII white space, A-Z lower-cased; fewer than k words
    make one shingle, none make no shingle."""
    words = (text or b"").lower().split()
    digest = xxhash.xxh3_64_intdigest
    h = np.fromiter((digest(w) for w in words), np.uint64, len(words))
    own = np.unique(h)
    with np.errstate(over="ignore"):
        fps = [majority(_mix(own + np.uint64(v + 1) * _STEP)) for v in range(views)]
        n = max(1, len(h) - k + 1) if len(h) else 0
        shingles = np.zeros(n, np.uint64)
        for j in range(min(k, len(h))):
            shingles = _mix(shingles + h[j : j + n] * _STEP + np.uint64(j + 1))
    shingles = np.unique(shingles >> np.uint64(64 - 8 * WIDTH))
    wide = max(BITS, 1 << (BITS_EACH * len(shingles) - 1).bit_length()) if len(shingles) else BITS
    odd = np.bincount((shingles % np.uint64(wide)).astype(np.int64), minlength=wide).astype(np.uint8) & 1
    parity = np.packbits(odd)
    bits = folded(parity, BITS // 8).view(np.int64).tolist()
    return [f - (1 << 64) if f >= 1 << 63 else f for f in fps], len(shingles), _packed(shingles), bits, parity.tobytes()


def jaccard(a: bytes, b: bytes) -> float:
    """Likeness of two sets of shingles. Two texts without words are alike."""
    x, y = unpacked(a), unpacked(b)
    if not len(x) and not len(y):
        return 1.0
    every = np.sort(np.concatenate([x, y]), kind="stable")
    both = int((every[1:] == every[:-1]).sum())
    return both / (len(every) - both)


def _held(pairs: DataFrame, texts: Bucketed, what: str, fits) -> DataFrame:
    """The pairs (a, b, x, y, cx, cy) for which fits(p, q, n, m) holds, p and q a column of the two texts, n and m their numbers
    of shingles. Texts in a pair are found bucket by bucket; only they meet the pairs. A text with many pairs is the skewed
    side of a join, which Spark splits."""
    columns = ["a", "b", "x", "y", "cx", "cy"]

    def run(batches):
        for batch in slices(batches, 256):
            got = [fits(*v) for v in zip(*(batch.column(i).to_pylist() for i in range(6, 10)))]
            yield batch.select(columns).filter(pa.array(got, pa.bool_()))

    def ends(end: str) -> DataFrame:
        wanted = pairs.select(F.col(f"c{end}").alias("content")).distinct()
        own = texts.rows().join(wanted, "content", "left_semi")
        return own.select(F.col("tid").alias(end), F.col(what).alias(f"p{end}"), F.col("n").alias(f"n{end}"))

    got = pairs.select(*columns).join(ends("x"), "x").join(ends("y"), "y")
    return got.select(*columns, "px", "py", "nx", "ny").mapInArrow(run, "a long, b long, x long, y long, cx binary, cy binary")


def _verified(pairs: DataFrame, texts: Bucketed, similarity: float) -> DataFrame:
    """The pairs of texts that are near copies, as (a, b). All parity bits of the two come first, an eighth of a byte or so for
    each byte of shingles; few pairs whose shingles are then compared are none."""
    likely = materialize(_held(pairs, texts, "parity", lambda p, q, n, m: may_be_alike(p, q, n, m, similarity)), "likely")
    return _held(likely, texts, "shingles", lambda p, q, n, m: jaccard(p, q) >= similarity).select("a", "b")


def _alike(n: Column, m: Column, similarity: float) -> Column:
    """Two sets can only be so alike if their sizes are."""
    return F.least(n, m) >= similarity * F.greatest(n, m) - 1e-9


def _shared(n: Column, m: Column, similarity: float) -> Column:
    """How many shingles texts with n and m have in common at least if they are near copies."""
    return F.ceil((n + m) * (similarity / (1 + similarity)) - 1e-9)


def _common(texts: DataFrame, count: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingles, ascending, in how many texts each was seen) of those that a bounded draw of texts has most often."""

    def run(batches):
        for b in slices(batches):
            own = [unpacked(x) for x in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(own or [np.zeros(0, np.uint64)]).astype(np.int64))], ["key"])

    drawn = texts.where(F.pmod(F.xxhash64("content"), F.lit(max(1, count // SAMPLE))) == 0).select("shingles")
    seen = drawn.mapInArrow(run, "key long").groupBy("key").agg(F.count("*").alias("n")).where("n > 2")
    rows = sorted(seen.orderBy(F.desc("n"), "key").limit(COMMON).collect())
    return np.array([r["key"] for r in rows], np.int64), np.array([r["n"] for r in rows], np.int64)


def _places(values: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(where each value would stand among the ascending known ones, whether it is one of them)."""
    if not len(known):
        return np.zeros(len(values), np.int64), np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return at, known[at] == values


def _prefix(packed: bytes, known: np.ndarray, often: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """(the first fifth of a text's shingles, rare ones first; whether each is known to be common)."""
    own = unpacked(packed).astype(np.int64)
    at, there = _places(own, known)
    seen = np.zeros(len(own), np.int64)
    seen[there] = often[at[there]]
    first = np.lexsort((own, seen))[: len(own) - int(np.ceil(len(own) * similarity - 1e-9)) + 1]
    return own[first], seen[first] > 0


def _prefix_rows(texts: DataFrame, known: np.ndarray, often: np.ndarray, similarity: float) -> DataFrame:
    """texts (tid, root, shingles) -> (key, tid, pos, hot) of every text's prefix, but for keys that one root alone has.

    Of the shingles known to be common it is found first, in sums formed before the shuffle, which of them several roots have;
    the rows of the others, such as those of a group that is connected by now, are not even made. The rows that are left are
    counted by key; those of a common key are dealt to several tasks meanwhile."""
    broadcast = texts.sparkSession.sparkContext.broadcast

    def hot(batches):
        known, often = lists.value
        for b in slices(batches):
            keys, roots = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for root, p in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                own, common = _prefix(p, known, often, similarity)
                keys.append(own[common])
                roots.append(np.full(int(common.sum()), root, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(roots))], ["key", "root"])

    lists = broadcast((known, often))
    shared = texts.mapInArrow(hot, "key long, root long").groupBy("key").agg(F.min("root").alias("p"), F.max("root").alias("q")).where("p <> q")
    several = broadcast(np.array(sorted(r["key"] for r in shared.select("key").collect()), np.int64))  # at most COMMON

    def run(batches):
        known, often = lists.value
        for b in slices(batches):
            out = []
            for tid, p in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
                own, common = _prefix(p, known, often, similarity)
                keep = ~common | _places(own, several.value)[1]
                out.append((own[keep], np.full(int(keep.sum()), tid, np.int64), np.nonzero(keep)[0].astype(np.int32), common[keep]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], ["key", "tid", "pos", "hot"])

    rows = texts.mapInArrow(run, "key long, tid long, pos int, hot boolean")
    rows = rows.withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("tid"), F.lit(SALTS))).otherwise(0).cast("int"))
    several_texts = F.count("*").over(Window.partitionBy("key", "salt")) > 1
    return rows.withColumn("more", several_texts).where("hot or more").select("key", "tid", "pos")


def _near(similarity: float, bits: bool) -> Column:
    """Whether the rows x (the smaller text) and y of a key may belong to near copies. No near copy fails any of these bounds."""
    n, m, i, j = F.col("x.n"), F.col("y.n"), F.col("x.pos"), F.col("y.pos")
    shared = _shared(n, m, similarity)
    out = (
        (F.col("x.key") == F.col("y.key")) & (F.col("x.root") != F.col("y.root"))
        & ((n < m) | ((n == m) & (F.col("x.tid") < F.col("y.tid")))) & _alike(n, m, similarity)
        & (i <= n - _shared(n, n, similarity))  # the smaller text's prefix is the shorter one
        & (F.least(i, j) + F.least(n - i, m - j) >= shared)  # what lies before the shared shingle in both, it, and what follows
    )
    if bits:
        apart = [hamming(F.col(f"x.b{k}"), F.col(f"y.b{k}")) for k in range(BITS // 64)]
        out = out & (sum(apart[1:], apart[0]) <= n + m - 2 * shared)
    return out


def _pairs(rows: DataFrame, texts: Bucketed) -> DataFrame:
    """Joined rows x and y -> (a, b, x, y, cx, cy), each pair once, written."""
    out = rows.select(F.col("x.root").alias("a"), F.col("y.root").alias("b"), F.col("x.tid").alias("x"), F.col("y.tid").alias("y")).distinct()
    return materialize(_with_contents(out, texts), "pairs")


def _with_contents(pairs: DataFrame, texts: Bucketed) -> DataFrame:
    for end in ("x", "y"):
        pairs = pairs.join(texts.rows().select(F.col("tid").alias(end), F.col("content").alias(f"c{end}")), end)
    return pairs.select("a", "b", "x", "y", "cx", "cy")


def _join_roots(narrow: DataFrame, links: DataFrame) -> DataFrame:
    """narrow with the roots that the links between its roots give, written once."""
    moved = connected_components(links).withColumnRenamed("node", "root")
    out = narrow.join(moved, "root", "left").withColumn("root", F.coalesce("component", "root")).drop("component")
    return materialize(out, "roots")


def near_copy_groups(docs: DataFrame, similarity: float = SIMILARITY, views: int = VIEWS, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """-> (content, doc_id, group): for every distinct text its digest, its least id, and a number that near copies (and what
    they connect) share. Equal texts, by a digest of 128 bits, are one point from the start."""
    text = F.coalesce(F.col(text_col), F.lit(""))

    def run(batches):
        for b in slices(batches):
            got = [profile(t, views) for t in b.column(2).to_pylist()]
            fps, n, shingles, bits, parity = zip(*got) if got else ((), (), (), (), ())
            columns = [b.column(0), b.column(1), pa.array(fps, pa.list_(pa.int64())), pa.array(n, pa.int32()), pa.array(shingles, pa.binary()), pa.array(bits, pa.list_(pa.int64())), pa.array(parity, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "content", "fps", "n", "shingles", "bits", "parity"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), digest(text).alias("content"), text.cast("binary").alias("t"))
    rows = rows.mapInArrow(run, "doc_id long, content binary, fps array<long>, n int, shingles binary, bits array<long>, parity binary")
    points = rows.groupBy("content").agg(F.min("doc_id").alias("doc_id"), F.first("fps").alias("fps"), F.first("n").alias("n"), F.first("shingles").alias("shingles"), F.first("bits").alias("bits"), F.first("parity").alias("parity"))
    with small_batches(docs.sparkSession):
        texts = Bucketed(points.withColumn("tid", F.monotonically_increasing_id()), "content", "texts")
        try:
            return _groups(texts, similarity, radius)
        finally:
            texts.drop()


def _groups(texts: Bucketed, similarity: float, radius: int) -> DataFrame:
    words = [F.col("bits")[i].alias(f"b{i}") for i in range(BITS // 64)]
    narrow = texts.rows().select("tid", "content", "n", F.col("tid").alias("root"), *words)

    # first step: the grid over fingerprints; every text against one of its cell's, the least in the cell's own order
    grids = len(grid_masks(radius, SLABS))
    points = texts.rows().where("n > 0").select("tid", "n", F.posexplode("fps").alias("view", "fp"))
    cells = grid_cells(points, radius, SLABS).withColumn("cell", F.xxhash64(F.col("view") * grids + F.col("grid"), "cell")).drop("view", "grid")
    cells = cells.withColumn("o", F.col("tid").bitwiseXOR(F.col("cell")))
    least = cells.groupBy("cell").agg(F.min(F.struct("o", "tid", "fp", "n")).alias("c"))
    x = cells.alias("x").join(least.alias("l"), "cell")
    near = (F.col("x.tid") != F.col("l.c.tid")) & (hamming(F.col("x.fp"), F.col("l.c.fp")) <= radius) & _alike(F.col("x.n"), F.col("l.c.n"), similarity)
    stars = x.where(near).select(F.col("x.tid").alias("x"), F.col("l.c.tid").alias("y")).distinct()
    stars = materialize(_with_contents(stars.select(F.col("x").alias("a"), F.col("y").alias("b"), "x", "y"), texts), "pairs")
    blank = texts.rows().where("n = 0").select("tid")
    blanks = blank.select(F.col("tid").alias("a"), F.lit(blank.agg(F.min("tid")).first()[0]).cast("long").alias("b"))
    roots = _join_roots(narrow, _verified(stars, texts, similarity).unionAll(blanks))

    # second step: prefixes
    count = roots.count()
    known, often = _common(texts.rows(), count)
    with_roots = texts.rows().join(roots.select("content", "root"), "content").select("tid", "root", "shingles")
    rows = materialize(_prefix_rows(with_roots, known, often, similarity), "prefixes")
    # each text against the least ones that share its most common shingles, by one order for all: large groups close up
    narrow = rows.join(roots.select("tid", "root", "n"), "tid")
    own = narrow.withColumn("rank", F.row_number().over(Window.partitionBy("tid").orderBy(F.desc("pos")))).where(F.col("rank") <= HELD).drop("rank")
    first = rows.groupBy("key").agg(F.min("tid").alias("tid"))
    least = first.join(narrow, ["key", "tid"])
    either = [(own.alias("x"), least.alias("y")), (least.alias("x"), own.alias("y"))]
    x, y = [p.join(q, _near(similarity, bits=False)).select(*[F.col(f"{s}.{c}").alias(f"{s}{c}") for s in "xy" for c in ("root", "tid")]) for p, q in either]
    both = x.unionAll(y).select(F.struct(F.col("xroot").alias("root"), F.col("xtid").alias("tid")).alias("x"), F.struct(F.col("yroot").alias("root"), F.col("ytid").alias("tid")).alias("y"))
    held = _pairs(both, texts)
    closer = _join_roots(roots, _verified(held, texts, similarity))
    # all pairs that are still apart
    wide = rows.join(closer.drop("content"), "tid")
    pairs = _pairs(wide.alias("x").join(wide.alias("y"), _near(similarity, bits=True)), texts)
    out = _join_roots(closer, _verified(pairs, texts, similarity))
    out = materialize(texts.rows().select("content", "doc_id").join(out.select("content", F.col("root").alias("group")), "content"), "groups")
    discard(stars, rows, held, pairs, roots, closer)
    return out


def digest(text: Column) -> Column:
    """128 bits that stand for a text."""
    return F.unhex(F.md5(text.cast("binary")))


def without_near_copies(docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, all columns, with one document of each group of near copies: the one with the least id.

    Exact copies and repeated rows are copies too. Null text counts as empty; all texts without words are one group; texts of
    fewer than five words are alike only if their words are. Null ids rank after all others. An empty table stays empty."""
    groups = near_copy_groups(docs, similarity, id_col=id_col, text_col=text_col)
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "content")
    kept = groups.groupBy("group").agg(F.min(order).alias("k")).select(F.col("k.doc_id").alias("__vellum_id"), F.col("k.content").alias("__vellum_content"))
    own, text = F.col(id_col).cast("long"), F.coalesce(F.col(text_col), F.lit(""))
    # rows that agree in id and text are rare: only where there are any is one of each chosen, in each task first
    many = docs.select(own.alias("__vellum_id"), digest(text).alias("__vellum_content")).groupBy("__vellum_id", "__vellum_content").count().where("count > 1").limit(1).count()
    marked = docs.withColumns({"__vellum_id": own, "__vellum_content": digest(text)})
    same = F.col("m.__vellum_id").eqNullSafe(F.col("k.__vellum_id")) & (F.col("m.__vellum_content") == F.col("k.__vellum_content"))
    out = marked.alias("m").join(kept.alias("k"), same, "left_semi")
    if many:
        out = out.dropDuplicates(["__vellum_id", "__vellum_content"])
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
