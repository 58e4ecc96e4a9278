"""Sharding (9): contiguous shards of near equal bytes from global prefix sums.

Rows are ordered by (60 bits of the text's digest, id); per-partition totals give every partition its offset, and a running sum inside the
partition gives every row its global byte position. Shards are cut at equal byte targets, each cut moved to the nearer edge
of the group of equal texts in which it falls, so that copies stay in one shard.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize


def shard_by_bytes(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """-> (doc_id, size, text_crc32, text_hash, start, shard, slot).

    Texts are dropped in the first projection; some fifty bytes a document are shuffled. The order's key ends in the id, so
    a text with a third of all rows is spread over partitions. To the driver go one row for each partition and at most two
    for each cut. Null text counts as empty; repeated rows each take a slot; null ids come first; an empty table gives no
    rows. Only id_col and text_col are read, so other columns may have any name."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    narrow = docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long").alias("text_hash"),
    )
    order = ["text_hash", "doc_id"]
    ranged = narrow.repartitionByRange(*order).sortWithinPartitions(*order)
    table = materialize(ranged.withColumn("part", F.spark_partition_id()), "order")

    totals = sorted(map(tuple, table.groupBy("part").agg(F.sum("size").cast("long"), F.count("*")).collect()))
    parts, at, rows = [], 0, 0
    for part, size, n in totals:
        parts.append((part, at, rows))
        at, rows = at + size, rows + n
    spark = docs.sparkSession
    offsets = spark.createDataFrame(parts, "part int, part_start long, part_row long")
    w = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inside = table.withColumn("before", F.coalesce(F.sum("size").over(w), F.lit(0))).withColumn("n", F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1)
    # one row for each partition of the shuffle: some thousands at most
    placed = inside.join(F.broadcast(offsets), "part").select(
        "doc_id", "size", "text_crc32", "text_hash", "part", (F.col("part_start") + F.col("before")).alias("start"), (F.col("part_row") + F.col("n")).alias("row"),
    )
    placed = materialize(placed, "placed")

    cuts, firsts = _cuts(placed, parts, at, shards)
    shard = F.lit(0)
    first = F.lit(0)
    for k, (cut, row) in enumerate(zip(cuts, firsts), start=1):
        shard = F.when(F.col("start") >= cut, F.lit(k)).otherwise(shard)
        first = F.when(F.col("start") >= cut, F.lit(row)).otherwise(first)
    return placed.select("doc_id", "size", "text_crc32", "text_hash", "start", shard.cast("int").alias("shard"), (F.col("row") - first).cast("long").alias("slot"))


def _cuts(placed: DataFrame, parts: list, total: int, shards: int) -> tuple[list[int], list[int]]:
    """For each of the shards - 1 cuts its byte position and the number of its first row."""
    if not total:
        return [], []
    targets = [total * k // shards for k in range(1, shards)]
    starts = [p[1] for p in parts]
    there = sorted({parts[bisect_right(starts, t) - 1][0] for t in targets})
    hit = F.lit(False)
    for t in targets:
        hit = hit | ((F.col("start") <= t) & (F.col("start") + F.col("size") > t))
    hashes = [r[0] for r in placed.where(F.col("part").isin(there)).where(hit).select("text_hash").distinct().collect()]
    groups = placed.where(F.col("text_hash").isin(hashes)).groupBy("text_hash").agg(
        F.min("start").alias("a"), F.max(F.col("start") + F.col("size")).alias("b"), F.min("row").alias("i"), F.max("row").alias("j"),
    ).collect()
    cuts, firsts = [], []
    for t in targets:
        g = next(g for g in groups if g["a"] <= t < g["b"])
        cut, row = (g["a"], g["i"]) if t - g["a"] < g["b"] - t else (g["b"], g["j"] + 1)
        cuts.append(cut)
        firsts.append(row)
    return cuts, firsts


def op9_sharding(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = shard_by_bytes(docs, shards=8)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _crc_table() -> list[int]:
    """The table of CRC-32 by its rule: the reflected polynomial (fixed value), eight steps for each byte."""
    out = []
    for c in range(256):
        for _ in range(8):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        out.append(c)
    return out


ORACLE = f"""with k as (select {_crc_table()}::bigint[] as k),
d as (select doc_id, coalesce(text, '') as t, strlen(t) + 1 as size, ('0x' || left(md5(t), 15))::bigint as h from documents),
s as (select *, sum(size) over w - size as start, row_number() over w - 1 as row, sum(size) over () as total from d window w as (order by h, doc_id rows unbounded preceding)),
g as (select h, min(start) as a, max(start + size) as b, min(row) as i, max(row) as j from s group by h),
goals as (select distinct total * k // 8 as goal from s, range(1, 8) r(k)),
cuts as (select case when goal - a < b - goal then a else b end as cut, case when goal - a < b - goal then i else j + 1 end as first, n from (select goal, count(*) over (order by goal) as n from goals) join g on a <= goal and goal < b)
select s.doc_id, s.size, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(regexp_extract_all(hex(encode(t)), '..'), lambda x: ('0x' || x)::bigint)), lambda c, b: xor(c >> 8, k[(xor(c, b) & 255) + 1])), 4294967295) as text_crc32,
  'bytes' as law, coalesce(max(n), 0)::int as shard, (s.row - coalesce(max(first), 0))::bigint as slot, null::int as grown_shard
from k, s left join cuts on cut <= s.start group by s.doc_id, s.size, s.t, s.row, k"""
