
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellum.functions import text as T

DEFAULT_LIMIT = 10 * 1024 * 1024


def scan(spark: SparkSession, roots: list[str], limit: int = DEFAULT_LIMIT, pattern: str = "*.pdf") -> DataFrame:
    """[SRC4, SET1] Files under the roots, those of limit bytes or more left out (0: none). The size filter is pushed to the
    file listing; contents are read only if the column is used."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(roots)
    files = files.withColumn("name", F.regexp_extract("path", r"([^/]*)$", 1))
    return files.where(F.col("length") < limit) if limit else files


def without_duplicates(files: DataFrame, order: str = "path") -> DataFrame:
    """[SET2, JN12, WIN4, SC21] files (name, length, content, order) without those whose name, size and content agree with an
    earlier one's; the columns but content. Contents are hashed where they are read and never shuffled: only the digest
    travels, so the join that would keep unique sizes from being hashed is not worth its shuffle."""
    narrow = files.withColumn("__digest", F.sha2("content", 256)).drop("content")
    first = F.row_number().over(Window.partitionBy("name", "length", "__digest").orderBy(order))
    return narrow.withColumn("__first", first).where("__first = 1").drop("__digest", "__first")


def seeded_hash(key: Column, seed: int) -> Column:
    """A text that depends on key, of any type, and seed alone, and orders rows by chance; the same in any engine."""
    return F.md5(F.concat(key.cast("string"), F.lit(f":{seed}")).cast("binary"))


def seeded_sample(rows: DataFrame, n: int, seed: int, key: str) -> DataFrame:
    """[LIM1, SRT3] n rows without replacement, in the order of their key (a number, a path); all rows if there are no more. The
    n least hashes are kept in each task, so only n rows of each are shuffled."""
    return rows.orderBy(seeded_hash(F.col(key), seed), key).limit(n).orderBy(key)


#: [FLT13] The keep rules: name -> condition over (maxlen, mlfrac, nfilled, rowfill). Fixed values.
RULES = {
    "shipped(keep all)": "true",
    "maxlen<=120": "maxlen <= 120",
    "maxlen<=300": "maxlen <= 300",
    "mlfrac<0.5": "mlfrac < 0.5",
    "rowfill>=0.5 & nf>=2": "nfilled >= 2 and rowfill >= 0.5",
    "rowfill>=0.6 & nf>=3": "nfilled >= 3 and rowfill >= 0.6",
    "rf>=0.5&nf>=2 & ml<=800": "nfilled >= 2 and rowfill >= 0.5 and maxlen <= 800",
}


def rule_sweep(features: DataFrame, labels: DataFrame) -> DataFrame:
    """[FLT13, FLT12, JN9, AGG10] -> (rule, kept_T, dropped_T, kept_F, dropped_F, kept_D, dropped_D) over all labelled grids
    (gid); the ambiguous class A is never scored. One pass: every rule is a column of conditional counts."""
    scored = features.join(labels.where(F.col("label").isin("T", "F", "D")), "gid")
    sums = [F.count_if(F.expr(f"({cond}) = {keep} and label = '{c}'")).alias(f"{i}_{c}_{keep}") for i, cond in enumerate(RULES.values()) for c in "TFD" for keep in ("true", "false")]
    wide = scored.agg(*sums)
    rows = [F.struct(F.lit(r).alias("rule"), *[F.col(f"{i}_{c}_{k}").alias(f"{w}_{c}") for c in "TFD" for k, w in (("true", "kept"), ("false", "dropped"))]) for i, r in enumerate(RULES)]
    return wide.select(F.inline(F.array(*rows)))


def grid_features(cells: DataFrame) -> DataFrame:
    """[AGG15, AGG1] cells (gid, row, col, text) -> the feature vector of each grid."""
    c = cells.withColumn("n", F.length("text")).withColumn("filled", F.col("text") != "")
    rows = c.groupBy("gid", "row").agg(F.count_if("filled").alias("f"), F.count("*").alias("width"))
    vote = rows.groupBy("gid").agg(F.count("*").alias("nrows"), F.max("width").alias("ncols"), F.count_if(F.col("f") >= 2).alias("nfilled"), F.count_if(F.col("f") > 0).alias("nonblank"))
    per = c.groupBy("gid").agg(
        F.count("*").alias("ncells"), (F.count_if(~F.col("filled")) / F.count("*")).alias("empty"), F.max("n").alias("maxlen"), F.median("n").alias("medlen"),
        F.percentile("n", F.lit(0.9)).alias("p90len"), F.count_if(F.contains("text", F.lit("\n"))).alias("nmultiline"), F.count_if("filled").alias("nonempty"),
    )
    out = vote.join(per, "gid")
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    return out.withColumns({"rowfill": share("nfilled", "nonblank"), "mlfrac": share("nmultiline", "nonempty")}).drop("nonempty")


def signal_sweep(grids: DataFrame, thresholds: list[float], signal: str = "rotated") -> DataFrame:
    """[AGG11] grids (signal, label, kept) -> what each threshold would drop of the kept grids, by class."""
    t = F.explode(F.array(*map(F.lit, thresholds))).alias("threshold")
    each = grids.where("kept").select(signal, "label", t).groupBy("threshold")
    return each.agg(*[F.count_if((F.col(signal) >= F.col("threshold")) & (F.col("label") == c)).alias(f"dropped_{c}") for c in "DTF"])


def score(docs: DataFrame, engine: str) -> DataFrame:
    """[CMP6] (doc_id, base, grids, bytes, notext, <engine> text, <engine>_s, <engine>_error) -> the same with a struct of the
    engine's metrics under its name; null where it failed. Tokens come from a column <engine>_tokens, null where unknown."""
    t, out, base = F.col(engine), F.col("__out"), F.col("__base")
    # markers hold digits of their own; without one the text's digits are the output's. Named columns are computed once.
    bare = F.when(F.contains(t, F.lit(T.NO_TEXT_MARKER)), T.without_markers(t)).otherwise(t)
    docs = docs.withColumns({"__out": T.digit_text(bare), "__base": T.digit_text(F.col("base"))})
    metrics = F.struct(
        T.glued(t).alias("glued"), T.mojibake(t).alias("mojibake"), T.mojibake_doc(t).alias("mojibake_doc"), T.phantom_rows(t, F.col("grids")).alias("phantom_rows"),
        T.digits_beyond(out, base).alias("digit_excess"), T.digits_beyond(base, out).alias("digit_deficit"), F.col(f"{engine}_tokens").alias("tokens"), F.col(f"{engine}_s").alias("s"),
    )
    return docs.withColumn(engine, F.when(F.col(f"{engine}_error").isNull(), metrics)).drop("__out", "__base")


def exact_medians(rows: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """[AGG8] -> (name, median) of each named number not below zero, the mean of the middle two for an even count, nulls left out;
    names without a value have no row. Values are counted before the shuffle. No task holds all values of a column: the
    middle ranks are looked for among sums over narrow ranges first, of which there are some ten thousand at most, then
    among the distinct values of the ranges they lie in."""
    each = rows.select(F.inline(F.array(*[F.struct(F.lit(n).alias("name"), c.cast("double").alias("v")) for n, c in columns.items()]))).where("v is not null")
    values = each.groupBy("name", "v").agg(F.count("*").alias("n")).withColumn("range", F.floor(F.log1p("v") * 1000))
    along = Window.partitionBy("name").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = values.groupBy("name", "range").agg(F.sum("n").alias("n"))
    ranges = ranges.withColumns({"before": F.coalesce(F.sum("n").over(along), F.lit(0)), "all": F.sum("n").over(Window.partitionBy("name"))})
    low, high = F.floor((F.col("all") + 1) / 2), F.floor(F.col("all") / 2) + 1  # ranks from 1
    holds = lambda before, n: ((low > before) & (low <= before + n)) | ((high > before) & (high <= before + n))
    middle = ranges.where(holds(F.col("before"), F.col("n"))).select("name", "range", "before", "all")
    inside = Window.partitionBy("name", "range").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    v = values.join(middle.hint("merge"), ["name", "range"]).withColumn("at", F.col("before") + F.coalesce(F.sum("n").over(inside), F.lit(0)))
    return v.where(holds(F.col("at"), F.col("n"))).groupBy("name").agg(((F.min("v") + F.max("v")) / 2).alias("median"))


COUNTERS = ("glued", "mojibake", "mojibake_doc", "phantom_rows", "digit_excess", "digit_deficit", "tokens")


def report(rows: DataFrame, engines: tuple[str, str], stock: str) -> DataFrame:
    """[CMP8: FLT9, FLT10, AGG6-AGG9, SNK5] Scored rows -> one row for each engine: counts over documents that both engines
    converted and whose source is well formed (by the stock engine's glue), failures over all. Aggregates alone: no name, path
    or text of a document can come out. The scores, a few numbers for each document, are kept until render.release()."""
    held = getattr(rows, "_held", ())
    rows = rows.select("bytes", "grids", "notext", *engines, *[f"{e}_error" for e in engines]).persist()
    ok = F.col(engines[0]).isNotNull() & F.col(engines[1]).isNotNull()
    well = ok & (F.col(f"{stock}.glued") <= T.BROKEN_SOURCE_GLUE)
    sums = [F.count_if(well).alias("n_docs"), F.count_if(ok & ~well).alias("n_broken"), F.sum(F.when(well, F.col("bytes"))).alias("bytes"), F.count_if(well & (F.col("grids") == 0)).alias("gridless"), F.sum(F.when(well, F.col("notext"))).alias("notext")]
    for e in engines:
        pick = lambda c, e=e: F.when(well, F.col(f"{e}.{c}"))
        sums += [F.coalesce(F.sum(pick(c)), F.lit(0)).alias(f"{e}__{c}") for c in COUNTERS]
        sums += [F.count_if(pick("glued") > 0).alias(f"{e}__docs_with_glue"), F.count_if(F.col(f"{e}_error").isNotNull()).alias(f"{e}__failures"), F.round(F.sum(pick("s")), 4).alias(f"{e}__elapsed")]
    wide = rows.agg(*sums)
    per = (*COUNTERS, "docs_with_glue", "failures", "elapsed")
    shared = [F.col(c) for c in ("n_docs", "n_broken", "bytes", "gridless", "notext")]
    each = [F.struct(F.lit(e).alias("engine"), *shared, *[F.col(f"{e}__{c}").alias(c) for c in per]) for e in engines]
    picked = {f"{e} {c}": F.when(well, F.col(f"{e}.{c}")) for e in engines for c in ("s", "glued", "digit_deficit")}
    middle = exact_medians(rows, picked).select(F.split_part("name", F.lit(" "), F.lit(1)).alias("engine"), F.split_part("name", F.lit(" "), F.lit(2)).alias("what"), "median")
    middle = middle.groupBy("engine").agg(*[F.max(F.when(F.col("what") == c, F.col("median"))).alias(f"median_{c}") for c in ("s", "glued", "digit_deficit")])
    out = wide.select(F.inline(F.array(*each))).join(middle.hint("merge"), "engine", "left")
    out = out.select("engine", *[c for c in out.columns if c != "engine" and not c.startswith("median_")], *[F.coalesce(c, F.lit(0.0)).alias(c) for c in middle.columns if c != "engine"])
    out._held = (rows, *held)
    return out


LABEL_SCHEMA = "file_id string, bbox array<double>, nrows int, ncols int, cov double, ncells int, empty double, maxlen int, medlen int, p90len int, nmultiline int, nested_in int, page int, idx int, gid int, mlfrac double"


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """[SRC7] Labelled grids, one JSON record for each line that is not blank; the schema is fixed, never inferred."""
    return spark.read.schema(LABEL_SCHEMA).json(path)


def with_file_names(labels: DataFrame, names: DataFrame) -> DataFrame:
    """[JN10] Records with the file that their opaque file_id stands for; those without one are skipped."""
    return labels.join(names.select("file_id", "filename"), "file_id")


def write_details(rows: DataFrame, path: str) -> None:
    """[SNK4] One JSON record for each document, failures included. It names documents, so it belongs outside of a repository."""
    rows.write.mode("overwrite").json(path)


def engine_diff(docs: DataFrame, left: str, right: str) -> DataFrame:
    """[CMP11] Two texts of a document side by side: (columns, n_left, n_right, only_left, only_right), the lines that one has
    and the other lacks. Within the row, without a join."""
    a, b = T.split_lines(F.col(left)), T.split_lines(F.col(right))
    return docs.select(
        *[c for c in docs.columns if c not in (left, right)], F.size(a).alias("n_left"), F.size(b).alias("n_right"),
        F.array_except(a, b).alias("only_left"), F.array_except(b, a).alias("only_right"),
    )
