"""Mixing sources to target weights (8): iterative proportional fitting, then sampling by calibrated probabilities.

Tokens are summed by (source, language, topic), with every category that the targets do not name under `*`. The sums are
raked until the three margins have the target shares of the wanted number of tokens, no cell beyond what it has; the raked
cells give every document its probability of inclusion. What the margins miss where that is impossible is reported. DataFrame
operations only; the raking itself is arithmetic on one small table, whose size the targets bound, not the data.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import words_of

OTHER = "*"
Cell = tuple[str, str, str]


@dataclass(frozen=True)
class Targets:
    """Shares of all tokens by category of each dimension; OTHER stands for all categories not named. They need not sum to
    1. fraction: tokens wanted, as a share of those there are."""

    source: dict[str, float]
    lang: dict[str, float]
    topic: dict[str, float]
    fraction: float = 0.5
    seed: int = 8

    def dimensions(self) -> tuple[dict[str, float], ...]:
        return tuple({OTHER: 0.0} | d for d in (self.source, self.lang, self.topic))


#: Every named source alike, though one of them may hold a third of all rows; languages and topics tilted.
PRODUCTION = Targets(
    source={f"src{i}": 0.05 for i in range(20)} | {OTHER: 0.02},
    lang={"en": 0.5, "de": 0.2, "fr": 0.2, "es": 0.1, OTHER: 0.01},
    topic={"prose": 0.9, "tabular": 0.04, "emphatic": 0.02, "marked": 0.04},
)


def topic_of(text: Column) -> Column:
    """A coarse topic by a text's form: tabular, emphatic, marked or prose (also null and empty texts)."""
    return (
        F.when(F.contains(text, F.lit(" | ")), "tabular").when(F.contains(text, F.lit("!!")), "emphatic")
        .when(F.contains(text, F.lit("###")) | F.contains(text, F.lit("$$$")) | F.contains(text, F.lit("%%%")), "marked").otherwise("prose")
    )


def _named(col: Column, named: dict[str, float]) -> Column:
    return F.when(col.isin(*[k for k in named if k != OTHER]), col).otherwise(OTHER)


@dataclass(frozen=True)
class Calibration:
    """probability: of inclusion, by cell. margins: (dimension, category, wanted share, reached share). gap: the greatest
    difference of those two. rounds: of fitting. settled: whether the fitting came to rest."""

    probability: dict[Cell, float]
    margins: tuple[tuple[str, str, float, float], ...]
    gap: float
    rounds: int
    settled: bool


def _wanted(cells: dict[Cell, float], targets: Targets) -> list[dict[str, float]]:
    """The share of each category by dimension. Categories without a token drop out and the others share their part."""
    out = []
    for d, wanted in enumerate(targets.dimensions()):
        present = {k: wanted.get(k, 0.0) for k in sorted({c[d] for c in cells})}
        whole = sum(present.values())
        out.append({k: v / whole for k, v in present.items()} if whole else {})
    return out


def calibrate(tokens: dict[Cell, float], targets: Targets, rounds: int = 500, tolerance: float = 1e-10) -> Calibration:
    """Iterative proportional fitting with a limit to each cell, what it has. In each step the cells of a category that are
    not full are scaled so that the category has its share of the wanted tokens, full ones counted; a cell that overflows is full
    from then on within the step, and the others make up for it. Cells without a token stay empty."""
    have = {c: t for c, t in sorted(tokens.items()) if t > 0}
    wanted = targets.fraction * sum(have.values())
    margins = _wanted(have, targets)
    fit = {c: t * targets.fraction for c, t in have.items()}
    moved, done = 0.0, 0
    for done in range(1, rounds + 1):
        moved = 0.0
        for d, margin in enumerate(margins):
            for k, share in margin.items():
                own = [c for c in have if c[d] == k]
                for c, v in _scaled({c: fit[c] for c in own}, have, share * wanted).items():
                    moved = max(moved, abs(v - fit[c]) / max(wanted, 1e-300))
                    fit[c] = v
        if moved < tolerance:
            break
    whole = sum(fit.values())
    report = tuple((("source", "lang", "topic")[d], k, share, sum(v for c, v in fit.items() if c[d] == k) / whole if whole else 0.0) for d, m in enumerate(margins) for k, share in m.items())
    gap = max((abs(x[2] - x[3]) for x in report), default=0.0)
    return Calibration({c: min(1.0, fit[c] / t) if t > 0 else 0.0 for c, t in tokens.items()}, report, gap, done, moved < tolerance)


def _scaled(own: dict[Cell, float], most: dict[Cell, float], goal: float) -> dict[Cell, float]:
    """own times one factor, each value at most `most`, so that they sum to the goal, or are all full."""
    full: set[Cell] = set()
    while True:
        rest = sum(v for c, v in own.items() if c not in full)
        left = goal - sum(most[c] for c in full)
        factor = max(0.0, left) / rest if rest > 0 else 0.0
        more = {c for c, v in own.items() if c not in full and v * factor > most[c]}
        if not more:
            return {c: most[c] if c in full else v * factor for c, v in own.items()}
        full |= more


def _cells(docs: DataFrame, targets: Targets, topic: Column, text_col: str, source_col: str, lang_col: str) -> DataFrame:
    s, l, _ = targets.dimensions()
    d = docs.withColumns({"__vellum_source": _named(F.col(source_col), s), "__vellum_lang": _named(F.col(lang_col), l), "__vellum_topic": topic})
    d = d.withColumn("__vellum_topic", _named(F.col("__vellum_topic"), targets.dimensions()[2]))
    return d.withColumn("__vellum_words", F.size(words_of(F.col(text_col))).cast("long"))


def _uniform(id_col: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on the id and the seed alone."""
    return F.shiftrightunsigned(F.xxhash64(id_col, F.lit(seed)), 11) / F.lit(float(1 << 53))


def with_probabilities(docs: DataFrame, targets: Targets = PRODUCTION, topic: Column | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang") -> DataFrame:
    """docs with the columns __vellum_source, __vellum_lang, __vellum_topic (cell), __vellum_words (words), __vellum_chance
    (probability), __vellum_taken, and __vellum_gap (by how much the worst margin misses its share, the same in all rows).

    Sums are formed in each task before the shuffle, so that a source with a third of all rows does not gather. At most
    (sources + 1) * (languages + 1) * (topics + 1) of the targets' categories reach the driver and come back as one constant
    lookup. Null sources, languages and categories without a target count as `*`; null texts have no words and, like all of a
    cell without words, probability 0; long texts are counted whole; an empty table stays empty. Repeated ids are taken or left
    together. Only id_col, text_col, source_col and lang_col are read; other columns, whatever their names, stay."""
    topic = topic_of(F.col(text_col)) if topic is None else topic
    d = _cells(docs, targets, topic, text_col, source_col, lang_col)
    sums = d.groupBy("__vellum_source", "__vellum_lang", "__vellum_topic").agg(F.sum("__vellum_words").alias("n")).collect()
    tokens = {(r["__vellum_source"], r["__vellum_lang"], r["__vellum_topic"]): float(r["n"]) for r in sums}
    fitted = calibrate(tokens, targets)
    chance = fitted.probability
    key = F.concat_ws("\x1f", "__vellum_source", "__vellum_lang", "__vellum_topic")
    pairs = [x for c, p in sorted(chance.items()) for x in (F.lit("\x1f".join(c)), F.lit(p))]
    p = F.element_at(F.create_map(*pairs), key) if pairs else F.lit(None).cast("double")
    d = d.withColumns({"__vellum_chance": F.coalesce(p, F.lit(0.0)), "__vellum_gap": F.lit(fitted.gap)})
    return d.withColumn("__vellum_taken", _uniform(F.col(id_col), targets.seed) < F.col("__vellum_chance"))


def sample(docs: DataFrame, targets: Targets = PRODUCTION, **columns) -> DataFrame:
    """The documents that the mixture takes, with their own columns."""
    return with_probabilities(docs, targets, **columns).where("__vellum_taken").select(*[F.col(f"`{c}`") for c in docs.columns])


def op8_mixing(spark, sf_dir: str) -> DataFrame:
    """-> (doc_id, source, lang, topic, n_tokens, probability, taken, margin_gap) of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source", "lang")
    out = with_probabilities(docs, PRODUCTION)
    return out.select("doc_id", F.col("__vellum_source").alias("source"), F.col("__vellum_lang").alias("lang"), F.col("__vellum_topic").alias("topic"), F.col("__vellum_words").alias("n_tokens"), F.col("__vellum_chance").alias("probability"), F.col("__vellum_taken").alias("taken"), F.col("__vellum_gap").alias("margin_gap"))
