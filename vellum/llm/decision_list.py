"""Quality rules (4): fixed base rules and a learned decision list over text statistics. DataFrame operations only.

The list is learned by sequential covering: rules, conjunctions of thresholds, are grown on two thirds of the labelled
statistics for the gain in precision, pruned on the last third, and kept while they are precise there; what a rule covers is
taken out before the next is grown. The result is one ordered conditional expression.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WS, crc_fold, drawn, words_of

SYMBOLS = "#*$%&|<>"
WINDOW = 8
FEATURES = ("n_words", "mean_word", "symbol_share", "upper_share", "mark_share", "distinct_share", "repeat_share", "dup_line_share")


def base_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """-> (doc_id, the base statistics, and what the learned list looks at besides). One pass over whole texts, no shuffle.

    Repeated windows: each word is hashed once and three doublings give the hash of every window of eight; only texts that do
    hold a repeated window are sorted. Null text has no words: every count is zero and every share zero."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.select(F.col(id_col).alias("doc_id"), text.alias("t"))
    d = d.select("doc_id", "t", words_of(F.col("t")).alias("w"))
    d = d.select("doc_id", "t", "w", F.transform("w", lambda x: F.xxhash64(x)).alias("h"))
    for step in (1, 2, 4):
        d = d.select("doc_id", "t", "w", F.transform("h", lambda x, i: F.xxhash64(x, F.get("h", i + step))).alias("h"))  # noqa: B023
    n = F.size("w")
    d = d.select("doc_id", "t", "w", F.slice("h", 1, F.greatest(n - (WINDOW - 1), F.lit(0))).alias("h"))
    lines = F.filter(F.split("t", "\n"), lambda x: F.regexp_replace(x, WS, "") != "")
    spaceless = F.translate("t", " \t\n\x0b\x0c\r", "")
    d = d.select(
        "doc_id", F.size("w").cast("long").alias("n_words"), F.length(spaceless).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        lines.alias("l"), _covered(F.col("h")).cast("long").alias("n_repeat_words"), F.size(F.array_distinct("w")).alias("distinct"),
        (F.length("t") - F.length(F.regexp_replace("t", r"\p{Lu}", ""))).alias("upper"), (F.length("t") - F.length(F.translate("t", "!?.,;:", ""))).alias("marks"),
    )
    words, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    return d.select(
        "doc_id", "n_words", "word_chars", "n_symbols", (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"), "n_repeat_words",
        (F.col("word_chars") / words).alias("mean_word"), (F.col("n_symbols") / chars).alias("symbol_share"), (F.col("upper") / chars).alias("upper_share"),
        (F.col("marks") / chars).alias("mark_share"), (F.col("distinct") / words).alias("distinct_share"), (F.col("n_repeat_words") / words).alias("repeat_share"),
        ((F.size("l") - F.size(F.array_distinct("l"))) / F.greatest(F.size("l"), F.lit(1))).alias("dup_line_share"),
    )


def _covered(windows: Column) -> Column:
    """How many words stand in windows that occur at least twice. windows: the hash of the window at each word."""
    pairs = F.sort_array(F.transform(windows, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))

    def starts(s: Column) -> Column:
        same = lambda e, j: F.coalesce(F.get(s, j)["h"] == e["h"], F.lit(False))
        return F.filter(F.transform(s, lambda e, i: F.when(same(e, i - 1) | same(e, i + 1), e["p"])), lambda p: p.isNotNull())

    def total(p: Column) -> Column:
        return F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x)

    # one-element arrays bind an intermediate array to a name, so that it is computed once
    once = lambda value, f: F.element_at(F.transform(F.array(value), f), 1)
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(once(pairs, lambda s: once(F.sort_array(starts(s)), total)))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    cut: float

    def holds(self, x: dict) -> np.ndarray:
        return x[self.feature] >= self.cut if self.above else x[self.feature] <= self.cut

    def column(self) -> Column:
        c = F.col(self.feature)
        return c >= F.lit(self.cut) if self.above else c <= F.lit(self.cut)


Rule = tuple[Condition, ...]


def _covers(rule: Rule, x: dict, n: int) -> np.ndarray:
    out = np.ones(n, bool)
    for c in rule:
        out &= c.holds(x)
    return out


def _grow(x: dict, bad: np.ndarray, weight: np.ndarray, longest: int, cuts: int) -> Rule:
    rule: Rule = ()
    inside = np.ones(len(bad), bool)
    for _ in range(longest):
        p0, all0 = weight[inside & bad].sum(), weight[inside].sum()
        if p0 == 0 or p0 >= 0.999 * all0:
            break
        best, gain = None, 1e-9
        for f in FEATURES:
            for cut in np.unique(np.quantile(x[f][inside], np.linspace(0.02, 0.98, cuts))):
                for above in (True, False):
                    c = Condition(f, above, float(cut))
                    now = inside & c.holds(x)
                    p1, all1 = weight[now & bad].sum(), weight[now].sum()
                    if p1 and (g := p1 * (np.log2(p1 / all1) - np.log2(p0 / all0))) > gain:
                        best, gain = c, g
        if best is None:
            break
        rule, inside = (*rule, best), inside & best.holds(x)
    return rule


def learn(stats: dict[str, np.ndarray], bad: np.ndarray, weight: np.ndarray, *, rules: int = 12, longest: int = 4, cuts: int = 24, least_precision: float = 0.9, least_rows: int = 5) -> list[Rule]:
    """The ordered rules for bad texts. weight makes the sample's class shares those of all labelled rows. Deterministic: the
    first two of every three rows grow, the third prunes."""
    n = len(bad)
    left = np.ones(n, bool)
    prune = np.arange(n) % 3 == 2
    out: list[Rule] = []
    for _ in range(rules):
        g, p = left & ~prune, left & prune
        if (g & bad).sum() < least_rows or not p.any():
            break
        take = lambda m: {f: v[m] for f, v in stats.items()}
        rule = _grow(take(g), bad[g], weight[g], longest, cuts)
        held, is_bad, w = take(p), bad[p], weight[p]

        def worth(r: Rule) -> float:
            c = _covers(r, held, len(is_bad))  # noqa: B023
            good, all_ = w[c & ~is_bad].sum(), w[c].sum()  # noqa: B023
            return (all_ - 2 * good) / all_ if all_ else -1.0

        if not rule:
            break
        rule = max((rule[:k] for k in range(len(rule), 0, -1)), key=worth)
        c = _covers(rule, stats, n) & left
        if worth(rule) < 2 * least_precision - 1 or weight[c & bad].sum() < least_precision * weight[c].sum():
            break
        out.append(rule)
        left &= ~c
    return out


def train(docs: DataFrame, labels: DataFrame, *, per_class: int = 1500, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> list[Rule]:
    """Learn the list from a bounded sample: per_class labelled rows of either class, chosen by the hash of their id. No
    labelled rows of a class: an empty list. Null labels and texts teach nothing."""
    known = labels.where(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("y"))
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return []
    chosen = drawn(known, "y", "doc_id", per_class, counts)  # 2 * per_class ids
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    rows = base_statistics(texts.join(F.broadcast(chosen.select("doc_id").distinct()), "doc_id")).join(F.broadcast(chosen), "doc_id")
    rows = rows.select("y", *FEATURES).orderBy(F.xxhash64("doc_id"), *FEATURES, "y").limit(4 * per_class).collect()
    if not rows:
        return []
    bad = np.array([r["y"] == 0 for r in rows])
    weight = np.array([counts[r["y"]] for r in rows], float) / np.where(bad, max(1, bad.sum()), max(1, (~bad).sum()))
    return learn({f: np.array([float(r[f]) for r in rows]) for f in FEATURES}, bad, weight)


def verdict(rules: list[Rule]) -> Column:
    """True unless a rule of the list covers the text: one ordered conditional."""
    out = None
    for rule in rules:
        held = rule[0].column()
        for c in rule[1:]:
            held = held & c.column()
        out = F.when(held, F.lit(False)) if out is None else out.when(held, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def judge(docs: DataFrame, rules: list[Rule], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """-> (doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept). base_failed: under 20
    words, or over 30 % of them in repeated windows. kept: neither that nor covered by the list. Null text fails. Repeated
    rows are judged alike, an empty table gives no rows, other columns are not read."""
    stats = base_statistics(docs, id_col, text_col)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    out = stats.withColumns({"base_failed": failed, "listed": verdict(rules)})
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & F.col("listed")).alias("kept"))


def op4_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return judge(docs, train(docs, labels.where(crc_fold(F.col("doc_id")) != 1)))
