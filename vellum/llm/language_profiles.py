"""Language ID (5): rank-order n-gram profiles and the out-of-place distance (Cavnar and Trenkle, 1994).

A language's profile is its most frequent letter n-grams in order of frequency. A document's own profile is held against each:
every n-gram adds how far its two ranks lie apart, or the greatest possible amount if the language's profile lacks it. The
language at the least distance wins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_fold, drawn

UNKNOWN = "und"
#: N-grams of a profile, the longest n-gram, and how many texts of a language teach its profile.
TOP, LONGEST, PER_LANGUAGE = 400, 3, 600
#: Longer texts teach no profile: what the driver gathers is bounded in bytes too.
MOST_BYTES = 1 << 18
_BITS = 21  # a code point


@cache
def _letters() -> np.ndarray:
    """For every code point its lower-case letter, or 0 where it is no letter."""
    table = np.zeros(0x110000, np.int64)
    for c in range(0x110000):
        x = chr(c)
        if x.isalpha():
            low = x.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


def ngrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(n-grams, counts) of a whole text: runs of letters, lower-cased, with a blank at either end, 1 to LONGEST
    characters packed in one number. No n-gram is a lone blank or spans a blank. No letter: empty."""
    codes = np.frombuffer((text or "").encode("utf-32-le", "replace"), np.uint32)
    c = np.concatenate([[0], _letters()[codes], [0]])
    c = c[np.concatenate([[True], (c[1:] != 0) | (c[:-1] != 0)])]  # one blank between words
    if len(c) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    grams = [c[c != 0]]
    shown = np.where(c == 0, ord(" "), c)  # a blank of value 0 would be lost at the front of a packed n-gram
    packed = shown
    for n in range(2, LONGEST + 1):
        packed = (packed[:-1] << _BITS) | shown[n - 1 :]
        inner = np.ones(len(packed), bool)
        for k in range(1, n - 1):
            inner &= c[k : k + len(packed)] != 0
        grams.append(packed[inner])
    return np.unique(np.concatenate(grams), return_counts=True)


def ranked(grams: np.ndarray, counts: np.ndarray, top: int = TOP) -> np.ndarray:
    """The most frequent n-grams, most frequent first, equal counts in the order of the n-grams."""
    return grams[np.argsort(-counts, kind="stable")[:top]]


@dataclass(frozen=True)
class Profiles:
    languages: tuple[str, ...]
    grams: np.ndarray  #: all n-grams of all profiles, ascending
    ranks: np.ndarray  #: (languages, grams + 1): rank in the profile; TOP where the profile lacks it

    def identify(self, text: str | None) -> tuple[str, float]:
        """(language, score): the nearest profile's language and 1 less its distance, a share of the greatest possible
        one; `und` and 0 without a letter or without profiles. Equal distances: the first language in the alphabet."""
        own = ranked(*ngrams(text))
        if not len(own) or not self.languages:
            return UNKNOWN, 0.0
        at = np.searchsorted(self.grams, own)
        at[at == len(self.grams)] = 0
        at = np.where(self.grams[at] == own, at, len(self.grams))
        there = self.ranks[:, at]
        apart = np.where(there == TOP, TOP, np.abs(there - np.arange(len(own))))
        distance = apart.sum(axis=1) / (TOP * len(own))
        best = int(np.argmin(distance))
        return self.languages[best], float(1 - distance[best])


def build(texts_by_language: dict[str, list[str]]) -> Profiles:
    lists = {}
    for lang, texts in sorted(texts_by_language.items()):
        lists[lang] = ranked(*ngrams("\n".join(texts)))
    every = np.unique(np.concatenate(list(lists.values()) or [np.zeros(0, np.int64)]))
    ranks = np.full((len(lists), len(every) + 1), TOP, np.int64)
    for i, own in enumerate(lists.values()):
        ranks[i, np.searchsorted(every, own)] = np.arange(len(own))
    return Profiles(tuple(lists), every, ranks)


def _sample(docs: DataFrame, per_language: int, most_bytes: int, id_col: str, text_col: str, lang_col: str) -> dict[str, list[str]]:
    """per_language texts of each language, chosen by the hash of their id, first by ids alone."""
    known = docs.where(F.col(lang_col).isNotNull() & (F.octet_length(F.col(text_col)) <= most_bytes))
    ids = known.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"))
    counts = {r["lang"]: r["n"] for r in ids.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row for each language
    if not counts:
        return {}
    chosen = drawn(ids, "lang", "id", per_language, counts).distinct()  # per_language ids of each language
    rows = known.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("t"))
    rows = rows.join(F.broadcast(chosen), ["id", "lang"]).withColumn("h", F.xxhash64("id"))
    rows = rows.orderBy("h", "id", "lang", "t").limit(per_language * len(counts)).collect()
    by: dict[str, list[str]] = {}
    for r in sorted(rows, key=lambda r: (r["id"], r["t"])):
        by.setdefault(r["lang"], []).append(r["t"])
    return by


def train(docs: DataFrame, *, per_language: int = PER_LANGUAGE, most_bytes: int = MOST_BYTES, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Profiles:
    """Profiles from a bounded sample of labelled texts: per_language of each language, none of more than most_bytes. Null
    texts, ids and languages teach nothing; no rows: no languages."""
    return build(_sample(docs, per_language, most_bytes, id_col, text_col, lang_col))


def floor(profiles: Profiles, texts: list[str]) -> float:
    """The score below which a text is in none of the languages: half of what all but one in a hundred of the labelled texts
    with a letter reach. Without such texts 0."""
    scores = sorted(score for lang, score in map(profiles.identify, texts) if lang != UNKNOWN)
    return scores[len(scores) // 100] / 2 if scores else 0.0


def train_with_floor(docs: DataFrame, *, per_language: int = PER_LANGUAGE, most_bytes: int = MOST_BYTES, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> tuple[Profiles, float]:
    """The profiles and the floor, both from the same sample."""
    by = _sample(docs, per_language, most_bytes, id_col, text_col, lang_col)
    profiles = build(by)
    return profiles, floor(profiles, [t for texts in by.values() for t in texts])


def with_language(docs: DataFrame, profiles: Profiles, lang: str = "lang_pred", score: str = "score", text_col: str = "text") -> DataFrame:
    """docs with the columns lang and score of every whole text; no shuffle. Null text and text without a letter: `und`, 0.
    Repeated rows are judged alike; an empty table gives no rows; the columns of docs stay as they are."""

    @F.pandas_udf("lang string, score double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([profiles.identify(t) for t in texts], columns=["lang", "score"])

    found = "__vellum_found"
    return docs.withColumn(found, run(F.col(text_col))).withColumns({lang: F.col(found)["lang"], score: F.col(found)["score"]}).drop(found)


def op5_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    profiles = train(docs.where(crc_fold(F.col("doc_id")) != 1))
    out = with_language(docs.select("doc_id", "text"), profiles)
    return out.select("doc_id", F.coalesce(crc_fold(F.col("doc_id")) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")
