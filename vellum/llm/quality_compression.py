"""Quality classifier (3): two zstandard dictionaries, one from good and one from bad labelled text.

A text is cut into short chunks, every chunk is compressed with either dictionary, and the normalised difference of the two
summed sizes becomes a probability by a logistic curve, fitted on labelled texts that the dictionaries have not seen. The chunks
are short so that what a text shares with a dictionary weighs more than what it repeats of itself.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_fold, drawn


@dataclass(frozen=True)
class CompressionModel:
    good: bytes
    bad: bytes
    trained: bool  #: dictionaries of zstandard's own format, else plain content
    weights: tuple[float, ...]
    chunk: int
    level: int

    def scorer(self):
        kind = zstandard.DICT_TYPE_FULLDICT if self.trained else zstandard.DICT_TYPE_RAWCONTENT
        by = []
        for data in (self.good, self.bad):
            d = zstandard.ZstdCompressionDict(data, dict_type=kind)
            d.precompute_compress(level=self.level)
            by.append(zstandard.ZstdCompressor(level=self.level, dict_data=d, write_content_size=False, write_dict_id=False))
        weights = np.array(self.weights)

        def score(text: bytes | None) -> float:
            z = float(_terms(_difference(text or b"", by, self.chunk)) @ weights)
            return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))

        return score


#: A zstandard frame without content.
_FRAME = 4


def _difference(text: bytes, by: list, chunk: int) -> float:
    """The normalised difference of the compressed sizes: above 0, the good dictionary does better. Empty text: 0."""
    good = bad = 1
    for i in range(0, len(text), chunk):
        piece = text[i : i + chunk]
        good += len(by[0].compress(piece)) - _FRAME
        bad += len(by[1].compress(piece)) - _FRAME
    return (bad - good) / (bad + good)


def _terms(d: float) -> np.ndarray:
    return np.array([10 * d, 1.0])


def _dictionary(texts: list[bytes], size: int, piece: int) -> tuple[bytes, bool]:
    """Lines that several of the texts have are left out: a passage shared by many says nothing of its class."""
    seen: dict[bytes, int] = {}
    for t in texts:
        for line in set(t.split(b"\n")):
            seen[line] = seen.get(line, 0) + 1
    pieces = []
    for t in texts:
        own = b"\n".join(x for x in t.split(b"\n") if seen[x] == 1)
        pieces += [own[i : i + piece] for i in range(0, len(own), piece)]
    try:
        return zstandard.train_dictionary(size, pieces).as_bytes(), True
    except zstandard.ZstdError:  # too few texts for a trained one
        return b"\n".join(pieces)[-size:], False


def _fit(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Logistic regression by Newton steps, each halved until the loss falls: without that, classes that a curve separates
    (nearly) without error make the steps overshoot."""

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float(np.logaddexp(0, z).sum() - y @ z + ridge / 2 * w @ w)

    w = np.zeros(x.shape[1])
    now = loss(w)
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (p - y) + ridge * w)
        size = 1.0
        while (then := loss(w - size * step)) > now and size > 1e-6:
            size /= 2
        if now - then < 1e-9 * (1 + abs(now)):
            break
        w, now = w - size * step, then
    return w


def train(docs: DataFrame, labels: DataFrame, *, per_class: int = 1500, most_bytes: int = 1 << 18, size: int = 112 << 10, chunk: int = 120, level: int = 3,
          id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> CompressionModel | None:
    """Fit on a bounded sample: per_class labelled rows of either class, chosen by the hash of their id, without texts of more
    than most_bytes; half of them make the dictionaries, half the curve. The class shares are counted over all labelled rows.
    None if a class has no rows. Only ids, text and label are read; rows with a null label, id or text teach nothing."""
    known = labels.where(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"))
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return None
    chosen = drawn(known, "y", "id", per_class, counts)  # 2 * per_class ids
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("t")).where(F.octet_length("t") <= most_bytes)
    rows = rows.join(F.broadcast(chosen), "id").orderBy(F.xxhash64("id"), "id", "t", "y").limit(2 * per_class).collect()
    of = {y: [bytes(r["t"]) for r in rows if r["y"] == y] for y in (1, 0)}
    if min(map(len, of.values())) < 2:
        return None
    made = [_dictionary(of[y][::2], size, chunk) for y in (1, 0)]
    trained = all(m[1] for m in made)
    if not trained:
        made = [(b"\n".join(of[y][::2])[-size:], False) for y in (1, 0)]
    kind = zstandard.DICT_TYPE_FULLDICT if trained else zstandard.DICT_TYPE_RAWCONTENT
    by = [zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(m[0], dict_type=kind), write_content_size=False, write_dict_id=False) for m in made]
    seen = [(_terms(_difference(t, by, chunk)), y) for y in (1, 0) for t in of[y][1::2]]
    x, y = np.array([s for s, _ in seen]), np.array([float(s) for _, s in seen])
    w = _fit(x, y)
    w[-1] += math.log(counts[1] / counts[0]) - math.log(max(1, y.sum()) / max(1, (1 - y).sum()))
    return CompressionModel(made[0][0], made[1][0], trained, tuple(map(float, w)), chunk, level)


def score_documents(docs: DataFrame, model: CompressionModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """-> (doc_id, score): the probability that a text is good. One pass over whole texts, no shuffle. Null text is scored as
    the empty text; without a model every score is 0.5; an empty table gives no rows; repeated rows are scored alike."""

    def run(batches):
        score = model.scorer() if model else lambda _: 0.5
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([score(t) for t in b.column(1).to_pylist()], pa.float64())], ["doc_id", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("t"))
    return rows.mapInArrow(run, "doc_id long, score double")


def with_score(docs: DataFrame, model: CompressionModel | None, name: str, text_col: str = "text") -> DataFrame:
    """docs with a column of scores; no shuffle. Null text counts as empty."""
    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        one = model.scorer() if model else lambda _: 0.5
        for texts in batches:
            yield pd.Series([one(t) for t in texts], dtype="float64")

    return docs.withColumn(name, score(F.col(text_col).cast("binary")))


def op3_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = train(docs, labels.where(crc_fold(F.col("doc_id")) != 1))
    out = score_documents(docs, model)
    return out.select("doc_id", F.coalesce(crc_fold(F.col("doc_id")) == 1, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
