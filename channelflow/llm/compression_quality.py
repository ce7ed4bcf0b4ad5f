"""Quality classifier by compression: zstandard dictionaries of good and of bad text, and the calibrated difference in size.

Half of a bounded sample of labelled rows builds the two dictionaries; the other half calibrates
a logistic score on normalised compressed sizes: the difference between both dictionaries, their mean,
and the size without a dictionary, each per byte. The logarithm of the text's length and products of these enter too (13 features in all), so that
short texts, whose sizes per byte are large whatever they say, are calibrated as well; the difference carries the score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import label_hash, sampled_rows, text_of
from .logistic import Logistic

PER_CLASS = 1500  # labelled rows of either class that the fit reads at most
MAX_CHARS = 20_000  # of such a row
DICTIONARY = 112_640  # bytes
LEVEL = 3
THRESHOLD = 0.3


def _dictionary(texts: list[bytes]) -> zstandard.ZstdCompressionDict:
    try:
        return zstandard.train_dictionary(DICTIONARY, texts, level=LEVEL)
    except zstandard.ZstdError:  # too few texts to train on: their bytes serve as they are
        raw = b"\n".join(texts)[-DICTIONARY:]
        return zstandard.ZstdCompressionDict(raw.ljust(8), dict_type=zstandard.DICT_TYPE_RAWCONTENT)


class CompressionModel:
    """Dictionaries and calibration. Picklable: compressors are made where they are used."""

    def __init__(self, rows: list[tuple[bytes, int]], share_good: float):
        good, bad = ([t for t, y in rows if y == label] for label in (1, 0))
        self.constant = None if len(good) > 3 and len(bad) > 3 else share_good
        if self.constant is not None:
            return
        self.good, self.bad = (_dictionary(x[: len(x) // 2]).as_bytes() for x in (good, bad))
        rest = [(t, 1) for t in good[len(good) // 2 :]] + [(t, 0) for t in bad[len(bad) // 2 :]]
        y = np.array([label for _, label in rest])
        weight = np.where(y == 1, share_good / max(1, (y == 1).sum()), (1 - share_good) / max(1, (y == 0).sum())) * len(y)
        self.fit = Logistic(self.features([t for t, _ in rest]), y, weight, penalty=1e-4)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "compressors"}

    def features(self, texts: list[bytes]) -> np.ndarray:
        if "compressors" not in self.__dict__:
            dicts = [zstandard.ZstdCompressionDict(x) for x in (self.good, self.bad)]
            for d in dicts:
                d.precompute_compress(level=LEVEL)
            self.compressors = [zstandard.ZstdCompressor(level=LEVEL, dict_data=d) for d in dicts] + [zstandard.ZstdCompressor(level=LEVEL)]
        sizes = np.array([[len(c.compress(t)) for c in self.compressors] for t in texts], dtype=float).reshape(-1, 3)
        n = np.array([len(t) + 16.0 for t in texts])
        good, bad, plain = (sizes / n[:, None]).T
        d, m, log = good - bad, (good + bad) / 2, np.log(n)
        return np.column_stack([d, m, plain, log, d * log, m * log, plain * log, m * m, plain * plain, d * d, log * log, d * m, d * plain])

    def score(self, texts: list[bytes]) -> np.ndarray:
        return np.full(len(texts), float(self.constant)) if self.constant is not None else self.fit(self.features(texts))


def fit_quality(labels: DataFrame, docs: DataFrame, per_class: int = PER_CLASS, max_chars: int = MAX_CHARS) -> CompressionModel:
    """Learns from labels.quality of rows whose crc32(doc_id as text) mod 5 is not 0; their texts are the only input."""
    fold = (label_hash() % 5 != 0) & F.col("quality").isin(0, 1)
    rows = [(t.encode("utf-8", "surrogatepass"), y) for _, t, y in sampled_rows(labels, docs, "quality", fold, per_class, max_chars)]
    n = labels.where(fold).agg(F.count("*").alias("n"), F.sum("quality").alias("good")).first()
    share = (n["good"] or 0) / n["n"] if n["n"] else 1.0
    return CompressionModel(rows, share)


def score_quality(docs: DataFrame, model: CompressionModel, threshold: float = THRESHOLD) -> DataFrame:
    """Adds score double (higher: good is likelier) and predicted int to every row of docs.

    The whole text is compressed; a null text counts as empty and gets a score as any other. Rows keep their columns
    (a column named score or predicted is replaced) and are scored where they are read, without a shuffle.
    With too few labels of either class every row gets the share of good labels.
    """
    docs = docs.drop("score", "predicted")

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(model.score([t.encode("utf-8", "surrogatepass") for t in texts]))

    scored = docs.withColumn("score", score(text_of()))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
