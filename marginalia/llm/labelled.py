"""Labelled samples and word features for the classifiers."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"[^\W\d_]+")


def sample(docs: DataFrame, labels: DataFrame, label: str, most: int, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(label int, text) of at most `most` labelled documents, those with the smallest hash of their id.

    Null labels and ids are left out; several labels of one id count as their majority (a tie is 1).
    """
    known = labels.filter(F.col(label).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg((F.avg(label) >= 0.5).cast("int").alias("_label"))
    chosen = known.orderBy(F.xxhash64(id_col), id_col).limit(most)  # at most `most` rows are broadcast
    return docs.select(id_col, F.coalesce(text_col, F.lit("")).alias("_text")).join(F.broadcast(chosen), id_col).select(
        F.col("_label").alias("label"), F.col("_text").alias("text"))


def bag(text: str) -> Counter:
    """Lower-cased words of a whole text with their counts."""
    return Counter(WORD.findall(text.lower()))


def word_hash(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word.encode())


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))
