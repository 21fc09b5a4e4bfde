"""Plug-in points for models: embed a text, score a pair, generate a reply."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

from ..functions import text as T

EMBED_DIM = 256


_EMBED_TERMS, _EMBED_CELLS = 1_000_000, 4_000_000  # terms and counts that are held at once, besides those of one row


def bucket_counts(tokens: pa.Array, dim: int) -> pa.Array:
    """Counts of each row's terms in `dim` buckets, by runs of rows with a bounded number of terms. Only different terms of a run
    become Python strings."""
    upto = np.cumsum(pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    parts, start, most = [], 0, max(1, _EMBED_CELLS // dim)
    while start < len(tokens):
        stop = int(np.searchsorted(upto, (upto[start - 1] if start else 0) + _EMBED_TERMS, "right"))
        stop = min(max(stop, start + 1), start + most)
        run = tokens.slice(start, stop - start)
        terms = pc.list_flatten(run).dictionary_encode()
        place = np.array([int(hashlib.md5(t.encode()).hexdigest()[:8], 16) % dim for t in terms.dictionary.to_pylist()], np.int64)
        cell = pc.list_parent_indices(run).to_numpy() * dim + place[terms.indices.to_numpy()]
        parts.append(np.bincount(cell, minlength=len(run) * dim).astype("float32"))
        start = stop
    flat = np.concatenate(parts) if parts else np.zeros(0, "float32")
    return pa.ListArray.from_arrays(pa.array(np.arange(len(tokens) + 1, dtype="int32") * dim), pa.array(flat))


def hashed_embedding(dim: int = EMBED_DIM) -> Callable[[Column], Column]:
    """Default embedder: counts of index terms in `dim` buckets (md5 prefix modulo `dim`)."""

    @F.arrow_udf(S.ArrayType(S.FloatType()))
    def buckets(tokens: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in tokens:
            yield bucket_counts(batch, dim)

    return lambda c: buckets(T.search_tokens(c))


def model_embedding(load: Callable[[], Callable[[list[str]], list]]) -> Callable[[Column], Column]:
    """Embedder from a loader; the model is loaded once per Python worker."""

    @F.pandas_udf(S.ArrayType(S.FloatType()))
    def embed(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for batch in texts:
            yield pd.Series([np.asarray(v, "float32") for v in model(batch.fillna("").tolist())])

    return embed


def by_language(models: dict[str, Callable[[Column], Column]], default: str = "en") -> Callable[[Column, Column], Column]:
    """Choose the embedder by a language column; each model only sees its own rows."""

    def embed(text: Column, language: Column) -> Column:
        parts = []
        for lang, model in models.items():
            mine = (language == lang) if lang != default else ~language.isin([x for x in models if x != default])
            parts.append(F.when(mine, model(F.when(mine, text))))
        return F.coalesce(*parts)

    return embed


def term_overlap(query: Column, text: Column) -> Column:
    """Default pair score: share of the query's distinct terms found in the text."""
    q = F.array_distinct(T.search_tokens(query))
    found = F.size(F.array_intersect(q, T.search_tokens(text)))
    return F.coalesce(F.try_divide(found.cast("double"), F.size(q).cast("double")), F.lit(0.0))


def model_pair_score(load: Callable[[], Callable[[list[tuple[str, str]]], list[float]]]) -> Callable[[Column, Column], Column]:
    """Pair scorer from a loader. A batch that fails scores 1.0, which keeps the incoming order."""

    @F.pandas_udf(S.DoubleType())
    def score(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        try:
            model = load()
        except Exception:
            model = None
        for query, text in parts:
            try:
                yield pd.Series([float(x) for x in model(list(zip(query.fillna(""), text.fillna(""))))])
            except Exception:
                yield pd.Series([1.0] * len(query))

    return score


def generate(
    rows: DataFrame, prompt: str, load: Callable[[], Callable[[list[str]], list[str]]], *,
    keep: list[str], batch: int = 16,
) -> DataFrame:
    """Reply per row: `keep`, reply, error. The number of partitions bounds the concurrent calls.

    A failed call leaves reply null and the message in `error`; the other rows go on.
    """
    schema = rows.select(*keep, F.lit("").alias("reply"), F.lit("").alias("error")).schema
    for field in schema.fields[-2:]:
        field.nullable = True

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for frame in frames:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at:at + batch]
                out = part[keep].copy()
                try:
                    out["reply"], out["error"] = model(part[prompt].tolist()), None
                except Exception as exc:
                    replies, errors = [], []
                    for p in part[prompt]:
                        try:
                            replies.append(model([p])[0])
                            errors.append(None)
                        except Exception as one:
                            replies.append(None)
                            errors.append(str(one) or str(exc))
                    out["reply"], out["error"] = replies, errors
                yield out

    return rows.select(*dict.fromkeys([*keep, prompt])).mapInPandas(run, schema)
