"""Sequential groupings of one row's array, as runs `(start, len)` with 1-based start.

Only counts or similarities travel to Python; texts stay in the JVM and are cut there by `slice`.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as S

RUNS = S.ArrayType(S.StructType([S.StructField("start", S.IntegerType()), S.StructField("len", S.IntegerType())]))


def _runs_udf(fold):
    @F.pandas_udf(RUNS)
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else [{"start": s, "len": n} for s, n in fold(list(v))])

    return run


def pack_runs(counts: Column, limit: int, max_items: int | None = None) -> Column:
    """Neighbours are packed while their sum stays within `limit`; an item above it stands alone in a run."""

    def fold(values):
        runs, start, total = [], 0, 0
        for i, v in enumerate(values):
            full = max_items is not None and i - start >= max_items
            if i > start and (full or total + v > limit):
                runs.append((start + 1, i - start))
                start, total = i, 0
            total += v
        if values:
            runs.append((start + 1, len(values) - start))
        return runs

    return _runs_udf(fold)(counts)


def pair_runs(counts: Column, min_words: int, max_words: int) -> Column:
    """Left to right: a short item joins its successor once, if the pair fits."""

    def fold(values):
        runs, i = [], 0
        while i < len(values):
            joins = (
                values[i] < min_words and i + 1 < len(values) and values[i] + values[i + 1] <= max_words
            )
            runs.append((i + 1, 2 if joins else 1))
            i += 2 if joins else 1
        return runs

    return _runs_udf(fold)(counts)


def paragraph_runs(breaks: Column, min_len: int = 3, max_len: int = 8) -> Column:
    """Sentence runs from "similarity to the next one is low" flags: cut when long enough, forced at `max_len`."""

    def fold(flags):
        runs, start, size = [], 0, 1
        for i, low in enumerate(flags):
            if (low and size >= min_len) or size >= max_len:
                runs.append((start + 1, size))
                start, size = i + 1, 1
            else:
                size += 1
        runs.append((start + 1, size))
        return runs

    return _runs_udf(fold)(breaks)


def char_windows(content: Column, size: int, overlap: int) -> Column:
    """Character windows as runs, each cut behind the last blank of its final fifth if there is one."""
    tail = int(size * 0.2)

    @F.pandas_udf(RUNS)
    def windows(texts: pd.Series) -> pd.Series:
        def cut(t: str):
            out, start, n = [], 0, len(t)
            while start < n:
                end = min(start + size, n)
                if end < n and end - start > 100:
                    blank = max(t.rfind(b, end - tail, end) for b in " \n\t　")
                    end = blank + 1 if blank >= 0 else end
                out.append({"start": start + 1, "len": end - start})
                start = end - overlap if end - overlap > start else start + max(1, size // 2)
            return out

        return texts.map(lambda t: None if t is None else cut(t))

    return windows(content)
