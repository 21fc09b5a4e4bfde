"""Small helpers around array expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def posexplode_rows(df: DataFrame, keep: list, array: Column | str, pos: str, item: str) -> DataFrame:
    """Explode a computed array.

    The array and the kept expressions are formed in a projection of their own: an expression over the
    array left above the explode would carry the whole array along with each of its rows. The outer form
    is used because the inner one adds a "not empty" filter that repeats the array expression.
    """
    array = F.col(array) if isinstance(array, str) else array
    inner = df.select(*keep, array.alias("_array"))
    names = [c for c in inner.columns if c != "_array"]
    return inner.select(*names, F.posexplode_outer("_array").alias(pos, item)).where(F.col(pos).isNotNull())


def dot(a: Column, b: Column) -> Column:
    """Dot product of two numeric arrays in double precision."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity, 0 where a vector is zero."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.coalesce(F.try_divide(dot(a, b), norm), F.lit(0.0))
