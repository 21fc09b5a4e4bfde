"""Exact de-duplication by two-pass Bloom filtering, in DataFrame functions only.

First pass: every document's digest gives two bit positions; positions that two documents share make up the
twice-seen filter, packed into native bitmaps. Second pass: documents whose bits are not both set are unique and
pass straight through; only suspected copies are shuffled by digest. Texts never leave their task: what moves is
the digest, the id and the length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import stored
from marginalia.session import broadcast_if_small

_HOT = 500
_MOST_BITS = 28  # 32 MB of bitmaps: the most that is broadcast


def stripped(text: Column) -> Column:
    """Text without ASCII white space; null counts as empty."""
    out = F.coalesce(text, F.lit(""))
    for char in (" ", "\n", "\t", "\r", "\x0b", "\x0c"):
        out = F.replace(out, F.lit(char), F.lit(""))
    return out


def _position(digest: Column, start: int, bits: int) -> Column:
    """Bit position from 12 hex digits of the digest."""
    return F.conv(F.substring(digest, start, 12), 16, 10).cast("bigint") % bits


def _bit(bitmap: Column, position: Column) -> Column:
    """Bit of a native bitmap at a position inside it."""
    byte = F.conv(F.hex(F.expr("substring(bitmap, cast(at div 8 as int) + 1, 1)")), 16, 10).cast("bigint")
    return F.getbit(byte, (position % 8).cast("int")) == 1


def twice_seen(keys: DataFrame, bits: int) -> DataFrame:
    """(bucket, bitmap) of the bit positions that at least two rows of `keys` (digest) share."""
    marks = keys.select(F.explode(F.array(_position(F.col("digest"), 1, bits), _position(F.col("digest"), 13, bits))).alias("p"))
    shared = marks.groupBy("p").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return shared.groupBy(F.bitmap_bucket_number("p").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bitmap"))


def suspected(keys: DataFrame, filters: DataFrame, bits: int) -> DataFrame:
    """`keys` with `suspect`: true where both bits of the digest are in the filter."""
    out = keys.withColumn("suspect", F.lit(True))
    for start in (1, 13):
        position = _position(F.col("digest"), start, bits)
        out = (
            out.withColumn("bucket", F.bitmap_bucket_number(position)).withColumn("at", F.bitmap_bit_position(position))
            .join(F.broadcast(filters), "bucket", "left")
            .withColumn("suspect", F.col("suspect") & F.coalesce(_bit(F.col("bitmap"), F.col("at")), F.lit(False)))
            .drop("bucket", "at", "bitmap")
        )
    return out


def exact_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", bits: int | None = None) -> DataFrame:
    """One row per document: id, keep_id, group_size (long), kept, text_sha256 of the text without white space.

    Of equal texts the one with the most code points in the original stays, then the smallest id (null ids come
    first). Null counts as empty; empty texts are equal to each other. Rows that repeat an id and its text
    are one document and share the decision. Other columns are ignored, whatever their names. `bits` (32 a row by
    default, at most 2**28) changes only how many unique rows are shuffled.
    """
    if bits is None:
        bits = 1 << min(_MOST_BITS, max(16, (docs.count() * 32).bit_length()))
    keys = stored(docs.select(
        F.col(id_col).alias("id"), F.sha2(stripped(F.col(text_col)), 256).alias("digest"),
        F.coalesce(F.char_length(F.col(text_col)), F.lit(0)).alias("n"),
    ), "text-digests")
    filters = stored(twice_seen(keys, bits), "twice-seen")
    marked = suspected(keys, filters, bits)
    copies = marked.filter("suspect")
    best = copies.groupBy("digest").agg(
        F.min(F.struct((-F.col("n")).alias("longest"), F.col("id").alias("id"))).alias("best"), F.count(F.lit(1)).alias("group_size"))
    best = stored(best.select("digest", F.col("best.id").alias("keep_id"), "group_size"), "copy-groups")
    # large groups are few: their rows take the answer where they lie, the rest is shuffled by digest
    hot = broadcast_if_small(best.filter(F.col("group_size") >= _HOT).select("digest", F.col("keep_id").alias("hot_id"), F.col("group_size").alias("hot_size")))
    split = copies.join(hot, "digest", "left")
    shuffled = split.filter("hot_size is not null").select("id", F.col("hot_id").alias("keep_id"), F.col("hot_size").alias("group_size"), "digest").unionByName(
        split.filter("hot_size is null").join(best.filter(F.col("group_size") < _HOT), "digest").select("id", "keep_id", "group_size", "digest"))
    unique = marked.filter("not suspect").select("id", F.col("id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"), "digest")
    return unique.unionByName(shuffled).select(
        F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("digest").alias("text_sha256"))


def drop_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` without exact copies. The ids to drop are few, so the texts are filtered by an anti join on them."""
    gone = exact_copies(docs, id_col=id_col, text_col=text_col).filter("not kept").select(F.col(id_col).alias("_gone")).distinct()
    return docs.join(gone, docs[id_col].eqNullSafe(F.col("_gone")), "left_anti")
