"""Content keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def short_sha(c: Column) -> Column:
    """First 16 hex digits of sha-256."""
    return F.left(F.sha2(c, 256), F.lit(16))


def call_key(*parts: Column) -> Column:
    """md5 over the JSON array of a call's arguments; every argument counts."""
    return F.md5(F.to_json(F.array(*[p.cast("string") for p in parts])))


def cache_key(knowledge_type: Column, persona: Column, operation: Column, content: Column, context: Column | None = None) -> Column:
    """`type:tenant:operation:hash`, the hash over canonical JSON with sorted names."""
    fields = {"content": content, "knowledge_type": knowledge_type, "operation": operation, "persona_id": persona}
    if context is not None:
        fields["context"] = context
    body = F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]))
    return F.concat_ws(":", knowledge_type, persona, operation, short_sha(body))


def corpus_hash(docs: DataFrame, keys: Sequence[str] = (), *, source: str = "source", content: str = "content", kind: str | None = None) -> DataFrame:
    """Hash of a document set, independent of row order.

    Every row is hashed where it lies and its hash is added up in eight 32-bit lanes, so a set of any
    size needs one aggregation of nine numbers and no sort.
    """
    row = F.sha2(F.concat_ws(":", source, content), 256)
    lanes = [F.conv(F.substring("_h", 8 * i + 1, 8), 16, 10).cast("bigint") for i in range(8)]
    sums = docs.select(*keys, row.alias("_h")).groupBy(*keys).agg(
        *[F.sum(lane).alias(f"_l{i}") for i, lane in enumerate(lanes)], F.count("*").alias("documents")
    )
    text = F.concat_ws(",", F.lit(kind or ""), *[F.col(f"_l{i}").cast("string") for i in range(8)], F.col("documents").cast("string"))
    return sums.select(*keys, F.sha2(text, 256).alias("corpus_hash"), "documents")


def row_hash(source: Column, content: Column, kind: str | None = None) -> Column:
    return F.sha2(F.concat(F.lit(f"{kind}|" if kind else ""), source, F.lit(":"), content), 256)
