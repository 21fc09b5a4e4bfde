"""Line de-duplication with a once-seen and a twice-seen Bloom filter.

1. Every line's key is hashed; all tasks together fill the two filters (`bloom.seen_twice`).
2. Only lines that the twice-seen filter suspects leave their task, counted per task first, and are confirmed
   on the key itself. A line that a third of all documents hold sends one row per task.
3. Confirmed keys go to every task as 16-byte digests when they are few (`max_broadcast`), and the texts are
   rewritten where they lie. Beyond that, suspected lines are joined with the confirmed keys by shuffle, and the
   line numbers to drop are joined to their documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm import bloom
from marginalia.llm.common import SPACE, schema_of, stored, utf8, without

_FLUSH = 200_000


def line_keys(text: bytes, min_chars: int) -> list[bytes | None]:
    """Key of each line: stripped of ASCII white space, A-Z lower-cased; None where it has too few code points."""
    keys = [line.strip(SPACE) for line in text.lower().split(b"\n")]
    if min_chars <= 1:
        return [k if len(k) >= min_chars else None for k in keys]
    return [k if len(k) >= min_chars and len(k.decode("utf-8", "replace")) >= min_chars else None for k in keys]


def _distinct(text: bytes, min_chars: int) -> dict[bytes, int]:
    """First line number of each key of a document."""
    out: dict[bytes, int] = {}
    for i, key in enumerate(line_keys(text, min_chars)):
        if key is not None and key not in out:
            out[key] = i
    return out


def _hashes(keys) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(k) for k in keys), np.uint64)


def drop_repeated_lines(
    docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep_first: bool = False, *, id_col: str = "doc_id", text_col: str = "text",
    max_broadcast: int = 1_000_000, bits: int | None = None,
) -> DataFrame:
    """`docs` without the lines whose key stands in at least `min_docs` documents, plus `n_lines`, `n_dropped` (long).

    With `keep_first` the first occurrence of such a line (smallest id, then line number; null ids first) stays.
    Null or empty text is one empty line and comes back as empty text. Each row is a document, also where
    rows repeat; repeated lines inside one document count once. Input columns called n_lines or n_dropped are
    replaced; other columns pass through. `bits` is the filter size (256 a document by default); it never
    changes the result.
    """
    spark = docs.sparkSession
    docs = without(docs, "n_lines", "n_dropped")
    bits = bits or bloom.bits_for(docs.count(), 256)
    id_type = docs.schema[id_col].dataType
    texts = docs.select(F.col(id_col).alias("id"), utf8(text_col).alias("body"))

    def hashes_of(batch: pa.RecordBatch) -> np.ndarray:
        return _hashes(k for t in batch.column("body").to_pylist() for k in _distinct(t, min_chars))

    suspects = spark.sparkContext.broadcast(bloom.seen_twice(texts.select("body"), hashes_of, bits))

    def suspected(keys: list[bytes]) -> list[bytes]:
        return [k for k, hit in zip(keys, bloom.test(suspects.value, _hashes(keys)), strict=True) if hit] if keys else []

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list] = {}

        def flush() -> pa.RecordBatch:
            arrays = [pa.array(list(held), pa.binary()), pa.array([v[0] for v in held.values()], pa.int64()),
                      pa.array([v[1] for v in held.values()], id_arrow), pa.array([v[2] for v in held.values()], pa.int32())]
            held.clear()
            return pa.RecordBatch.from_arrays(arrays, names=["key", "n", "id", "line"])

        id_arrow = pa.null()
        for batch in batches:
            id_arrow = batch.schema.field("id").type
            for doc, text in zip(batch.column("id").to_pylist(), batch.column("body").to_pylist(), strict=True):
                first = _distinct(text, min_chars)
                for key in suspected(list(first)):
                    order = (doc is not None, doc, first[key]) if doc is not None else (False, 0, first[key])
                    seen = held.get(key)
                    if seen is None:
                        held[key] = [1, doc, first[key], order]
                    else:
                        seen[0] += 1
                        if keep_first and order < seen[3]:
                            seen[1:] = [doc, first[key], order]
            if len(held) >= _FLUSH:
                yield flush()
        if held:
            yield flush()

    counted = texts.mapInArrow(count, schema_of(None, key="binary", n="long", id=id_type, line="int"))
    repeated = counted.groupBy("key").agg(
        F.sum("n").alias("n"), F.min(F.struct(F.col("id").isNotNull(), F.col("id"), F.col("line"))).alias("first")
    ).filter(F.col("n") >= min_docs)
    repeated = stored(repeated.select("key", F.col("first.id").alias("first_id"), F.col("first.line").alias("first_line")), "repeated-lines")

    out_schema = schema_of(docs, n_lines="long", n_dropped="long")
    if repeated.limit(max_broadcast + 1).count() <= max_broadcast:
        known = spark.sparkContext.broadcast({
            xxhash.xxh3_128_digest(bytes(r.key)): (r.first_id, r.first_line) for r in repeated.toLocalIterator()
        })

        def numbers(doc, text: bytes, _) -> set[int]:
            drop = set()
            for i, key in enumerate(line_keys(text, min_chars)):
                if key is not None and (first := known.value.get(xxhash.xxh3_128_digest(key))) is not None:
                    if not (keep_first and first == (doc, i)):
                        drop.add(i)
            return drop

        return _rewrite(docs, out_schema, id_col, text_col, numbers)

    def mentions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for row, doc, text in zip(*(batch.column(c).to_pylist() for c in ("row", "id", "body")), strict=True):
                keys = line_keys(text, min_chars)
                hit = set(suspected(list({k for k in keys if k is not None})))
                out += [(row, doc, i, k) for i, k in enumerate(keys) if k in hit]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[j] for x in out], t) for j, t in enumerate((pa.int64(), batch.schema.field("id").type, pa.int32(), pa.binary()))],
                names=["row", "id", "line", "key"])

    # a row is known by its id and text; rows that agree in both drop the same lines
    row = F.xxhash64(F.col(id_col), F.col(text_col))
    lines = docs.select(row.alias("row"), F.col(id_col).alias("id"), utf8(text_col).alias("body")).mapInArrow(
        mentions, schema_of(None, row="long", id=id_type, line="int", key="binary"))
    hits = lines.join(repeated, "key")
    if keep_first:
        hits = hits.filter(~(F.col("id").eqNullSafe(F.col("first_id")) & (F.col("line") == F.col("first_line"))))
    gone = hits.groupBy("row").agg(F.collect_set("line").alias("_gone")).withColumnRenamed("row", "_row")
    joined = docs.withColumn("_row", row).join(gone, "_row", "left").drop("_row")
    return _rewrite(joined, out_schema, id_col, text_col, lambda doc, text, gone: set(gone or ()))


def _rewrite(docs: DataFrame, schema, id_col: str, text_col: str, numbers) -> DataFrame:
    """Drop the lines that `numbers(id, text, _gone)` names."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, total, dropped = [], [], []
            gone = batch.column("_gone").to_pylist() if "_gone" in batch.schema.names else [None] * batch.num_rows
            for doc, text, numbered in zip(batch.column(id_col).to_pylist(), batch.column(text_col).to_pylist(), gone, strict=True):
                body = (text or "").encode()
                drop, lines = numbers(doc, body, numbered), body.split(b"\n")
                out.append(b"\n".join(x for i, x in enumerate(lines) if i not in drop).decode() if drop else text or "")
                total.append(len(lines))
                dropped.append(len(drop))
            columns = [pa.array(out, pa.string()) if n == text_col else batch.column(n) for n in schema.names[:-2]]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(total, pa.int64()), pa.array(dropped, pa.int64())], names=schema.names)

    return docs.mapInArrow(cut, schema)
