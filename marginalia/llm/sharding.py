"""Shards by a k-d tree over document metadata, cut at distributed weighted medians.

Each level splits every node along its widest dimension. The median is found by radix refinement on an integer key
(value, then hash of the id): one aggregation per 16 bits gives the bytes per bucket, and only the bucket that holds
the median is looked into further. What reaches the driver is a row per node; texts are read once, for their size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.llm.common import stored
from marginalia.session import broadcast_if_small

VALUE_BITS, TIE_BITS, STEP = 20, 42, 16
_SLOT_ROWS = 20_000


def name_value(col: str) -> Column:
    """Place of a name (language, source) between 0 and 1; null is 0."""
    return F.when(F.col(col).isNull(), F.lit(0.0)).otherwise(F.pmod(F.xxhash64(F.col(col).cast("string")), F.lit(1 << VALUE_BITS)) / (1 << VALUE_BITS))


def kd_shards(
    docs: DataFrame, dimensions: dict[str, Column], shards: int | None = None, target_bytes: int | None = None, *, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """(id, size, text_crc32, shard, slot): `shards` shards of near equal bytes, or as many as `target_bytes` asks for.

    Size is the UTF-8 bytes of the text plus 1, so null and empty texts weigh 1. `dimensions` are columns over
    `docs` with values from 0 to 1 (null is 0). Equal values are parted by the hash of the id; rows that repeat an id
    and its values stay together. Two shards differ by about one document's size per level of the tree. Slots
    number the rows of a shard from 0 without gaps, in the order of id hash, id and text. An empty table has no shards.
    """
    body = F.coalesce(F.col(text_col), F.lit(""))
    tie = F.xxhash64(id_col).bitwiseAND((1 << TIE_BITS) - 1)
    names = [f"k{i}" for i in range(len(dimensions))]
    keys = [
        (F.shiftleft(F.least(F.floor(F.coalesce(v, F.lit(0.0)) * (1 << VALUE_BITS)), F.lit((1 << VALUE_BITS) - 1)).cast("bigint"), TIE_BITS) + tie).alias(n)
        for n, v in zip(names, dimensions.values(), strict=True)
    ]
    rows = stored(docs.select(
        F.col(id_col).alias("id"), (F.octet_length(body) + 1).cast("bigint").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"), *keys), "kd-rows")
    total = rows.agg(F.sum("size")).first()[0] or 0
    if shards is None:
        shards = max(1, -(-total // target_bytes)) if target_bytes else 1
    rows = rows.withColumn("first", F.lit(0)).withColumn("leaves", F.lit(int(shards)))
    while True:
        cuts = _cuts(rows, names)
        if not cuts:
            break
        table = rows.sparkSession.createDataFrame(cuts, "first int, dimension int, cut bigint, left int")  # a row per node
        key = F.array(*names)[F.col("dimension")]
        right = F.col("dimension").isNotNull() & (key > F.col("cut"))
        moved = rows.join(F.broadcast(table), "first", "left")
        rows = stored(moved.select(
            "id", "size", "text_crc32", *names, F.when(right, F.col("first") + F.col("left")).otherwise(F.col("first")).alias("first"),
            F.when(F.col("dimension").isNull(), F.col("leaves")).when(right, F.col("leaves") - F.col("left")).otherwise(F.col("left")).alias("leaves")), "kd-rows")
    return _slots(rows.select("id", "size", "text_crc32", F.col("first").alias("shard")), rows.count(), int(shards)).withColumnRenamed("id", id_col)


def _cuts(rows: DataFrame, names: list[str]) -> list[tuple[int, int, int, int]]:
    """(node, dimension, last key of the left side, shards of the left side) of each node that still holds several."""
    spread = [(F.max(F.shiftright(n, TIE_BITS)) - F.min(F.shiftright(n, TIE_BITS))).alias(f"w{i}") for i, n in enumerate(names)]
    nodes = rows.filter("leaves > 1").groupBy("first", "leaves").agg(F.sum("size").alias("bytes"), *spread).collect()
    if not nodes:
        return []
    state = {}
    for n in nodes:
        widths = [n[f"w{i}"] for i in range(len(names))]
        left = n.leaves // 2
        state[n.first] = {"dimension": widths.index(max(widths)), "left": left, "need": n.bytes * left / n.leaves, "prefix": 0, "total": n.bytes}
    bits = VALUE_BITS + TIE_BITS
    while bits > 0:
        step = min(STEP, bits)
        live = [(f, s["dimension"], s["prefix"]) for f, s in state.items()]
        table = F.broadcast(rows.sparkSession.createDataFrame(live, "first int, dimension int, prefix bigint"))
        key = F.array(*names)[F.col("dimension")]
        inside = rows.join(table, "first").withColumn("key", key).filter(F.shiftright("key", bits) == F.col("prefix"))
        buckets = inside.groupBy("first", F.shiftright("key", bits - step).alias("bucket")).agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
        up_to = F.sum("bytes").over(Window.partitionBy("first").orderBy("bucket"))  # at most 2**16 buckets a node
        need = rows.sparkSession.createDataFrame([(f, float(s["need"])) for f, s in state.items()], "first int, need double")
        met = buckets.withColumn("up_to", up_to).join(F.broadcast(need), "first").filter("up_to >= need").groupBy("first").agg(
            F.min(F.struct("bucket", "bytes", "up_to", "n")).alias("b"))
        most = 0
        for r in met.collect():
            s = state[r.first]
            s["prefix"], s["bytes"] = r.b.bucket, r.b.bytes
            s["need"] -= r.b.up_to - r.b.bytes
            most = max(most, r.b.n)
        bits -= step
        if most <= 1:
            break
    out = []
    for first, s in state.items():
        last = s["prefix"] if s["need"] * 2 >= s["bytes"] else s["prefix"] - 1
        out.append((int(first), s["dimension"], ((last + 1) << bits) - 1, s["left"]))
    return out


def _slots(rows: DataFrame, n: int, shards: int) -> DataFrame:
    """Rows with their number inside the shard: counted per chunk of a shard, so that no task numbers a whole shard."""
    chunks = max(1, n // (shards * _SLOT_ROWS))
    parted = rows.withColumn("chunk", F.pmod(F.xxhash64("id"), F.lit(chunks)))
    counts = parted.groupBy("shard", "chunk").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = stored(counts.select("shard", "chunk", before.alias("start")), "kd-chunks")
    place = F.row_number().over(Window.partitionBy("shard", "chunk").orderBy(F.xxhash64("id"), "id", "text_crc32")) - 1
    return parted.withColumn("place", place).join(broadcast_if_small(starts), ["shard", "chunk"]).select(
        "id", "size", "text_crc32", "shard", (F.col("place") + F.col("start")).cast("bigint").alias("slot"))


def write_shards(docs: DataFrame, placed: DataFrame, path: str, *, id_col: str = "doc_id") -> None:
    """Write `docs` as one folder per shard; a shard is written by several tasks when it is large."""
    place = placed.select(F.col(id_col), "shard", "slot")
    docs.join(place, id_col).write.partitionBy("shard").parquet(path)
