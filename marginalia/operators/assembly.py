"""Order-dependent work over scopes of any size: running totals, text windows, message trimming, batching.

Rows are cut into ranges that hold about as many rows each (Spark samples the bounds); ranges are summed in
parallel, their prefix sums are tiny, and rows are finished inside their range. No scope is ever sorted by one
task, however dense or sparse the order column is.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import broadcast_if_small, cut_lineage


def ranged(df: DataFrame, scope: Sequence[str], order: Sequence[str], rows: int | None = None) -> DataFrame:
    """`df` with `_slice`: the number of the range of (scope, order) that a row lies in, rising with the order.

    Ranges hold about `rows` rows, or as many as a shuffle partition of the session. Rows are written once after they
    are dealt, so a task that is run again finds the same rows in its range.
    """
    parts = [max(1, -(-df.count() // rows))] if rows else []
    return cut_lineage(df.repartitionByRange(*parts, *scope, *order)).withColumn("_slice", F.spark_partition_id())


def running_total(
    df: DataFrame, scope: Sequence[str], order: Sequence[str], values: dict[str, Column], *, slice_width: int | None = None
) -> DataFrame:
    """Add exclusive running totals `out -> value` per scope, in the order of the columns `order` (any type), by ranges
    of about `slice_width` rows."""
    rows = ranged(df.withColumns({f"_v_{k}": v for k, v in values.items()}), scope, order, slice_width)
    keys = [*scope, "_slice"]
    sums = rows.groupBy(*keys).agg(*[F.sum(f"_v_{k}").alias(f"_s_{k}") for k in values])
    before = Window.partitionBy(*scope).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*keys, *[F.coalesce(F.sum(f"_s_{k}").over(before), F.lit(0)).alias(f"_o_{k}") for k in values])
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = rows.withColumns({f"_i_{k}": F.coalesce(F.sum(f"_v_{k}").over(inside), F.lit(0)) for k in values}).join(offsets, keys)
    out = out.withColumns({k: F.col(f"_i_{k}") + F.col(f"_o_{k}") for k in values})
    return out.drop("_slice", *[f"_{x}_{k}" for k in values for x in "voi"])


def _filled(docs: DataFrame, content: str) -> DataFrame:
    return docs.where(F.col(content).rlike(r"\S"))


def _placed(docs: DataFrame, scope: Sequence[str], order: str, content: str) -> DataFrame:
    """(scope, order, size, start) of the non-blank documents in the joined text (two line feeds between documents).

    Only lengths take part; they are kept once, for the windows that are cut from them.
    """
    rows = _filled(docs, content).select(*scope, order, F.length(content).alias("size"))
    return cut_lineage(running_total(rows, scope, [order], {"start": F.col("size") + 2}))


def _window(docs: DataFrame, placed: DataFrame, scope: Sequence[str], order: str, content: str, low: Column, high: Column, out: str) -> DataFrame:
    """Characters [low, high) of the joined text; only texts of documents that overlap leave the scan."""
    last = F.col("start") + F.col("size") + 2  # the separator behind a document belongs to it
    hit = placed.withColumns({"_low": low, "_high": high, "_last": last}).where((F.col("start") < F.col("_high")) & (F.col("_last") > F.col("_low")))
    hit = broadcast_if_small(hit.select(*scope, order, "start", "_low", "_high", "_last"))
    rows = _filled(docs, content).select(*scope, order, content).join(hit, [*scope, order])
    begin = F.greatest(F.col("_low") - F.col("start"), F.lit(0))
    size = F.least("_high", "_last") - F.col("start") - begin
    piece = F.substring(F.concat(F.col(content), F.lit("\n\n")), (begin + 1).cast("int"), size.cast("int"))
    parts = rows.select(*scope, F.struct(F.col(order).alias("o"), piece.alias("t")).alias("p"))
    return parts.groupBy(*scope).agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda x: x["t"]), "").alias(out))


def joined_text(docs: DataFrame, scope: Sequence[str], order: str, *, max_tokens: int = 15000, content: str = "content") -> DataFrame:
    """Documents joined in order and cut at `max_tokens` * 4 characters. `order` names a document inside its scope."""
    placed = _placed(docs, scope, order, content)
    total = placed.groupBy(*scope).agg((F.max(F.col("start") + F.col("size"))).alias("_total"))
    high = F.least(F.lit(max_tokens * 4), F.col("_total"))
    return _window(docs, placed.join(total, list(scope)), scope, order, content, F.lit(0), high, "text")


def sampled_text(
    docs: DataFrame, hashes: DataFrame, scope: Sequence[str], order: str, *, first_tokens: int = 20000,
    random_tokens: int = 20000, content: str = "content",
) -> DataFrame:
    """The start of the joined text and one piece of the rest, placed by the corpus hash."""
    first, piece = first_tokens * 4, random_tokens * 4
    placed = _placed(docs, scope, order, content)
    info = placed.groupBy(*scope).agg(F.max(F.col("start") + F.col("size")).alias("_total")).join(hashes, list(scope))
    seed = F.conv(F.substring("corpus_hash", 1, 8), 16, 10).cast("bigint")
    rest = F.col("_total") - first
    info = info.select(*scope, "_total", F.when(rest > piece, F.lit(first) + seed % (rest - piece + 1)).alias("_at"))
    placed = cut_lineage(placed.join(info, list(scope)))
    head = _window(docs, placed, scope, order, content, F.lit(0), F.least(F.lit(first), F.col("_total")), "head")
    extra = _window(docs, placed.where(F.col("_at").isNotNull()), scope, order, content, F.col("_at"), F.col("_at") + piece, "extra")
    both = head.join(extra, list(scope), "left")
    text = F.concat_ws("\n\n[... SAMPLE FROM MIDDLE ...]\n\n", "head", "extra")
    return both.select(*scope, text.alias("text"))


def recent_messages(
    messages: DataFrame, *, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    max_tokens: int = 6000, human: str = "user", enders: Sequence[str] = ("user", "tool"),
) -> DataFrame:
    """The last messages within the token budget, opened by a human turn, plus a leading system message."""
    tokens = F.ceil(F.length(text) / 4).cast("bigint")
    m = messages.withColumn("_tokens", tokens)
    is_system = (F.col(role) == "system") & (F.col(turn) == F.col("_first"))
    bounds = m.groupBy(conversation).agg(
        F.min(turn).alias("_first"), F.max(F.when(F.col(role).isin(list(enders)), F.col(turn))).alias("_last"),
        F.coalesce(F.min_by(F.when(F.col(role) == "system", F.col("_tokens")), turn), F.lit(0)).alias("_sys_tokens"),
    )
    m = m.join(bounds, conversation).where((F.col(turn) <= F.col("_last")) | is_system)
    system = m.where(is_system)
    body = m.where(~is_system & (F.col(turn) <= F.col("_last")))
    total = body.groupBy(conversation).agg(F.sum("_tokens").alias("_total"))
    body = running_total(body, [conversation], [turn], {"_before": F.col("_tokens")}).join(total, conversation)
    body = body.where(F.col("_total") - F.col("_before") + F.col("_sys_tokens") <= max_tokens)
    opener = body.where(F.col(role) == human).groupBy(conversation).agg(F.min(turn).alias("_open"))
    kept = body.join(opener, conversation).where(F.col(turn) >= F.col("_open"))
    cols = messages.columns
    return kept.select(*cols).unionByName(system.select(*cols))


def greedy_batches(
    docs: DataFrame, scope: Sequence[str], order: Sequence[str], *, id_col: str = "doc_id", tokens: Column | None = None,
    max_items: int = 10, max_tokens: int = 100_000, block: int = 10_000,
) -> DataFrame:
    """Greedy batches in order: (scope, id, batch_start), where batch_start is the index of the first member.

    A batch never spans more than `max_items` rows, so a block of rows only needs to know which of its
    first `max_items` rows opens its first batch. Every block works out all those cases at once; the cases
    are chained over the blocks of a scope (a few numbers per block); then every block assigns its rows.
    The result is that of one sequential pass, with no sequential pass over the rows.
    """
    scope = list(scope)
    block = max(block, max_items)
    tokens = F.floor(F.length("content") / 4) if tokens is None else tokens
    rows = running_total(docs.select(*scope, id_col, *[c for c in order if c != id_col], tokens.cast("bigint").alias("_t")), scope, order, {"_at": F.lit(1)})
    rows = rows.select(*scope, id_col, F.col("_at").cast("bigint").alias("_at"), "_t").withColumn("_block", F.floor(F.col("_at") / block).cast("bigint"))
    # The head of each block is also shown to the block before it.
    ahead = rows.where((F.col("_at") % block < max_items) & (F.col("_block") > 0)).withColumn("_block", F.col("_block") - 1)
    seen = rows.unionByName(ahead)
    keys = [*scope, "_block"]

    def jumps(pdf: pd.DataFrame) -> tuple[pd.DataFrame, list[int], int]:
        pdf = pdf.sort_values("_at")
        at, size = pdf["_at"].to_numpy(), pdf["_t"].tolist()
        own = int((at // block == pdf["_block"].iloc[0]).sum())
        nxt = []
        for i in range(own):
            j, total = i + 1, size[i]
            while j < len(size) and j - i < max_items and total + size[j] <= max_tokens:
                total += size[j]
                j += 1
            nxt.append(j)
        return pdf, nxt, own

    def cases(pdf: pd.DataFrame) -> pd.DataFrame:
        head, nxt, own = jumps(pdf)
        leave = [0] * own
        for i in range(own - 1, -1, -1):
            leave[i] = nxt[i] - own if nxt[i] >= own else leave[nxt[i]]
        exits = [leave[o] if o < own else o - own for o in range(max_items)]
        return pd.DataFrame([[*head[keys].iloc[0], exits]], columns=[*keys, "exits"])

    key_fields = ", ".join(f"`{c}` {t}" for c, t in rows.select(*keys).dtypes)
    maps = seen.groupBy(*keys).applyInPandas(cases, f"{key_fields}, exits array<int>")

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_block")
        enter, at = [], 0
        for exits in pdf["exits"]:
            enter.append(at)
            at = int(exits[at])
        return pdf[keys].assign(enter=enter)

    entries = maps.groupBy(*scope).applyInPandas(chain, f"{key_fields}, enter int")

    def assign(pdf: pd.DataFrame) -> pd.DataFrame:
        head, nxt, own = jumps(pdf)
        start_of, i = {}, int(head["enter"].iloc[0])
        while i < own:
            for j in range(i, nxt[i]):
                start_of[j] = i
            i = nxt[i]
        base = int(head["_at"].iloc[0])
        out = head.iloc[sorted(start_of)][[*scope, id_col]].copy()
        out["batch_start"] = [base + start_of[j] for j in sorted(start_of)]
        return out

    id_fields = ", ".join(f"`{c}` {t}" for c, t in rows.select(*scope, id_col).dtypes)
    return seen.join(entries, keys).groupBy(*keys).applyInPandas(assign, f"{id_fields}, batch_start bigint")


def counted_batches(docs: DataFrame, scope: Sequence[str], order: Sequence[str], size: int) -> DataFrame:
    """Batches of `size` rows in order."""
    rows = running_total(docs, scope, order, {"_at": F.lit(1)})
    return rows.withColumn("batch", F.floor(F.col("_at") / size).cast("bigint")).drop("_at")
