"""Clusters of records that say the same in other words, by shared words instead of equal names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import broadcast_if_small, cut_lineage, kept_table


def jaccard(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b)).cast("double")), F.lit(0.0))


def signature_bands(tokens: Column, bands: int, rows: int) -> Column:
    """One key per band of a MinHash signature."""
    keys = []
    for band in range(bands):
        mins = [F.array_min(F.transform(tokens, _hash(band * rows + r))) for r in range(rows)]
        keys.append(F.xxhash64(F.lit(band), *mins))
    return F.array(*keys)


def _hash(seed: int):
    return lambda t: F.xxhash64(F.lit(seed), t)


def similar_records(
    records: DataFrame, *, id_col: str = "doc_id", text: str = "text", scope: Sequence[str] = ("persona_id",),
    threshold: float = 0.5, bands: int = 16, rows: int = 2,
) -> DataFrame:
    """(scope, id, cluster): records of a scope linked through similar word sets; cluster is the smallest id.

    Each record is compared with the smallest id of every band it falls in, not with all its band mates,
    so a band shared by a third of all records costs one comparison per record.
    """
    scope = list(scope)
    words = cut_lineage(records.select(*scope, id_col, F.array_distinct(T.search_tokens(F.col(text))).alias("_w")).where(F.size("_w") > 0))
    banded = words.select(*scope, id_col, F.posexplode(signature_bands(F.col("_w"), bands, rows)).alias("_band", "_key"))
    heads = banded.groupBy(*scope, "_band", "_key").agg(F.min(id_col).alias("_head"))
    links = banded.join(heads, [*scope, "_band", "_key"]).where(F.col(id_col) != F.col("_head")).select(*scope, id_col, "_head").distinct()
    head_words = words.select(*scope, F.col(id_col).alias("_head"), F.col("_w").alias("_hw"))
    links = links.join(words, [*scope, id_col]).join(head_words, [*scope, "_head"])
    links = links.where(jaccard(F.col("_w"), F.col("_hw")) >= threshold).select(*scope, F.col(id_col).alias("a"), F.col("_head").alias("b"))
    edges = cut_lineage(links.unionByName(links.select(*scope, F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = connected(edges, scope)
    out = records.select(*scope, id_col).join(labels.withColumnRenamed("a", id_col), [*scope, id_col], "left")
    return out.withColumn("cluster", F.coalesce("label", F.col(id_col))).drop("label")


def connected(edges: DataFrame, scope: Sequence[str]) -> DataFrame:
    """Smallest reachable id per node of a symmetric edge table; labels are written once per round.

    A checkpoint would keep the planner's estimate of its size, the product of the joined ones: in a loop the number of its
    digits grows with each round until it fills the driver. A written table is as large as its files.
    """
    scope = list(scope)
    labels = kept_table(edges.groupBy(*scope, "a").agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        around = edges.join(labels.withColumnsRenamed({"a": "b", "label": "_l"}), [*scope, "b"]).groupBy(*scope, "a").agg(F.min("_l").alias("_near"))
        step = labels.join(around, [*scope, "a"]).withColumn("_new", F.least("label", "_near"))
        jump = labels.select(*scope, F.col("a").alias("_new"), F.col("label").alias("_far"))
        step = step.join(jump, [*scope, "_new"], "left").select(
            *scope, "a", F.least("_new", F.coalesce("_far", "_new")).alias("label"), F.col("label").alias("_old")
        )
        step = kept_table(step, "labels")
        labels = step.drop("_old")
        if step.where(F.col("label") != F.col("_old")).limit(1).count() == 0:
            return labels


def _needed(n: Column, threshold: float) -> Column:
    """Words that a set of `n` must share with another one to reach the threshold."""
    return F.ceil(F.lit(threshold) * n - 1e-9)


def prefix_postings(sets: DataFrame, scope: Sequence[str], threshold: float, frequent: int) -> DataFrame:
    """(scope, _t, _id, _n, _at): the rarest words of each set (_set, _id, _w), as many as a partner must meet.

    Two sets that reach the threshold share one of these words whatever the common order of words is, so the
    order only needs to put frequent words last: counts of the `frequent` most frequent words are sent to the
    tasks, all others come first. Words are posted as 64-bit hashes; a collision adds a candidate, no link.
    """
    scope = list(scope)
    counts = sets.select(F.explode("_w").alias("_word")).groupBy("_word").agg(F.count("*").alias("_df"))
    often = counts.where("_df > 1").orderBy(F.desc("_df"), "_word").limit(frequent)
    # Dealt by set once; exploding, looking up and gathering the words again then stay where the set lies.
    words = sets.repartition(*scope, "_set").select(*scope, "_set", "_id", F.explode("_w").alias("_word"))
    words = words.join(F.broadcast(often), "_word", "left")  # at most `frequent` rows
    order = F.array_sort(F.collect_list(F.struct(F.coalesce("_df", F.lit(0)).alias("df"), F.col("_word").alias("w"))))
    ordered = words.groupBy(*scope, "_set", "_id").agg(order.alias("_o")).withColumn("_n", F.size("_o"))
    prefix = F.slice("_o", F.lit(1), (F.col("_n") - _needed(F.col("_n"), threshold) + 1).cast("int"))
    ordered = ordered.select(*scope, "_id", "_n", F.transform(prefix, lambda x: F.xxhash64(x["w"])).alias("_p"))
    return ordered.select(*scope, "_id", "_n", F.posexplode("_p").alias("_at", "_t"))


def _possible(a: str, b: str, threshold: float) -> Column:
    """Lengths and the words left behind the shared one still allow the threshold."""
    n_a, n_b = F.col(f"{a}._n"), F.col(f"{b}._n")
    left = F.least(n_a - F.col(f"{a}._at"), n_b - F.col(f"{b}._at"))
    both = F.lit(threshold / (1 + threshold)) * (n_a + n_b)
    return (F.least(n_a, n_b) >= _needed(F.greatest(n_a, n_b), threshold)) & (left >= both - 1e-9)


def _confirmed(pairs: DataFrame, sets: DataFrame, scope: list[str], threshold: float) -> DataFrame:
    """Pairs (scope, a, b) whose whole sets reach the threshold."""
    words = sets.select(*scope, F.col("_id"), "_w")
    both = pairs.distinct().join(words.withColumnsRenamed({"_id": "a", "_w": "_wa"}), [*scope, "a"])
    both = both.join(words.withColumnsRenamed({"_id": "b", "_w": "_wb"}), [*scope, "b"])
    return both.where(jaccard(F.col("_wa"), F.col("_wb")) >= threshold).select(*scope, "a", "b").distinct()


def _both_ways(links: DataFrame, scope: list[str]) -> DataFrame:
    return links.unionByName(links.select(*scope, F.col("b").alias("a"), F.col("a").alias("b")))


def block_pairs(postings: DataFrame, scope: Sequence[str], threshold: float, block: int) -> DataFrame:
    """(scope, a, b): possible pairs, a < b, of different `_label` that share a posted word.

    Words with more than `block` postings are cut into blocks, and each pair of blocks is a key of its own.
    """
    scope = list(scope)
    hot = postings.groupBy(*scope, "_t").agg(F.count("*").alias("_c")).where(F.col("_c") > block)
    hot = broadcast_if_small(hot.select(*scope, "_t", F.ceil(F.col("_c") / block).cast("int").alias("_k")))
    dealt = postings.join(hot, [*scope, "_t"], "left").withColumn("_k", F.coalesce("_k", F.lit(1)))
    dealt = dealt.withColumn("_x", F.pmod(F.xxhash64("_id"), "_k").cast("int"))
    dealt = dealt.withColumn("_y", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)))
    dealt = dealt.withColumn("_i", F.least("_x", "_y")).withColumn("_j", F.greatest("_x", "_y")).drop("_y", "_k")
    a, b = dealt.alias("p"), dealt.alias("q")
    same = F.lit(True)
    for key in [*scope, "_t", "_i", "_j"]:
        same = same & (F.col(f"p.{key}") == F.col(f"q.{key}"))
    once = (F.col("p._i") == F.col("p._j")) | (F.col("p._x") != F.col("q._x"))
    apart = (F.col("p._id") < F.col("q._id")) & (F.col("p._label") != F.col("q._label"))
    pairs = a.join(b, same & once & apart & _possible("p", "q", threshold))
    return pairs.select(*[F.col(f"p.{c}").alias(c) for c in scope], F.col("p._id").alias("a"), F.col("q._id").alias("b"))


def similar_clusters(
    records: DataFrame, *, id_col: str = "doc_id", text: str = "text", scope: Sequence[str] = ("persona_id",),
    threshold: float = 0.5, frequent: int = 50_000, block: int = 1_000,
) -> DataFrame:
    """(scope, id, cluster) per row: every pair of a scope whose word sets have a Jaccard similarity of `threshold`
    or more is in one cluster; cluster is the smallest id. No link is missed (`similar_records` may miss some).

    Equal word sets count once. Each set is first compared with the smallest id behind each of its posted words;
    what is linked by then is not compared again, so a large family costs one comparison per record. Sets of
    different clusters that still share a rare word are then compared in blocks. Rows without words, with a null
    id or a null scope are linked with nothing; rows of one id are one record.
    """
    scope = list(scope)
    rows = records.select(*scope, F.col(id_col).alias("_id"), F.array_sort(F.array_distinct(T.search_tokens(F.col(text)))).alias("_w"))
    rows = rows.where(F.size("_w") > 0).dropna(subset=[*scope, "_id"]).withColumn("_set", F.sha2(F.array_join("_w", " "), 256))
    sets = cut_lineage(rows.groupBy(*scope, "_set").agg(F.min("_id").alias("_id"), F.first("_w").alias("_w")))
    heads = sets.select(*scope, "_set", F.col("_id").alias("_head"))
    members = cut_lineage(rows.select(*scope, "_id", "_set").distinct().join(heads, [*scope, "_set"]).drop("_set"))
    several = members.groupBy(*scope, "_id").agg(F.min("_head").alias("_low"), F.max("_head").alias("_high")).where("_low < _high")
    known = members.join(several, [*scope, "_id"], "left_semi").where("_id <> _head").select(*scope, F.col("_id").alias("a"), F.col("_head").alias("b"))

    postings = cut_lineage(prefix_postings(sets, scope, threshold, frequent))
    first = postings.groupBy(*scope, "_t").agg(F.min(F.struct("_id", "_n", "_at")).alias("h"))
    star = postings.join(first, [*scope, "_t"]).where("_id <> h._id").select(*scope, F.struct("_id", "_n", "_at").alias("p"), "h")
    star = star.where(_possible("p", "h", threshold)).select(*scope, F.col("p._id").alias("a"), F.col("h._id").alias("b"))
    edges = cut_lineage(_both_ways(_confirmed(star, sets, scope, threshold).unionByName(known), scope))
    labels = connected(edges, scope).withColumnRenamed("a", "_id")

    labelled = postings.join(labels, [*scope, "_id"], "left").withColumn("_label", F.coalesce("label", "_id")).drop("label")
    rest = _confirmed(block_pairs(labelled, scope, threshold, block), sets, scope, threshold)
    edges = cut_lineage(edges.unionByName(_both_ways(rest, scope)))
    labels = connected(edges, scope).withColumnRenamed("a", "_head")

    found = members.join(labels, [*scope, "_head"], "left").groupBy(*scope, "_id").agg(F.min(F.coalesce("label", "_head")).alias("cluster"))
    out = records.select(*scope, id_col).join(found.withColumnRenamed("_id", id_col), [*scope, id_col], "left")
    return out.withColumn("cluster", F.coalesce("cluster", F.col(id_col)))
