"""Exact and approximate nearest neighbours over tables of vectors."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as S
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.arrays import cosine
from ..session import broadcast_if_small
from . import ranking

QUERY_BLOCK = 256
VECTOR_BLOCK = 2048
SALTS = 64
MAX_BROADCAST_QUERIES = 5_000


def _pack(vectors: DataFrame, scope: Sequence[str], id_col: str, vec: str) -> DataFrame:
    """Vectors of one scope and Arrow batch in one row: ids and the normalised matrix, row by row. No shuffle."""
    scope = list(scope)
    fields = [vectors.schema[c] for c in scope] + [
        S.StructField("_ids", S.ArrayType(vectors.schema[id_col].dataType)),
        S.StructField("_matrix", S.BinaryType()),
    ]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            groups = frame.groupby(scope, sort=False, dropna=False) if scope else [((), frame)]
            for key, part in groups:
                for at in range(0, len(part), VECTOR_BLOCK):
                    piece = part.iloc[at:at + VECTOR_BLOCK]
                    matrix = np.stack(piece[vec].to_numpy()).astype("float64")
                    norm = np.linalg.norm(matrix, axis=1, keepdims=True)
                    matrix = np.divide(matrix, norm, out=np.zeros_like(matrix), where=norm > 0)
                    yield pd.DataFrame(
                        [[*key, piece[id_col].tolist(), matrix.tobytes()]], columns=[*scope, "_ids", "_matrix"]
                    )

    return vectors.where(F.col(vec).isNotNull()).select(*scope, id_col, vec).mapInPandas(run, S.StructType(fields))


def _block_pairs(queries: DataFrame, vectors: DataFrame, scope: Sequence[str], id_col: str, vec: str, query_vec: str) -> DataFrame:
    """Blocks of queries beside blocks of vectors of the same scope: (scope, _ids, _matrix, _qids, _qv)."""
    scope = list(scope)
    n_queries = queries.count()
    blocks = max(1, math.ceil(n_queries / QUERY_BLOCK))
    q = queries.withColumn("_block", F.pmod(F.xxhash64("query_id"), F.lit(blocks))).groupBy(*scope, "_block").agg(
        F.collect_list(F.struct("query_id", F.col(query_vec).cast("array<double>").alias("v"))).alias("_q")
    ).select(*scope, F.col("_q.query_id").alias("_qids"), F.col("_q.v").alias("_qv"))
    v = _pack(vectors.na.drop(subset=scope) if scope else vectors, scope, id_col, vec)  # no query is of a tenant that is null
    if n_queries <= MAX_BROADCAST_QUERIES:
        q, on = F.broadcast(q.withColumn("_salt", F.lit(0))), [*scope, "_salt"]
        v = v.withColumn("_salt", F.lit(0))
    else:
        salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>"))
        # The planner takes the exploded blocks for as small as they are once, and would broadcast all their copies.
        v = v.withColumn("_salt", F.pmod(F.xxhash64("_matrix"), F.lit(SALTS))).hint("merge")
        q, on = q.withColumn("_salt", salts), [*scope, "_salt"]
    return v.join(q, on).select(*scope, "_ids", "_matrix", "_qids", "_qv")


def _cosines(raw: bytes, n: int, qv) -> np.ndarray:
    """Rounded cosines of a block of queries (rows) with a packed block of `n` vectors."""
    matrix = np.frombuffer(raw, "float64").reshape(n, -1)
    qm = np.stack([np.asarray(x, "float64") for x in qv])
    norm = np.linalg.norm(qm, axis=1, keepdims=True)
    qm = np.divide(qm, norm, out=np.zeros_like(qm), where=norm > 0)
    return np.round(qm @ matrix.T, ranking.SCORE_DIGITS) + 0.0


def nearest(
    queries: DataFrame, vectors: DataFrame, k: int = 4, *, id_col: str = "doc_id", vec: str = "embedding",
    query_vec: str = "query_vec", scope: Sequence[str] = (),
) -> DataFrame:
    """Exact top `k` by cosine for every query: (scope, query_id, id, score, rank).

    Blocks of queries meet blocks of vectors of the same scope and are scored by one matrix product; each
    pair of blocks passes on its k best rows, so a query vector of zeros, alike to all, passes on k as well. The queries are sent to the tasks where a
    count shows they fit, and vectors are scored where they lie; else both sides are shuffled on (scope, salt), which spreads a hot scope.
    """
    if queries.limit(MAX_BROADCAST_QUERIES + 1).count() <= MAX_BROADCAST_QUERIES:
        return ranking.best(_scored_in_place(queries, vectors, scope, id_col, vec, query_vec, k), [*scope, "query_id"], k, id_col)
    pairs = _block_pairs(queries, vectors, scope, id_col, vec, query_vec)
    scored = _scored(pairs, scope, queries.schema["query_id"], vectors.schema[id_col], k)
    return ranking.best(scored, [*scope, "query_id"], k, id_col)


def _unit(matrix: np.ndarray) -> np.ndarray:
    """Rows of length 1; zeros stay."""
    norm = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, norm, out=np.zeros_like(matrix), where=norm > 0)


def _matrix_of(vectors: pa.Array) -> np.ndarray:
    """Vectors of one length as rows; a null entry is not a number."""
    sizes = np.unique(pc.list_value_length(vectors).to_numpy(zero_copy_only=False))
    if len(sizes) > 1:
        raise ValueError(f"vectors of different lengths: {sizes[:2].tolist()}")
    return pc.list_flatten(vectors).to_numpy(zero_copy_only=False).astype("float64").reshape(len(vectors), -1)


def _scored_in_place(queries: DataFrame, vectors: DataFrame, scope: Sequence[str], id_col: str, vec: str, query_vec: str, k: int) -> DataFrame:
    """As `_scored`, for few queries: these are sent to the tasks, and no block of vectors leaves the process that reads it."""
    scope, query_field = list(scope), queries.schema["query_id"]
    asked: dict = {}
    for r in queries.where(F.col(query_vec).isNotNull()).select(*scope, "query_id", F.col(query_vec).cast("array<double>").alias("_v")).collect():  # checked by the caller
        ids, rows = asked.setdefault(tuple(r[c] for c in scope), ([], []))
        ids.append(r["query_id"])
        rows.append(r["_v"])
    sent = queries.sparkSession.sparkContext.broadcast({key: (ids, _unit(np.array(rows, "float64"))) for key, (ids, rows) in asked.items()})
    fields = [*(vectors.schema[c] for c in scope), query_field, vectors.schema[id_col], S.StructField("score", S.DoubleType())]
    schema = S.StructType([S.StructField(f.name, f.dataType) for f in fields])
    query_type = to_arrow_type(query_field.dataType)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups: dict = {}
            keys = zip(*(batch.column(c).to_pylist() for c in scope)) if scope else [()] * batch.num_rows
            for i, key in enumerate(keys):
                if key in sent.value and None not in key:
                    groups.setdefault(key, []).append(i)
            for key, rows in groups.items():
                for at in range(0, len(rows), VECTOR_BLOCK):
                    piece = batch.take(pa.array(rows[at:at + VECTOR_BLOCK]))
                    piece = piece.take(pc.sort_indices(piece.column(id_col)))  # equal scores go to the smaller id
                    yield from best_of(piece, *sent.value[key])

    def best_of(piece: pa.RecordBatch, ids: list, asked: np.ndarray) -> Iterator[pa.RecordBatch]:
        matrix = _unit(_matrix_of(piece.column(vec)))
        for start in range(0, len(ids), QUERY_BLOCK):
            sims = np.round(asked[start:start + QUERY_BLOCK] @ matrix.T, ranking.SCORE_DIGITS) + 0.0
            top = np.argsort(-sims, axis=1, kind="stable")[:, :k]
            which = np.repeat(np.arange(start, start + len(sims)), top.shape[1])
            owner = [piece.column(c).take(pa.array(np.zeros(top.size, "int64"))) for c in scope]
            asked_by = pa.array(ids, query_type).take(pa.array(which))
            yield pa.RecordBatch.from_arrays(
                [*owner, asked_by, piece.column(id_col).take(pa.array(top.ravel())), pa.array(np.take_along_axis(sims, top, axis=1).ravel())], names=schema.names)

    return vectors.where(F.col(vec).isNotNull()).select(*scope, id_col, vec).mapInArrow(score, schema)


def _scored(pairs: DataFrame, scope: Sequence[str], query_id: S.StructField, id_field: S.StructField, k: int) -> DataFrame:
    """The k best vectors of each pair of blocks for each of its queries; equal scores go to the smaller id."""
    scope, id_col = list(scope), id_field.name
    fields = [pairs.schema[c] for c in scope] + [
        S.StructField("query_id", query_id.dataType), S.StructField(id_col, id_field.dataType), S.StructField("score", S.DoubleType()),
    ]

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                key, (ids, raw, qids, qv) = row[: len(scope)], row[len(scope):]
                ids, qids = np.asarray(ids, object), np.asarray(qids, object)
                by_id = sorted(range(len(ids)), key=ids.__getitem__)
                sims = _cosines(raw, len(ids), qv)[:, by_id]
                # the sort is stable and the columns are in the order of ids
                at = np.argsort(-sims, axis=1, kind="stable")[:, :k]
                out = pd.DataFrame({c: [value] * at.size for c, value in zip(scope, key)})
                out["query_id"], out[id_col] = np.repeat(qids, at.shape[1]), ids[by_id][at.ravel()]
                out["score"] = np.take_along_axis(sims, at, axis=1).ravel()
                yield out

    return pairs.mapInPandas(score, S.StructType(fields))


def score_ranges(queries: DataFrame, vectors: DataFrame, *, id_col: str = "doc_id", vec: str = "embedding", query_vec: str = "query_vec",
                 scope: Sequence[str] = ()) -> DataFrame:
    """Cosines of every query with all vectors of its scope: (scope, query_id, pairs, best, worst).

    Each pair of blocks passes on one row per query, whatever the number of vectors.
    """
    scope = list(scope)
    pairs = _block_pairs(queries, vectors, scope, id_col, vec, query_vec)
    fields = [vectors.schema[c] for c in scope] + [
        S.StructField("query_id", queries.schema["query_id"].dataType), S.StructField("_pairs", S.LongType()),
        S.StructField("_best", S.DoubleType()), S.StructField("_worst", S.DoubleType()),
    ]

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                key, (ids, raw, qids, qv) = row[: len(scope)], row[len(scope):]
                sims = _cosines(raw, len(ids), qv)
                out = pd.DataFrame({c: [value] * len(sims) for c, value in zip(scope, key)})
                out["query_id"], out["_pairs"] = np.asarray(qids, object), sims.shape[1]
                out["_best"], out["_worst"] = sims.max(axis=1), sims.min(axis=1)
                yield out

    return pairs.mapInPandas(score, S.StructType(fields)).groupBy(*scope, "query_id").agg(
        F.sum("_pairs").alias("pairs"), F.max("_best").alias("best"), F.min("_worst").alias("worst"))


def rerank_by_vector(candidates: DataFrame, queries: DataFrame, vectors: DataFrame, k: int = 10, *,
                     id_col: str = "doc_id", vec: str = "embedding", query_vec: str = "query_vec", scope: Sequence[str] = ()) -> DataFrame:
    """Re-order candidates by the cosine of their vectors to the query's; `scope` are the tenant columns of all three."""
    keys = [*scope, "query_id"]
    rows = candidates.select(*keys, id_col).join(vectors.select(*scope, id_col, vec), [*scope, id_col]).join(
        queries.select(*keys, query_vec), keys
    )
    scored = rows.select(*keys, id_col, ranking.rounded(cosine(F.col(query_vec), F.col(vec))).alias("score"))
    return ranking.best(scored, keys, k, id_col)


def seeded_centroids(lists: int, dim: int, seed: int = 7) -> np.ndarray:
    """Random directions: centroids that need no training and are the same everywhere."""
    return np.random.default_rng(seed).standard_normal((lists, dim)).round(4)


def train_centroids(vectors: DataFrame, lists: int = 64, *, sample: int = 20_000, rounds: int = 10, id_col: str = "doc_id",
                    vec: str = "embedding", seed: int = 7) -> np.ndarray:
    """Spherical k-means on the `sample` vectors with the smallest hash of their id; null and zero vectors are left out.

    The sample alone reaches the driver. There are fewer lists where it holds fewer vectors, and none without any.
    """
    chosen = vectors.where(F.col(vec).isNotNull()).orderBy(F.xxhash64(id_col), id_col).limit(sample).select(F.col(vec).alias("v"))
    rows = [r.v for r in chosen.collect()]
    if not rows:
        return np.zeros((0, 0))
    x = np.array(rows, "float64")
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    x = (x / np.where(norm > 0, norm, 1))[norm[:, 0] > 0]
    if not len(x):
        return np.zeros((0, 0))
    centroids = x[np.random.default_rng(seed).choice(len(x), min(lists, len(x)), replace=False)]
    for _ in range(rounds):
        near = (x @ centroids.T).argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, x)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(size > 0, sums / np.where(size > 0, size, 1), centroids)
    return centroids


def _near_lists(vec: Column, centroids: np.ndarray, n: int) -> Column:
    """The `n` lists whose centroids have the largest cosine with a vector, best first; ties go to the smaller number."""
    norm = np.linalg.norm(centroids, axis=1, keepdims=True)
    unit = centroids / np.where(norm > 0, norm, 1)

    @F.pandas_udf(S.ArrayType(S.IntegerType()))
    def near(v: pd.Series) -> pd.Series:
        x = np.stack(v.to_numpy()).astype("float64")
        size = np.linalg.norm(x, axis=1, keepdims=True)
        sims = np.round(x @ unit.T / np.where(size > 0, size, 1), ranking.SCORE_DIGITS)
        return pd.Series(list(np.argsort(-sims, axis=1, kind="stable")[:, :n].astype("int32")))

    return near(vec)


class ListIndex:
    """Inverted lists: every vector in the list of its nearest centroid, packed in blocks of one list and scope."""

    def __init__(self, blocks: DataFrame, centroids: np.ndarray, scope: Sequence[str], id_field: S.StructField):
        self.blocks, self.centroids, self.scope, self.id_field = blocks, centroids, list(scope), id_field

    @classmethod
    def build(cls, vectors: DataFrame, centroids: np.ndarray, *, id_col: str = "doc_id", vec: str = "embedding", scope: Sequence[str] = ()) -> ListIndex:
        """All vectors are listed, also those outside the sample that the centroids were learnt from; null vectors are not."""
        rows = vectors.where(F.col(vec).isNotNull()).select(*scope, id_col, vec)
        listed = rows.withColumn("_list", _near_lists(F.col(vec), centroids, 1)[0])
        return cls(_pack(listed, [*scope, "_list"], id_col, vec), centroids, scope, vectors.schema[id_col])

    def write(self, path: str) -> None:
        """One folder for each list, so that a search reads the lists it probes; centroids are rows of their own."""
        self.blocks.write.mode("overwrite").partitionBy("_list").parquet(f"{path}/blocks")
        rows = [(i, c.tolist()) for i, c in enumerate(self.centroids)]
        self.blocks.sparkSession.createDataFrame(rows, "list INT, centroid ARRAY<DOUBLE>").write.mode("overwrite").parquet(f"{path}/centroids")

    @classmethod
    def read(cls, spark: SparkSession, path: str, *, id_col: str = "doc_id", scope: Sequence[str] = ()) -> ListIndex:
        blocks = spark.read.parquet(f"{path}/blocks").select(*scope, "_list", "_ids", "_matrix")
        rows = spark.read.parquet(f"{path}/centroids").orderBy("list").collect()  # as many as there are lists
        return cls(blocks, np.array([r.centroid for r in rows]), scope, S.StructField(id_col, blocks.schema["_ids"].dataType.elementType))

    def search(self, queries: DataFrame, k: int = 4, *, probe: int = 40, query_vec: str = "query_vec") -> DataFrame:
        """Exact scores of the vectors in each query's `probe` nearest lists: (scope, query_id, id, score, rank).

        Blocks of queries that probe a list meet the blocks of that list. With `probe` equal to the number of lists the result
        is that of `nearest`.
        """
        keys, id_col = [*self.scope, "_list"], self.id_field.name
        asked = queries.where(F.col(query_vec).isNotNull()).select(*self.scope, "query_id", F.col(query_vec).cast("array<double>").alias("v"))
        probes = asked.withColumn("_list", F.explode(_near_lists(F.col("v"), self.centroids, probe)))
        n = queries.count()
        blocks = max(1, math.ceil(n / QUERY_BLOCK))
        q = probes.withColumn("_block", F.pmod(F.xxhash64("query_id"), F.lit(blocks))).groupBy(*keys, "_block").agg(
            F.collect_list(F.struct("query_id", "v")).alias("_q")).select(*keys, F.col("_q.query_id").alias("_qids"), F.col("_q.v").alias("_qv"))
        pairs = self.blocks.join(broadcast_if_small(q), keys).select(*self.scope, "_ids", "_matrix", "_qids", "_qv")
        scored = _scored(pairs, self.scope, queries.schema["query_id"], self.id_field, k)
        return ranking.best(scored, [*self.scope, "query_id"], k, id_col)


def nearest_approx(
    queries: DataFrame, vectors: DataFrame, k: int = 4, *, lists: int = 64, probe: int = 40, centroids: np.ndarray | None = None,
    id_col: str = "doc_id", vec: str = "embedding", query_vec: str = "query_vec", scope: Sequence[str] = (), seed: int = 7,
) -> DataFrame:
    """One-off search by inverted lists: centroids are learnt from a bounded sample unless given, all vectors are listed."""
    if centroids is None:
        centroids = train_centroids(vectors, lists, id_col=id_col, vec=vec, seed=seed)
    if not len(centroids):
        return nearest(queries, vectors, k, id_col=id_col, vec=vec, query_vec=query_vec, scope=scope)
    return ListIndex.build(vectors, centroids, id_col=id_col, vec=vec, scope=scope).search(queries, k, probe=probe, query_vec=query_vec)


def recall_at_k(exact: DataFrame, approx: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Share of the exact results that the approximate run found, over all queries."""
    hits = exact.join(approx.select("query_id", id_col, F.lit(1).alias("_hit")), ["query_id", id_col], "left")
    return hits.agg(F.count("*").alias("expected"), F.count("_hit").alias("found"))
