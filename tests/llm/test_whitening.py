import numpy as np
import pytest
from pyspark.sql import functions as F

from marginalia.llm import whitening
from marginalia.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def frame(spark, vectors, kind="float"):
    return spark.createDataFrame([(i, v, "w", 1) for i, v in enumerate(vectors)], f"vec_id long, embedding array<{kind}>, whitened string, deviation int").repartition(3)


def exact(vectors):
    x = np.floor(64 * np.asarray(vectors, float)).astype(np.int64) + 1_000_000
    values, components = np.linalg.eigh(np.cov(x.T, bias=True).reshape(x.shape[1], x.shape[1]))
    return x, values[::-1], components[:, ::-1]


def same_up_to_sign(a, b):
    return np.minimum(np.abs(a - b).max(axis=0), np.abs(a + b).max(axis=0)).max()


def test_query_equals_dense_decomposition(spark):
    """More dimensions than columns of the block, so the polynomial filter has to separate them."""
    rows = QUERIES["op13_embedding_whitening"](spark, SF)
    assert rows.dtypes == [("vec_id", "bigint"), ("component", "int"), ("n", "bigint"), ("deviation", "bigint"), ("whitened", "double"),
                           ("explained", "double"), ("identity_error", "double")]
    rows = rows.collect()
    given = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    x, values, components = exact([r.embedding for r in given])
    n, sums = len(x), x.sum(axis=0)
    want = (x - sums / n) @ components[:, :32] / np.sqrt(values[:32])
    place = {r.vec_id: i for i, r in enumerate(given)}
    got = np.zeros((n, 32))
    for r in rows:
        got[place[r.vec_id], r.component - 1] = r.whitened
        assert r.n == n and r.identity_error < 1e-9 and abs(r.explained / (values[r.component - 1] / values.sum()) - 1) < 1e-10
        assert r.deviation == sum((n * int(a) - int(s)) ** 2 for a, s in zip(x[place[r.vec_id]], sums, strict=True))
    assert len(rows) == 32 * n and same_up_to_sign(got, want) < 1e-8


@pytest.mark.parametrize("spread", [3.0, 1.05, 1.0])
def test_filter_against_dense(spark, spread):
    """Well parted, close and (up to sampling) equal eigenvalues; one direction far above the rest."""
    random = np.random.default_rng(3)
    scale = np.append(40.0, spread ** -np.arange(29) * 4)
    vectors = (random.standard_normal((400, 30)) * scale).tolist()
    fitted = whitening.fit(frame(spark, vectors, "double"), 5, guard=3)
    _, values, components = exact(vectors)
    assert np.allclose(fitted.values, values[:5], rtol=1e-10) and same_up_to_sign(fitted.components, components[:, :5]) < 1e-7
    assert fitted.passes > 2 and fitted.residuals[-1] <= 1e-10
    assert whitening.identity_error(frame(spark, vectors, "double"), fitted) < 1e-8


def test_block_grows_where_the_edge_is_tied(spark):
    """Twelve equal eigenvalues around the edge: any of their vectors will do, but all must be certified."""
    axes = np.vstack([np.eye(12) * 8, -np.eye(12) * 8])
    vectors = [[*v, 0.0, 1.0] for v in axes.tolist()]
    fitted = whitening.fit(frame(spark, vectors, "double"), 4, guard=2)
    assert len(fitted.values) == 4 and np.allclose(fitted.values, fitted.values[0]) and fitted.residuals[-1] < 1e-10
    assert whitening.identity_error(frame(spark, vectors, "double"), fitted) < 1e-9


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = np.random.default_rng(1).standard_normal((40, 3)).tolist()
    vectors = [*good, None, [nan, 0.0, 0.0], [0.0, inf, 0.0], [0.0, None, 1.0], [1.0, 2.0], [], good[0], [1e300, 0.0, 0.0]]
    df = frame(spark, vectors, "double")
    fitted = whitening.fit(df)
    rows = whitening.whiten(df, fitted).collect()
    assert {r.vec_id for r in rows} == {*range(40), 46, 47} and fitted.n == 42  # a huge entry is held at a bound
    assert rows[0].asDict().keys() == {"vec_id", "embedding", "whitened", "deviation"}
    small = frame(spark, vectors[:-1], "double")
    fitted = whitening.fit(small)
    rows = {r.vec_id: r for r in whitening.whiten(small, fitted).collect()}
    assert len(fitted.values) == 3 and rows[0].whitened == rows[46].whitened and all(len(r.whitened) == 3 for r in rows.values())
    assert whitening.identity_error(small, fitted) < 1e-9


@pytest.mark.parametrize("vectors", [[], [None], [[]], [[1.0, 2.0]], [[1.0, 2.0]] * 5])
def test_nothing_to_whiten(spark, vectors):
    """Empty tables, one row, equal rows: no direction has variance."""
    df = frame(spark, vectors)
    fitted = whitening.fit(df)
    assert len(fitted.values) == 0 and whitening.identity_error(df, fitted) == 0
    rows = whitening.whiten(df, fitted).collect()
    assert len(rows) == fitted.n and all(r.whitened == [] and r.deviation == 0 for r in rows)


def test_fewer_directions_than_components(spark):
    base = np.random.default_rng(5).standard_normal((60, 2)) * 10
    vectors = np.hstack([base, base[:, :1], np.ones((60, 3))]).tolist()
    fitted = whitening.fit(frame(spark, vectors, "double"), 4, guard=1)
    assert len(fitted.values) == 2
    assert whitening.identity_error(frame(spark, vectors, "double"), fitted) < 1e-6


def test_sums_beyond_64_bits(spark):
    vectors = [[1e14, 0.0], [-1e14, 1.0], [1e14, 2.0]]
    df = frame(spark, vectors, "double")
    fitted = whitening.fit(df)
    held = [int(min(max(64 * v[0], -whitening.BOUND), whitening.BOUND)) + 1_000_000 for v in vectors]
    assert fitted.sums[0] == sum(held)
    second = [64 * int(v[1]) + 1_000_000 for v in vectors]
    want = [(3 * a - sum(held)) ** 2 + (3 * b - sum(second)) ** 2 for a, b in zip(held, second, strict=True)]
    assert [int(r.deviation) for r in whitening.whiten(df, fitted).orderBy("vec_id").collect()] == want
    assert whitening.whiten(df.filter(F.lit(False)), fitted).count() == 0
