import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from marginalia.llm import near_dedup
from marginalia.llm.exact_dedup import drop_copies, exact_copies


def brute_exact(rows):
    groups = {}
    for i, t in rows:
        digest = hashlib.sha256(re.sub("[\x20\x09-\x0d]", "", t or "").encode()).hexdigest()
        groups.setdefault(digest, []).append((-len(t or ""), (i is not None, i or 0), i))
    return sorted([(i, min(g, key=lambda x: x[:2])[2], len(g), d) for d, g in groups.items() for _, _, i in g], key=str)


def exact(df, **kw):
    return sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in exact_copies(df, **kw).collect()], key=str)


def test_exact_equals_brute_force(spark, docs, odd, monkeypatch):
    for df in (docs, odd):
        rows = [(r.doc_id, r.text) for r in df.collect()]
        assert exact(df) == brute_exact(rows)
        assert exact(df, bits=64) == brute_exact(rows)  # a full filter only shuffles more
        monkeypatch.setattr("marginalia.llm.exact_dedup._HOT", 2)
        assert exact(df) == brute_exact(rows)
    assert exact_copies(odd.filter(F.lit(False))).count() == 0


def test_exact_stays_in_the_engine(spark, docs):
    plan = exact_copies(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_drop_copies(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "a  b"), (3, "ab"), (4, "c")], "doc_id bigint, text string")
    assert sorted(r.doc_id for r in drop_copies(df).collect()) == [2, 4]


def brute_near(rows, size=5, percent=75):
    sets = {}
    for i, t in rows:
        words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(words[j : j + size]) for j in range(len(words) - size + 1)} if len(words) >= size else ({tuple(words)} if words else set())
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return sorted((i, len(sets[i]), find(i), find(i) == i) for i in ids)


def near(df, **kw):
    return sorted(tuple(r) for r in near_dedup.near_copies(df, **kw).collect())


def test_near_equals_brute_force(spark, docs):
    assert near(docs) == brute_near([(r.doc_id, r.text) for r in docs.collect()])


@pytest.fixture(scope="module")
def families():
    """Chains, stars and pairs just above and below the limit, over a shared passage."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    common = [word() for _ in range(30)]
    rows, i = [], 0
    for _ in range(40):
        base = [word() for _ in range(rng.randrange(30, 150))]
        text = base
        for _ in range(rng.randrange(1, 9)):
            text = list(text if rng.random() < 0.5 else base)
            for _ in range(rng.randrange(0, 5)):
                text[rng.randrange(len(text))] = word()
            rows.append((i, " ".join(text + common * rng.randrange(2))))
            i += 1
    return rows


@pytest.mark.parametrize("small", [1_000, 2])
def test_near_families(spark, families, monkeypatch, small):
    monkeypatch.setattr(near_dedup, "SMALL", small)
    assert near(spark.createDataFrame(families, "doc_id bigint, text string")) == brute_near(families)


def test_a_pair_with_unlike_tokens_is_linked(spark):
    """Sets alike by exactly 0.75 whose tokens happen to agree far less, in a node that is compared exhaustively."""
    rng = random.Random(3)
    while True:
        words = [str(rng.randrange(10**9)) for _ in range(39)]
        pair = [" ".join(words), " ".join([*words[:19], "other", *words[20:]])]
        tokens = near_dedup.minwise(near_dedup.shingle_sets([t.encode() for t in pair], 5), 120)
        if (tokens[0] == tokens[1]).mean() < 0.63:
            break
    others = [(i, " ".join(str(rng.randrange(10**9)) for _ in range(40))) for i in range(2, 12)]
    rows = [(0, pair[0]), (1, pair[1]), *others]
    docs = spark.createDataFrame(rows, "id bigint, text string").select("id", F.col("text").cast("binary").alias("body"))
    reps = near_dedup.signatures(docs, 5, 120).withColumnsRenamed({"id": "rep", "n_shingles": "n"}).cache()
    for once in (False, True):
        state = near_dedup._Join(docs, reps, 5, 75, 6)
        shared = next(x[0] for _, x, _ in near_dedup._leaves(tokens.reshape(2, 6, 20)) if x[0] == x[1])  # the first node of both
        members = reps.select(F.lit(int(np.uint64(shared).view(np.int64))).alias("node"), "rep", "n", F.lit(len(rows)).alias("size"), F.col("rep").alias("root"))
        near_dedup._exhaust(state, members, once=once)
        assert {r.v: r.root for r in state.roots.collect()} == {0: 0, 1: 0}


def test_parities_never_exceed_the_difference():
    rng = np.random.default_rng(1)
    for n in (1, 5, 300, 9_000):
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        b = np.union1d(a[n // 4 :], rng.integers(0, 2**63, n // 3, dtype=np.uint64))
        x, y = (np.frombuffer(p, np.uint64) for p in near_dedup.parities([a, b]))
        assert np.bitwise_count(x ^ y).sum() <= len(np.setxor1d(a, b))


def test_near_odd_rows(spark, odd):
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_copies(odd).collect()}
    assert {(1, 4, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 0, 4, True), (6, 4, 1, False), (None, 1, None, True)} <= got
    assert near_dedup.near_copies(odd).count() == odd.count()
    assert near_dedup.near_copies(odd.filter(F.lit(False))).count() == 0
    assert near_dedup.drop_near_copies(odd).columns == odd.columns


def test_rows_that_share_an_id_are_judged_apart(spark):
    """A copy that goes takes no other text of its id along; rows without an id are compared too."""
    a, b, c = ("one two three four five six", "quite another text with words of its own", "a third text that nobody copied so far")
    rows = [(0, a), (1, a), (1, b), (2, c), (None, c), (None, alone := "the only text without an id at all")]
    for _ in range(2):
        out = near_dedup.drop_near_copies(spark.createDataFrame(rows, "doc_id bigint, text string"))
        assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted([(0, a), (1, b), (None, c), (None, alone)], key=str)
        rows.reverse()


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 102), (101, 102), (7, 90)]
    found = {r.v: r.root for r in near_dedup.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert found == {**{i: 0 for i in range(41)}, 90: 0, 100: 100, 101: 100, 102: 100}
