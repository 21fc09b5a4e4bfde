"""Records, quality checks, caches and flows."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from marginalia.functions import keys
from marginalia.operators import consolidation, dedup, knowledge as N, linguistics as L, quality as Q, telemetry as E
from marginalia.plans import persona as PE
from marginalia.sources import artifacts, collections, files


def one(spark, column, schema, row):
    return spark.createDataFrame([row], schema).select(column.alias("r")).first()[0]


def test_complexity(spark):
    assert one(spark, N.complexity(F.col("s"), F.col("d")), "s ARRAY<STRING>, d STRING", (["a"] * 4, "x" * 100)) == 0.34


def test_evidence_strength(spark):
    assert one(spark, N.evidence_strength(F.col("e")), "e ARRAY<STRING>", (["x" * 100] * 2,)) == 0.46
    assert one(spark, N.evidence_strength(F.col("e")), "e ARRAY<STRING>", ([],)) == 0.0


@pytest.mark.parametrize("category,want", [("social media marketing", "marketing"), ("business mindset", "entrepreneurship"), ("sentiment", "productivity"), ("", "uncategorized"), ("Cooking ", "cooking")])
def test_standard_category(spark, category, want):
    assert one(spark, N.standard_category(F.col("c")), "c STRING", (category,)) == want


@pytest.mark.parametrize("statement,want", [("You must always test", "very_high"), ("Mustard is fine", "high"), ("This should often work", "moderate"), ("plain", "low")])
def test_conviction(spark, statement, want):
    assert one(spark, N.conviction(F.col("s"), F.lit(0.5)), "s STRING", (statement,)) == want


def test_unique_keys_over_slices(spark, monkeypatch):
    monkeypatch.setattr(N, "SLICE", 2)
    df = spark.createDataFrame([(i, "p", "x" if i != 3 else "y") for i in range(7)], "doc_id BIGINT, persona_id STRING, name STRING")
    got = [r.record_key for r in N.unique_keys(df, F.col("name"), ["doc_id"]).orderBy("doc_id").collect()]
    assert got == ["x", "x_1", "x_2", "y", "x_3", "x_4", "x_5"]


def test_sentiment(spark):
    df = spark.createDataFrame([("p", "great good bad")], "persona_id STRING, content STRING")
    r = L.sentiment(df).first()
    assert (r.overall_sentiment, r.positive_ratio) == pytest.approx((1 / 3, 2 / 3))


def test_upper_median(spark):
    df = spark.createDataFrame([("p", "a. b b. c c c. d d d d.")], "persona_id STRING, content STRING")
    assert L.sentence_patterns(df).first().median_len == 3


def test_collocations_of_a_known_text(spark):
    """'red fox' is seen five times in a row of other words; chi-squared by the textbook formula."""
    text = " ".join(f"red fox word{chr(97 + i)} item{chr(97 + i)}" for i in range(5))
    df = spark.createDataFrame([("p", 1, text.replace("word", "wrd").replace("item", "itm"))], "persona_id STRING, doc_id BIGINT, content STRING")
    got = {r.ngram: r for r in L.collocations(df, window=2, stop_words=[]).collect()}
    n, both, a, b = 20, 5, 5, 5
    none = n - both - (a - both) - (b - both)
    assert got["red fox"].score == pytest.approx(n * (both * none) ** 2 / (a * b * none * none), abs=0.01)


def test_first_copies_and_new_documents(spark):
    df = spark.createDataFrame([(1, "Same text"), (2, " same TEXT"), (3, "other"), (4, " ")], "doc_id BIGINT, content STRING")
    assert sorted(r.doc_id for r in dedup.first_per_fingerprint(df, order=["doc_id"]).collect()) == [1, 3]
    more = spark.createDataFrame([(5, "OTHER"), (6, "new")], "doc_id BIGINT, content STRING")
    assert [r.doc_id for r in dedup.new_documents(more, df, order=["doc_id"]).collect()] == [6]


def test_rejected_items_become_messages(spark):
    art = json.dumps({"mental_models": [{"name": "A", "description": "d", "steps": [" x ", 3, ""], "confidence_score": 0.5}, {"name": "B"}]})
    df = spark.createDataFrame([("p", art)], "persona_id STRING, json STRING")
    good, bad = N.split_valid(N.process_items(N.explode_artifacts(df, "mental_models"), "mental_models"))
    assert [(r.name, r.steps, r.confidence_score) for r in good.collect()] == [("A", ["x", "3"], 0.5)]
    assert sorted(r.error for r in bad.collect()) == [
        "Mental model 1 missing required field: description (will be skipped)", "Mental model 1 missing required field: steps (will be skipped)",
    ]


def persona(spark):
    model = "STRUCT<name: STRING, description: STRING, steps: ARRAY<STRING>, confidence_score: DOUBLE>"
    belief = "STRUCT<statement: STRING, category: STRING, confidence_score: DOUBLE>"
    style = "STRUCT<tone: STRING, catchphrases: ARRAY<STRING>, vocabulary: ARRAY<STRING>, communication_style: STRING>"
    row = ("p", (None, ["ab", "abc"], ["x", "yy"], "s"), [("m", "", ["1", "2"], 0.5), ("thin", "d", ["1"], 1.0)], [("b", "", 0.8), ("", "c", 0.4)], 10, 1, ["k"], [])
    return spark.createDataFrame([row], f"persona_id STRING, style {style}, mental_models ARRAY<{model}>, core_beliefs ARRAY<{belief}>, total_words INT, total_documents INT, top_keywords ARRAY<STRING>, top_collocations ARRAY<STRING>")


def test_persona_is_fixed(spark):
    r = Q.fix_personas(persona(spark)).first()
    assert r.style.tone == "Professional and informative" and r.style.catchphrases == ["abc"] and r.style.vocabulary == ["yy"]
    assert [(m.name, m.description) for m in r.mental_models] == [("m", "A framework with 2 steps")]
    assert [(b.statement, b.category) for b in r.core_beliefs] == [("b", "general")]


def test_persona_issues_and_scores(spark):
    r = Q.quality_scores(Q.persona_issues(persona(spark))).first()
    assert "Mental model 'thin' has insufficient steps: 1" in r.issues and "Core belief 1 missing statement" in r.issues
    assert "Core belief 'b...' missing category" in r.issues and "Insufficient source content: 10 words" in r.issues
    assert (r.score_style, r.score_models, r.score_beliefs, r.score_statistics) == pytest.approx((0.25, 0.375, 0.3, 0.25))


def test_persona_checks_over_rows_equal_those_of_nested_records(spark):
    nested = persona(spark)
    people = nested.drop("mental_models", "core_beliefs")
    models = nested.select("persona_id", F.posexplode("mental_models").alias("rank", "x")).select("persona_id", "rank", "x.*")
    beliefs = nested.select("persona_id", F.posexplode("core_beliefs").alias("rank", "x")).select("persona_id", "rank", "x.*")
    stray = models.withColumn("persona_id", F.lit("unknown"))
    rows = people, models.unionByName(stray), beliefs
    got = sorted(r.issue for r in Q.persona_issue_rows(*rows).collect())
    assert got == sorted(Q.persona_issues(nested).first().issues)
    flat = Q.with_measures(*rows)
    assert Q.persona_summary(flat).collect() == Q.persona_summary(nested).collect()
    scores = ["score_style", "score_models", "score_beliefs", "score_statistics", "score_overall"]
    assert Q.quality_scores(flat).select(scores).first() == pytest.approx(Q.quality_scores(nested).select(scores).first())
    fixed, want = Q.fix_rows(*rows), Q.fix_personas(nested).first()
    assert fixed[0].first().style == want.style
    assert [r.description for r in fixed[1].where("persona_id = 'p'").collect()] == [m.description for m in want.mental_models]
    assert [r.category for r in fixed[2].collect()] == [b.category for b in want.core_beliefs]
    assert [(r.name, r.pos) for r in Q.most_confident(models, 1).collect()] == [("thin", 0)]


@pytest.mark.parametrize("name", ["agg_21_persona_summary", "val_02_persona_issues", "val_03_quality_scores", "val_04_fix_personas", "top_02_by_confidence"])
def test_persona_queries_gather_no_tenant(spark, name):
    from checks.records import CHECKS

    plan = CHECKS[name][0](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan


def test_records_sort_by_confidence(spark):
    got = persona(spark).select(Q.by_confidence(F.col("mental_models")).alias("m")).first().m
    assert [x.name for x in got] == ["thin", "m"]


def test_corpus_hash_ignores_row_order(spark):
    df = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "source STRING, content STRING")
    h = lambda d: keys.corpus_hash(d).first().corpus_hash
    assert h(df) == h(df.orderBy(F.desc("source"))) != h(df.where("source <> 'c'"))


def test_results_expire(spark):
    now = F.to_timestamp(F.lit("2024-01-03 00:00:00"))
    rows = spark.createDataFrame([("h1", "k", "s", "new", "2024-01-02 12:00:00"), ("h1", "k", "s", "old", "2024-01-02 10:00:00"), ("h2", "k", "s", "x", "2023-12-01 00:00:00")],
                                 "content_hash STRING, kind STRING, settings_hash STRING, payload STRING, t STRING").withColumn("saved_at", F.to_timestamp("t"))
    work = spark.createDataFrame([("h1", "k", "s"), ("h2", "k", "s"), ("h1", "k", "other")], "content_hash STRING, kind STRING, settings_hash STRING")
    known, todo = E.reuse(work, rows, now, 24)
    assert [r.payload for r in known.collect()] == ["new"] and todo.count() == 2


def test_similar_records_form_clusters(spark):
    rows = [(i, "p", t) for i, t in enumerate([
        "alpha beta gamma delta", "beta alpha gamma delta", "alpha beta gamma delta epsilon", "one two three four", "unrelated words only here"])]
    df = spark.createDataFrame(rows, "doc_id BIGINT, persona_id STRING, text STRING")
    got = {r.doc_id: r.cluster for r in consolidation.similar_records(df, threshold=0.6, bands=32, rows=1).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 3, 4: 4}


@pytest.mark.parametrize("block", [5, 1_000])
def test_similar_clusters_equal_brute_force(spark, block):
    """Families of near records, chains, copies, a word in all records, empty and null rows, one id on two texts."""
    rng = random.Random(4)
    rows = []
    for family in range(60):
        base = [f"f{family}w{i}" for i in range(rng.randint(4, 14))]
        for _ in range(25):
            kept = [w for w in base if rng.random() < 0.85] + [f"x{rng.randrange(400)}" for _ in range(rng.randint(0, 4))]
            rows.append((len(rows), f"p{family % 3}", " ".join(["all", *rng.sample(kept, len(kept))])))
    rows += [(len(rows) + i, "p0", "exactly the same text") for i in range(300)]
    rows += [(5, "p2", rows[-1][2]), (9001, "p0", ""), (9002, "p0", None), (9003, None, "all"), (None, "p0", "all")]
    df = spark.createDataFrame(rows, "doc_id BIGINT, persona_id STRING, text STRING")
    got = {(r.persona_id, r.doc_id): r.cluster for r in consolidation.similar_clusters(df, threshold=0.6, block=block).collect()}

    sets, parent = {}, {}
    for i, p, t in rows:
        if t and p and i is not None:
            sets.setdefault((p, i), set()).add(frozenset(re.findall(r"\w{2,}", t)))

    def root(x):
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    keys = sorted(sets)
    for n, a in enumerate(keys):
        for b in keys[n + 1 :]:
            if a[0] == b[0] and any(len(s & t) >= 0.6 * len(s | t) for s in sets[a] for t in sets[b]):
                low, high = sorted((root(a), root(b)))
                parent[high] = low
    assert got == {(p, i): root((p, i))[1] if (p, i) in sets else i for i, p, t in rows}
    assert consolidation.similar_clusters(df.limit(0)).count() == 0


def test_components_of_a_chain_keep_small_estimates(spark):
    """Many rounds of joins: the planner's estimate of the labels must not be multiplied in each."""
    edges = spark.createDataFrame([(p, "t") for i in range(300) for p in ((i, i + 1), (i + 1, i))], "p struct<a:long,b:long>, persona_id string")
    labels = consolidation.connected(edges.select("persona_id", "p.a", "p.b"), ["persona_id"])
    assert labels.count() == 301 and labels.where("label <> 0").count() == 0
    assert len(str(labels._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < 9


def test_artifact_files(spark, tmp_path):
    import gzip

    (tmp_path / "persona_ann_b_20240101_000000.json").write_text('{"mental_models": []}')
    (tmp_path / "persona_ann_b_20240301_000000.json").write_text('{"mental_models": 3}')
    with gzip.open(tmp_path / "persona_ann_b_20240201_000000.json.gz", "wt") as f:
        f.write('{"core_beliefs": []}')
    (tmp_path / "other.json").write_text("{}")
    rows = artifacts.read_artifacts(spark, str(tmp_path))
    assert rows.count() == 2
    r = artifacts.latest_artifacts(rows).first()
    assert (r.persona_id, r.compressed) == ("ann_b", True)
    with pytest.raises(ValueError):
        artifacts.export_json(rows, "xml")


def test_text_folder(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a_talk.txt").write_bytes("Grüße\n\nan alle".encode("latin-1"))
    (tmp_path / "sub" / "b.md").write_text("# The Big Heading\ntext")
    (tmp_path / "c.pdf").write_text("no")
    (tmp_path / "empty.txt").write_text("")
    rows = {r.filename: r for r in files.read_text_files(spark, str(tmp_path), recursive=True).collect()}
    assert set(rows) == {"a_talk.txt", "b.md"}
    assert rows["a_talk.txt"].content == "Grüße\nan alle" and rows["b.md"].title == "The Big Heading"
    flat = files.read_text_list(spark, [str(tmp_path / "a_talk.txt"), str(tmp_path / "gone.txt")])
    assert [r.filename for r in flat.collect()] == ["a_talk.txt"]


def test_upsert_twice_changes_nothing(spark, tmp_path):
    rows = spark.createDataFrame([("p", "k", str(i), "old") for i in range(4)] + [("q", "k", "0", "keep")], "persona_id STRING, knowledge_type STRING, record_key STRING, v STRING")
    path = str(tmp_path / "t")
    collections.upsert(spark, rows, path, str(tmp_path / "s0"))
    new = rows.where("persona_id = 'p' AND record_key < '2'").withColumn("v", F.lit("new"))
    for i in range(2):
        collections.upsert(spark, new, path, str(tmp_path / f"s{i + 1}"))
    got = {(r.persona_id, r.record_key): r.v for r in spark.read.parquet(path).collect()}
    assert got == {("p", "0"): "new", ("p", "1"): "new", ("p", "2"): "old", ("p", "3"): "old", ("q", "0"): "keep"}


def test_failed_calls_are_kept_apart(spark):
    def load():
        def answer(prompts):
            if any("bad" in p for p in prompts):
                raise RuntimeError("quota")
            return ['{"mental_models": []}'] * len(prompts)

        return answer

    docs = spark.createDataFrame([(1, "p", "s1", "good"), (2, "p", "s2", "bad")], "doc_id BIGINT, persona_id STRING, source STRING, content STRING")
    replied = PE.extract(PE.extraction_batches(docs, "mental_models", max_items=1), "mental_models", load)
    assert [(r.batch_start, r.reason) for r in PE.quarantine(replied).collect()] == [(1, "quota")]


def test_whole_texts_and_starts_as_fingerprints(spark):
    start = "x" * 250
    df = spark.createDataFrame([(1, start + "a"), (2, start + "b"), (3, start + "A")], "doc_id BIGINT, content STRING")
    kept = lambda **kw: sorted(r.doc_id for r in dedup.first_per_fingerprint(df, order=["doc_id"], **kw).collect())
    assert kept() == [1, 2] and kept(chars=200) == [1]


def test_merged_sketches_stay_near_exact_quantiles(spark):
    """Days merged to one sketch, also with days added later, against exact ranks; null times count nowhere."""
    rng = random.Random(3)
    rows = [(f"2024-01-{d + 1:02d} 10:00:00", op, None if i % 97 == 0 else rng.expovariate(1 / (d + 1)))
            for d in range(20) for op in ("load", "save") for i in range(1_000)]
    df = spark.createDataFrame(rows, "ts STRING, operation STRING, seconds DOUBLE").withColumn("ts", F.to_timestamp("ts"))
    early, late = (E.timing_sketches(df.where(c)) for c in (F.col("ts") < "2024-01-08", F.col("ts") >= "2024-01-08"))
    merged = E.sketched_quantiles(E.merged_sketches(early.unionByName(late), ["operation"]), {"q00": 0.0, "q50": 0.5, "q99": 0.99, "q100": 1.0})
    for r in merged.collect():
        exact = sorted(s for _, op, s in rows if op == r.operation and s is not None)
        assert r.runs == len(exact) and r.q00 == exact[0] and r.q100 == exact[-1]
        for q, got in ((0.5, r.q50), (0.99, r.q99)):
            assert abs(sum(s <= got for s in exact) / len(exact) - q) < 0.015
