import random
import re
import zlib

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import functions as F

from marginalia.llm import language, quality, toxicity
from marginalia.llm.common import crc_mod, table
from marginalia.llm.queries import QUERIES

SF = "/root/testdata/sf0.1"


def auc(y, score):
    rank = pd.Series(score).rank()
    n1 = sum(y)
    return (rank[np.array(y) == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(y) - n1))


def held_out(spark, scored, label):
    labels = table(spark, SF, "labels").filter(crc_mod("doc_id", 5) == 0)
    rows = scored.join(labels, "doc_id").select(label, "score").collect()
    return auc([r[0] for r in rows], [r[1] for r in rows])


def test_quality_held_out(spark):
    docs = table(spark, SF, "documents").select("doc_id", "text")
    machine = quality.fit(docs, table(spark, SF, "labels").filter(crc_mod("doc_id", 5) != 0), most=1_500)
    assert held_out(spark, quality.score(docs.join(table(spark, SF, "labels"), "doc_id", "left_semi"), machine), "quality") > 0.98


def test_toxicity_held_out(spark):
    docs = table(spark, SF, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, SF, "labels").filter(crc_mod("doc_id", 5) != 0))
    assert held_out(spark, toxicity.score(docs.join(table(spark, SF, "labels"), "doc_id", "left_semi"), model), "toxic") > 0.95


def test_pair_sum_in_linear_time():
    rng = np.random.default_rng(0)
    n = quality.BUCKETS + quality.STATISTICS
    m = quality.Machine(0.3, rng.normal(size=n), rng.normal(size=(n, 4)))
    at, x = np.array([3, 9, 77, 500]), rng.normal(size=4)
    pairs = sum(m.factor[at[i]] @ m.factor[at[j]] * x[i] * x[j] for i in range(4) for j in range(i + 1, 4))
    assert np.isclose(m.raw(at, x), 0.3 + m.weight[at] @ x + pairs)


def test_swapping_groups_keeps_the_score():
    """One group is named mostly in toxic texts; without the penalty its name alone raises the score."""
    texts = [(1, f"the muslim idiot said word{i % 7}") for i in range(60)] + [(0, f"a kind christian said word{i % 7}") for i in range(60)]
    rows = [(y, toxicity._hashes(t), [toxicity._hashes(s) for s in toxicity.swaps(t)]) for y, t in texts]
    gap = lambda m: abs(m.score("a muslim neighbour") - m.score("a christian neighbour"))
    free, bound = toxicity.train(rows, penalty=0.0), toxicity.train(rows, penalty=5.0)
    assert gap(free) > 0.2 and gap(bound) < 0.02 and bound.score("what an idiot") > 0.5
    assert toxicity.swaps("no group here") == [] and "muslim" not in toxicity.swaps("The Muslim. A muslim!")[0]


def plain_score(model, text):
    """Score by the fitted weights, from a plain reading of the words and of the pairs around a group's name."""
    words = re.findall(r"[^\W\d_]+", (text or "").lower())
    names = {t for line in toxicity.IDENTITY_TERMS for t in line}
    found = set(words) | {f"{a} {b}" for a, b in zip(words, words[1:]) if a in names or b in names}
    raw = model.bias + sum(model.weights.get(xxhash.xxh3_64_intdigest(w.encode()), 0.0) for w in found)
    return 1 / (1 + np.exp(-raw))


def test_toxicity_query_on_group_mentions(spark, tmp_path):
    """Toxic texts often name one group; neutral texts that name it must not be taken for toxic, insults must."""
    rng = random.Random(7)
    plain, insults = [f"plain{''.join(rng.choices('abcdef', k=5))}" for _ in range(300)], [f"slur{c}" for c in "abcdefghijklmnopqrstuvwxyz"]
    docs, labels, kind = [], [], {}
    for i in range(3_000):
        words = rng.choices(plain, k=12)
        toxic = i % 3 == 0
        named = rng.random() < (0.7 if toxic else 0.06)
        if toxic and rng.random() < 0.8:
            words[rng.randrange(12)] = rng.choice(insults)
        if named:
            words.insert(rng.randrange(12), "muslims")
        docs.append((i, " ".join(words) + "."))
        labels.append((i, int(toxic), 0))
        kind[i] = (toxic, named, any(w.startswith("slur") for w in words))
    docs += [(3_000, None), (3_001, "")]
    docs = spark.createDataFrame(docs, "doc_id bigint, text string")
    labels = spark.createDataFrame(labels, "doc_id bigint, toxic int, quality int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    learnt = labels.filter(crc_mod("doc_id", 5) != 0)
    bound, free = toxicity.fit(docs, learnt), toxicity.fit(docs, learnt, penalty=0.0)
    rows = QUERIES["op10_toxicity"](spark, str(tmp_path)).collect()
    text = {r.doc_id: r.text for r in docs.collect()}
    assert len(rows) == 3_002
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.5)
        assert abs(r.score - plain_score(bound, text[r.doc_id])) < 1e-9
    held = [r for r in rows if r.held_out and r.doc_id in kind]
    neutral = [r for r in held if not kind[r.doc_id][0] and kind[r.doc_id][1]]
    before = np.mean([plain_score(free, text[r.doc_id]) >= 0.5 for r in neutral])
    after = np.mean([r.predicted for r in neutral])
    assert before > 0.5 and after < 0.1
    assert np.mean([r.predicted for r in held if kind[r.doc_id][2]]) > 0.9
    gap = lambda m: np.mean([abs(plain_score(m, f"{w} muslims") - plain_score(m, w)) for w in plain])
    assert gap(bound) < 0.1 * gap(free)


def test_names_are_put_into_texts_without_one():
    assert toxicity.mentions("") == [] and toxicity.mentions("1 2 3") == [] and toxicity.mentions("The women here.") == []
    versions = toxicity.mentions("Some words. Others, too.")
    assert len(versions) == 2 and versions == toxicity.mentions("Some words. Others, too.")
    for name, version in versions:
        assert version.replace(f"{name} ", "") == "some words. others, too." and name in toxicity.features(version)
    assert toxicity.features("the women said the end") == ["the", "women", "said", "end", "the women", "women said"]


def test_language(spark, docs):
    model = language.fit(docs.filter(crc_mod("doc_id", 3) != 1))
    rows = language.predict(docs.filter(crc_mod("doc_id", 3) == 1), model).collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.97
    small = language.fit(docs, per_lang=20)  # many words are unseen: characters decide
    rows = language.predict(docs, small).collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.9


def plain_language(rows, query):
    """[(language, share)] of the texts in `query` from strings and dictionaries, learnt from all (lang, text) in `rows`."""
    counts = ({}, {})
    for lang, text in rows:
        for w in language.LETTERS.findall(text.lower()):
            marked = f"<{w}>"
            for kind, terms in ((0, [w]), (1, [marked[i : i + s] for s in range(1, 6) for i in range(len(marked) - s + 1)])):
                for t in terms:
                    own = counts[kind].setdefault(t, {})
                    own[lang] = own.get(lang, 0) + 1
    langs = sorted({x for x, t in rows if language.LETTERS.search(t)})
    total = [{x: sum(own.get(x, 0) for own in kind.values()) for x in langs} for kind in counts]

    def logs(kind, term):
        share = [counts[kind][term].get(x, 0) / total[kind][x] for x in langs]
        return np.log(0.9 * np.array(share) + 0.1 * np.mean(share))

    floor = min(np.log(0.1 * np.mean([own.get(x, 0) / total[1][x] for x in langs])) for own in counts[1].values())

    def word(w):
        if w in counts[0]:
            return logs(0, w)
        marked, at, got = f"<{w}>", 0, []
        while at < len(marked):
            size = next((s for s in range(min(5, len(marked) - at), 0, -1) if marked[at : at + s] in counts[1]), 0)
            got.append(logs(1, marked[at : at + size]) - 0.9 * (5 - size) if size else np.full(len(langs), floor))
            at += max(1, size - 1)
        return np.mean(got, axis=0)

    out = []
    for text in query:
        words = language.LETTERS.findall((text or "").lower())
        score = sum((word(w) for w in words), np.zeros(len(langs)))
        out.append((langs[int(score.argmax())], float(1 / np.exp(score - score.max()).sum())) if words else ("und", 0.0))
    return out


def test_language_query_equals_plain_python(spark, docs):
    got = {r.doc_id: r for r in QUERIES["op4_language_id"](spark, "/root/testdata/sf0.001").collect()}
    rows = docs.collect()
    fold = lambda r: zlib.crc32(str(r.doc_id).encode()) % 3
    want = plain_language([(r.lang, r.text) for r in rows if r.lang and r.text and fold(r) != 1], [r.text for r in rows])
    assert len(got) == len(rows)
    for r, (lang, share) in zip(rows, want, strict=True):
        assert got[r.doc_id].held_out == (fold(r) == 1) and got[r.doc_id].lang_pred == lang and abs(got[r.doc_id].score - share) < 1e-3


def test_small_languages_beside_large_ones(spark):
    """300 large documents of each of two languages and 250 languages of three short documents, all over the same letters."""
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("aeioustn") for _ in range(6))
    large = {x: [word() for _ in range(1_500)] for x in ("aa", "bb")}
    small = {f"s{i:03d}": [word() for _ in range(8)] for i in range(250)}
    rows = [(x, " ".join(rng.choices(own, k=300))) for x, own in large.items() for _ in range(300)]
    rows += [(x, " ".join(rng.sample(own, 6))) for x, own in small.items() for _ in range(3)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id bigint, lang string, text string")
    model = language.fit(df)
    assert len(model.langs) == 252
    got = [(r.lang, r.lang_pred) for r in language.predict(df, model).collect()]
    for kind in (small, large):
        assert np.mean([a == b for a, b in got if a in kind]) > 0.97


def test_odd_rows(spark, odd):
    got = {r.doc_id: r for r in language.predict(odd, language.fit(odd)).collect()}
    assert [got[i].lang_pred for i in (2, 3, 4)] == ["und"] * 3 and got[2].score == 0.0 and got[7].lang_pred != "und"
    none = odd.filter(F.lit(False))
    assert {r.lang_pred for r in language.predict(odd, language.fit(none)).collect()} == {"und"}
    labels = spark.createDataFrame([(1, 1, 0), (5, 0, 1), (5, 1, 1), (9, None, None), (None, 1, 1)], "doc_id bigint, quality int, toxic int")
    for module in (quality, toxicity):
        for rows in (labels, labels.filter(F.lit(False))):
            out = module.score(odd, module.fit(odd, rows))
            assert out.columns.count("score") == 1 and out.count() == odd.count()
            assert all(0 <= r.score <= 1 for r in out.collect())
        assert module.score(none, module.fit(none, labels)).count() == 0
