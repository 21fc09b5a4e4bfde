"""Repeated phrases: against brute force, and without a row per n-gram."""

import random
import re
from collections import Counter

import pytest

from marginalia.functions import fixed
from marginalia.operators import linguistics, phrases


def brute_force(rows):
    found = Counter()
    for _, tenant, text in rows:
        for sentence in re.split(r"(?<=[.!?])\s+", text or ""):
            words = re.findall(r"\w+", sentence.lower())
            for n in range(3, 9):
                for i in range(len(words) - n + 1):
                    cut = words[i : i + n]
                    if not set(cut) <= set(fixed.STOP_WORDS):
                        found[tenant, " ".join(cut)] += 1
    return {
        (*k, n) for k, n in found.items()
        if n >= 2 and 11 <= len(k[1]) <= 99 and not k[1].startswith(("the", "and", "or", "but"))
    }


def texts():
    draw = random.Random(3)
    vocabulary = ["alpha", "beta", "gamma", "delta", "the", "of", "Ünder", "x1", "is", "omega"]
    rows = [(i, f"t{i % 3}", " ".join(draw.choice(vocabulary) + draw.choice(["", "", "", ". ", "!"]) for _ in range(draw.randrange(1, 60)))) for i in range(90)]
    copy = "one very common passage of more than eight words that all hold."
    return [*rows, *((100 + i, "t0", copy) for i in range(30)), (200, "t1", None), (201, "t1", ""), (202, "t2", "... !! ??"), (203, "t2", copy)]


@pytest.mark.parametrize("most_bits", [30, 14])  # 14: a filter so full that nearly every start is suspected
def test_repeated_phrases_equal_brute_force(spark, monkeypatch, most_bits):
    monkeypatch.setattr(phrases, "_FILTER", (14, 30))
    rows = texts()
    df = spark.createDataFrame(rows, "doc_id long, persona_id string, content string").repartition(5)
    got = linguistics.repeated_phrases(df, most_bits=most_bits).collect()
    assert {(r.persona_id, r.phrase, r.n) for r in got} == brute_force(rows) and len(got) == len(brute_force(rows))


def test_repeated_phrases_without_scope_and_with_long_texts_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(phrases, "_PIECE", 100)
    rows = [(i, None, t) for i, _, t in texts()]
    df = spark.createDataFrame(rows, "doc_id long, persona_id string, content string")
    got = linguistics.repeated_phrases(df.drop("persona_id"), ()).collect()
    assert {(None, r.phrase, r.n) for r in got} == brute_force(rows)


def test_unique_phrases_stay_where_they_are(spark):
    """No n-gram is shuffled as a text of its own: what leaves a task are suspected starts, and none is left here."""
    rows = [(i, "t", " ".join(f"word{i}x{j}" for j in range(50))) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, persona_id string, content string")
    plan = linguistics.repeated_phrases(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "LeftSemi" not in plan
    assert phrases.repeated_runs(df, ["persona_id"], content="content", low=3, high=8).count() == 0
