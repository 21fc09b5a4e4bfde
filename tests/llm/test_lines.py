from collections import Counter

import pytest
from pyspark.sql import functions as F

from marginalia.llm.line_dedup import drop_repeated_lines

SPACE = " \t\n\x0b\x0c\r"
UPPER = {c: c + 32 for c in range(65, 91)}


def brute(rows, min_docs, min_chars=1):
    split = [(i, (t or "").split("\n")) for i, t in rows]
    key = lambda x: x.strip(SPACE).translate(UPPER)
    count = Counter(k for _, lines in split for k in {key(x) for x in lines} if len(k) >= min_chars)
    out = []
    for i, lines in split:
        kept = [x for x in lines if count[key(x)] < min_docs]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def got(df):
    return sorted([(r.doc_id, r.n_lines, r.n_dropped, r.text) for r in df.collect()], key=str)


@pytest.mark.parametrize("few", [1_000_000, 0])
def test_equals_brute_force_on_both_paths(spark, docs, few):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    for min_docs, min_chars in ((2, 1), (10, 1), (3, 20)):
        assert got(drop_repeated_lines(docs, min_docs, min_chars, max_broadcast=few)) == brute(rows, min_docs, min_chars)


def test_a_full_filter_changes_nothing(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert got(drop_repeated_lines(docs, 2, bits=1 << 10)) == brute(rows, 2)


@pytest.mark.parametrize("few", [1_000_000, 0])
def test_keep_first(spark, few):
    df = spark.createDataFrame([(3, "X\na"), (1, " x \nb\nX"), (2, "x")], "doc_id bigint, text string")
    assert got(drop_repeated_lines(df, 2, keep_first=True, max_broadcast=few)) == [(1, 3, 1, " x \nb"), (2, 1, 1, ""), (3, 2, 1, "a")]


@pytest.mark.parametrize("few", [1_000_000, 0])
def test_odd_rows(spark, odd, few):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    out = drop_repeated_lines(odd, 2, max_broadcast=few)
    assert got(out) == brute(rows, 2)
    assert out.columns.count("n_lines") == 1 and "score" in out.columns
    assert drop_repeated_lines(odd.filter(F.lit(False)), 2, max_broadcast=few).count() == 0
