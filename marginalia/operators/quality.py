"""Data quality of documents and of persona records.

Checks of persona records come in two forms: over one nested row per tenant, for records that were consolidated, and
over `people` (one row per tenant) beside the tables of its `models` and `beliefs`, which gathers no tenant.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import ranking
from .assembly import running_total
from .dedup import repeated_starts


def document_issues(docs: DataFrame, *, id_col: str = "doc_id", content: str = "content", source: str = "source", min_words: int = 1000) -> DataFrame:
    """Issue rows (id, issue): missing or empty content, missing source, copies, too little text overall."""
    c, s = F.col(content), F.col(source)
    per_row = F.array_compact(F.array(
        F.when(c.isNull(), F.lit("missing content")),
        F.when(c.isNotNull() & (T.strip(c) == ""), F.lit("empty content")),
        F.when(s.isNull(), F.lit("missing source")),
    ))
    issues = docs.select(F.col(id_col).cast("string").alias("id"), F.explode(per_row).alias("issue"))
    copies = repeated_starts(docs, id_col, content).select(F.col(id_col).cast("string").alias("id"), F.lit("duplicate start").alias("issue"))
    total = docs.agg(F.coalesce(F.sum(T.count_words(c)), F.lit(0)).alias("w")).where(F.col("w") < min_words)
    return issues.unionByName(copies).unionByName(total.select(F.lit("*").alias("id"), F.lit("too few words").alias("issue")))


MINIMUMS = {"mental_models": 3, "core_beliefs": 5, "catchphrases": 3, "vocabulary": 10}


def _nested_measures() -> dict[str, Column]:
    return {
        "_models": F.size("mental_models"), "_beliefs": F.size("core_beliefs"),
        "_model_confidence": _mean_confidence("mental_models"), "_belief_confidence": _mean_confidence("core_beliefs"),
    }


def _measured(p: DataFrame) -> DataFrame:
    """Counts and mean confidences of the records: those of `with_measures`, else of the nested arrays."""
    return p if "_models" in p.columns else p.withColumns(_nested_measures())


def with_measures(people: DataFrame, models: DataFrame, beliefs: DataFrame) -> DataFrame:
    """`people` with the count and mean confidence of each tenant's records, which stay rows of their own.

    `persona_summary` and `quality_scores` take the result in place of nested records.
    """
    for rows, n, mean in ((models, "_models", "_model_confidence"), (beliefs, "_beliefs", "_belief_confidence")):
        found = rows.groupBy("persona_id").agg(F.count("*").alias(n), (F.sum("confidence_score") / F.count("*")).alias(mean))
        people = people.join(found, "persona_id", "left").withColumns({n: F.coalesce(n, F.lit(0)), mean: F.coalesce(mean, F.lit(0.0))})
    return people


def _tenant_issues(minimums: dict[str, int] | None, min_tone: int) -> list[Column]:
    m = {**MINIMUMS, **(minimums or {})}
    sized = {
        "mental_models": ("mental models", F.col("_models")),
        "core_beliefs": ("core beliefs", F.col("_beliefs")),
        "catchphrases": ("catchphrases", F.size("style.catchphrases")),
        "vocabulary": ("vocabulary terms", F.size("style.vocabulary")),
    }
    single = [
        F.when(n < m[k], F.concat(F.lit(f"Insufficient {label}: "), n.cast("string"), F.lit(f" < {m[k]}")))
        for k, (label, n) in sized.items()
    ]
    tone = F.coalesce(F.length("style.tone"), F.lit(0))
    return [*single, F.when(tone < min_tone, F.lit("Missing or insufficient tone description"))]


def _too_few_words(min_words: int) -> Column:
    return F.when(F.col("total_words") < min_words, F.concat(
        F.lit("Insufficient source content: "), F.col("total_words").cast("string"), F.lit(" words")))


def _is_blank(text: Column) -> Column:
    return F.coalesce(text, F.lit("")) == ""


# Issues and repairs of one record; `x` gives its fields. A model's issue is a test and a text, which is null if the name is.
def _thin_model(x: Callable[[str], Column]) -> tuple[Column, Column]:
    return F.size(x("steps")) < 2, F.concat(
        F.lit("Mental model '"), x("name"), F.lit("' has insufficient steps: "), F.size(x("steps")).cast("string"))


def _plain_model(x: Callable[[str], Column]) -> tuple[Column, Column]:
    return _is_blank(x("description")), F.concat(F.lit("Mental model '"), x("name"), F.lit("' missing description"))


def _blank_belief(x: Callable[[str], Column], i: Column) -> Column:
    return F.when(_is_blank(x("statement")), F.concat(F.lit("Core belief "), i.cast("string"), F.lit(" missing statement")))


def _bare_belief(x: Callable[[str], Column]) -> Column:
    return F.when(_is_blank(x("category")), F.concat(
        F.lit("Core belief '"), F.left(x("statement"), F.lit(30)), F.lit("...' missing category")))


def _described(x: Callable[[str], Column]) -> Column:
    return F.when(_is_blank(x("description")), F.concat(
        F.lit("A framework with "), F.size(x("steps")).cast("string"), F.lit(" steps"))).otherwise(x("description"))


def _categorised(x: Callable[[str], Column]) -> Column:
    return F.when(_is_blank(x("category")), F.lit("general")).otherwise(x("category"))


def persona_issues(p: DataFrame, minimums: dict[str, int] | None = None, min_words: int = 1000, min_tone: int = 10) -> DataFrame:
    """`issues` column: too few items, short tone, thin models, blank beliefs, too little source text.

    A persona row has style (tone, catchphrases, vocabulary), mental_models, core_beliefs, total_words.
    """
    said = lambda issue: F.transform(F.filter("mental_models", lambda x: issue(x.__getitem__)[0]), lambda x: issue(x.__getitem__)[1])
    blank = F.transform("core_beliefs", lambda x, i: _blank_belief(x.__getitem__, i))
    bare = F.transform("core_beliefs", lambda x: _bare_belief(x.__getitem__))
    single = F.array(*_tenant_issues(minimums, min_tone))
    out = _measured(p).withColumn("issues", F.concat(
        F.array_compact(single), said(_thin_model), said(_plain_model), F.array_compact(F.concat(blank, bare, F.array(_too_few_words(min_words))))))
    return out.select(*p.columns, "issues")


def persona_issue_rows(
    people: DataFrame, models: DataFrame, beliefs: DataFrame, minimums: dict[str, int] | None = None, min_words: int = 1000,
    min_tone: int = 10, *, order: str = "rank", check_beliefs: bool = True,
) -> DataFrame:
    """(persona_id, issue): the issues of `persona_issues` as rows, from records that are rows.

    Beliefs are numbered by confidence, then `order`, as in a nested record; without `check_beliefs` they are only
    counted. Records of tenants without a row in `people` are left out, as there.
    """
    each = lambda rows, *issues: rows.select("persona_id", F.explode(F.array_compact(F.array(*issues))).alias("issue"))
    said = F.array(*[F.struct(bad.alias("bad"), text.alias("issue")) for bad, text in (_thin_model(F.col), _plain_model(F.col))])
    found = models.select("persona_id", F.explode(F.filter(said, lambda x: x["bad"])).alias("_x")).select("persona_id", "_x.issue")
    if check_beliefs:
        flags = beliefs.select("persona_id", (-F.col("confidence_score")).alias("_c"), order, F.when(_is_blank(F.col("statement")), F.lit("")).otherwise("-").alias("statement"))
        numbered = running_total(flags, ["persona_id"], ["_c", order], {"_at": F.lit(1)})
        found = found.unionByName(each(beliefs, _bare_belief(F.col))).unionByName(each(numbered, _blank_belief(F.col, F.col("_at"))))
    tenants = people.select(F.col("persona_id").alias("_tenant"))
    found = found.join(tenants, F.col("persona_id").eqNullSafe(F.col("_tenant")), "left_semi")
    return each(with_measures(people, models, beliefs), *_tenant_issues(minimums, min_tone), _too_few_words(min_words)).unionByName(found)


def _mean_confidence(arr: str) -> Column:
    total = F.aggregate(arr, F.lit(0.0), lambda a, x: a + x["confidence_score"])
    return F.coalesce(F.try_divide(total, F.size(arr).cast("double")), F.lit(0.0))


def quality_scores(p: DataFrame) -> DataFrame:
    """Four component scores in 0..1 and their mean, of nested records or of the rows of `with_measures`."""
    on = lambda cond, x: F.when(cond, F.lit(x)).otherwise(F.lit(0.0))
    style = (
        on(F.coalesce(F.col("style.tone"), F.lit("")) != "", 0.25) + on(F.size("style.catchphrases") >= 5, 0.25)
        + on(F.size("style.vocabulary") >= 20, 0.25) + on(F.col("style.communication_style").isNotNull(), 0.25)
    )
    models = on(F.col("_models") >= 3, 0.3) + on(F.col("_models") >= 5, 0.2) + F.col("_model_confidence") * 0.5
    beliefs = on(F.col("_beliefs") >= 5, 0.3) + on(F.col("_beliefs") >= 10, 0.2) + F.col("_belief_confidence") * 0.5
    stats = (
        on(F.col("total_words") >= 5000, 0.3) + on(F.col("total_documents") >= 3, 0.2)
        + on(F.size("top_keywords") > 0, 0.25) + on(F.size("top_collocations") > 0, 0.25)
    )
    parts = {"score_style": style, "score_models": models, "score_beliefs": beliefs, "score_statistics": stats}
    out = _measured(p).withColumns({k: F.least(F.lit(1.0), v) for k, v in parts.items()})
    return out.withColumn("score_overall", sum(F.col(k) for k in parts) / 4).select(*p.columns, *parts, "score_overall")


def _fixed_style() -> Column:
    tone = F.when(_is_blank(F.col("style.tone")), F.lit("Professional and informative")).otherwise(F.col("style.tone"))
    return (
        F.col("style").withField("tone", tone)
        .withField("catchphrases", F.filter("style.catchphrases", lambda x: F.length(x) > 2))
        .withField("vocabulary", F.filter("style.vocabulary", lambda x: F.length(x) > 1))
    )


def fix_personas(p: DataFrame) -> DataFrame:
    """Default tone; short phrases, thin models and blank beliefs dropped; default texts filled in."""
    models = F.transform(
        F.filter("mental_models", lambda x: F.size(x["steps"]) >= 2),
        lambda x: x.withField("description", _described(x.__getitem__)),
    )
    beliefs = F.transform(
        F.filter("core_beliefs", lambda x: ~_is_blank(x["statement"])),
        lambda x: x.withField("category", _categorised(x.__getitem__)),
    )
    return p.withColumns({"style": _fixed_style(), "mental_models": models, "core_beliefs": beliefs})


def fix_rows(people: DataFrame, models: DataFrame, beliefs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The repairs of `fix_personas` on records that are rows."""
    return (
        people.withColumn("style", _fixed_style()),
        models.where(F.size("steps") >= 2).withColumn("description", _described(F.col)),
        beliefs.where(~_is_blank(F.col("statement"))).withColumn("category", _categorised(F.col)),
    )


def by_confidence(records: Column) -> Column:
    """Array of records, highest confidence first; equal ones keep their order."""
    indexed = F.transform(records, lambda x, i: F.struct((-x["confidence_score"]).alias("c"), i.alias("i"), x.alias("x")))
    return F.transform(F.array_sort(indexed, lambda a, b: F.when(a["c"] < b["c"], -1).when(a["c"] > b["c"], 1).otherwise(a["i"] - b["i"])), lambda s: s["x"])


def most_confident(records: DataFrame, k: int, *, order: str = "rank") -> DataFrame:
    """The first `k` records of each tenant by `by_confidence`, as rows with their position from 0."""
    best = ranking.top_k(records, ["persona_id"], [F.desc("confidence_score"), F.asc(order)], k, "pos")
    return best.withColumn("pos", F.col("pos") - 1)


def persona_summary(p: DataFrame) -> DataFrame:
    """Counts and mean confidences of nested records or of the rows of `with_measures`."""
    return _measured(p).select(
        "persona_id",
        F.col("_models").alias("models"), F.col("_beliefs").alias("beliefs"),
        F.size("style.catchphrases").alias("catchphrases"), F.size("style.vocabulary").alias("vocabulary"),
        F.col("_model_confidence").alias("model_confidence"), F.col("_belief_confidence").alias("belief_confidence"),
    )


def collection_check(expected: DataFrame, rows: DataFrame) -> DataFrame:
    """Expected collections (persona_id, expected) beside the rows found; missing ones show 0."""
    found = rows.groupBy("persona_id").agg(F.count("*").alias("found"))
    return expected.join(found, "persona_id", "left").withColumn("found", F.coalesce("found", F.lit(0))).withColumn(
        "status", F.when(F.col("found") == 0, "missing").when(F.col("found") < F.col("expected"), "incomplete").otherwise("ok")
    )
