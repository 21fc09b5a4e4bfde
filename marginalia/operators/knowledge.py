"""Knowledge records: parse, validate, clean, enrich, turn into search documents, consolidate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as T
from ..functions.arrays import let, posexplode_rows
from ..functions.keys import short_sha
from . import ranking
from .assembly import ranged

LABELS = {"mental_models": "Mental model", "core_beliefs": "Core belief"}
REQUIRED = {"mental_models": ["name", "description", "steps"], "core_beliefs": ["statement", "category"]}
FIELD_TYPES = {
    "mental_models": {"name": "string", "description": "string", "steps": "list", "categories": "list"},
    "core_beliefs": {"statement": "string", "category": "string", "supporting_evidence": "list"},
}


def explode_artifacts(artifacts: DataFrame, kind: str, json: str = "json") -> DataFrame:
    """Items of one knowledge array of every artifact, each as a VARIANT with its position."""
    items = F.try_variant_get(F.try_parse_json(F.col(json)), f"$.{kind}", "array<variant>")
    keep = [c for c in artifacts.columns if c != json]
    return posexplode_rows(artifacts, keep, items, "index", "item")


def _get(item: Column, field: str, kind: str = "string") -> Column:
    return F.try_variant_get(item, f"$.{field}", kind)


def item_errors(item: Column, index: Column, kind: str) -> Column:
    """Messages for missing, empty or wrongly typed fields; an empty array means valid."""
    label = F.concat(F.lit(f"{LABELS[kind]} "), index.cast("string"))
    is_object = F.startswith(F.schema_of_variant(item), F.lit("OBJECT"))
    checks = []
    for field in REQUIRED[kind]:
        raw = F.try_variant_get(item, f"$.{field}", "variant")
        missing = raw.isNull()
        text = F.coalesce(_get(item, field), F.to_json(raw))
        empty = F.coalesce(text.isin("", "[]", "{}", "0", "false", "null"), F.lit(True))
        checks.append(F.when(missing, F.concat(label, F.lit(f" missing required field: {field} (will be skipped)"))))
        checks.append(F.when(~missing & empty, F.concat(label, F.lit(f" has empty required field: {field} (will be skipped)"))))
    for field, want in FIELD_TYPES[kind].items():
        raw = F.try_variant_get(item, f"$.{field}", "variant")
        have = F.schema_of_variant(raw)
        ok = (have == "STRING") if want == "string" else F.startswith(have, F.lit("ARRAY"))
        name = "a string" if want == "string" else "a list"
        checks.append(F.when(raw.isNotNull() & ~ok, F.concat(label, F.lit(f" '{field}' must be {name}"))))
    not_object = F.array(F.concat(label, F.lit(" is not a dictionary")))
    return F.when(is_object, F.array_compact(F.array(*checks))).otherwise(not_object)


def _clean_list(item: Column, field: str) -> Column:
    values = F.try_variant_get(item, f"$.{field}", "array<variant>")
    texts = F.transform(values, lambda v: T.strip(F.coalesce(F.try_variant_get(v, "$", "string"), F.to_json(v))))
    return F.coalesce(F.filter(texts, lambda s: s.isNotNull() & (s != "")), F.array().cast("array<string>"))


def process_items(items: DataFrame, kind: str) -> DataFrame:
    """Typed, trimmed columns with a content hash; `errors` tells which rows to skip."""
    item = F.col("item")
    text = lambda f: T.strip(F.coalesce(_get(item, f), F.lit("")))
    cols = {"errors": item_errors(item, F.col("index"), kind)}
    if kind == "mental_models":
        cols |= {"name": text("name"), "description": text("description"), "steps": _clean_list(item, "steps"), "categories": _clean_list(item, "categories")}
        key = F.concat(text("name"), text("description"))
    else:
        cols |= {"statement": text("statement"), "category": text("category"), "supporting_evidence": _clean_list(item, "supporting_evidence")}
        key = F.concat(text("statement"), text("category"))
    cols |= {
        "confidence_score": F.coalesce(_get(item, "confidence_score", "double"), F.lit(0.0)),
        "frequency": F.coalesce(_get(item, "frequency", "int"), F.lit(0)),
        "content_hash": short_sha(key),
    }
    return items.withColumns(cols).drop("item")


def split_valid(processed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good rows and rejected rows with one message each."""
    good = processed.where(F.size("errors") == 0).drop("errors")
    bad = processed.where(F.size("errors") > 0).select(
        *[c for c in ("persona_id", "batch_start", "index") if c in processed.columns], F.explode("errors").alias("error")
    )
    return good, bad


def model_content(name: str = "name", description: str = "description", steps: str = "steps", categories: str = "categories") -> Column:
    """Search text of a mental model: labelled parts, steps numbered unless they already are."""

    def step(s: Column, i: Column) -> Column:
        n = (i + 1).cast("string")
        t = T.strip(s)
        return F.when(t != "", F.when(F.startswith(t, F.concat(n, F.lit("."))), t).otherwise(F.concat(n, F.lit(". "), t)))

    numbered = F.array_compact(F.transform(steps, step))
    cats = F.filter(F.transform(categories, T.strip), lambda c: c != "")
    return F.concat_ws(
        "\n\n",
        F.when(T.strip(F.col(name)) != "", F.concat(F.lit("Framework: "), T.strip(F.col(name)))),
        F.when(T.strip(F.col(description)) != "", F.concat(F.lit("Description: "), T.strip(F.col(description)))),
        F.when(F.size(steps) > 0, F.lit("Steps:")),
        numbered,
        F.when(F.size(cats) > 0, F.concat(F.lit("Categories: "), F.array_join(cats, ", "))),
    )


def belief_content(statement: str = "statement", category: str = "category", evidence: str = "supporting_evidence") -> Column:
    lines = F.transform(F.filter(F.transform(evidence, T.strip), lambda e: e != ""), lambda e: F.concat(F.lit("• "), e))
    return F.concat_ws(
        "\n\n",
        F.when(T.strip(F.col(statement)) != "", F.concat(F.lit("Belief: "), T.strip(F.col(statement)))),
        F.when(T.strip(F.col(category)) != "", F.concat(F.lit("Category: "), T.strip(F.col(category)))),
        F.when(F.size(evidence) > 0, F.lit("Supporting Evidence:")),
        lines,
    )


def complexity(steps: Column, description: Column) -> Column:
    return F.round(F.least(F.size(steps) / 10.0, F.lit(1.0)) * 0.7 + F.least(F.length(description) / 500.0, F.lit(1.0)) * 0.3, 3)


def evidence_strength(evidence: Column) -> Column:
    n = F.size(evidence)
    total = F.aggregate(evidence, F.lit(0), lambda a, e: a + F.length(e))
    mean = F.coalesce(F.try_divide(total, n), F.lit(0.0))
    score = F.round(F.least(n / 5.0, F.lit(1.0)) * 0.4 + F.least(mean / 200.0, F.lit(1.0)) * 0.6, 3)
    return F.when(n > 0, score).otherwise(F.lit(0.0))


def primary_category(categories: Column) -> Column:
    return F.coalesce(F.lower(T.strip(F.get(categories, F.lit(0)))), F.lit("uncategorized"))


def framework_type(name: Column, description: Column, categories: Column) -> Column:
    text = F.lower(F.concat_ws(" ", name, description, F.array_join(categories, " ")))
    return let(text, lambda t: T.first_class(t, fixed.FRAMEWORK_TYPES, "concept"))


def belief_type(statement: Column, category: Column) -> Column:
    return let(F.lower(F.concat_ws(" ", statement, category)), lambda t: T.first_class(t, fixed.BELIEF_TYPES, "general"))


def standard_category(category: Column, missing: str | None = "uncategorized") -> Column:
    """Standard name of a category, else its tidied text; null or empty gives `missing`, or stays as it is with None."""
    normal = let(T.strip(F.lower(category)), lambda c: T.first_class(c, fixed.STANDARD_CATEGORIES, c))
    return normal if missing is None else F.when(F.coalesce(category, F.lit("")) == "", F.lit(missing)).otherwise(normal)


def conviction(statement: Column, confidence: Column) -> Column:
    """Level from the confidence or from words of certainty found anywhere in the statement."""
    s = F.lower(statement)
    strong, moderate = T.count_contained(s, fixed.STRONG_WORDS), T.count_contained(s, fixed.MODERATE_WORDS)
    return (
        F.when((confidence >= 0.9) | (strong >= 2), "very_high")
        .when((confidence >= 0.8) | (strong >= 1), "high")
        .when((confidence >= 0.7) | (moderate >= 2), "moderate")
        .when((confidence >= 0.6) | (moderate >= 1), "moderate_low")
        .otherwise("low")
    )


def _longer(words: Column, n: int) -> Column:
    return F.filter(words, lambda w: F.length(w) > n)


def model_keywords(name: Column, categories: Column, description: Column) -> Column:
    """Sorted words of name, categories and, if longer than four letters, description."""
    found = F.concat(
        T.meaningful_words(name), F.flatten(F.transform(categories, T.meaningful_words)), _longer(T.meaningful_words(description), 4)
    )
    return F.array_sort(F.array_distinct(found))


def belief_keywords(statement: Column, category: Column, evidence: Column, limit: int = 10) -> Column:
    found = F.concat(
        _longer(T.meaningful_words(statement), 3), T.meaningful_words(category),
        F.flatten(F.transform(F.slice(evidence, 1, 3), lambda e: _longer(T.meaningful_words(e), 5))),
    )
    return F.slice(F.array_sort(F.array_distinct(found)), 1, limit)


def build_documents(records: DataFrame, kind: str, *, index: str = "doc_index") -> DataFrame:
    """Search documents: content, id `tenant_type_index`, derived fields. Arrays stay arrays."""
    base = {
        "type": F.lit(kind),
        "document_id": F.concat_ws("_", F.col("persona_id"), F.lit(kind), F.col(index).cast("string")),
    }
    if kind == "mental_models":
        extra = {
            "content": model_content(),
            "steps_count": F.size("steps"),
            "categories_count": F.size("categories"),
            "complexity_score": complexity(F.col("steps"), F.col("description")),
            "primary_category": primary_category(F.col("categories")),
            "framework_type": framework_type(F.col("name"), F.col("description"), F.col("categories")),
            "search_keywords": model_keywords(F.col("name"), F.col("categories"), F.col("description")),
        }
    else:
        extra = {
            "content": belief_content(),
            "name": F.concat(F.lit("belief_"), F.left(F.md5(T.strip(F.col("statement"))), F.lit(16))),
            "evidence_count": F.size("supporting_evidence"),
            "evidence_strength": evidence_strength(F.col("supporting_evidence")),
            "belief_type": belief_type(F.col("statement"), F.col("category")),
            "semantic_category": standard_category(F.col("category")),
            "conviction_level": conviction(F.col("statement"), F.col("confidence_score")),
            "search_keywords": belief_keywords(F.col("statement"), F.col("category"), F.col("supporting_evidence")),
        }
    return records.withColumns({**base, **extra})


def delimited_metadata(records: DataFrame) -> DataFrame:
    """Arrays as delimited text, for export to stores that hold no arrays."""
    cols = {}
    for name, sep in (("steps", "\n"), ("categories", "|"), ("supporting_evidence", "\n")):
        if name in records.columns:
            cols[f"{name}_text"] = F.array_join(name, sep)
    return records.withColumns(cols)


def unique_keys(records: DataFrame, key: Column, order: Sequence[str], scope: Sequence[str] = ("persona_id",)) -> DataFrame:
    """Key with a running suffix for repeats: `x`, `x_1`, `x_2`, ...

    Numbered in two levels so that one name held by very many rows is not sorted by one task: rows are
    counted per range of (name, order), ranges are offset by a prefix sum, then numbered inside the range.
    """
    rows = ranged(records.withColumn("_key", key), [*scope, "_key"], order, SLICE)
    rows, keys = rows.withColumn("_group", F.struct(*scope, "_key")), ["_group"]  # never null, so a join keeps rows without a tenant
    sizes = rows.groupBy(*keys, "_slice").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    within = Window.partitionBy(*keys, "_slice").orderBy(*order)
    numbered = rows.withColumn("_in", F.row_number().over(within) - 1).join(offsets, [*keys, "_slice"])
    n = F.col("_in") + F.col("_before")
    out = numbered.withColumn("record_key", F.when(n == 0, F.col("_key")).otherwise(F.concat_ws("_", F.col("_key"), n.cast("string"))))
    return out.drop("_key", "_group", "_slice", "_in", "_before")


SLICE: int | None = None  # rows per range of `unique_keys`; None: those of a shuffle partition


def consolidation_key(name: Column) -> Column:
    """Letters and digits of a name, lower-cased, single-spaced."""
    return F.trim(F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}]+", " "))


def consolidate(
    candidates: DataFrame, kind: str, *, key: Column | None = None, min_frequency: int = 1, top: int | None = 100,
    scope: Sequence[str] = ("persona_id",), order: str = "doc_id",
) -> DataFrame:
    """One record per cluster: summed frequency, mean confidence, union of the list fields, best text.

    The best `top` clusters of each scope stay, all with None. List items are de-duplicated by an aggregation of their own before they are gathered, so many copies
    of a record do not pile up in one buffer.
    """
    name, lists = ("name", ["steps", "categories"]) if kind == "mental_models" else ("statement", ["supporting_evidence"])
    body = "description" if kind == "mental_models" else "category"
    rows = candidates.withColumn("_key", consolidation_key(F.col(name)) if key is None else key)
    keys = [*scope, "_key"]
    pick = F.struct((-F.col("confidence_score")).alias("c"), F.col(order).alias("o"), F.col(name).alias("name"), F.col(body).alias("body"))
    merged = rows.groupBy(*keys).agg(
        F.min(pick).alias("_best"), F.sum("frequency").alias("frequency"),
        F.round(F.avg("confidence_score"), 2).alias("confidence_score"), F.count("*").alias("members"),
    ).where(F.col("frequency") >= min_frequency)
    best = [F.desc("frequency"), F.desc("confidence_score"), F.asc("_key")]
    if top is None:
        merged = merged.withColumn("rank", F.row_number().over(Window.partitionBy(*scope).orderBy(*best)))
    else:
        merged = ranking.top_k(merged, scope, best, top)
    for field in lists:
        items = cluster_items(rows.join(merged.select(*keys), keys, "left_semi"), keys, field)
        gathered = items.groupBy(*keys).agg(F.array_sort(F.collect_list("_v")).alias(field))
        merged = merged.join(gathered, keys, "left").withColumn(field, F.coalesce(field, F.array().cast("array<string>")))
    return merged.withColumns({name: F.col("_best.name"), body: F.col("_best.body")}).drop("_best", "_key")


def cluster_items(rows: DataFrame, keys: Sequence[str], field: str) -> DataFrame:
    """Distinct list items per cluster as rows; the form to keep where a cluster has very many of them."""
    return rows.select(*keys, F.explode(field).alias("_v")).distinct()


def repeated_names(records: DataFrame, name: str = "name", scope: Sequence[str] = ("persona_id",), order: str = "doc_id", list_field: str = "steps") -> DataFrame:
    """Names seen more than once with their count, first row and whether any row lacks its list."""
    return records.groupBy(*scope, name).agg(
        F.count("*").alias("copies"), F.min(order).alias("first_id"), F.count_if(F.size(list_field) == 0).alias("without_list")
    ).where((F.col("copies") > 1) | (F.col("without_list") > 0))


def record_statistics(models: DataFrame, beliefs: DataFrame, scope: Sequence[str] = ("persona_id",)) -> DataFrame:
    """Counts, mean confidence, category sets and mean list sizes of both kinds per scope."""
    s = list(scope)
    cats = models.select(*s, F.explode("categories").alias("c")).distinct().groupBy(*s).agg(F.array_sort(F.collect_list("c")).alias("model_categories"))
    m = models.groupBy(*s).agg(F.count("*").alias("models"), F.avg("confidence_score").alias("model_confidence"), F.avg(F.size("steps")).alias("avg_steps"))
    bcats = beliefs.select(*s, F.col("category").alias("c")).distinct().groupBy(*s).agg(F.array_sort(F.collect_list("c")).alias("belief_categories"))
    b = beliefs.groupBy(*s).agg(F.count("*").alias("beliefs"), F.avg("confidence_score").alias("belief_confidence"), F.avg(F.size("supporting_evidence")).alias("avg_evidence"))
    return m.join(cats, s, "left").join(b, s, "full_outer").join(bcats, s, "left")
