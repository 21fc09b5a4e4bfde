"""Extraction flow: batch the documents, call a model per batch, parse, consolidate, assemble one record per tenant."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import replies
from ..functions.keys import row_hash
from ..operators import assembly, knowledge, quality, telemetry
from ..operators.models import generate
from ..session import cut_lineage

MODEL_FIELDS = ["name", "description", "steps", "categories", "confidence_score", "frequency"]
BELIEF_FIELDS = ["statement", "category", "supporting_evidence", "confidence_score", "frequency"]
PROMPT = "Return JSON with the key {kind}, holding what these documents teach.\n\n"


def extraction_batches(
    docs: DataFrame, kind: str, *, scope: Sequence[str] = ("persona_id",), order: Sequence[str] = ("doc_id",),
    id_col: str = "doc_id", max_items: int = 10, max_tokens: int = 100_000,
) -> DataFrame:
    """(scope, batch_start, content_hash, documents, prompt). A batch holds at most `max_items` documents."""
    scope = list(scope)
    placed = assembly.greedy_batches(docs, scope, order, id_col=id_col, max_items=max_items, max_tokens=max_tokens)
    rows = placed.join(docs.select(*scope, *dict.fromkeys([id_col, *order]), "source", "content"), [*scope, id_col])
    item = F.struct(*order, row_hash(F.col("source"), F.col("content"), kind).alias("h"), F.col("content").alias("t"))
    packed = rows.groupBy(*scope, "batch_start").agg(F.array_sort(F.collect_list(item)).alias("_d"))
    return packed.select(
        *scope, "batch_start", F.size("_d").alias("documents"),
        F.sha2(F.array_join(F.transform("_d", lambda d: d["h"]), ""), 256).alias("content_hash"),
        F.concat(F.lit(PROMPT.replace("{kind}", kind)), F.array_join(F.transform("_d", lambda d: d["t"]), "\n\n")).alias("prompt"),
    )


def extract(
    batches: DataFrame, kind: str, load: Callable, *, scope: Sequence[str] = ("persona_id",),
    results: DataFrame | None = None, settings_hash: str = "", now: Column | None = None, max_age_hours: float | None = None,
) -> DataFrame:
    """Reply per batch: (scope, batch_start, content_hash, reply, error, cached). Known batches are not sent again."""
    keep = [*scope, "batch_start", "content_hash"]
    work = batches.withColumns({"kind": F.lit(kind), "settings_hash": F.lit(settings_hash)})
    if results is None:
        return generate(work, "prompt", load, keep=keep).withColumn("cached", F.lit(False))
    known, todo = telemetry.reuse(work, results, now if now is not None else F.current_timestamp(), max_age_hours)
    called = generate(todo, "prompt", load, keep=keep).withColumn("cached", F.lit(False))
    reused = known.select(*keep, F.col("payload").alias("reply"), F.lit(None).cast("string").alias("error"), F.lit(True).alias("cached"))
    return called.unionByName(reused)


def candidates(replied: DataFrame, kind: str, *, min_confidence: float | None = None, scope: Sequence[str] = ("persona_id",)) -> tuple[DataFrame, DataFrame]:
    """(records, rejects) from the replies of all batches; failed batches give no record."""
    parsed = replied.where(F.col("reply").isNotNull()).select(*scope, "batch_start", replies.extract_json(F.col("reply"))["json"].alias("json"))
    good, bad = knowledge.split_valid(knowledge.process_items(knowledge.explode_artifacts(parsed, kind), kind))
    floor = {"mental_models": 0.7, "core_beliefs": 0.6}[kind] if min_confidence is None else min_confidence
    return good.where(F.col("confidence_score") >= floor), bad


def quarantine(replied: DataFrame, scope: Sequence[str] = ("persona_id",)) -> DataFrame:
    """Batches whose call failed or whose reply holds no JSON."""
    method = replies.extract_json(F.col("reply"))["method"]
    reason = F.coalesce("error", F.when(method == "failed", F.lit("no JSON in reply")))
    return replied.withColumn("reason", reason).where(F.col("reason").isNotNull()).select(*scope, "batch_start", "reason")


DEFAULT_TONE = "Analysis failed - using default"


def style_records(texts: DataFrame, load: Callable, scope: Sequence[str] = ("persona_id",)) -> DataFrame:
    """Style per tenant from its sampled text; a failed call gives the default record."""
    out = generate(texts.withColumn("_prompt", F.concat(F.lit("Return JSON describing the style of:\n\n"), "text")), "_prompt", load, keep=list(scope))
    v = F.try_parse_json(replies.extract_json(F.col("reply"))["json"])
    text = lambda p: F.try_variant_get(v, f"$.{p}", "string")
    items = lambda p: F.coalesce(F.try_variant_get(v, f"$.{p}", "array<string>"), F.array().cast("array<string>"))
    raw = {f: text(f"communication_style.{f}") for f in replies.fixed.STYLE_DEFAULTS}
    style = F.struct(
        F.coalesce(text("tone"), F.lit(DEFAULT_TONE)).alias("tone"), items("catchphrases").alias("catchphrases"),
        items("vocabulary").alias("vocabulary"), items("sentence_structures").alias("sentence_structures"),
        replies.communication_style(raw).alias("communication_style"),
    )
    return out.select(*scope, style.alias("style"))


def assemble_personas(models: DataFrame, beliefs: DataFrame, style: DataFrame, totals: DataFrame, *, order: str = "rank") -> DataFrame:
    """One nested row per tenant, arrays sorted by confidence.

    Records are expected consolidated (at most `top` per tenant), so the arrays are small.
    """

    def gathered(rows: DataFrame, fields: list[str], out: str) -> DataFrame:
        item = F.struct((-F.col("confidence_score")).alias("_c"), F.col(order).alias("_o"), F.struct(*fields).alias("x"))
        lists = rows.groupBy("persona_id").agg(F.array_sort(F.collect_list(item)).alias("_l"))
        return lists.select("persona_id", F.transform("_l", lambda s: s["x"]).alias(out))

    m = gathered(models, MODEL_FIELDS, "mental_models")
    b = gathered(beliefs, BELIEF_FIELDS, "core_beliefs")
    out = totals.join(style, "persona_id", "left").join(m, "persona_id", "left").join(b, "persona_id", "left")
    none = {c: F.array().cast(dict(out.dtypes)[c]) for c in ("mental_models", "core_beliefs")}
    return out.withColumns({c: F.coalesce(c, empty) for c, empty in none.items()})


@dataclass
class Built:
    """Records of all tenants, and what did not become part of them."""

    personas: DataFrame
    rejects: DataFrame  # (persona_id, kind, batch_start, index, error)
    failed: DataFrame  # (persona_id, kind, batch_start, reason)


def build(
    docs: DataFrame, totals: DataFrame, load_models: dict[str, Callable], *, hashes: DataFrame, top: int | None = 100,
    min_frequency: int = 1, consolidate: bool = True, results: DataFrame | None = None, order: str = "doc_id",
) -> Built:
    """Statistics, style, records and scores in one nested row per tenant, with rejects and failed batches.

    `load_models` has loaders for style, mental_models and core_beliefs; `totals` holds the corpus report. Every model
    is called once per batch: replies are kept before anything reads them. `top` of None keeps all records.
    """
    records, rejects, failed = {}, [], []
    for kind in ("mental_models", "core_beliefs"):
        batches = extraction_batches(docs, kind, order=[order])
        replied = cut_lineage(extract(batches, kind, load_models[kind], results=results))
        good, bad = candidates(replied, kind)
        rejects.append(bad.select("persona_id", F.lit(kind).alias("kind"), "batch_start", "index", "error"))
        failed.append(quarantine(replied).withColumn("kind", F.lit(kind)).select("persona_id", "kind", "batch_start", "reason"))
        good = good.withColumn("_order", F.struct("batch_start", "index"))
        if consolidate:
            good = knowledge.consolidate(good, kind, min_frequency=min_frequency, top=top, order="_order")
        else:
            good = good.withColumn("rank", F.col("_order"))
        records[kind] = good
    style = cut_lineage(style_records(assembly.sampled_text(docs, hashes, ["persona_id"], order), load_models["style"]))
    people = assemble_personas(records["mental_models"], records["core_beliefs"], style, totals)
    return Built(quality.quality_scores(quality.fix_personas(people)), rejects[0].unionByName(rejects[1]), failed[0].unionByName(failed[1]))


def build_personas(docs: DataFrame, totals: DataFrame, load_models: dict[str, Callable], **kw) -> DataFrame:
    """The records alone; see `build`."""
    return build(docs, totals, load_models, **kw).personas
