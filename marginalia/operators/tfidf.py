"""TF-IDF weights and cosine search."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.arrays import let, posexplode_rows
from ..session import broadcast_if_small, cut_lineage
from . import ranking, tfidf_numbers


def ngrams(tokens: Column, low: int, high: int) -> Column:
    """All runs of `low` to `high` neighbouring tokens, joined by blanks."""

    def joined(ts: Column, n: int):
        return lambda i: F.array_join(F.slice(ts, i, F.lit(n)), " ")

    def of(ts: Column) -> Column:
        parts = []
        for n in range(low, high + 1):
            if n == 1:
                parts.append(ts)
                continue
            count = F.size(ts) - (n - 1)
            starts = F.when(count > 0, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>"))
            parts.append(F.transform(starts, joined(ts, n)))
        return F.concat(*parts)

    return let(tokens, of)


def term_counts(docs: DataFrame, id_col: str, terms: Column, vocab: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """(scope, id, term, tf, idf) for terms of the vocabulary; others are dropped before the shuffle."""
    rows = posexplode_rows(docs, [*scope, id_col], terms, "_pos", "term").drop("_pos")
    return rows.join(vocab, [*scope, "term"]).groupBy(*scope, id_col, "term", "idf").agg(F.count("*").alias("tf"))


def vocabulary(
    docs: DataFrame, terms: Column, max_terms: int, min_df: int = 1, max_df: float = 1.0, scope: Sequence[str] = (),
) -> DataFrame:
    """The `max_terms` most frequent terms per scope with their smooth idf.

    Each document's terms are sorted in its row and the first of equal ones is flagged, so document and
    total counts come from one aggregation whose map side shrinks to the vocabulary.
    """
    scope = list(scope)
    n_table = docs.groupBy(*scope).agg(F.count("*").alias("n_docs"))
    flagged = let(F.sort_array(terms), lambda ts: F.transform(ts, lambda t, i: F.struct(
        t.alias("term"), F.when(i == 0, F.lit(1)).otherwise((t != F.get(ts, i - 1)).cast("int")).alias("first"))))
    rows = posexplode_rows(docs, scope, flagged, "_pos", "_t").select(*scope, "_t.term", "_t.first")
    found = rows.groupBy(*scope, "term").agg(F.sum("first").alias("df"), F.count("*").alias("total"))
    return most_frequent(allowed_terms(found, n_table, min_df, max_df, scope), max_terms, scope)


def allowed_terms(found: DataFrame, n_table: DataFrame, min_df: int, max_df: float, scope: Sequence[str] = ()) -> DataFrame:
    """Counted terms (scope, term, df, total) with n_docs, where the document count is within the bounds."""
    scope = list(scope)
    if scope:
        found = found.join(n_table, scope)
    else:
        found = found.withColumn("n_docs", n_table.select("n_docs").scalar())
    return found.where((F.col("df") >= F.least(F.lit(min_df), F.col("n_docs"))) & (F.col("df") <= F.col("n_docs") * max_df))


def most_frequent(found: DataFrame, max_terms: int, scope: Sequence[str] = ()) -> DataFrame:
    """(scope, term, idf) of the `max_terms` allowed terms with the largest totals."""
    scope, order = list(scope), [F.desc("total"), F.asc("term")]
    if scope:
        found = ranking.top_k(found, scope, order, max_terms, "_rank").drop("_rank")
    else:
        found = found.orderBy(*order).limit(max_terms)
    return found.select(*scope, "term", (F.log((1 + F.col("n_docs")) / (1 + F.col("df"))) + 1).alias("idf"))


def weights(counts: DataFrame, id_col: str, scope: Sequence[str] = ()) -> DataFrame:
    """L2-normalised weights; a document has at most as many rows as the vocabulary."""
    rows = counts.withColumn("w", F.col("tf") * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(*scope, id_col)))
    return rows.select(*scope, id_col, "term", (F.col("w") / norm).alias("weight"))


def search(
    docs: DataFrame, queries: DataFrame, k: int = 5, *, id_col: str = "chunk_id", text: str = "content",
    max_terms: int = 5000, stop_words: Sequence[str] = (), threshold: float = 0.1, fallback: float = 0.05,
) -> DataFrame:
    """Cosine of TF-IDF vectors over 1- and 2-grams.

    Of the best 2k those with score >= `threshold` stay; if there is none, of the best k those with
    score >= `fallback`. At most k are returned. An id names one document.

    Texts are counted and scored by number in the tasks (`tfidf_numbers`); where the frequent words, their pairs or the
    queries' terms are too many to be sent there, terms are rows and joined.
    """

    def tokens(c: Column) -> Column:
        toks = T.search_tokens(c)
        return F.filter(toks, lambda t: ~t.isin(list(stop_words))) if stop_words else toks

    terms = ngrams(tokens(F.col(text)), 1, 2)
    rows, words, found = tfidf_numbers.count_terms(docs, id_col, tokens(F.col(text)), max_terms) or (None, None, None)
    vocab = most_frequent(found, max_terms) if found is not None else vocabulary(docs.select(text), terms, max_terms)
    vocab = F.broadcast(cut_lineage(vocab))  # at most max_terms rows
    query_w = cut_lineage(weights(term_counts(queries, "query_id", ngrams(tokens(F.col("query")), 1, 2), vocab), "query_id"))
    if found is not None and broadcast_if_small(query_w) is not query_w:
        sims = tfidf_numbers.best_documents(rows, id_col, words, vocab, query_w, 2 * k, min(threshold, fallback))
    else:
        doc_w = weights(term_counts(docs.select(id_col, text), id_col, terms, vocab), id_col)
        sims = (
            doc_w.withColumnRenamed("weight", "dw").join(query_w, "term")
            .groupBy("query_id", id_col).agg(ranking.rounded(F.sum(F.col("dw") * F.col("weight"))).alias("score"))
        )
    top = ranking.best(sims, ["query_id"], 2 * k, id_col)
    strong = F.count_if(F.col("score") >= threshold).over(Window.partitionBy("query_id"))
    keep = F.when(F.col("_strong") > 0, F.col("score") >= threshold).otherwise(F.col("score") >= fallback)
    return top.withColumn("_strong", strong).where(keep & (F.col("rank") <= k)).drop("_strong")


def excerpt_context(
    queries: DataFrame, hits: DataFrame, content: str = "content",
    empty: str = "No relevant context found in the knowledge base.", keys: Sequence[str] = ("query_id",),
) -> DataFrame:
    """One text per query: `EXCERPT i:` blocks in rank order. A query has at most k hits; `keys` name it, with its tenant if any."""
    blocks = F.transform(
        F.array_sort(F.collect_list(F.struct("rank", T.strip(F.col(content)).alias("text")))),
        lambda x, i: F.concat(F.lit("EXCERPT "), (i + 1).cast("string"), F.lit(":\n"), x["text"]),
    )
    context = hits.groupBy(*keys).agg(F.array_join(blocks, "\n\n").alias("context"))
    return queries.select(*keys).join(context, list(keys), "left").withColumn(
        "context", F.coalesce("context", F.lit(empty))
    )
