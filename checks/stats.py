"""Registered queries: aggregations and text statistics."""

from pyspark.sql import functions as F

from marginalia.functions import fixed
from marginalia.functions import text as T
from marginalia.operators import chunking as C
from marginalia.operators import corpus_stats as A
from marginalia.operators import linguistics as L

from .base import (
    SQL_CORPUS, SQL_MODELS, beliefs, corpus, models, sql_alpha, sql_chunks, sql_list,
    sql_sentences, sql_strip, sql_words, table,
)
from .chunks import SQL_BOOKS, books, chunks

CHECKS = {}
STOP = sql_list(fixed.STOP_WORDS)


def r6(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


def counted(spark, sf):
    return corpus(spark, sf).withColumns({"word_count": T.count_words(F.col("content"), F.col("language")), "char_count": F.length("content")})


SQL_COUNTED = f"{SQL_CORPUS}, counted AS (SELECT *, len({sql_words('content')}) AS w, length(content) AS c FROM corpus)"
CHECKS["agg_01_corpus_stats"] = (
    lambda spark, sf: r6(A.corpus_totals(counted(spark, sf)), "avg_words", "avg_chars"),
    f"""WITH {SQL_COUNTED} SELECT count(*) AS documents, sum(w)::BIGINT AS total_words, sum(c)::BIGINT AS total_chars, round(avg(w), 6) AS avg_words, round(avg(c), 6) AS avg_chars,
    max(w) AS max_words, min(w) AS min_words, (SELECT source FROM counted ORDER BY w DESC, source LIMIT 1) AS largest, (SELECT source FROM counted ORDER BY w, source LIMIT 1) AS smallest FROM counted""",
)
CHECKS["agg_01_extensions"] = (
    lambda spark, sf: A.extension_counts(corpus(spark, sf).withColumn("source", F.when(F.col("language") == "en", F.col("source")).otherwise(F.regexp_replace("source", "txt$", "MD")))),
    "SELECT CASE WHEN lang = 'en' THEN '.txt' ELSE '.md' END AS extension, count(*) AS documents FROM documents GROUP BY 1",
)
CHECKS["agg_02_document_summary"] = (
    lambda spark, sf: r6(A.corpus_totals(counted(spark, sf), ["persona_id"]), "avg_words").select("persona_id", "documents", "total_words", "avg_words", "max_words", "min_words"),
    f"WITH {SQL_COUNTED} SELECT persona_id, count(*) AS documents, sum(w)::BIGINT AS total_words, round(avg(w), 6) AS avg_words, max(w) AS max_words, min(w) AS min_words FROM counted GROUP BY 1",
)
CHECKS["agg_03_chunk_stats"] = (
    lambda spark, sf: r6(A.chunk_totals(chunks(spark, sf), ["persona_id"]), "avg_words", "avg_chars"),
    f"""WITH {SQL_CORPUS}, {sql_chunks(100, 20)} SELECT persona_id, count(*) AS chunks, sum(word_count)::BIGINT AS total_words, round(avg(word_count), 6) AS avg_words, max(word_count) AS max_words,
    min(word_count) AS min_words, round(avg(length(content)), 6) AS avg_chars, count(DISTINCT parent_source) AS parents FROM chunks GROUP BY 1""",
)
_WORDS = rf"{SQL_CORPUS}, ws AS (SELECT persona_id, doc_id, unnest({sql_alpha('lower(content)')}) AS word FROM corpus), wc AS (SELECT persona_id, word, count(*) AS n FROM ws GROUP BY ALL)"
_KW_TOK = rf"list_filter(regexp_extract_all(lower(content), '[\p{{L}}\p{{N}}_]+'), lambda w: regexp_full_match(w, '[a-z][a-z0-9]*') AND w NOT IN {STOP})"
_KW = rf"""{SQL_CORPUS}, kd AS (SELECT persona_id, doc_id, {_KW_TOK} AS t FROM corpus WHERE {sql_strip('content')} <> ''),
  kg AS (SELECT persona_id, doc_id, unnest(list_concat(list_concat(t, list_transform(generate_series(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1])),
     list_transform(generate_series(1, len(t) - 2), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2]))) AS term FROM kd),
  kc AS (SELECT persona_id, doc_id, term, count(*) AS tf FROM kg GROUP BY ALL), kn AS (SELECT persona_id, count(*) AS n FROM kd GROUP BY 1),
  kv AS (SELECT * FROM (SELECT persona_id, term, ln((1 + n) / (1 + count(*)::DOUBLE)) + 1 AS idf, row_number() OVER (PARTITION BY persona_id ORDER BY sum(tf) DESC, term) AS rn
     FROM kc JOIN kn USING (persona_id) GROUP BY persona_id, term, n HAVING count(*) >= least(2, n) AND count(*) <= 0.95::DOUBLE * n) WHERE rn <= 1000),
  kw AS (SELECT persona_id, doc_id, term, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY persona_id, doc_id)) AS w FROM kc JOIN kv USING (persona_id, term)),
  km AS (SELECT persona_id, term, round(sum(w) / n, 6) AS mean FROM kw JOIN kn USING (persona_id) GROUP BY persona_id, term, n),
  keywords AS (SELECT persona_id, term, floor(mean * 1000)::BIGINT AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY persona_id ORDER BY mean DESC, term) AS rank FROM km) WHERE rank <= 100)"""
CHECKS["agg_06_keywords"] = (
    lambda spark, sf: L.keywords(corpus(spark, sf)),
    f"WITH {_KW} SELECT * FROM keywords",
)


def dictionary(spark, sf):
    """Dictionary made of the benchmark's words, labelled by their length."""
    words = table(spark, sf, "benchmark").select(F.explode(T.alpha_words(F.lower("text"))).alias("entity")).distinct()
    return words.withColumn("label", F.element_at(F.array(F.lit("PERSON"), F.lit("DATE"), F.lit("ORG")), (F.length("entity") % 3 + 1).cast("int")))


_ENT = f"""{_WORDS}, dict AS (SELECT DISTINCT w AS word, ['PERSON', 'DATE', 'ORG'][length(w) % 3 + 1] AS label FROM (SELECT unnest({sql_alpha('lower(text)')}) AS w FROM benchmark)),
  entities AS (SELECT persona_id, entity, mentions, rank FROM (SELECT persona_id, word || ' (' || label || ')' AS entity, n AS mentions, row_number() OVER (PARTITION BY persona_id ORDER BY n DESC, word || ' (' || label || ')') AS rank
    FROM wc JOIN dict USING (word) WHERE label <> 'DATE' AND length(word) > 2) WHERE rank <= 50)"""
CHECKS["agg_07_entities"] = (
    lambda spark, sf: L.entity_counts(L.dictionary_entities(corpus(spark, sf), dictionary(spark, sf))),
    f"WITH {_ENT} SELECT * FROM entities",
)


def names(spark, sf):
    """Runs of one to four words of the benchmark, labelled by their number of words."""
    w = table(spark, sf, "benchmark").select(T.alpha_words(F.lower("text")).alias("w")).where(F.size("w") > 3)
    starts = F.sequence(F.lit(1), F.size("w") - 3)
    runs = F.flatten(F.transform(starts, lambda i: F.transform(F.sequence(F.lit(1), F.lit(4)), lambda n: F.array_join(F.slice("w", i, n), " "))))
    rows = w.select(F.explode(runs).alias("entity")).distinct()
    return rows.withColumn("label", F.element_at(F.array(F.lit("PERSON"), F.lit("ORG"), F.lit("DATE"), F.lit("WORK")), F.size(F.split("entity", " "))))


CHECKS["agg_07_names_of_several_words"] = (
    lambda spark, sf: L.top_names(L.name_counts(corpus(spark, sf), names(spark, sf))),
    rf"""WITH {SQL_CORPUS}, bw AS (SELECT {sql_alpha('lower(text)')} AS w FROM benchmark),
  dict AS (SELECT DISTINCT array_to_string(w[i:i + n - 1], ' ') AS entity, n, ['PERSON', 'ORG', 'DATE', 'WORK'][n] AS label
    FROM (SELECT w, unnest(generate_series(1, len(w) - 3)) AS i FROM bw), (SELECT unnest([1, 2, 3, 4]) AS n)),
  dw AS (SELECT doc_id, persona_id, unnest(w) AS w1, generate_subscripts(w, 1) AS i FROM (SELECT doc_id, persona_id, {sql_alpha('lower(content)')} AS w FROM corpus)),
  pos AS (SELECT *, lead(w1, 1) OVER o AS w2, lead(w1, 2) OVER o AS w3, lead(w1, 3) OVER o AS w4 FROM dw WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
  runs AS (SELECT doc_id, persona_id, i, unnest([w1, w1 || ' ' || w2, w1 || ' ' || w2 || ' ' || w3, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4]) AS entity FROM pos),
  hits AS (SELECT doc_id, any_value(persona_id) AS persona_id, i, max(n) AS n, arg_max(entity, n) AS entity, arg_max(label, n) AS label FROM runs JOIN dict USING (entity) GROUP BY doc_id, i),
  walks AS (SELECT doc_id, list_reduce(list({{'free': i + n, 'i': i, 'kept': [i]}} ORDER BY i),
    lambda x, y: CASE WHEN y.i >= x.free THEN {{'free': y.free, 'i': y.i, 'kept': list_concat(x.kept, y.kept)}} ELSE x END).kept AS kept FROM hits GROUP BY doc_id),
  counted AS (SELECT persona_id, entity || ' (' || label || ')' AS entity, count(*) AS mentions FROM (SELECT doc_id, unnest(kept) AS i FROM walks) JOIN hits USING (doc_id, i)
    WHERE label <> 'DATE' AND length(entity) > 2 GROUP BY ALL)
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY persona_id ORDER BY mentions DESC, entity) AS rank FROM counted) WHERE rank <= 50""",
)
_CELL = "coalesce(({o} - {e}) * ({o} - {e}) / nullif({e}, 0), 0)"


def _cells():
    n, na, nb, nc, t = "n", "n_a", "n_b", "n_c", "n_all"
    ab, ac, bc = "(n_ab - n)", "(n_ac - n)", "(n_bc - n)"
    a, b, c = f"(n_a - n - {ab} - {ac})", f"(n_b - n - {ab} - {bc})", f"(n_c - n - {ac} - {bc})"
    rest = f"(n_all - n - {ab} - {ac} - {bc} - {a} - {b} - {c})"
    nota, notb, notc = f"({t} - {na})", f"({t} - {nb})", f"({t} - {nc})"
    rows = [(n, na, nb, nc), (ab, na, nb, notc), (ac, na, notb, nc), (bc, nota, nb, nc), (a, na, notb, notc), (b, nota, nb, notc), (c, nota, notb, nc), (rest, nota, notb, notc)]
    return " + ".join(_CELL.format(o=o, e=f"({x}::DOUBLE * {y} * {z} / ({t}::DOUBLE * {t}))") for o, x, y, z in rows)


_COL = rf"""{SQL_CORPUS}, cw AS (SELECT persona_id, list_filter({sql_alpha('lower(content)')}, lambda w: length(w) > 2 AND w NOT IN {STOP}) AS t FROM corpus),
  s1 AS (SELECT persona_id, w, count(*) AS n FROM (SELECT persona_id, unnest(t) AS w FROM cw) GROUP BY ALL), tot AS (SELECT persona_id, sum(n)::BIGINT AS n_all FROM s1 GROUP BY 1),
  p1 AS (SELECT persona_id, g['a'] AS a, g['b'] AS b FROM (SELECT persona_id, unnest(list_transform(generate_series(1, len(t) - 1), lambda i: {{'a': t[i], 'b': t[i + 1]}})) AS g FROM cw)),
  p2 AS (SELECT persona_id, g['a'] AS a, g['b'] AS b FROM (SELECT persona_id, unnest(list_transform(generate_series(1, len(t) - 2), lambda i: {{'a': t[i], 'b': t[i + 2]}})) AS g FROM cw)),
  near AS (SELECT persona_id, a, b, count(*) AS n FROM p1 GROUP BY ALL), far AS (SELECT persona_id, a, b, count(*) AS n FROM p2 GROUP BY ALL),
  pr AS (SELECT persona_id, a, b, count(*) AS n FROM (SELECT * FROM p1 UNION ALL SELECT * FROM p2) GROUP BY ALL HAVING count(*) >= 3),
  px AS (SELECT pr.persona_id, a || ' ' || b AS ngram, pr.n AS frequency, pr.n / 2.0::DOUBLE AS ii, sa.n - pr.n / 2.0::DOUBLE AS io, sb.n - pr.n / 2.0::DOUBLE AS oi, n_all FROM pr
     JOIN s1 sa ON sa.persona_id = pr.persona_id AND sa.w = a JOIN s1 sb ON sb.persona_id = pr.persona_id AND sb.w = b JOIN tot ON tot.persona_id = pr.persona_id),
  pc AS (SELECT persona_id, ngram, 'bigram' AS kind, frequency, round(n_all * pow(ii * (n_all - ii - io - oi) - io * oi, 2) / ((ii + io) * (ii + oi) * (io + (n_all - ii - io - oi)) * (oi + (n_all - ii - io - oi))), 6) AS raw FROM px),
  t3 AS (SELECT persona_id, g['a'] AS a, g['b'] AS b, g['c'] AS c, count(*) AS n FROM (SELECT persona_id, unnest(list_transform(generate_series(1, len(t) - 2), lambda i: {{'a': t[i], 'b': t[i + 1], 'c': t[i + 2]}})) AS g FROM cw) GROUP BY ALL HAVING count(*) >= 3),
  tx AS (SELECT t3.persona_id, t3.a || ' ' || t3.b || ' ' || t3.c AS ngram, t3.n, x.n AS n_ab, y.n AS n_bc, z.n AS n_ac, sa.n AS n_a, sb.n AS n_b, sc.n AS n_c, n_all FROM t3
     JOIN near x ON x.persona_id = t3.persona_id AND x.a = t3.a AND x.b = t3.b JOIN near y ON y.persona_id = t3.persona_id AND y.a = t3.b AND y.b = t3.c
     JOIN far z ON z.persona_id = t3.persona_id AND z.a = t3.a AND z.b = t3.c
     JOIN s1 sa ON sa.persona_id = t3.persona_id AND sa.w = t3.a JOIN s1 sb ON sb.persona_id = t3.persona_id AND sb.w = t3.b JOIN s1 sc ON sc.persona_id = t3.persona_id AND sc.w = t3.c
     JOIN tot ON tot.persona_id = t3.persona_id),
  tc AS (SELECT persona_id, ngram, 'trigram' AS kind, n AS frequency, round({_cells()}, 6) AS raw FROM tx),
  u AS (SELECT *, row_number() OVER (PARTITION BY persona_id, kind ORDER BY raw DESC, ngram) AS rn FROM (SELECT * FROM pc UNION ALL SELECT * FROM tc)),
  collocations AS (SELECT persona_id, ngram, kind, frequency, score, rank FROM (SELECT *, round(raw, 2) AS score, row_number() OVER (PARTITION BY persona_id ORDER BY round(raw, 2) DESC, ngram) AS rank
    FROM u WHERE rn <= CASE kind WHEN 'bigram' THEN 25 ELSE 20 END AND raw >= 5.0) WHERE rank <= 50)"""
CHECKS["agg_08_collocations"] = (
    lambda spark, sf: L.collocations(corpus(spark, sf)),
    f"WITH {_COL} SELECT * FROM collocations",
)
_SYL = "greatest(1, len(regexp_extract_all(w, '[aeiouy]+')) - CASE WHEN ends_with(w, 'e') AND len(regexp_extract_all(w, '[aeiouy]+')) > 1 THEN 1 ELSE 0 END)"
_READ = rf"""{SQL_CORPUS}, rd AS (SELECT persona_id, len({sql_sentences('content')}) AS s, {sql_alpha('lower(content)')} AS ws FROM corpus),
  rt AS (SELECT persona_id, sum(s)::BIGINT AS s, sum(len(ws))::BIGINT AS w, sum(list_sum(list_transform(ws, lambda w: length(w))))::BIGINT AS c, sum(list_sum(list_transform(ws, lambda w: {_SYL})))::BIGINT AS y FROM rd GROUP BY 1),
  readability AS (SELECT persona_id, s AS total_sentences, w AS total_words, y AS total_syllables, round(w / s, 2) AS avg_sentence_length, round(c / w, 2) AS avg_word_length, round(y / w, 2) AS avg_syllables_per_word,
    round(greatest(0, least(100, 206.835::DOUBLE - 1.015::DOUBLE * w / s - 84.6::DOUBLE * y / w)), 2) AS flesch_reading_ease, round(greatest(0, 0.39::DOUBLE * w / s + 11.8::DOUBLE * y / w - 15.59::DOUBLE), 2) AS flesch_kincaid_grade FROM rt)"""
CHECKS["agg_09_readability"] = (
    lambda spark, sf: L.readability(corpus(spark, sf)),
    f"WITH {_READ} SELECT * FROM readability",
)
_SP = rf"""{SQL_CORPUS}, sx AS (SELECT persona_id, unnest({sql_sentences('content')}) AS s FROM corpus), sl AS (SELECT persona_id, s, len({sql_words('s')}) AS l FROM sx),
  patterns AS (SELECT persona_id, count(*) AS sentences, round(avg(ends_with(s, '?')::INT), 6) AS question_ratio, round(avg(ends_with(s, '!')::INT), 6) AS exclamation_ratio, min(l) AS min_len, max(l) AS max_len,
    round(avg(l), 6) AS avg_len, list_sort(list(l))[len(list(l)) // 2 + 1] AS median_len FROM sl GROUP BY 1)"""
CHECKS["agg_10_sentence_patterns"] = (
    lambda spark, sf: r6(L.sentence_patterns(corpus(spark, sf)), "question_ratio", "exclamation_ratio", "avg_len"),
    f"WITH {_SP} SELECT * FROM patterns",
)
CHECKS["agg_10_punctuation"] = (
    lambda spark, sf: L.punctuation_counts(corpus(spark, sf)),
    "SELECT source AS persona_id, " + ", ".join(f"sum(length(text) - length(replace(text, '{m}', '')))::BIGINT AS {n}" for m, n in
    {".": "period", ",": "comma", "!": "exclamation", "?": "question", ";": "semicolon", ":": "colon"}.items()) + " FROM documents GROUP BY 1",
)
CHECKS["agg_10_top_words"] = (
    lambda spark, sf: L.top_words(L.word_counts(corpus(spark, sf))),
    f"WITH {_WORDS} SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY persona_id ORDER BY n DESC, word) AS rank FROM wc) WHERE rank <= 20",
)
CHECKS["agg_10_richness"] = (
    lambda spark, sf: r6(L.richness(L.word_counts(corpus(spark, sf))), "vocabulary_richness"),
    f"WITH {_WORDS} SELECT persona_id, round(count(*) / sum(n), 6) AS vocabulary_richness FROM wc GROUP BY 1",
)
CHECKS["agg_10_tag_shares"] = (
    lambda spark, sf: r6(L.tag_shares(corpus(spark, sf).withColumn("tags", F.transform(L.lower_words(F.col("content")), lambda w: F.right(w, F.lit(1)))), "tags"), "share"),
    f"""WITH {_WORDS}, t AS (SELECT persona_id, right(word, 1) AS tag, sum(n) AS n FROM wc GROUP BY ALL)
    SELECT persona_id, tag, rank, share FROM (SELECT persona_id, tag, round(n / sum(n) OVER (PARTITION BY persona_id), 6) AS share, row_number() OVER (PARTITION BY persona_id ORDER BY n DESC, tag) AS rank FROM t) WHERE rank <= 10""",
)
_POS, _NEG = ["the", "de", "der", "que", "good"], ["of", "la", "und", "el", "bad"]
CHECKS["agg_11_sentiment"] = (
    lambda spark, sf: r6(L.sentiment(corpus(spark, sf), positive=_POS, negative=_NEG), "overall_sentiment", "positive_ratio", "negative_ratio"),
    f"""WITH {_WORDS}, s AS (SELECT persona_id, sum(n)::BIGINT AS w, coalesce(sum(n) FILTER (word IN {sql_list(_POS)}), 0)::BIGINT AS p, coalesce(sum(n) FILTER (word IN {sql_list(_NEG)}), 0)::BIGINT AS q FROM wc GROUP BY 1)
    SELECT persona_id, w AS total_words, p AS positive, q AS negative, round(coalesce((p - q) / nullif(p + q, 0), 0), 6) AS overall_sentiment, round(p / w, 6) AS positive_ratio, round(q / w, 6) AS negative_ratio FROM s""",
)
_TONES = [*fixed.POSITIVE_WORDS, *fixed.NEGATIVE_WORDS]


def _toned(spark, sf):
    """Each document ends with one word of the default lists."""
    word = F.element_at(F.array(*[F.lit(w) for w in _TONES]), (F.col("doc_id") % len(_TONES) + 1).cast("int"))
    return corpus(spark, sf).withColumn("content", F.concat_ws(" ", "content", word))


CHECKS["agg_11_sentiment_default_lists"] = (
    lambda spark, sf: r6(L.sentiment(_toned(spark, sf)), "overall_sentiment", "positive_ratio", "negative_ratio"),
    CHECKS["agg_11_sentiment"][1].replace(sql_list(_POS), sql_list(fixed.POSITIVE_WORDS)).replace(sql_list(_NEG), sql_list(fixed.NEGATIVE_WORDS)).replace("FROM corpus", "FROM toned").replace(
        SQL_CORPUS + ",", SQL_CORPUS + f", toned AS (SELECT * REPLACE (content || ' ' || {list(_TONES)}[doc_id % {len(_TONES)} + 1] AS content) FROM corpus),"),
)
_SIG = rf"""{SQL_CORPUS}, se AS (SELECT persona_id, regexp_extract_all(lower(s), '[\p{{L}}\p{{N}}_]+') AS t FROM (SELECT persona_id, unnest({sql_sentences('content')}) AS s FROM corpus)),
  gr AS (SELECT persona_id, unnest(flatten(list_transform(generate_series(3, 8), lambda n: list_transform(generate_series(1, len(t) - n + 1), lambda i: t[i:i + n - 1])))) AS g FROM se),
  ph AS (SELECT persona_id, array_to_string(g, ' ') AS phrase FROM gr WHERE len(list_filter(g, lambda w: w NOT IN {STOP})) > 0),
  ok AS (SELECT persona_id, phrase, count(*) AS n FROM ph WHERE length(phrase) BETWEEN 11 AND 99 AND NOT regexp_matches(phrase, '^(the|and|or|but)') GROUP BY ALL HAVING count(*) >= 2)"""
CHECKS["agg_12_repeated_phrases"] = (
    lambda spark, sf: L.repeated_phrases(corpus(spark, sf)),
    f"WITH {_SIG} SELECT * FROM ok",
)
_PAT = [r"(?i)\b(?:listen|look|here''s|now|so|but|and)\s+[^.!?]*", r"(?i)\bthe\s+(?:point|thing|reality|truth)\s+is\b[^.!?]*",
        r"(?i)\byou\s+(?:need|have|want|should|must)\s+to\b[^.!?]*", r"(?i)\blet\s+me\s+(?:tell|show|explain)\b[^.!?]*"]
_PATSQL = " UNION ALL ".join(f"SELECT persona_id, doc_id, {i} AS family, regexp_extract_all(content, '{p}') AS f FROM corpus" for i, p in enumerate(_PAT))
_SIGALL = _SIG + rf""", fam AS ({_PATSQL}), fe AS (SELECT persona_id, doc_id, family, unnest(f) AS phrase, unnest(generate_series(1, len(f))) AS place FROM fam),
  pf AS (SELECT DISTINCT persona_id, {sql_strip('phrase')} AS phrase FROM (SELECT *, row_number() OVER (PARTITION BY persona_id, family ORDER BY doc_id, place) AS rn FROM fe) WHERE rn <= 5),
  al AS (SELECT persona_id, phrase, max(n) AS n FROM (SELECT * FROM ok UNION ALL SELECT persona_id, phrase, 1 FROM pf WHERE length(phrase) BETWEEN 11 AND 99 AND NOT regexp_matches(phrase, '^(the|and|or|but)')) GROUP BY ALL)"""
CHECKS["agg_12_signature_phrases"] = (
    lambda spark, sf: L.signature_phrases(corpus(spark, sf)),
    f"WITH {_SIGALL} SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY persona_id ORDER BY n DESC, phrase) AS rank FROM al) WHERE rank <= 20",
)
CHECKS["set_01_phrase_union"] = (
    lambda spark, sf: L.pattern_phrases(corpus(spark, sf)).unionByName(L.repeated_phrases(corpus(spark, sf)).drop("n")).distinct().groupBy("persona_id").agg(F.count("*").alias("phrases")),
    f"WITH {_SIGALL} SELECT persona_id, count(*) AS phrases FROM (SELECT persona_id, phrase FROM ok UNION SELECT persona_id, phrase FROM pf) GROUP BY 1",
)
CHECKS["agg_13_vocabulary"] = (
    lambda spark, sf: r6(L.vocabulary_totals(L.word_counts(corpus(spark, sf))), "vocabulary_richness", "avg_length"),
    f"""WITH {_WORDS} SELECT persona_id, sum(n)::BIGINT AS total_words, count(*) AS unique_words, round(count(*) / sum(n), 6) AS vocabulary_richness,
    coalesce(sum(n) FILTER (word NOT IN {STOP}), 0)::BIGINT AS content_words, count(*) FILTER (word NOT IN {STOP}) AS unique_content_words, round(sum(length(word) * n) / sum(n), 6) AS avg_length FROM wc WHERE length(word) > 2 GROUP BY 1""",
)
CHECKS["agg_13_length_histogram"] = (
    lambda spark, sf: L.length_histogram(L.word_counts(corpus(spark, sf))),
    f"WITH {_WORDS} SELECT persona_id, length(word) AS length, sum(n)::BIGINT AS words FROM wc WHERE length(word) > 2 GROUP BY ALL",
)
CHECKS["agg_13_top_content_words"] = (
    lambda spark, sf: L.top_words(L.word_counts(corpus(spark, sf)).where((F.length("word") > 2) & ~F.col("word").isin(fixed.STOP_WORDS)), top=30),
    f"WITH {_WORDS} SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY persona_id ORDER BY n DESC, word) AS rank FROM wc WHERE length(word) > 2 AND word NOT IN {STOP}) WHERE rank <= 30",
)
_KR, _ER, _TR = [("short", ["anth", "ment"]), ("teutonic", ["sch"])], [("people", ["(person)"])], [("a", ["en th", "de"]), ("b", ["er"])]


def _domains(spark, sf):
    kw = L.keywords(corpus(spark, sf)).groupBy("persona_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]), " ").alias("kw"))
    ents = L.entity_counts(L.dictionary_entities(corpus(spark, sf), dictionary(spark, sf))).groupBy("persona_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "entity"))), lambda x: x["entity"]), " ").alias("ents"))
    return kw.join(ents, "persona_id", "full_outer").select("persona_id", F.array_join(L.expertise_domains(F.col("kw"), F.col("ents"), _KR, _ER), ",").alias("domains"))


CHECKS["agg_15_expertise_domains"] = (
    _domains,
    f"""WITH {_KW}, {_ENT.replace(SQL_CORPUS + ', ', '')}, k AS (SELECT persona_id, string_agg(term, ' ' ORDER BY rank) AS kw FROM keywords GROUP BY 1), e AS (SELECT persona_id, lower(string_agg(entity, ' ' ORDER BY rank)) AS ents FROM entities GROUP BY 1)
    SELECT persona_id, array_to_string(list_sort(list_filter([CASE WHEN contains(kw, 'anth') OR contains(kw, 'ment') THEN 'short' END, CASE WHEN contains(kw, 'sch') THEN 'teutonic' END, CASE WHEN contains(ents, '(person)') THEN 'people' END], lambda x: x IS NOT NULL)), ',') AS domains
    FROM k FULL OUTER JOIN e USING (persona_id)""",
)


def _themes(spark, sf):
    c = L.collocations(corpus(spark, sf)).where("rank <= 10").groupBy("persona_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "ngram"))), lambda x: x["ngram"]).alias("p"))
    return c.select("persona_id", F.array_join(L.content_themes(F.col("p"), _TR), ",").alias("themes"))


CHECKS["agg_15_content_themes"] = (
    _themes,
    f"""WITH {_COL} SELECT persona_id, coalesce(string_agg(DISTINCT CASE WHEN contains(ngram, 'en th') OR contains(ngram, 'de') THEN 'a' WHEN contains(ngram, 'er') THEN 'b' END, ',' ORDER BY CASE WHEN contains(ngram, 'en th') OR contains(ngram, 'de') THEN 'a' WHEN contains(ngram, 'er') THEN 'b' END), '') AS themes
    FROM collocations WHERE rank <= 10 GROUP BY 1""",
)
CHECKS["agg_23_book_statistics"] = (
    lambda spark, sf: A.book_statistics(C.split_books(books(spark, sf)).select("language", F.explode_outer("chapters").alias("c")).where("c IS NOT NULL").select("language", F.col("c.word_count").alias("word_count")), "language").na.fill("ALL", ["language"]),
    f"""WITH {SQL_BOOKS}, e AS (SELECT language, unnest(counts) AS w FROM counted JOIN books USING (doc_id)) SELECT coalesce(language, 'ALL') AS language, count(*) AS chunks, min(w) AS min_words, max(w) AS max_words, floor(sum(w) / count(*))::BIGINT AS avg_words, grouping(language)::BIGINT AS level FROM e GROUP BY ROLLUP (language)""",
)
CHECKS["agg_22_distinct_categories"] = (
    lambda spark, sf: A.distinct_categories(models(spark, sf)),
    SQL_MODELS + "SELECT DISTINCT unnest(categories) AS category FROM model_items ORDER BY 1",
)
CHECKS["agg_19_collection_rollup"] = (
    lambda spark, sf: A.collection_rollup(models(spark, sf).select("persona_id", F.lit("mental_models").alias("knowledge_type")).unionAll(
        beliefs(spark, sf).select("persona_id", F.lit("core_beliefs").alias("knowledge_type")))).na.fill("ALL", ["persona_id", "knowledge_type"]),
    f"""WITH u AS (SELECT source AS persona_id, unnest(['mental_models', 'core_beliefs']) AS knowledge_type FROM documents)
    SELECT coalesce(persona_id, 'ALL') AS persona_id, coalesce(knowledge_type, 'ALL') AS knowledge_type, count(*) AS records, grouping_id(persona_id, knowledge_type)::BIGINT AS level FROM u GROUP BY ROLLUP (persona_id, knowledge_type)""",
)
