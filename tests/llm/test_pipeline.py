import base64
import hashlib

import numpy as np
import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from marginalia.llm import language
from marginalia.llm.common import crc_mod
from tests.llm.test_copies import brute_near
from tests.llm.test_decontaminate import WORD, brute
from tests.llm.test_lines import brute as brute_lines

SF = "/root/testdata/sf0.001"


def test_run_equals_plain_python(spark, docs):
    """Every stage again without Spark; the language model is the fitted one, applied text by text."""
    model = language.fit(docs.filter(crc_mod("doc_id", 3) != 1))
    kept = []
    for r in docs.collect():
        words = language.LETTERS.findall((r.text or "").lower())
        if words and model.score([words])[1][0] >= corpus_pipeline.LEAST_FAMILIAR:
            kept.append((r.doc_id, r.text))
    lines = [(i, text) for i, _, _, text in brute_lines(kept, 10)]
    alone = {i for i, _, _, own in brute_near(lines) if own}
    bench = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    clean = dirty = 0
    for i, text in lines:
        if i not in alone:
            assert i not in got
            continue
        n, hit, _ = brute(text, bench, 10)
        if hit == 0:
            want = np.array(enc.encode_ordinary(text), "<u4").tobytes()
            assert bytes(got[i].ids) == want and got[i].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
            clean += 1
        elif i in got:
            left = enc.decode(np.frombuffer(got[i].ids, "<u4").tolist())
            assert brute(left, bench, 10)[1] == 0 and len(WORD.findall(left)) >= n - 2 * hit
            dirty += 1
        else:
            assert hit > 0.5 * n
    assert clean > 100 and set(got) <= alone


def test_stages_keep_the_columns(spark, docs, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontaminate", "byte_bpe"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).schema == docs.schema
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_columns_with_the_names_that_operators_add(spark, docs):
    """A caller's own columns come back as they were, whatever they are called."""
    names = ["lang_pred", "score", "familiar", "n_lines", "n_dropped", "n_words", "spans", "items", "id", "body", "component_id", "kept", "n_shingles", "row"]
    own = docs.limit(60)
    for n in names:
        own = own.withColumn(n, F.concat(F.lit(n), F.col("doc_id").cast("string")))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, own, SF)
        assert out.schema == own.schema, name
        rows = out.collect()
        assert rows and all(r[n] == f"{n}{r.doc_id}" for r in rows for n in names), name


def test_unknown_languages_go(spark, docs):
    """Never learnt: another script, and letters at random. All given documents stay."""
    strange = [(900001, "Это длинный русский текст о погоде и людях в большом городе " * 20), (900002, "xqzvk wqprt zzxcv bnmlk qqwx jkhgf vbnxz " * 20)]
    more = spark.createDataFrame(strange, "doc_id bigint, text string").select(
        *[F.col(c) if c in ("doc_id", "text") else F.lit(None).cast(docs.schema[c].dataType).alias(c) for c in docs.columns])
    kept = {r.doc_id for r in corpus_pipeline.keep_known_languages(spark, docs.unionByName(more), SF).collect()}
    assert not kept & {900001, 900002} and kept == {r.doc_id for r in docs.collect() if language.LETTERS.search(r.text or "")}
