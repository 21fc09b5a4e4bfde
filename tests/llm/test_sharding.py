import zlib

from pyspark.sql import functions as F

from marginalia.llm.sharding import kd_shards, name_value


def dims():
    return {"source": name_value("source"), "lang": name_value("lang"), "size": F.log2(F.coalesce(F.octet_length("text"), F.lit(0)) + 1) / 32}


def brute(rows, shards, n_dims, bits=42):
    """The same tree on sorted lists. rows: (id, size, keys)."""
    out, todo = {}, [(rows, 0, shards)]
    while todo:
        part, first, leaves = todo.pop()
        if leaves == 1 or not part:
            out.update({r[0]: first for r in part})
            continue
        widths = [max(r[2][d] >> bits for r in part) - min(r[2][d] >> bits for r in part) for d in range(n_dims)]
        d, left = widths.index(max(widths)), leaves // 2
        need, total, cut = sum(r[1] for r in part) * left / leaves, 0, None
        for r in sorted(part, key=lambda r: r[2][d]):
            if total + r[1] >= need:
                cut = r[2][d] if (need - total) * 2 >= r[1] else r[2][d] - 1
                break
            total += r[1]
        todo += [([r for r in part if r[2][d] <= cut], first, left), ([r for r in part if r[2][d] > cut], first + left, leaves - left)]
    return out


def test_equals_brute_force(spark, docs):
    keyed = docs.select("doc_id", (F.octet_length("text") + 1).alias("size"), F.array(*[
        F.shiftleft(F.least(F.floor(v * (1 << 20)), F.lit((1 << 20) - 1)).cast("bigint"), 42) + F.xxhash64("doc_id").bitwiseAND((1 << 42) - 1)
        for v in dims().values()]).alias("keys")).collect()
    for shards in (16, 5):
        got = {r.doc_id: r for r in kd_shards(docs, dims(), shards).collect()}
        assert {i: r.shard for i, r in got.items()} == brute([tuple(r) for r in keyed], shards, 3)
    sizes = {}
    for r in got.values():
        sizes.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in sizes.values())
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(r.text_crc32 == zlib.crc32(texts[i].encode()) and r.size == len(texts[i].encode()) + 1 for i, r in got.items())


def test_target_bytes_and_chunks(spark, docs, monkeypatch):
    monkeypatch.setattr("marginalia.llm.sharding._SLOT_ROWS", 10)
    total = docs.agg(F.sum(F.octet_length("text") + 1)).first()[0]
    out = kd_shards(docs, dims(), target_bytes=total // 4 - 1).collect()
    per = {}
    for r in out:
        per.setdefault(r.shard, []).append(r)
    assert len(per) == 5 and all(sorted(r.slot for r in p) == list(range(len(p))) for p in per.values())
    assert max(sum(r.size for r in p) for p in per.values()) < total / 5 * 1.2


def test_odd_rows(spark, odd):
    df = odd.withColumn("source", F.lit(None).cast("string"))
    out = kd_shards(df, dims(), 4)
    rows = out.collect()
    assert len(rows) == df.count() and {r.size for r in rows if r.doc_id in (2, 3)} == {1}
    assert len({r.shard for r in rows if r.doc_id == 1}) == 1  # rows that repeat an id
    assert kd_shards(df.filter(F.lit(False)), dims(), 4).count() == 0
