import zlib

from shelfline.llm import sharding as S
from tests.llm.helpers import EMPTY, documents, save


def laid_out(rows, n=8):
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(slots) == list(range(len(slots))) for slots in by.values())
    counts = [len(by.get(k, [])) for k in range(n)]
    assert max(counts) - min(counts) <= 1
    return counts


def test_law_and_repeatability(spark):
    rows = [(i, f"text {i % 5}", "src0" if i % 3 else "b") for i in range(501)] + EMPTY + [(7, "text 2", "b")] * 3 + [(None, "x", None)]
    docs = documents(spark, rows)
    first = S.shuffle_into_shards(docs, ["doc_id"]).collect()
    assert sum(laid_out(first)) == len(rows)
    assert sorted(map(str, first)) == sorted(map(str, S.shuffle_into_shards(docs, ["doc_id"]).collect()))
    other = S.shuffle_into_shards(docs, ["doc_id"], seed=18).collect()
    assert sorted(map(str, first)) != sorted(map(str, other))
    assert [r.doc_id for r in sorted(first, key=lambda r: (r.shard, r.slot))] != sorted((r.doc_id or 0) for r in first)


def test_order_is_spread(spark):
    rows = S.shuffle_into_shards(documents(spark, [(i, "t", "s") for i in range(4000)]), ["doc_id"]).collect()
    means = {}
    for r in rows:
        means.setdefault(r.shard, []).append(r.doc_id)
    assert all(abs(sum(v) / len(v) - 2000) < 250 for v in means.values())


def test_few_rows_empty_and_clashes(spark):
    assert laid_out(S.shuffle_into_shards(documents(spark, [(1, "a", "s"), (2, None, None)]), ["doc_id"]).collect()) .count(1) == 2
    assert S.shuffle_into_shards(documents(spark, []), ["doc_id"]).count() == 0
    out = S.shuffle_into_shards(documents(spark, [(1, "a", "s")]).selectExpr("*", "9 as Shard", "9 as bucket", "9 as n", "9 as rec", "9 as start"), ["doc_id"])
    (row,) = out.collect()
    assert (row.shard, row.slot, row.bucket, row.rec, row.start) == (0, 0, 9, 9, 9)


def test_op6_reads_what_it_wrote(spark, tmp_path):
    rows = [(i, "é" * (i % 9), "s") for i in range(40)] + [(99, None, None)]
    got = S.op6_sharding(spark, save(spark, tmp_path, documents=documents(spark, rows))).collect()
    laid_out(got)
    assert {(r.doc_id, r.size, r.text_crc32) for r in got} == {(i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in rows}
    assert S.op6_sharding(spark, save(spark, tmp_path / "e", documents=documents(spark, []))).count() == 0


def test_brute_force_scatter_and_shuffle(spark):
    """Buckets laid end to end, each some order of the rows that hash to it, are cut into shards one after another."""
    docs = documents(spark, [(i, f"text {i}", "s") for i in range(333)])
    bucket = {r.doc_id: r.b for r in docs.selectExpr("doc_id", f"pmod(xxhash64(17, doc_id), {S.LEAST_BUCKETS}) AS b").collect()}
    got = sorted(S.shuffle_into_shards(docs, ["doc_id"]).collect(), key=lambda r: (r.shard, r.slot))
    assert [bucket[r.doc_id] for r in got] == sorted(bucket.values())
    want = [(shard, slot) for shard in range(8) for slot in range(len([at for at in range(333) if at * 8 // 333 == shard]))]
    assert [(r.shard, r.slot) for r in got] == want
    inside = [r.doc_id for r in got]
    assert any(a > b for a, b in zip(inside, inside[1:]) if bucket[a] == bucket[b])


def test_very_long_text(spark):
    docs = documents(spark, [(1, "x" * 3_000_000, "s"), *[(i, "y", "s") for i in range(2, 20)]])
    rows = S.shuffle_into_shards(docs, ["doc_id"]).collect()
    assert sum(laid_out(rows)) == 19 and max(len(r.text) for r in rows) == 3_000_000
