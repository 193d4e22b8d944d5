"""Every stage and the whole pipeline against plain Python on a small corpus."""

import pyarrow as pa

import corpus_pipeline as P
from shelfline.llm.common import table
from tests.llm.helpers import documents, save, sentence
from tests.llm.test_near_dedup import brute

ITEM = "which of the seven hills of the capital lies nearest to the river and its bridges"


def corpus(spark, tmp_path):
    good = [(i, sentence(i, 60) + ".", f"src{i % 3}") for i in range(90)]
    good += [(200 + i, sentence(i, 59) + " changed.", "src0") for i in range(5)] + [(300, sentence(50, 20) + " " + ITEM + " end.", "src1")]
    bad = [(400 + i, " | ".join(sentence(i, 14).split()), "src2") for i in range(40)]
    labels = [(i, int(i < 400), 0) for i, _, _ in good + bad]
    return good, save(
        spark,
        tmp_path,
        documents=documents(spark, good + bad),
        labels=spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
        benchmark=spark.createDataFrame([(1, ITEM)], "item_id long, text string"),
    )


def test_stages(spark, tmp_path):
    good, sf = corpus(spark, tmp_path)
    assert [name for name, _ in P.STAGES] == ["quality", "near_dedup", "decontaminate", "mix", "shard"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = P.quality(spark, docs, sf)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, _, _ in good}
    unique = P.near_dedup(spark, kept, sf)
    expected = {i for i, (_, _, k) in brute([(i, t) for i, t, _ in good], 5, 80).items() if k}
    assert {r.doc_id for r in unique.collect()} == expected and expected.isdisjoint(range(200, 205))
    clean = P.decontaminate(spark, unique, sf)
    assert {r.doc_id for r in clean.collect()} == expected - {300}
    mixed = P.mix(spark, clean, sf)
    assert mixed.columns == docs.columns and {r.doc_id for r in mixed.collect()} <= expected - {300}
    final = P.run(spark, sf)
    assert sorted(r.doc_id for r in final.collect()) == sorted(r.doc_id for r in mixed.collect())
    counts = [r["count"] for r in final.groupBy("shard").count().collect()]
    assert max(counts) - min(counts) <= 1


def test_odd_rows_go_through_every_stage(spark, tmp_path):
    good, sf = corpus(spark, tmp_path / "a")
    odd = [(900, None, None), (901, "", "src1"), (902, sentence(170, 20_000), "src9"), (None, sentence(171, 40), None), (903, sentence(172, 60), "src1"), (903, sentence(172, 60), "src1")]
    docs = documents(spark, [(i, t, s) for i, t, s in good] + odd).selectExpr("*", "1 as shard", "2 as N_hit", "3 as __id", "5 as __COPIES", "6 as __copy", "7 as __text", "4 as Score")
    columns = docs.columns
    for name, stage in P.STAGES[1:]:
        docs = P.stored(stage(spark, docs, sf), name)
        assert name == "shard" or docs.columns == columns
        if name == "decontaminate":
            before = [r.doc_id for r in docs.select("doc_id").collect()]
    left = [r.doc_id for r in docs.select("doc_id").collect()]
    assert {900, 901, 902, 903, None} <= set(before) and set(left) <= set(before)
    assert left.count(900) == left.count(901) == 1 and all(left.count(i) <= 3 for i in before if i != 903)
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in P.STAGES:
        empty = stage(spark, empty, sf)
        assert empty.count() == 0


def test_arrow_batches_are_bounded_by_bytes(spark, tmp_path):
    """Long texts come to Python a few at a time, not ten thousand at once."""
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    data = save(spark, tmp_path, documents=spark.range(0, 300, 1, 1).selectExpr("id AS doc_id", "repeat('long text ', 10000) AS text"))

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["n"])

    found = table(spark, data, "documents").mapInArrow(sizes, "n long").collect()
    assert len(found) > 5 and max(r.n for r in found) < 2 * 4 * 2**20
