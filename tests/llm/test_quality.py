import zlib

import numpy as np

from shelfline.llm import quality as Q
from tests.llm.helpers import EMPTY, documents, save, sentence


def corpus(spark, n=240):
    good = [(i, sentence(i, 50) + ".", "s") for i in range(n)]
    bad = [(n + i, " | ".join(sentence(i, 12).split()) if i % 2 else f"w{i} " * 40, "s") for i in range(n // 3)]
    labels = [(i, 1, 0) for i, _, _ in good] + [(i, 0, 0) for i, _, _ in bad] + [(None, 1, 0), (5000, None, None), (9999, 0, 0)]
    return good + bad, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy_and_repeatability(spark, tmp_path):
    rows, labels = corpus(spark)
    sf = save(spark, tmp_path, documents=documents(spark, rows + [(-i, t, s) for i, t, s in EMPTY] + [(None, "x", None)]), labels=labels)
    got = Q.op9_quality(spark, sf).collect()
    assert len(got) == len(rows) + 5 and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    right = [r.predicted == (r.doc_id < 240) for r in held if r.doc_id >= 0]
    assert np.mean(right) > 0.95 and len(right) > 60
    again = {r.doc_id: r.score for r in Q.op9_quality(spark, sf).collect()}
    assert all(again[r.doc_id] == r.score for r in got)


def test_labels_of_held_out_rows_play_no_part(spark):
    rows, labels = corpus(spark, 90)
    docs = documents(spark, rows)
    flipped = labels.withColumn("quality", Q.F.when(Q.held_out(Q.F.col("doc_id")), 1 - Q.F.col("quality")).otherwise(Q.F.col("quality")))
    usable = ~Q.held_out(Q.F.col("doc_id"))
    assert (Q.train(docs, labels, usable) == Q.train(docs, flipped, usable)).all()


def test_scores_are_sparse_dot_products(spark):
    weights = np.random.default_rng(0).normal(size=(1 << Q.BITS) + 1).astype(np.float32)
    texts = ["A b a b, b", "", None, "é é", "word " * 3]
    docs = documents(spark, [(i, t, "s") for i, t in enumerate(texts)]).selectExpr("*", "'x' as SCORE", "1 as weights")
    got = {r.doc_id: r.score for r in Q.score(docs, weights).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        index, _ = Q.features(np.frombuffer(raw, dtype=np.uint8), np.array([0, len(raw)]))
        z = weights[index].astype(float).sum() / np.sqrt(max(1, len(index))) + weights[-1]
        assert abs(got[i] - 1 / (1 + np.exp(-z))) < 1e-9


def test_no_labels_and_empty_documents(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rated = Q.rated_documents(documents(spark, [(1, "a", "s")] * 2), none).collect()
    assert [r.score for r in rated] == [0.5, 0.5]
    assert Q.rated_documents(documents(spark, []), none).count() == 0


def test_learner_by_plain_follow_the_regularised_leader():
    """FTRL-proximal in plain Python, weight by weight, over the same rows."""
    import math

    rng, size = np.random.default_rng(4), 12
    model, z, n = Q.Ftrl(size), [0.0] * (size + 1), [0.0] * (size + 1)

    def weight(i):
        if i == size:
            return -z[i] / ((Q.BETA + math.sqrt(n[i])) / Q.ALPHA)
        return 0.0 if abs(z[i]) <= Q.L1 else -(z[i] - math.copysign(Q.L1, z[i])) / ((Q.BETA + math.sqrt(n[i])) / Q.ALPHA + Q.L2)

    for _ in range(200):
        index = np.append(np.sort(rng.choice(size, 4, replace=False)), size)
        value, label = np.append(rng.random(4), 1.0), int(rng.random() < 0.4)
        model.learn(index, value, label)
        w = [weight(i) for i in index]
        p = 1 / (1 + math.exp(-sum(a * b for a, b in zip(w, value))))
        for i, v, own in zip(index, value, w):
            g = (p - label) * v
            z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / Q.ALPHA * own
            n[i] += g * g
    assert np.allclose(model.weights(np.arange(size + 1)), [weight(i) for i in range(size + 1)])


def test_features_by_plain_tokens(spark):
    """Texts that agree in tokens, pairs and repeats score alike; those that differ in one do not; long texts are whole."""
    weights = np.random.default_rng(1).normal(size=(1 << Q.BITS) + 1).astype(np.float32)
    long = sentence(3, 20_000)
    texts = ["One two, two", "one  TWO,\ttwo", "one two two,", long, long + " end"]
    got = {r.doc_id: r.score for r in Q.score(documents(spark, [(i, t, "s") for i, t in enumerate(texts)]).selectExpr("*", "1 as __Text"), weights).collect()}
    assert got[0] == got[1] != got[2] and got[3] != got[4]
    one = {r.doc_id: r.score for r in Q.score(documents(spark, [(3, long, "s")]), weights).collect()}
    assert one[3] == got[3]  # neighbours in a batch play no part
