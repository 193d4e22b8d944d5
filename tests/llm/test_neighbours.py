import numpy as np

from shelfline.llm import neighbours as N
from tests.llm.helpers import save

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, k, step=20):
    ok = [(i, np.array(v, dtype=np.float32).astype(float)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all() and np.any(np.array(v) != 0)]
    out = set()
    for q, a in ok:
        if q % step == 0:
            near = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in ok if i != q and len(a) == len(b))[:k]
            out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(near)}
    return out


def test_exact_with_odd_vectors_and_ties(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(N, "QUERY_BYTES", 500)
    monkeypatch.setattr(N, "CANDIDATE_BLOCK", 60)
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=8).astype(np.float32)]) for i in range(300)]
    rows += [(300 + i, rows[40][1]) for i in range(90)]  # copies of a query
    rows += [(400, None), (420, [0.0] * 8), (440, [float("nan")] + [1.0] * 7), (460, [None] + [1.0] * 7), (480, [float("inf")] * 8), (None, [1.0] * 8)]
    rows += [(500, [1.0, 2.0]), (501, [3.0, 1.0]), (520, [1e-30] * 8), (540, [-0.0] * 7 + [5.0]), (541, [0.0] * 7 + [5.0])]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as label", "2 as dim", "3 as V")
    got = {tuple(r) for r in N.op10_neighbours(spark, save(spark, tmp_path, embeddings=df)).collect()}
    assert got == brute(rows, 20)


def test_repeated_rows_count_once_and_empty_sides(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [0.5, 0.0]), (1, [0.5, 0.0]), (2, [0.1, 0.0])]
    df = spark.createDataFrame(rows, SCHEMA)
    assert [(r.rank, r.vec_id) for r in N.nearest(df.filter("vec_id = 0"), df).orderBy("rank").collect()] == [(1, 1), (2, 2)]
    assert N.nearest(df.limit(0), df).count() == 0 and N.nearest(df, df.limit(0)).count() == 0


def test_bounds_hold():
    rng = np.random.default_rng(5)
    a, b = rng.normal(size=(50, 16)), rng.normal(size=(70, 16)) * 10 ** rng.uniform(-3, 3, (70, 1))
    (ca, sa, na, ea), (cb, sb, _, eb) = N.quantised(a), N.quantised(b)
    near = (ca.astype(float) @ cb.T.astype(float)) * sa[:, None] * sb
    assert (np.abs(near - a @ b.T) <= (na[:, None] * eb + ea[:, None] * np.linalg.norm(b, axis=1)) * (1 + 1e-9) + 1e-12).all()
