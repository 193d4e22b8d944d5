"""Nearest neighbours by inner product: a block matrix join over int8 tiles with error bounds.

Queries and candidates are dealt by hashes of their ids to blocks of bounded size; every pair of blocks is a
tile, a cogroup of its own.  In a tile the product of int8 codes approximates every inner product, and the norms
of the codes' errors bound what it can be off.  Pairs whose upper bound reaches the tile's k-th lower bound are
recomputed in double precision.  Each query's survivors of all tiles meet in heaps of k.

The result is exact: bounds only spare work.  Equal vectors are compared once in a tile, so large groups of
copies cost no more than one vector.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfline.llm.common import table

K = 20
#: Bytes of a block of queries, about: candidates are sent once to each.  Rows of a block of candidates, about.
QUERY_BYTES = 32 << 20
CANDIDATE_BLOCK = 4096
#: Queries of a tile that are compared at a time.
STRIP = 256

PAIRS = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
FOUND = pa.schema([("query_id", pa.int64()), ("rank", pa.int32()), ("vec_id", pa.int64()), ("score", pa.float64())])


def usable(vector: str) -> F.Column:
    """True for vectors that take part: not null, not zero, and all components finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(int8 codes, scale of each row, norm of each row as coded, norm of each row's error)."""
    scale = np.abs(x).max(axis=1) / 127
    scale[scale == 0] = np.finfo(np.float64).tiny  # a subnormal vector
    codes = np.clip(np.rint(x / scale[:, None]), -127, 127)
    coded = codes * scale[:, None]
    return codes.astype(np.int8), scale, np.linalg.norm(coded, axis=1), np.linalg.norm(x - coded, axis=1)


def tile(query_ids: np.ndarray, a: np.ndarray, vec_ids: np.ndarray, b: np.ndarray, k: int) -> list[tuple[int, int, float]]:
    """(query, candidate, score) of each query's k nearest in the tile, own id left out."""
    order = np.lexsort((vec_ids,))
    vec_ids, b = vec_ids[order], b[order]
    raw = np.ascontiguousarray(b + 0.0).view(np.dtype((np.void, b.shape[1] * 8))).ravel()
    _, first, of = np.unique(raw, return_index=True, return_inverse=True)
    holders: list[list[int]] = [[] for _ in first]
    for i, u in zip(vec_ids.tolist(), of.tolist()):
        if len(holders[u]) <= k and (not holders[u] or holders[u][-1] != i):
            holders[u].append(i)  # the k + 1 smallest ids: more can't be among the nearest
    b = b[first]
    codes_a, scale_a, norm_a, off_a = quantised(a)
    codes_b, scale_b, norm_b, off_b = quantised(b)
    exact = np.float32 if a.shape[1] * 127 * 127 < 1 << 24 else np.float64  # sums of int8 products are whole in it
    codes_b = codes_b.astype(exact).T
    true_b = np.linalg.norm(b, axis=1)
    out = []
    for s in range(0, len(a), STRIP):
        own = slice(s, s + STRIP)
        near = (codes_a[own].astype(exact) @ codes_b).astype(np.float64) * scale_a[own, None] * scale_b
        off = norm_a[own, None] * off_b + off_a[own, None] * true_b
        off = off * (1 + 1e-9) + 1e-12 * (norm_a[own, None] + off_a[own, None]) * true_b
        if len(b) > k + 1:
            least = np.partition(near - off, len(b) - k - 1, axis=1)[:, len(b) - k - 1]
        else:
            least = np.full(len(near), -np.inf)
        alive = near + off >= least[:, None]
        for i in range(len(near)):
            left = np.flatnonzero(alive[i])
            scores = np.add.accumulate(b[left] * a[s + i], axis=1)[:, -1]
            q = int(query_ids[s + i])
            pairs = ((-x, v) for x, u in zip(scores.tolist(), left.tolist()) for v in holders[u] if v != q)
            out += [(q, v, -x) for x, v in heapq.nsmallest(k, pairs)]
    return out


def nearest(queries: DataFrame, candidates: DataFrame, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest candidates by inner product.

    Vectors that are null, zero or hold null or non-finite components take no part, nor do rows with null ids;
    vectors are compared with those of their own length only; ties go to the smaller id; rows that repeat id
    and vector count once, and of a query id with several vectors the first in byte order is searched; an
    empty side gives no rows; other columns play no part.
    """

    def part(df: DataFrame) -> DataFrame:
        own = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
        return own.filter(F.col("id").isNotNull() & usable("v")).withColumn("dim", F.size("v"))

    q, c = part(queries), part(candidates)
    size = q.agg(F.sum(F.col("dim") * 8)).first()[0] or 0
    rows_of, columns_of = max(1, math.ceil(size / QUERY_BYTES)), max(1, math.ceil(c.count() / CANDIDATE_BLOCK))

    def block(n: int) -> F.Column:
        return F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")

    def each(n: int) -> F.Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    key = ["dim", "row", "col"]
    left = q.withColumn("row", block(rows_of)).withColumn("col", each(columns_of))
    right = c.withColumn("col", block(columns_of)).withColumn("row", each(rows_of))

    def compare(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return PAIRS.empty_table()
        dim = a.column("dim")[0].as_py()
        ids, vectors = a.column("id").to_numpy(), _matrix(a.column("v"), dim)
        order = np.lexsort((*vectors.T[::-1], ids))
        ids, vectors = ids[order], vectors[order]
        _, first = np.unique(ids, return_index=True)
        found = tile(ids[first], vectors[first], b.column("id").to_numpy(), _matrix(b.column("v"), dim), k)
        columns = list(zip(*found)) or [[], [], []]
        return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(columns, PAIRS)], schema=PAIRS)

    pairs = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(compare, "query_id long, vec_id long, score double")

    def merge(batches):
        heaps: dict[int, list] = {}
        for batch in batches:
            for query, vec, value in zip(*(batch.column(i).to_pylist() for i in range(3))):
                heap = heaps.setdefault(query, [])
                if len(heap) < k:
                    heapq.heappush(heap, (value, -vec))
                elif (value, -vec) > heap[0]:
                    heapq.heapreplace(heap, (value, -vec))
        rows = [(q, i + 1, -v, x) for q, heap in heaps.items() for i, (x, v) in enumerate(sorted(heap, reverse=True))]
        columns = list(zip(*rows)) or [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, FOUND)], schema=FOUND)

    dealt = pairs.repartition("query_id")
    return dealt.mapInArrow(merge, "query_id long, rank int, vec_id long, score double")


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every vector whose id is divisible by 20, among all vectors."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(vectors.filter("vec_id % 20 = 0"), vectors)


OP10_SQL = f"""
WITH v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= {K}
"""
