"""Nearest neighbours by inner product: a block matrix join.

Queries and candidates are cut into blocks; each pair of blocks is a tile. In
a tile both sides are rounded to 8-bit whole numbers, whose products a matrix
product gives without error. The rounding errors' lengths bound how far each
product is from the true one, so a candidate whose upper bound is below the
k-th best lower bound cannot be among the k nearest. The others are computed
again from the original vectors in double precision, component by component,
and heaps merge the k nearest of each tile. The result is exact.

Vectors that are null, zero or hold null or non-finite components take no part;
neither do rows without an id. Rows of one id and one vector are one row;
vectors that share an id are rows of their own, but never of each other's
nearest. A query meets candidates of its own length. Blocks go by a hash of id
and vector, and their sizes by the number of vectors of a length, so neither a
repeated id nor a single long vector makes blocks large or many. Each vector is
copied to as many tiles as the other side has blocks: with n vectors and q
queries of d components, n * q * d / 2**20 vectors are moved. Ties go to the
smaller id. With no valid vectors the
result is empty. Columns other than the id and the vector are ignored.
"""

from __future__ import annotations

import heapq
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import written

#: Components that a block holds at most, and tiles aimed at for small inputs.
BLOCK_VALUES, LEAST_TILES = 1 << 20, 16
#: Rows of a tile that are multiplied at once, and pairs recomputed at once.
SLICE, PAIRS = 256, 1 << 18
#: Tiles whose results are merged in one group.
FAN = 256


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), np.float64).reshape(-1, dim)


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """8-bit rows, their scales, the lengths of the rounded rows, and of what
    the rounding left."""
    scale = np.abs(x).max(1) / 127
    scale[scale == 0] = 1.0
    q = np.rint(x / scale[:, None]).astype(np.int8)
    rounded = q * scale[:, None]
    return q, scale, np.sqrt((rounded**2).sum(1)), np.sqrt(((x - rounded) ** 2).sum(1))


def exact(q: np.ndarray, c: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Inner products of the pairs in double precision, added in order."""
    out = np.zeros(len(i))
    for t in range(q.shape[1]):
        out += q[i, t] * c[j, t]
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The whole-number products of 8-bit rows, exact: 1024 components add up
    to less than 2**24 and so fit a float's digits."""
    out = np.zeros((len(a), len(b)))
    for k in range(0, a.shape[1], 1024):
        out += a[:, k : k + 1024].astype(np.float32) @ b[:, k : k + 1024].astype(np.float32).T
    return out


def tile_nearest(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int) -> list[tuple[int, list[tuple[float, int]]]]:
    """For each query its k nearest candidates of the tile, as (-score, id)."""
    c8, c_scale, _, c_left = quantise(c)
    c_len = np.sqrt((c**2).sum(1))
    out = []
    for at in range(0, len(q), SLICE):
        own, ids = q[at : at + SLICE], q_ids[at : at + SLICE]
        q8, q_scale, q_len, q_left = quantise(own)
        near = products(q8, c8) * q_scale[:, None] * c_scale
        slack = (q_len[:, None] * c_left + q_left[:, None] * c_len) * (1 + 1e-9) + 1e-12 * (q_len + q_left)[:, None] * c_len
        mine = ids[:, None] == c_ids
        near[mine] = -np.inf
        low = near - slack
        floor = np.partition(low, len(c) - k, axis=1)[:, len(c) - k] if len(c) > k else np.full(len(own), -np.inf)
        alive = (near + slack >= floor[:, None]) & ~mine
        i, j = np.nonzero(alive)
        score = np.concatenate([exact(own, c, i[s : s + PAIRS], j[s : s + PAIRS]) for s in range(0, len(i), PAIRS)] or [np.zeros(0)])
        ends = np.cumsum(alive.sum(1)).tolist()
        first, ids_of, scores = 0, c_ids[j].tolist(), score.tolist()
        for query, end in zip(ids.tolist(), ends, strict=True):
            out.append((query, heapq.nsmallest(k, ((-s, d) for s, d in zip(scores[first:end], ids_of[first:end], strict=True)))))
            first = end
    return out


def block_nearest(vectors: DataFrame, is_query: Column, k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: of each row that fulfils
    is_query (a condition on id_col) its k nearest other rows."""
    bad = F.exists(vector_col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    part = F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & ~bad & F.exists(vector_col, lambda x: x != 0)
    kind = vectors.schema[vector_col].dataType.elementType.simpleString()
    valid = vectors.where(part).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(f"array<{kind if kind == 'float' else 'double'}>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("is_query"))
    valid = valid.distinct().withColumn("dim", F.size("v"))
    most = F.greatest(F.lit(64), F.floor(F.lit(BLOCK_VALUES) / F.col("dim")))
    blocks = valid.groupBy("dim").agg(F.count("*").alias("n"), F.count_if("is_query").alias("n_q")).where("n_q > 0")
    c_most = F.least(most, F.greatest(F.lit(1024), F.ceil(F.col("n") / LEAST_TILES)))
    blocks = written(blocks.select(F.col("dim").alias("b_dim"), F.ceil(F.col("n") / c_most).cast("int").alias("cbs"), F.ceil(F.col("n_q") / most).cast("int").alias("qbs"), F.least(most, F.col("n_q")).alias("held")), "blocks")
    n_q, c_blocks, held = blocks.agg(F.count("*"), F.max("cbs"), F.max("held")).first()
    schema = "query_id long, rank int, vec_id long, score double"
    if not n_q:
        return vectors.sparkSession.createDataFrame([], schema)
    block = lambda number: F.pmod(F.xxhash64("id", "v"), F.col(number)).cast("int")
    every = lambda number: F.explode(F.sequence(F.lit(0), F.col(number) - 1))
    valid = valid.join(blocks, F.col("dim") == F.col("b_dim"))
    candidates = valid.select(F.col("dim").alias("c_dim"), block("cbs").alias("c_cb"), every("qbs").alias("c_qb"), F.col("id").alias("c_id"), F.col("v").alias("c_v"))
    queries = valid.where("is_query").select("dim", every("cbs").alias("cb"), block("qbs").alias("qb"), "id", "v")

    def tile(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        dim, cb, qb = (x.as_py() for x in key)
        found = []
        if left.num_rows and right.num_rows:
            found = tile_nearest(np.asarray(left["id"]), _matrix(left["v"], dim), np.asarray(right["c_id"]), _matrix(right["c_v"], dim), k)
        rows = [(q, d, -s) for q, best in found for s, d in best]
        a, b, c = zip(*rows, strict=True) if rows else ((), (), ())
        return pa.table({"cb": pa.array([cb] * len(rows), pa.int32()), "qb": pa.array([qb] * len(rows), pa.int32()), "query_id": pa.array(a, pa.int64()), "vec_id": pa.array(b, pa.int64()), "score": pa.array(c, pa.float64())})

    found = queries.groupBy("dim", "cb", "qb").cogroup(candidates.groupBy("c_dim", "c_cb", "c_qb")).applyInArrow(tile, "cb int, qb int, query_id long, vec_id long, score double")

    def merge(rows: pa.Table, last: bool) -> pa.Table:
        best = []
        order = rows.sort_by("query_id")
        lines = zip(*(order[c].to_pylist() for c in ("query_id", "score", "vec_id", "cb", "qb")), strict=True)
        for query, own in groupby(lines, key=lambda r: r[0]):
            own = list(own)
            best += [(query, r, d, -s, own[0][3] // FAN, own[0][4]) for r, (s, d) in enumerate(heapq.nsmallest(k, ((-x[1], x[2]) for x in own)), 1)]
        cols = list(zip(*best, strict=True)) if best else [()] * 6
        out = {"query_id": pa.array(cols[0], pa.int64()), "rank": pa.array(cols[1], pa.int32()), "vec_id": pa.array(cols[2], pa.int64()), "score": pa.array(cols[3], pa.float64())}
        return pa.table(out if last else out | {"cb": pa.array(cols[4], pa.int32()), "qb": pa.array(cols[5], pa.int32())})

    # queries of a block are merged in groups of about 64, the tiles by FAN at a time
    slot = F.pmod(F.xxhash64("query_id", F.lit(1)), F.lit(max(1, held // 64))).alias("slot")
    while c_blocks > FAN:
        found = found.groupBy("qb", slot, F.floor(F.col("cb") / FAN)).applyInArrow(lambda t: merge(t, False), schema + ", cb int, qb int").select("cb", "qb", "query_id", "vec_id", "score")
        c_blocks = -(-c_blocks // FAN)
    return found.groupBy("qb", slot).applyInArrow(lambda t: merge(t, True), schema)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0, 20)


#: The same by brute force; the pairs are the stated query set against all rows.
ORACLE2 = """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
             AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.e, c.e) AS score
      FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id AND len(c.e) = len(q.e)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM p)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 20
"""
