"""Operator 1: exact top-k inner-product search with multi-resolution segment statistics.

Vectors are cut into equal segments; each has a mean and a deviation. For two vectors and a resolution,

    |q - x|^2  >=  sum over segments of length * ((mean_q - mean_x)^2 + (dev_q - dev_x)^2)

so with the norms the inner product is at most the sum of length * (mean_q * mean_x + dev_q * dev_x). Bounds
go from coarse to fine: a block of candidates and queries is first bounded with 4 segments, then the pairs left with 16,
and the exact integer products are computed for the survivors. A pair goes only if its bound is below the
query's k-th score so far, so the result is exact, ties to the smaller id included.

The query set is taken in waves of at most ``WAVE_BYTES``, each broadcast and run against all candidates in
one scan; a task keeps k rows a query, so the shuffle holds k rows for each query and task.

Defined results: vectors that are null, empty or hold a null or non-finite component take no part; vectors
of different lengths are not compared; a query id on several rows is asked once (its smallest vector by
components), and rows with the query's id are never its results; other repeated rows each count; fewer than k
candidates give fewer rows; other columns are not read. Components up to 2**20 in size after scaling are exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evalbench.llm._spark import stash, table

WAVE_BYTES = 16 << 20
SEGMENTS = (4, 16)
BLOCK = 1024
#: Pairs of a step, and numbers of the vectors gathered for them: a task's memory does not grow with the queries' number.
PAIRS = 1 << 17
GATHERED = 1 << 20
SCALE = 1024.0
#: Bounds are computed in doubles; this much of the size of the terms covers their rounding.
SLACK = 1e-9


def integers(column: pa.Array) -> list[np.ndarray]:
    """floor(1024 * x) of each vector as doubles; an empty array where a vector takes no part."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten()
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    values = np.floor(SCALE * pc.fill_null(flat.cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False))
    off = np.concatenate([[0], np.cumsum(sizes)])
    broken = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    return [values[a:b] if broken[a] == broken[b] else values[:0] for a, b in zip(off[:-1], off[1:], strict=True)]


def statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations by segment, each times the root of the length: their products are the bound."""
    dim = x.shape[1]
    cuts = np.unique(np.linspace(0, dim, min(segments, dim) + 1).astype(int))[:-1]
    length = np.diff(np.append(cuts, dim))
    mean = np.add.reduceat(x, cuts, axis=1) / length
    square = np.add.reduceat(x * x, cuts, axis=1) / length
    dev = np.sqrt(np.maximum(square - mean * mean, 0))
    return np.concatenate([mean, dev], axis=1) * np.sqrt(np.concatenate([length, length]))


def _kept(left: np.ndarray, a: np.ndarray, b: np.ndarray, worst: np.ndarray, slack: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Those of the pairs ``left`` whose product, with ``slack``, reaches the row's ``worst``, and the products.

    Where many are left, one matrix product of the block is quicker than pairs gathered one by one. Integer products
    are exact in any order.
    """
    qi, ci = np.nonzero(left)
    if 16 * len(qi) > left.size:
        product = (a @ b.T)[qi, ci]
    else:
        product = np.empty(len(qi))
        step = max(1, GATHERED // a.shape[1])
        for at in range(0, len(qi), step):
            product[at : at + step] = np.einsum("ij,ij->i", a[qi[at : at + step]], b[ci[at : at + step]])
    keep = product + (0.0 if slack is None else slack[qi, ci]) >= worst[qi]
    return qi[keep], ci[keep], product[keep]


class Search:
    """Running top-k of a block of queries of one length."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.q, self.k = ids, vectors, k
        self.levels = [statistics(vectors, s) for s in SEGMENTS]
        self.norm = np.linalg.norm(vectors, axis=1)
        self.scores = np.full((len(ids), k), -np.inf)
        self.found = np.full((len(ids), k), np.iinfo(np.int64).max)

    def add(self, ids: np.ndarray, x: np.ndarray) -> None:
        for at in range(0, len(ids), BLOCK):
            own, part = ids[at : at + BLOCK], x[at : at + BLOCK]
            levels, norm = [statistics(part, s) for s in SEGMENTS], np.linalg.norm(part, axis=1)
            step = max(1, PAIRS // len(own))
            for first in range(0, len(self.ids), step):
                self._block(slice(first, first + step), own, part, levels, norm)

    def _block(self, some: slice, ids: np.ndarray, x: np.ndarray, levels: list[np.ndarray], norm: np.ndarray) -> None:
        """Some of the queries, at most ``PAIRS`` pairs, whatever the number of queries."""
        worst = self.scores[some, -1]
        slack = SLACK * np.outer(self.norm[some], norm) + 1e-6
        left = (self.levels[0][some] @ levels[0].T + slack >= worst[:, None]) & (self.ids[some, None] != ids[None, :])
        qi, ci = _kept(left, self.levels[1][some], levels[1], worst, slack)[:2]
        if not len(qi):
            return
        left[:] = False
        left[qi, ci] = True
        qi, ci, exact = _kept(left, self.q[some], x, worst)
        if not len(qi):
            return
        qi = qi + some.start
        touched = np.unique(qi)
        all_q = np.concatenate([np.repeat(touched, self.k), qi])
        all_s = np.concatenate([self.scores[touched].ravel(), exact])
        all_i = np.concatenate([self.found[touched].ravel(), ids[ci]])
        order = np.lexsort((all_i, -all_s, all_q))
        all_q, all_s, all_i = all_q[order], all_s[order], all_i[order]
        first = np.searchsorted(all_q, touched)
        rank = np.arange(len(all_q)) - np.repeat(first, np.diff(np.append(first, len(all_q))))
        top = rank < self.k
        self.scores[touched] = all_s[top].reshape(len(touched), self.k)
        self.found[touched] = all_i[top].reshape(len(touched), self.k)

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        there = np.isfinite(self.scores)
        return np.repeat(self.ids, self.k)[there.ravel()], self.found[there], self.scores[there].astype(np.int64)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows of ``vectors`` for each of ``queries`` (both vec_id, embedding)."""
    spark = vectors.sparkSession
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where("vec_id is not null")
    queries = queries.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where("vec_id is not null and embedding is not null")
    n, dim = queries.agg(F.count(F.lit(1)), F.max(F.size("embedding"))).first()
    waves = max(1, -(-int(n) * int(dim or 1) * 8 // WAVE_BYTES))
    parts = []
    for wave in range(waves):
        own = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(waves)) == wave) if waves > 1 else queries
        rows = own.toArrow()  # WAVE_BYTES or so
        asked: dict[int, dict[int, np.ndarray]] = {}
        for i, v in zip(rows["vec_id"].to_pylist(), integers(rows["embedding"]), strict=True):
            known = next((d[i] for d in asked.values() if i in d), None)
            if len(v) and (known is None or (len(v), v.tolist()) < (len(known), known.tolist())):
                for d in asked.values():
                    d.pop(i, None)
                asked.setdefault(len(v), {})[i] = v
        packed = {d: (np.array(list(own)), np.array(list(own.values()))) for d, own in asked.items() if own}
        shared = spark.sparkContext.broadcast(packed)

        def run(batches, shared=shared):
            searches = {d: Search(ids, q, k) for d, (ids, q) in shared.value.items()}
            for batch in batches:
                ids, values = batch.column(0).to_numpy(zero_copy_only=False), integers(batch.column(1))
                sizes = np.array([len(v) for v in values])
                for d, search in searches.items():
                    at = np.flatnonzero(sizes == d)
                    if len(at):
                        search.add(ids[at], np.array([values[i] for i in at]))
            for search in searches.values():
                q, v, s = search.rows()
                yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(v, pa.int64()), pa.array(s, pa.int64())], ["query_id", "vec_id", "score"])

        found = vectors.mapInArrow(run, "query_id long, vec_id long, score long")
        parts.append(stash(found, "topk-wave") if waves > 1 else found)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where(F.col("vec_id") % 100 == 0), 10)


SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as e
  from embeddings
  where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select q.vec_id as query_id, v.vec_id as vec_id, cast(list_sum(list_transform(list_zip(q.e, v.e), lambda z: z[1] * z[2])) as bigint) as score
  from v as q join v on v.vec_id <> q.vec_id and len(v.e) = len(q.e)
  where q.vec_id % 100 = 0
), r as (
  select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score from s
)
select query_id, rank, vec_id, score from r where rank <= 10
"""
