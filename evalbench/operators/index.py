"""An inverted-file index over vectors: built and stored by Spark, searched approximately or exactly.

Centroids come from spherical k-means over a bounded sample (``SAMPLE_ROWS`` a list, ``SAMPLE_BYTES`` in all). Every
valid vector is filed under its nearest centroid; rows are written in the order of their list, so a search for few
lists reads few row groups. For each list the index keeps its number of rows and the least cosine of a row with the
centroid.

A search meets a query with the rows of its nearest ``probes`` lists. Rows of a list and queries for it are both cut
into blocks of bounded size by a hash, and a group is one block of each, so a hot list (copies of one vector, say) is
many groups and no set of queries is a broadcast. Candidates are scored by the exact cosine. With ``exact`` the lists
left over are bounded by the triangle inequality on angles: one whose bound reaches a query's k-th score is read too,
so the result is that of the full search.

Defined results: vectors that are null, of another length, zero or with a component that is null or not finite are
not indexed and, as queries, get no rows; an index of no rows finds nothing; ties go to the smaller chunk id. Chunk
and question ids are unique.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalbench.operators import retrieval as op
from evalbench.sources.shared import rewritten

MOST_LISTS = 4096
CENTROID_BYTES = 64 << 20
SAMPLE_ROWS = 64
SAMPLE_BYTES = 256 << 20
ROUNDS = 12
ROW_BLOCK, QUERY_BLOCK = 4096, 1024  # of a list, in one group
MARGIN = 1e-7  # of bounds, for rounding


@dataclass(frozen=True)
class Index:
    path: str
    centroids: np.ndarray
    sizes: np.ndarray  # rows of each list
    least: np.ndarray  # their least cosine with the centroid

    @property
    def lists(self) -> int:
        return len(self.centroids)

    def rows(self, spark: SparkSession) -> DataFrame:
        """chunk_id, vector, list of every indexed row."""
        return spark.read.parquet(f"{self.path}/rows")


def _units(column: pa.Array) -> np.ndarray:
    """Unit vectors of a column of valid vectors of one length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    v = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(column), -1)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def k_means(sample: np.ndarray, lists: int, seed: int = 0) -> np.ndarray:
    """Unit centroids; a centroid that attracts nothing keeps its place."""
    r = np.random.RandomState(seed)
    centroids = sample[np.sort(r.permutation(len(sample))[:lists])].copy()
    for _ in range(ROUNDS):
        nearest = np.concatenate([(sample[at : at + 8192] @ centroids.T).argmax(axis=1) for at in range(0, len(sample), 8192)])
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, sample)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(length > 1e-12, sums / np.maximum(length, 1e-12), centroids)
    return centroids


def _filed(shared) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids = shared.value
        for batch in batches:
            near, cosine = np.zeros(len(batch), np.int32), np.zeros(len(batch))
            for at in range(0, len(batch), 2048):
                products = _units(batch.column(1).slice(at, 2048)) @ centroids.T
                near[at : at + 2048] = products.argmax(axis=1)
                cosine[at : at + 2048] = products.max(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(near), pa.array(cosine)], ["chunk_id", "vector", "list", "cosine"])

    return run


def build(vectors: DataFrame, path: str, lists: int | None = None, dim: int | None = None, seed: int = 0) -> Index:
    """Index ``vectors`` (chunk_id, vector) in the folder ``path``; without ``lists`` there are as many as the root of the rows.

    The description of the index is written last, so a folder without it is no index.
    """
    spark = vectors.sparkSession
    dim = dim or vectors.agg(F.max(F.size("vector"))).first()[0] or 0
    rows = vectors.where(op.valid_vector(op.doubles(F.col("vector")), dim)).select("chunk_id", "vector")
    n = rows.count()
    most = max(1, min(MOST_LISTS, CENTROID_BYTES // (8 * max(1, dim)), n))
    lists = min(most, lists or round(n**0.5) or 1)
    if n:
        bound = max(lists, min(lists * SAMPLE_ROWS, SAMPLE_BYTES // (8 * dim)))
        sample = rows.orderBy(F.xxhash64(F.lit(seed), "chunk_id"), "chunk_id").limit(bound).select(op.doubles(F.col("vector")).alias("v")).toArrow()
        centroids = k_means(_units(sample["v"]), lists, seed)
    else:
        centroids = np.zeros((0, dim))
    kind = vectors.schema["vector"].dataType.simpleString()
    filed = rewritten(rows.mapInArrow(_filed(spark.sparkContext.broadcast(centroids)), f"chunk_id string, vector {kind}, list int, cosine double"), "filed")
    filed.drop("cosine").repartitionByRange("list", "chunk_id").sortWithinPartitions("list", "chunk_id").write.parquet(f"{path}/rows")
    facts = {r["list"]: r for r in filed.groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.min("cosine").alias("least")).collect()}  # a row a list
    known = [(i, [float(x) for x in c], facts[i]["n"] if i in facts else 0, facts[i]["least"] if i in facts else 1.0) for i, c in enumerate(centroids)]
    spark.createDataFrame(known, "list int, centroid array<double>, n long, least double").coalesce(1).write.parquet(f"{path}/lists")
    return opened(spark, path)


def opened(spark: SparkSession, path: str) -> Index:
    """A stored index."""
    known = spark.read.parquet(f"{path}/lists").orderBy("list").collect()
    return Index(path, np.array([r.centroid for r in known]), np.array([r.n for r in known], int), np.array([r.least for r in known], float))


def _probed(shared, probes: int, bounded: bool) -> object:
    """(question_id, list, q) of each query's nearest lists; with ``bounded`` of the others whose bound reaches its ``score``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids, least = shared.value
        radius = np.arccos(np.clip(least, -1, 1))
        for batch in batches:
            for at in range(0, len(batch), 1024):
                part = batch.slice(at, 1024)
                cosine = _units(part.column(1)) @ centroids.T
                order = np.argsort(-cosine, axis=1, kind="stable")
                if bounded:
                    reach = np.cos(np.maximum(0, np.arccos(np.clip(cosine, -1, 1)) - radius)) + MARGIN
                    floor = part.column(2).to_numpy(zero_copy_only=False)
                    wanted = reach >= np.where(np.isnan(floor), -2, floor)[:, None]
                    np.put_along_axis(wanted, order[:, :probes], False, axis=1)
                else:
                    wanted = np.zeros(cosine.shape, bool)
                    np.put_along_axis(wanted, order[:, :probes], True, axis=1)
                query, found = np.nonzero(wanted)
                for a in range(0, len(query), 8192):
                    take = pa.array(query[a : a + 8192])
                    yield pa.RecordBatch.from_arrays([part.column(0).take(take), pa.array(found[a : a + 8192].astype(np.int32)), part.column(1).take(take)], ["question_id", "list", "q"])

    return run


def _scored(k: int) -> object:
    def run(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(rows) and len(asked):
            names = rows["chunk_id"].to_numpy()
            order = np.argsort(names, kind="stable")
            v = np.array(rows["vector"].tolist(), dtype=float)[order]
            q = np.array(asked["q"].tolist(), dtype=float)
            scores = (q / np.linalg.norm(q, axis=1, keepdims=True)) @ (v / np.linalg.norm(v, axis=1, keepdims=True)).T
            rounded, names = np.round(scores, op.TIE_DECIMALS), names[order]
            for i, question in enumerate(asked["question_id"]):
                # names are in order, so a stable sort leaves ties by name
                best = np.argsort(-rounded[i], kind="stable")[:k]
                out.append(pd.DataFrame({"question_id": question, "chunk_id": names[best], "score": scores[i, best]}))
        return pd.concat(out) if out else pd.DataFrame({"question_id": pd.Series(dtype=str), "chunk_id": pd.Series(dtype=str), "score": pd.Series(dtype=float)})

    return run


def _met(index: Index, asked: DataFrame, k: int) -> DataFrame:
    """question_id, chunk_id, score: the k best of each query in each group of a block of rows and a block of queries."""
    spark = asked.sparkSession
    cut = lambda name, blocks: F.pmod(F.xxhash64(name), F.col(blocks)).cast("int")
    deal = lambda blocks: F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))
    known = spark.createDataFrame([(i, -(-int(n) // ROW_BLOCK)) for i, n in enumerate(index.sizes) if n], "list int, row_blocks int")
    # a row for each list that was asked for
    blocks = rewritten(asked.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).cast("int").alias("query_blocks")).join(F.broadcast(known), "list"), "index-blocks")
    rows = index.rows(spark).join(F.broadcast(blocks), "list").select("list", cut("chunk_id", "row_blocks").alias("rb"), deal("query_blocks").alias("qb"), "chunk_id", "vector")
    queries = asked.join(F.broadcast(blocks), "list").select("list", deal("row_blocks").alias("rb"), cut("question_id", "query_blocks").alias("qb"), "question_id", "q")
    keys = ["list", "rb", "qb"]
    return rows.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInPandas(_scored(k), "question_id string, chunk_id string, score double")


def search(index: Index, queries: DataFrame, k: int = 10, probes: int = 8, exact: bool = False) -> DataFrame:
    """question_id, chunk_id, score, rank of the k best by cosine for ``queries`` (question_id, vector)."""
    if k <= 0 or probes <= 0:
        raise ValueError("k and probes must be positive")
    spark = queries.sparkSession
    if not index.sizes.sum():
        return spark.createDataFrame([], "question_id string, chunk_id string, score double, rank int")
    shared = spark.sparkContext.broadcast((index.centroids, index.least))
    valid = queries.where(op.valid_vector(op.doubles(F.col("vector")), index.centroids.shape[1])).select("question_id", op.doubles(F.col("vector")).alias("q"))
    schema = "question_id string, list int, q array<double>"
    asked = rewritten(valid.mapInArrow(_probed(shared, probes, False), schema), "index-asked")
    found = op.best(_met(index, asked, k), k)
    if not exact:
        return found
    found = rewritten(found, "index-found")
    floor = found.where(F.col("rank") == k).select("question_id", F.col("score").alias("floor"))
    more = rewritten(valid.join(floor, "question_id", "left").mapInArrow(_probed(shared, probes, True), schema), "index-more")
    return op.best(found.drop("rank").unionByName(_met(index, more, k)), k)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """question_id, wanted, found: how many of the exact hits a search has, ties in score counting as hits."""
    least = exact.groupBy("question_id").agg(F.count(F.lit(1)).alias("wanted"), F.min(F.round("score", op.TIE_DECIMALS)).alias("least"))
    near = found.select("question_id", F.round("score", op.TIE_DECIMALS).alias("score"))
    met = least.join(near, "question_id", "left").groupBy("question_id", "wanted").agg(F.count(F.when(F.col("score") >= F.col("least"), 1)).alias("found"))
    return met.select("question_id", "wanted", F.least("wanted", "found").alias("found"))


def calibrated(index: Index, queries: DataFrame, k: int = 10, target: float = 0.95, most: int = 256) -> int:
    """The fewest probes that find ``target`` of the exact hits of a sample of at most ``most`` of ``queries``.

    One exact search tells: a hit is found by as many probes as its list stands in the order of the query's lists.
    """
    spark = queries.sparkSession
    sample = rewritten(queries.orderBy(F.xxhash64("question_id"), "question_id").limit(most), "index-sample")
    hits = rewritten(search(index, sample, k, min(8, max(1, index.lists)), exact=True), "index-sample-hits")
    asked = sample.select("question_id", op.doubles(F.col("vector")).alias("q")).join(hits.select("question_id").distinct(), "question_id").toArrow()
    if not len(asked):
        return max(1, index.lists)
    place = np.argsort(np.argsort(-(_units(asked["q"]) @ index.centroids.T), axis=1, kind="stable"), axis=1)
    of = {name: places for name, places in zip(asked["question_id"].to_pylist(), place, strict=True)}
    lists = index.rows(spark).select("chunk_id", "list").join(F.broadcast(hits.select("question_id", "chunk_id")), "chunk_id").select("question_id", "list")
    found = np.sort([of[r.question_id][r["list"]] + 1 for r in lists.collect()])  # at most k a sampled query
    return int(found[min(len(found), int(np.ceil(target * len(found)))) - 1])
