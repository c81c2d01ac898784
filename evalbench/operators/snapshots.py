"""Chunk and embedding snapshots in a versioned store: immutable once complete, complete only if sets and counts agree.

A snapshot is known by its identity (corpus, parse mode, strategy, model, dimension). Creating it registers its chunks
under a manifest: a hash over all of them that does not depend on their order. The same snapshot may be created again,
which changes nothing; with another identity or other chunks it is refused. Vectors come in batches: what is stored
with the same numbers is left out, other numbers for a stored chunk, a chunk that is not registered, a wrong length or
a number that is not finite refuse the batch. ``finish`` completes a snapshot if each chunk has its vector; then it
takes no more. Each step is one commit and works for many snapshots at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalbench.operators import lifecycle
from evalbench.operators.retrieval import doubles, norm, small
from evalbench.sources.shared import rewritten
from evalbench.sources.store import Store

IDENTITY = ["corpus", "parse_mode", "strategy", "model_id", "dimension"]
TABLES = {
    "snapshots": "snapshot_id string, corpus string, parse_mode string, strategy string, model_id string, dimension int, chunks long, manifest string",
    "chunks": "snapshot_id string, chunk_id string, document_id string, ordinal int, token_count int, content string",
    "vectors": "snapshot_id string, chunk_id string, vector array<float>",
    "complete": "snapshot_id string, version long",
}


def manifests(chunks: DataFrame) -> DataFrame:
    """snapshot_id, chunks and the manifest of each snapshot of ``chunks``: their number and two sums of hashes of their ids, documents, texts and sizes."""
    line = F.concat_ws("|", "chunk_id", "document_id", F.col("ordinal").cast("string"), F.col("token_count").cast("string"), F.sha2("content", 256))
    digest = F.sha2(line, 256)
    part = lambda at: F.sum(F.conv(F.substring(digest, at, 15), 16, 10).cast("decimal(38,0)"))
    g = chunks.groupBy("snapshot_id").agg(F.count(F.lit(1)).alias("chunks"), part(1).alias("a"), part(16).alias("b"))
    return g.select("snapshot_id", "chunks", F.sha2(F.concat_ws(":", F.col("chunks").cast("string"), F.col("a").cast("string"), F.col("b").cast("string")), 256).alias("manifest"))


def _refuse(rows: DataFrame, what: str, *columns: str) -> None:
    found = [tuple(r) for r in rows.select(*columns).limit(5).collect()]
    if found:
        raise ValueError(f"{what}: {found}")


def repeated(rows: DataFrame, key: list[str]) -> DataFrame:
    """Keys that are there more than once. Their hashes are counted first, so only keys of equal hashes are shuffled."""
    h = F.xxhash64(*key).alias("__h")
    again = rows.groupBy(h).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select("__h")
    return lifecycle.duplicates(rows.select(*key, h).join(again, "__h", "left_semi").drop("__h"), key) if not again.isEmpty() else rows.select(*key).limit(0)


class Snapshots:
    def __init__(self, spark: SparkSession, base: str):
        self.store = Store(spark, base, TABLES)

    def create(self, snapshots: DataFrame, chunks: DataFrame) -> int:
        """Register ``snapshots`` (snapshot_id and IDENTITY) with their ``chunks``; the version is the old one if nothing is new."""
        _refuse(lifecycle.duplicates(snapshots, ["snapshot_id"]), "snapshots given twice", "snapshot_id")
        _refuse(repeated(chunks, ["snapshot_id", "chunk_id"]), "chunks given twice", "snapshot_id", "chunk_id")
        _refuse(chunks.join(small(snapshots.select("snapshot_id")), "snapshot_id", "left_anti"), "chunks of no snapshot", "snapshot_id", "chunk_id")
        given = snapshots.select("snapshot_id", *IDENTITY).join(manifests(chunks), "snapshot_id", "left").fillna(0, ["chunks"]).fillna("", ["manifest"])
        given = rewritten(given, "manifests")  # a row a snapshot; texts are hashed once

        def change(parent: int) -> int:
            known = self.store.read("snapshots", parent)
            theirs = known.withColumnsRenamed({c: f"__{c}" for c in [*IDENTITY, "manifest"]}).drop("chunks")
            met = given.join(theirs, "snapshot_id")
            _refuse(met.where(" or ".join(f"not ({c} <=> __{c})" for c in IDENTITY)), "stored with another identity", "snapshot_id")
            _refuse(met.where("manifest <> __manifest"), "stored with other chunks", "snapshot_id")
            fresh = rewritten(given.join(known, "snapshot_id", "left_anti"), "fresh")
            if fresh.isEmpty():
                return parent
            return self.store.commit(parent, "create", {"snapshots": fresh, "chunks": chunks.join(small(fresh.select("snapshot_id")), "snapshot_id", "left_semi")})

        return self.store.retried(change)

    def pending(self, version: int | None = None) -> DataFrame:
        """snapshot_id, chunk_id and content of chunks without a vector."""
        have = self.store.read("vectors", version).select("snapshot_id", "chunk_id")
        return self.store.read("chunks", version).join(have, ["snapshot_id", "chunk_id"], "left_anti").select("snapshot_id", "chunk_id", "content")

    def add(self, vectors: DataFrame) -> int:
        """Store ``vectors`` (snapshot_id, chunk_id, vector) of chunks that have none; nothing of a batch is stored if it breaks a rule."""
        rows, key = vectors.select("snapshot_id", "chunk_id", F.col("vector").cast("array<float>").alias("vector")), ["snapshot_id", "chunk_id"]
        _refuse(repeated(rows, key), "vectors given twice", *key)

        def change(parent: int) -> int:
            _refuse(rows.join(self.store.read("complete", parent), "snapshot_id", "left_semi"), "complete snapshots do not change", *key)
            _refuse(rows.join(self.store.read("chunks", parent), key, "left_anti"), "no such chunk", *key)
            sized = rows.join(self.store.read("snapshots", parent).select("snapshot_id", "dimension"), "snapshot_id")
            numbers = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
            good = (F.size("vector") == F.col("dimension")) & numbers & (norm(doubles(F.col("vector"))) > 0)
            _refuse(sized.where(~F.coalesce(good, F.lit(False))), "no vector", *key)
            stored = self.store.read("vectors", parent)
            other = rows.withColumnRenamed("vector", "__new").join(stored, key).where("__new <> vector")
            _refuse(other, "stored with another vector", *key)
            fresh = rows.join(stored.select(*key), key, "left_anti")
            return parent if fresh.isEmpty() else self.store.commit(parent, "vectors", {"vectors": fresh})

        return self.store.retried(change)

    def finish(self, snapshots: DataFrame) -> int:
        """Complete ``snapshots`` (snapshot_id): every chunk has its vector and there are as many as registered."""

        def change(parent: int) -> int:
            state = self.state(parent)
            _refuse(snapshots.join(state, "snapshot_id", "left_anti"), "unknown snapshots", "snapshot_id")
            open_ = state.join(snapshots, "snapshot_id", "left_semi").where("not complete")
            _refuse(open_.where("stored <> chunks or vectors <> chunks"), "chunks and vectors differ", "snapshot_id", "chunks", "stored", "vectors")
            if open_.isEmpty():
                return parent
            return self.store.commit(parent, "finish", {"complete": open_.select("snapshot_id", F.lit(parent + 1).cast("long").alias("version"))})

        return self.store.retried(change)

    def state(self, version: int | None = None) -> DataFrame:
        """snapshot_id, IDENTITY, manifest, chunks (registered), stored, vectors and complete."""
        count = lambda table, name: self.store.read(table, version).groupBy("snapshot_id").agg(F.count(F.lit(1)).alias(name))
        rows = self.store.read("snapshots", version).join(count("chunks", "stored"), "snapshot_id", "left").join(count("vectors", "vectors"), "snapshot_id", "left")
        done = self.store.read("complete", version).select("snapshot_id", F.lit(True).alias("complete"))
        return rows.join(done, "snapshot_id", "left").fillna(0, ["stored", "vectors"]).fillna(False, ["complete"])
