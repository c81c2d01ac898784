"""Snapshots: registered once, refused changes, resumed vectors, complete only with all of them."""

import pytest
from pyspark.sql import functions as F

from evalbench.operators.snapshots import Snapshots

SNAPSHOTS = "snapshot_id string, corpus string, parse_mode string, strategy string, model_id string, dimension int"
CHUNKS = "snapshot_id string, chunk_id string, document_id string, ordinal int, token_count int, content string"
VECTORS = "snapshot_id string, chunk_id string, vector array<float>"


@pytest.fixture
def made(spark, tmp_path):
    s = Snapshots(spark, f"file://{tmp_path}/s")
    known = spark.createDataFrame([(i, "c", "standard", "fixed", "m", 2) for i in ("s1", "s2")], SNAPSHOTS)
    chunks = spark.createDataFrame([(i, f"{i}-{k}", "d", k, 3, f"text {k}") for i in ("s1", "s2") for k in range(4)], CHUNKS)
    return s, known, chunks


def vectors(spark, *rows):
    return spark.createDataFrame([(i, f"{i}-{k}", v) for i, k, v in rows], VECTORS)


def test_a_snapshot_is_created_once(spark, made):
    s, known, chunks = made
    assert s.create(known, chunks) == 1 and s.create(known, chunks.orderBy(F.rand(1))) == 1
    with pytest.raises(ValueError, match="identity"):
        s.create(known.withColumn("dimension", F.lit(3)), chunks)
    for other in (chunks.where("chunk_id <> 's1-2'"), chunks.withColumn("content", F.when(F.col("chunk_id") == "s1-2", "else").otherwise(F.col("content"))), chunks.withColumn("token_count", F.lit(4))):
        with pytest.raises(ValueError, match="other chunks"):
            s.create(known, other)
    with pytest.raises(ValueError, match="twice"):
        s.create(known, chunks.unionByName(chunks))
    with pytest.raises(ValueError, match="no snapshot"):
        s.create(known.where("snapshot_id = 's1'"), chunks)
    more = known.where("snapshot_id = 's1'").withColumn("snapshot_id", F.lit("s3"))
    assert s.create(more, chunks.where("false")) == 2
    assert s.store.read("chunks").count() == 8 and s.finish(more.select("snapshot_id")) == 3  # of no chunks: complete at once


def test_vectors_resume_and_complete(spark, made):
    s, known, chunks = made
    s.create(known, chunks)
    assert s.add(vectors(spark, ("s1", 0, [1.0, 0.0]), ("s1", 1, [0.5, 0.5]))) == 2
    assert s.add(vectors(spark, ("s1", 0, [1.0, 0.0]))) == 2  # stored already
    for rows, problem in (([("s1", 0, [1.0, 0.1])], "another vector"), ([("s1", 9, [1.0, 0.0])], "no such chunk"), ([("s1", 2, [1.0])], "no vector"), ([("s1", 2, [0.0, 0.0])], "no vector"), ([("s1", 2, [float("nan"), 1.0])], "no vector"), ([("s1", 2, None)], "no vector"), ([("s1", 2, [1.0, 2.0])] * 2, "twice")):
        with pytest.raises(ValueError, match=problem):
            s.add(vectors(spark, ("s1", 3, [1.0, 1.0]), *rows))
    assert s.store.version() == 2  # nothing of a refused batch is stored
    assert sorted(r.chunk_id for r in s.pending().where("snapshot_id = 's1'").collect()) == ["s1-2", "s1-3"]
    with pytest.raises(ValueError, match="differ"):
        s.finish(known.select("snapshot_id").where("snapshot_id = 's1'"))
    s.add(s.pending().where("snapshot_id = 's1'").select("snapshot_id", "chunk_id", F.array(F.lit(1.0), F.lit(2.0)).alias("vector")))
    done = s.finish(known.select("snapshot_id").where("snapshot_id = 's1'"))
    state = {r.snapshot_id: (r.chunks, r.vectors, r.complete) for r in s.state().collect()}
    assert state == {"s1": (4, 4, True), "s2": (4, 0, False)} and not any(r.complete for r in s.state(done - 1).collect())
    assert s.finish(known.select("snapshot_id").where("snapshot_id = 's1'")) == done
    with pytest.raises(ValueError, match="do not change"):
        s.add(vectors(spark, ("s1", 0, [1.0, 0.0])))
    with pytest.raises(ValueError, match="unknown"):
        s.finish(spark.createDataFrame([("s9",)], "snapshot_id string"))
