"""The index against brute force: exact search, recall of calibrated probes, hot lists, odd vectors, reopening."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalbench.operators import index as ix
from evalbench.operators import retrieval as op

SCHEMA = "chunk_id string, vector array<float>"


@pytest.fixture(scope="module")
def clustered(spark):
    r = np.random.RandomState(1)
    centres = r.randn(20, 16) * 3
    v = np.concatenate([centres[i % 20] + r.randn(16) for i in range(1500)]).reshape(-1, 16).astype(np.float32)
    rows = [(f"c{i:05d}", [float(x) for x in v[i]]) for i in range(1500)]
    rows += [(f"t{i:05d}", rows[3][1]) for i in range(700)]  # a hot list: a third of all rows
    odd = [("n1", None), ("n2", [0.0] * 16), ("n3", [float("nan")] * 16), ("n4", [1.0] * 15), ("n5", [None] * 16)]
    return spark.createDataFrame(rows + odd, SCHEMA), rows


@pytest.fixture(scope="module")
def index(clustered, tmp_path_factory):
    return ix.build(clustered[0], f"file://{tmp_path_factory.mktemp('index')}/ix", dim=16)


@pytest.fixture(scope="module")
def queries(clustered):
    return clustered[0].where("chunk_id like 'c%7' or chunk_id in ('n1', 'n4')").withColumnRenamed("chunk_id", "question_id")


def by_loop(rows, k=10):
    names, v = [n for n, _ in rows], np.array([x for _, x in rows], np.float32).astype(float)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    out = {}
    for i, name in enumerate(names):
        if name.startswith("c") and name.endswith("7"):
            s = np.round(v @ v[i], op.TIE_DECIMALS)
            out[name] = sorted(zip(-s, names))[:k]
    return out


def test_exact_search_equals_brute_force(clustered, index, queries, monkeypatch):
    monkeypatch.setattr(ix, "ROW_BLOCK", 100)
    monkeypatch.setattr(ix, "QUERY_BLOCK", 7)
    want = by_loop(clustered[1])
    got = {}
    for x in ix.search(index, queries, 10, probes=2, exact=True).collect():
        got.setdefault(x.question_id, []).append((x["rank"], x.chunk_id))
    assert {q: [c for _, c in sorted(hits)] for q, hits in got.items()} == {q: [n for _, n in hits] for q, hits in want.items()}


def test_calibrated_probes_reach_the_recall(spark, clustered, index, queries):
    others = clustered[0].where("chunk_id like 'c001%' or chunk_id like 'c004%'").withColumnRenamed("chunk_id", "question_id")
    probes = ix.calibrated(index, others, 10, 0.95)
    exact = ix.search(index, queries, 10, exact=True)
    total = ix.recall(ix.search(index, queries, 10, probes), exact).agg(F.sum("found"), F.sum("wanted")).first()
    assert total[1] == 1500 and total[0] >= 0.9 * total[1] and probes < index.lists / 3


def test_every_valid_row_is_filed_once(spark, clustered, index):
    rows = index.rows(spark)
    assert rows.count() == rows.select("chunk_id").distinct().count() == len(clustered[1]) == index.sizes.sum()
    again = ix.opened(spark, index.path)
    assert np.array_equal(again.centroids, index.centroids) and again.least.tolist() == index.least.tolist()
    near = {r.chunk_id: r["list"] for r in rows.collect()}
    v = np.array([x for _, x in clustered[1]])
    cosine = (v / np.linalg.norm(v, axis=1, keepdims=True)) @ index.centroids.T
    for (name, _), c in zip(clustered[1], cosine):
        assert near[name] == c.argmax() and c.max() >= index.least[near[name]] - 1e-9


def test_random_vectors_of_the_tables(spark, tmp_path):
    from evalbench.plans import catalog
    from evalbench.plans import relations as rel

    sf = "/root/testdata/sf0.01"
    exact = op.cosine(rel.vectors(spark, sf), rel.query_vectors(spark, sf), 10)
    total = ix.recall(catalog.queries()["r6_index_search"](spark, sf), exact.select("question_id", F.round("score", 6).alias("score"))).agg(F.sum("found"), F.sum("wanted")).first()
    assert total[0] >= 0.9 * total[1]


def test_empty_tables_and_arguments(spark, clustered, index, queries, tmp_path):
    none = ix.build(clustered[0].where("chunk_id = 'n1'"), f"file://{tmp_path}/none")
    assert ix.search(none, queries, 5).count() == 0 and none.rows(spark).count() == 0
    assert ix.search(index, queries.where("false"), 5, exact=True).count() == 0
    with pytest.raises(ValueError):
        ix.search(index, queries, 0)
