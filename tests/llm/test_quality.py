import random
import tracemalloc

import numpy as np

from evalbench.llm import quality


def test_fit_holds_labelled_counts_sparse(spark):
    r = random.Random(5)
    letters = [chr(i) for i in range(33, 127)]
    rows = [(i, "".join(r.choices(letters if i % 2 else letters[::-1], range(1, 95), k=400))) for i in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, quality int")
    tracemalloc.start()
    try:
        voter = quality.fit(docs, labels)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    used = sum(r.label is not None for r in quality.training_labels(labels).collect())
    dense = used * len(voter.projection) * 4
    assert dense > 12e6 and peak < 2.5 * dense, (peak, dense)  # dense counts, weights and their Gram matrix took 4.1 times as much
    assert np.allclose(voter.projection.T @ voter.projection, np.eye(quality.DIMENSIONS), atol=1e-3)
    out = quality.score(docs, voter, ["doc_id"]).collect()
    assert sum((r.score >= 0.5) == (r.doc_id % 2 == 1) for r in out) > 0.99 * len(rows)


def test_leading_directions_are_those_of_the_whole_matrix():
    r = np.random.RandomState(3)
    for n, rank in ((40, 40), (700, 700), (700, 20)):
        x = r.standard_normal((n, rank)) / np.arange(1, rank + 1)
        gram = x @ x.T
        values, vectors = quality.leading(lambda q, g=gram: g @ q, n, 64)
        want = np.linalg.eigvalsh(gram)[::-1][:64]
        assert np.allclose(values, want, atol=1e-4 * want[0])
        assert np.allclose(vectors.T @ vectors, np.eye(len(values)), atol=1e-8)
        top = min(rank, 15)
        assert np.allclose(gram @ vectors[:, :top], vectors[:, :top] * values[:top], atol=1e-3 * want[0])
