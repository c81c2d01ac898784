import math
import random

import pytest
from pyspark.sql import functions as F

from evalbench.functions import text as tx
from evalbench.operators import context, retrieval


def chunks(spark, rows):
    return spark.createDataFrame(rows, "chunk_id string, document_id string, content string")


def questions(spark, rows):
    return spark.createDataFrame(rows, "question_id string, query string")


def ranking(spark, rows):
    return spark.createDataFrame([("q", c, i + 1, s) for i, (c, s) in enumerate(rows)], "question_id string, chunk_id string, rank int, score double")


def test_tokens_keep_grouped_numbers(spark):
    df = spark.createDataFrame([("Ｚoo: 7,000,300.25 und 88.5%, GROẞ_x 1,23",)], "t string")
    assert df.select(tx.tokens(F.col("t"), unicode_forms=True)).first()[0] == ["zoo", "7,000,300.25", "und", "88.5", "gross", "x", "1", "23"]


def formula(texts, query, k1, b):
    """Scores by the textbook formula over white-space words."""
    words = {i: t.split() for i, t in texts.items()}
    mean = sum(map(len, words.values())) / len(words)
    out = {}
    for i, own in words.items():
        score = 0.0
        for term in dict.fromkeys(query.split()):
            df, tf = sum(term in w for w in words.values()), own.count(term)
            if tf:
                score += math.log(1 + (len(words) - df + 0.5) / (df + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(own) / mean))
        if score:
            out[i] = score
    return out


def test_bm25_equals_the_formula(spark):
    r = random.Random(17)
    words = ["river", "stone", "glass", "paper", "cloud", "ember", "maple"]
    texts = {f"c{i:02d}": " ".join(r.choice(words) for _ in range(r.randint(1, 30))) for i in range(40)}
    asked = {"q1": "river stone river", "q2": "maple", "q3": "absent", "q4": " ; "}
    for k1, b in ((1.2, 0.75), (0.4, 0.0), (2.0, 1.0)):
        hits = retrieval.bm25(chunks(spark, [(i, f"d{int(i[1:]) % 3}", t) for i, t in texts.items()]), questions(spark, list(asked.items())), None, k1, b).collect()
        for q, text in asked.items():
            got = {x.chunk_id: x.score for x in hits if x.question_id == q}
            want = formula(texts, text, k1, b)
            assert set(got) == set(want) and all(got[i] == pytest.approx(want[i], rel=1e-12) for i in got)


def test_bm25_filter_keeps_statistics_and_ties_by_id(spark):
    texts = {"m": "red kite", "b": "red kite", "x": "9,100.75", "y": "9100.75", "k": "blue"}
    c = chunks(spark, [(i, "left" if i in "mx" else "right", t) for i, t in texts.items()])
    q = questions(spark, [("same", "kite"), ("number", "9,100.75")])
    hits = retrieval.bm25(c, q).collect()
    assert [(x.chunk_id, x.rank) for x in sorted((x for x in hits if x.question_id == "same"), key=lambda x: x.rank)] == [("b", 1), ("m", 2)]
    assert [x.chunk_id for x in hits if x.question_id == "number"] == ["x"]
    some = retrieval.bm25(c, q, allowed=spark.createDataFrame([("left",)], "document_id string")).collect()
    whole = {(x.question_id, x.chunk_id): x.score for x in hits}
    assert {(x.question_id, x.chunk_id): x.score for x in some} == {k: v for k, v in whole.items() if k[1] in "mx"}
    for bad in ({"k1": 0}, {"b": 1.5}, {"k": 0}):
        with pytest.raises(ValueError):
            retrieval.bm25(c, q, **bad)


def test_many_terms_are_not_sent_to_all_tasks(spark, monkeypatch):
    c, q = chunks(spark, [("a", "d", "one two"), ("b", "d", "two three three")]), questions(spark, [("q", "two three")])
    want = {x.chunk_id: x.score for x in retrieval.bm25(c, q).collect()}
    monkeypatch.setattr(retrieval, "BROADCAST_ROWS", 0)
    assert {x.chunk_id: x.score for x in retrieval.bm25(c, q).collect()} == pytest.approx(want)


def test_cosine_blocks_equal_all_pairs(spark):
    r = random.Random(9)
    rows = [(f"c{i:03d}", [float(r.randint(-3, 3)) + 0.5 for _ in range(12)]) for i in range(300)]
    rows += [(f"t{i}", rows[7][1]) for i in range(9)]  # ties
    vectors = spark.createDataFrame(rows, "chunk_id string, vector array<float>").repartition(5)
    asked = spark.createDataFrame([(f"q{i}", rows[i * 7][1]) for i in range(6)], "question_id string, vector array<float>")
    for k, prefix in ((4, None), (20, 5), (1000, None)):
        every = retrieval.cosine(vectors, asked, None, prefix).where(F.col("rank") <= k)
        key = lambda df: sorted((x.question_id, x.rank, x.chunk_id, round(x.score, 9)) for x in df.collect())
        assert key(retrieval.cosine(vectors, asked, k, prefix)) == key(every)
    assert retrieval.cosine(vectors.where("chunk_id = ''"), asked, 3).count() == 0


def test_fusion_equals_the_formula(spark):
    r = random.Random(2)
    lists = [r.sample("abcdefghij", n) for n in (6, 4, 9)]
    for k, weights in ((60, None), (5, [0.5, 2.0, 1.0])):
        want = {c: sum(w / (k + x.index(c) + 1) for x, w in zip(lists, weights or [1.0] * 3) if c in x) for c in "abcdefghij" if any(c in x for x in lists)}
        got = retrieval.reciprocal_rank_fusion([ranking(spark, [(c, 1.0) for c in x]) for x in lists], k, weights).orderBy("rank").collect()
        assert {x.chunk_id: x.score for x in got} == pytest.approx(want)
        assert [x.chunk_id for x in got] == sorted(want, key=lambda c: (-round(want[c], 9), c))
    for bad in ({"k": -1}, {"weights": [1.0]}, {"weights": [1.0, 1.0, 0.0]}):
        with pytest.raises(ValueError):
            retrieval.reciprocal_rank_fusion([ranking(spark, [("a", 1.0)])] * 3, **bad)


def test_hybrid_keeps_component_ranks(spark):
    dense, sparse = [("p", 0.7), ("r", 0.6), ("s", 0.2)], [("s", 9.0), ("t", 3.5)]
    got = retrieval.hybrid(ranking(spark, dense), ranking(spark, sparse), 4).orderBy("rank").collect()
    assert {x.chunk_id: (x.dense_rank, x.sparse_rank) for x in got} == {"p": (1, None), "r": (2, None), "s": (3, 1), "t": (None, 2)}
    assert got[0].chunk_id == "s"


def test_scoring_equals_a_loop(spark):
    r = random.Random(23)
    asked = [(f"q{i}", "fact", float(r.randint(1, 50))) for i in range(30)]
    found = [(q, c, i + 1) for q, *_ in asked for i, c in enumerate(r.sample("abcdefgh", r.randint(0, 6)))]
    evidence = [(q, c) for i, (q, *_) in enumerate(asked) if i % 4 for c in r.sample("abcdefgh", r.randint(1, 3))]
    df = lambda rows, schema: spark.createDataFrame(rows, schema)
    row = retrieval.aggregate_retrieval(retrieval.score_rankings(df(asked, "question_id string, question_type string, latency_ms double"), df(found, "question_id string, chunk_id string, rank int"), df(evidence, "question_id string, chunk_id string"), 3)).first()
    recalls, hits, ranks, total = [], [], [], 0
    for q, *_ in asked:
        gold, own = {c for x, c in evidence if x == q}, [c for x, c, _ in found if x == q]
        if gold:
            recalls.append(len(gold & set(own[:3])) / len(gold))
            hits.append(float(bool(gold & set(own[:3]))))
            total += len(gold & set(own[:3]))
            ranks.append(next((1 / (i + 1) for i, c in enumerate(own) if c in gold), 0.0))
    assert (row.questions, row.scorable, row.no_evidence) == (30, len(recalls), 30 - len(recalls))
    mean = lambda x: sum(x) / len(x)
    assert (row.hit, row.macro_recall, row.mrr, row.latency_ms, row.micro_recall) == pytest.approx((mean(hits), mean(recalls), mean(ranks), mean([x[2] for x in asked]), total / len(evidence)))


def test_context_is_a_prefix(spark):
    rows = [("q", "a", 1, 0.9, "x", 5), ("q", "b", 2, 0.8, "y", 50), ("q", "c", 3, 0.7, "z", 1), ("q", "a", 4, 0.1, "x", 5)]
    df = spark.createDataFrame(rows, "question_id string, chunk_id string, rank int, score double, content string, tokens int")
    assert [(r.chunk_id, r.citation_id) for r in context.build_context(df, 20).collect()] == [("a", "C1")]


def test_answer_parse(spark):
    good = '{"answer":"x","citations":["C1"],"abstained":false}'
    df = spark.createDataFrame([(good,), (f"```json\n{good}\n```",), ('{"answer":"x"}',), ("no",), (None,)], "t string")
    assert [r[0] is not None for r in df.select(context.parse_answer(F.col("t"))).collect()] == [True, True, False, False, False]
