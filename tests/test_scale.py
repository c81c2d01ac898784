"""Steps whose memory, shuffle or time grew faster than their input."""

import difflib
import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalbench.functions import text as tx
from evalbench.operators import curate, retrieval, stats, validation
from evalbench.plans import catalog, lifecycle
from evalbench.plans import relations as rel

DATA = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_postings_are_counted_in_their_row(spark):
    rows = [("c1", "d", "b a b"), ("c2", "d", "a, a"), ("c2", "d", "a b"), ("c3", None, ""), ("c4", None, None), ("c5", None, "x"), ("c5", None, "x")]
    tokens = retrieval.tokenised(spark.createDataFrame(rows, "chunk_id string, document_id string, content string"))
    got = sorted((r.term, r.chunk_id, r.length, r.tf) for r in retrieval.postings(tokens).collect())
    assert got == [("a", "c1", 3, 1), ("a", "c2", 2, 3), ("b", "c1", 3, 2), ("b", "c2", 2, 1), ("x", "c5", 1, 2)]
    assert "Exchange" not in physical(retrieval.postings(tokens.where("chunk_id in ('c1', 'c3')")))


@pytest.mark.parametrize("k", [3, None])
def test_bm25_meets_in_tasks_of_bounded_size(spark, monkeypatch, k):
    want = sorted(tuple(r) for r in retrieval.bm25(rel.chunks(spark, DATA), rel.questions(spark, DATA), k).select("question_id", "chunk_id", F.round("score", 6), "rank").collect())
    monkeypatch.setattr(retrieval, "MET_ROWS", 500)
    sizes = []
    met = retrieval.met_by_chunk

    def watched(*args):
        rows = met(*args)
        sizes.extend(r[0] for r in rows.groupBy(F.spark_partition_id()).count().select("count").collect())
        return rows

    monkeypatch.setattr(retrieval, "met_by_chunk", watched)
    got = sorted(tuple(r) for r in retrieval.bm25(rel.chunks(spark, DATA), rel.questions(spark, DATA), k).select("question_id", "chunk_id", F.round("score", 6), "rank").collect())
    assert got == want and len(sizes) > 4 and max(sizes) < 4 * 500


def test_term_postings_meet_by_chunk(spark):
    text = physical(catalog.queries()["j1_terms_postings"](spark, DATA))
    assert "Expand" not in text and text.count("Exchange hashpartitioning") <= 2


def test_evidence_explodes_no_texts(spark):
    assert "Generate" not in plan(rel.evidence(spark, DATA))


def test_evidence_of_queries_of_any_length_and_numbers(spark, tmp_path):
    r = random.Random(12)
    prose = [" ".join("".join(r.choice("abcdeé가") for _ in range(r.randint(1, 7))) for _ in range(40)) for _ in range(12)]
    docs = ["", None, "x", "a 1234,5678 in one two three four five six seven", "Σοφός ΣΑΣ", *prose]
    queries = ["", None, "x", "one two", "34,5678 in one two three four five six", "ΣΑΣ", ", ", *(t[i : i + n] for t in prose for n in (1, 2, 3, 5, 7, 8, 13, 15, 30, 62, 63, 80) for i in (0, 17))]
    spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(docs)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(queries)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = sorted((f"q{i:05d}", f"c{j:08d}") for i, q in enumerate(queries) for j, t in enumerate(docs) if q is not None and t is not None and q in t)
    assert sorted(tuple(x) for x in rel.evidence(spark, str(tmp_path)).collect()) == want


def test_only_found_chunks_are_cut_into_tokens(spark):
    text = plan(lifecycle.hits(spark, DATA))
    assert text.index("regexp_extract_all") < text.index("Join")


def test_draws_are_no_rows(spark):
    rows = [(i, None if i % 9 == 4 else float(i * i % 31), 1.0) for i in range(70)]
    got = stats.bootstrap_observations(spark.createDataFrame(rows, "place long, left double, right double"), 7, 20)
    d = [None if x is None else x - y for _, x, y in rows]
    means = []
    for r in range(20):
        drawn = [d[int(hashlib.md5(f"7:{r}:{k}".encode()).hexdigest()[:8], 16) % 70] for k in range(70)]
        drawn = [x for x in drawn if x is not None]
        means.append(sum(drawn) / len(drawn))
    row = got.first()
    assert np.allclose([row.low, row.high], np.quantile(means, [0.025, 0.975])) and row.rounds == 20
    assert "Join Inner, (place" not in plan(got) and "FlatMapCoGroupsInPandas" in plan(got)


def test_all_pairs_are_products_of_blocks(spark):
    rows = [(i, None if i == 7 else [float(np.float32(np.cos(i * j + 1))) for j in range(8)]) for i in range(90)]
    vectors = spark.createDataFrame([(f"c{i}", v) for i, v in rows], "chunk_id string, vector array<float>")
    queries = spark.createDataFrame([(f"q{i}", v) for i, v in rows if i % 7 == 0], "question_id string, vector array<float>")
    got = {r.question_id: r for r in retrieval.cosine_summary(vectors, queries).collect()}
    v = np.array([x for i, x in rows if i != 7])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    for i, x in rows[::7]:
        r = got[f"q{i}"]
        assert r.pairs == 90
        if x is None:
            assert r.best is None and r["mean"] is None
        else:
            s = v @ (np.array(x) / np.linalg.norm(x))
            assert np.allclose([r.best, r["mean"]], [s.max(), s.mean()])
    assert "Join" not in plan(catalog.queries()["j2_query_vector_pairs"](spark, DATA))


def test_a_snapshot_is_stored_without_a_shuffle_of_its_texts(spark, tmp_path, monkeypatch):
    from evalbench.operators.snapshots import Snapshots
    from evalbench.sources.store import Store

    rows = [("s", f"c{i}", "d", i, 1, "word " * 50) for i in range(20)]
    chunks = spark.createDataFrame(rows, "snapshot_id string, chunk_id string, document_id string, ordinal int, token_count int, content string")
    known = spark.createDataFrame([("s", "c", "m", "x", "n", 4)], "snapshot_id string, corpus string, parse_mode string, strategy string, model_id string, dimension int")
    plans, commit = [], Store.commit

    def watched(self, parent, action, add=None, replace=None):
        plans.append(physical(add["chunks"]))
        return commit(self, parent, action, add, replace)

    monkeypatch.setattr(Store, "commit", watched)
    s = Snapshots(spark, f"file://{tmp_path}/s")
    assert s.create(known, chunks) == s.create(known, chunks) == 1 and len(plans) == 1
    assert "SortMergeJoin" not in plans[0] and "Exchange hashpartitioning" not in plans[0]
    assert s.store.read("chunks").count() == 20
    with pytest.raises(ValueError, match="given twice"):
        s.create(known, chunks.unionByName(chunks.limit(1)))


def test_a_document_is_squashed_before_its_candidates_meet_it(spark):
    text = plan(catalog.queries()["b4_unanswerable_rules"](spark, DATA))
    assert "regexp_replace(lower(translate(whole" not in text.split("Join")[0]


def test_no_candidate_carries_its_document(spark):
    assert "whole" not in plan(catalog.queries()["b4_unanswerable_rules"](spark, DATA))


@pytest.mark.parametrize("block", [3, 16, 1 << 18])
def test_facts_are_found_over_the_ends_of_units_and_blocks(spark, block):
    r = random.Random(block)
    units = [(f"d{i % 3}", i // 12, f"k{i % 12:02d}", "".join(r.choice("ab C,가") for _ in range(r.randint(0, 9))) if i % 7 else None) for i in range(72)]
    facts = [(f"d{r.randrange(4)}", "".join(r.choice("abc가") for _ in range(r.randint(1, 12)))) for _ in range(400)]
    got = validation.facts_in_documents(spark.createDataFrame(facts, "document_id string, fact string"), spark.createDataFrame(units, "document_id string, page int, chunk_id string, content string"), block)
    whole = {d: "".join((u[3] or "").lower().replace(" ", "").replace(",", "") for u in sorted(units, key=lambda u: u[1:3]) if u[0] == d) for d, *_ in units}
    want = sorted({(d, f) for d, f in facts if f in whole.get(d, "")})
    assert sorted(tuple(x) for x in got.collect()) == want and len(want) > 20


def test_an_empty_fact_is_in_every_document_with_text(spark):
    candidates = spark.createDataFrame([(i, "q", False) for i in range(3)], "ord long, question string, answerable boolean")
    changes = spark.createDataFrame([(0, "d", 1, "k", "x", "!"), (1, "e", 1, "k", "x", "!"), (2, "d", 1, "k", "x", None)], "ord long, document_id string, page int, chunk_id string, original string, changed string")
    units = spark.createDataFrame([("d", 1, "k", "x"), ("e", 1, "k", None)], "document_id string, page int, chunk_id string, content string")
    assert sorted(tuple(x) for x in validation.unanswerable(candidates, changes, units).collect()) == [(0, "asserted_absent_fact_present"), (1, "impossible_target_document")]


def test_texts_that_share_a_piece_only_are_no_rows_of_a_join(spark, tmp_path):
    letters, r = "abcdefghijklmnopqrstuvwxyz", random.Random(4)
    texts = ["licensedunderthe" + "".join(r.choice(letters) for _ in range(80)) for _ in range(150)]
    texts.append(texts[7][:50] + texts[7][53:])
    compared = []

    def checkpoint(df):
        path = f"file://{tmp_path}/{len(list(tmp_path.iterdir()))}"
        df.write.parquet(path)
        out = spark.read.schema(df.schema).parquet(path)
        if {"fa", "fb"} <= set(df.columns):
            compared.append(out.count())
        return out

    out = curate.duplicate_groups(spark.createDataFrame(list(enumerate(texts)), "item_id long, question string"), 0.92, checkpoint)
    assert sorted(tuple(x) for x in out.collect()) == [(7, 7, False), (150, 7, True)]
    assert compared and sum(compared) < 20 and "Broadcast" not in physical(out)


def test_letter_bits_bound_what_texts_share(spark):
    r = random.Random(2)
    texts = ["", "a", "가나다가나다", *("".join(r.choice("abcde가나 ") for _ in range(r.randint(1, 90))) for _ in range(40))]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", tx.letter_bits("t").alias("s")).collect()
    held = {x.t: x.s for x in rows}
    for a in texts:
        for b in texts:
            for j, cut in enumerate((list, lambda t: list(zip(t, t[1:], strict=False)))):
                real = sum((Counter(cut(a)) & Counter(cut(b))).values())
                bits = sum(((x & y) & (2**64 - 1)).bit_count() for x, y in zip(held[a][4 * j : 4 * j + 4], held[b][4 * j : 4 * j + 4], strict=True))
                assert real <= bits + min(held[a][8 + j], held[b][8 + j])


def test_units_are_squashed_once_before_spans_meet_them(spark):
    quotes = spark.createDataFrame([(1, "d", 1, "k", "one two"), (2, "d", 1, "k", "x")], "ord long, document_id string, page int, chunk_id string, quote string")
    units = spark.createDataFrame([("d", 1, "k", "One, two, three")], "document_id string, page int, chunk_id string, content string")
    out = validation.evidence(quotes, units)
    text = plan(out)
    assert "regexp_replace" not in text[: text.index("Join")]
    assert [tuple(x) for x in out.collect()] == [(2, "evidence_not_found")]


@pytest.mark.parametrize("n", [1, 7, 10, 33, 64])
def test_windows_are_those_of_a_loop(spark, n):
    r, rows = random.Random(n), []
    for i in range(60):
        text = "".join(r.choice("abcd가") for _ in range(r.choice([0, n - 1, n, 3 * n + 5])))
        at = r.randrange(max(len(text) - n, 0) + 1)
        quote = (text[at : at + n] or "a") if r.random() < 0.6 else "".join(r.choice("abce") for _ in range(n))
        rows.append((i, quote[: n // 2] + r.choice(["", "e", "b"]) + quote[n // 2 + 1 :], text))
    got = {x.i: x.ok for x in spark.createDataFrame(rows, "i int, q string, t string").select("i", tx.nearly_contains(0.85)("q", "t").alias("ok")).collect()}
    for i, q, t in rows:
        places = range(0, len(t) - len(q) + 1, max(1, len(q) // 10))
        assert got[i] == any(difflib.SequenceMatcher(None, q, t[p : p + len(q)]).ratio() >= 0.85 for p in places), (q, t)


def test_bm25_of_all_hits_sorts_no_question_as_a_whole(spark):
    text = physical(catalog.queries()["p4_positive_score"](spark, DATA))
    assert "Window" not in text and "Sort " not in text
