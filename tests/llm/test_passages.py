"""Repeated passages against planted ones and brute force."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from evalbench.llm import passages


def words(n, r):
    return ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 8))) for _ in range(n)]


def found(spark, texts):
    rows = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    out = {}
    for x in passages.passages(rows).collect():
        out.setdefault(x.doc_id, []).append((x.start_word, x.end_word))
    return {i: sorted(v) for i, v in out.items()}


@pytest.mark.parametrize(("length", "changes"), [(54, ["swap"]), (56, ["drop"]), (56, ["add"]), (120, ["swap", "swap"]), (120, ["drop", "add"]), (300, ["swap"] * 6)])
def test_edited_passages_are_found(spark, length, changes):
    r = random.Random(length)
    texts = []
    for k in range(60):
        one = words(length, r)
        two = list(one)
        for n, change in enumerate(changes):
            at = length * (n + 1) // (len(changes) + 1)
            two[at : at + (change != "add")] = [] if change == "drop" else [f"new{k}"]
        texts += [words(40, r) + one + words(30, r), words(25, r) + two + words(60, r)]
    got = found(spark, texts)
    assert len(got) >= 0.95 * len(texts)
    assert all(spans[0][0] in range(25, 48) and spans[-1][1] - spans[0][0] >= 0.8 * length for spans in got.values())


def test_passages_whose_halves_others_quote(spark):
    """Pairs of a passage with a word changed in its middle, among texts that quote one half of it, which is no passage."""
    r = random.Random(12)
    texts, pairs = [], []
    for k in range(30):
        one = words(54, r)
        two = [*one[:27], f"new{k}", *one[28:]]
        pairs += [len(texts), len(texts) + 1]
        texts += [words(40, r) + one + words(30, r), words(25, r) + two + words(60, r)]
        texts += [words(30, r) + (one[:27] if i % 2 else one[28:]) + words(35, r) for i in range(16)]
    got = found(spark, texts)
    assert sum(i in got for i in pairs) >= 0.9 * len(pairs)
    assert len(set(got) - set(pairs)) <= 0.02 * len(texts)


def test_same_documents_as_all_pairs(spark):
    """Equal stretches of 50 words, by comparing all pairs; with lines that fall short of a passage in a third of all texts, at several places of one text."""
    r = random.Random(4)
    line, shared = words(35, r), [words(r.randint(44, 70), r) for _ in range(12)]
    texts = []
    for i in range(150):
        parts = [words(r.randint(5, 40), r)]
        for _ in range(r.randint(0, 3)):
            parts += [r.choice(shared) if r.random() < 0.3 else words(r.randint(5, 30), r)]
        if i % 3 == 0:
            parts += [words(3, r), line, words(4, r), line, words(9, r)]
        if i % 25 == 0:  # the line with more before or after it
            parts += [["k1", "k2", "k3", *line, *shared[0][:20]]] if i % 2 else [[*shared[1][-20:], *line, "k4"]]
        texts.append([w for p in parts for w in p])
    grams = [{tuple(t[i : i + 50]) for i in range(len(t) - 49)} for t in texts]
    want = {i for a, b in itertools.combinations(range(len(texts)), 2) if grams[a] & grams[b] for i in (a, b)}
    got = found(spark, texts)
    assert 20 < len(want) < 140 and want <= set(got)
    for i in set(got) - want:  # similar, not equal
        a, b = got[i][0]
        assert b - a >= 50
    assert len(set(got) - want) <= 0.1 * len(texts)


def test_a_passage_at_two_places(spark):
    r = random.Random(9)
    shared = words(60, r)
    texts = [words(20, r) + shared + words(30, r), words(10, r) + shared[5:40] + words(30, r) + shared + words(8, r) + shared]
    got = found(spark, texts)
    assert got[0] == [(20, 80)] and [x for x in got[1] if x[1] - x[0] >= 60] == [(75, 135), (143, 203)]


def test_odd_rows(spark):
    r = random.Random(2)
    long, short = " ".join(words(60, r)), " ".join(words(49, r))
    rows = [(1, long), (2, long), (1, long), (3, short), (4, short), (5, None), (6, ""), (None, long), (7, " ".join(["same"] * 3000)), (8, " ".join(["same"] * 400))]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("bucket", "place", "leader", "words")})
    got = passages.passages(df).collect()
    assert {x.doc_id for x in got} == {1, 2, 7, 8} and {(x.start_word, x.end_word) for x in got if x.doc_id < 3} == {(0, 60)}
    assert passages.passages(df.where("doc_id = 0")).count() == 0
