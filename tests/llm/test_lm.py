"""The Elias-Fano trie by level and the scores, against plain dictionaries."""

import collections
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalbench.llm import lm


def test_elias_fano_reads_any_range():
    r = random.Random(1)
    for values in ([], [0], [5, 5, 5], sorted(r.sample(range(1 << 60), 1000)), [7] * 9000, sorted(r.randrange(1 << 20) for _ in range(20_000)), list(range(0, 50_000, 3))):
        x = np.array(values, np.uint64)
        ef = lm.EliasFano.view(np.frombuffer(lm.EliasFano.of(x).to_bytes(), np.uint8), 0)[0]
        for _ in range(30):
            a, b = sorted((r.randint(0, len(x)), r.randint(0, len(x))))
            assert (ef.range(a, b) == x[a:b]).all()


@pytest.fixture
def counted():
    r = random.Random(2)
    words = sorted(r.getrandbits(63) for _ in range(40))
    pairs = collections.Counter((r.randrange(40), r.choice(words) >> 32) for _ in range(300))
    triples = collections.Counter(((r.randrange(40), r.choice(words) >> 32), r.choice(words) >> 32) for _ in range(500))
    return words, [r.randint(0, 50) for _ in words], pairs, triples


def built(counted, n=1000, scale=lm.SCALE):
    words, counts, pairs, triples = counted
    contexts = sorted({c for c, _ in triples})
    at = {c: i for i, c in enumerate(contexts)}
    key = lambda rows: np.array([a << 32 | b for a, b in rows], np.uint64)
    order, third = sorted(pairs), sorted((at[c], w) for c, w in triples)
    return lm.TrieShard.build(np.array(words, np.uint64), np.array(counts), key(order), np.array([pairs[x] for x in order]), key(contexts), key(third), np.array([triples[contexts[c], w] for c, w in third]), scale, np.full(len(words), n))


@pytest.mark.parametrize("block", [1, 7, 1 << 18])
def test_each_level_equals_a_dictionary(tmp_path, monkeypatch, counted, block):
    monkeypatch.setattr(lm, "BLOCK", block)
    words, counts, pairs, triples = counted
    with lm.mapped(built(counted), str(tmp_path / "tries")) as trie:
        assert isinstance(trie.triples.codes.base, np.memmap) or isinstance(trie.triples.codes, np.memmap)
        asked = np.array(sorted([*words, 0, 5, (1 << 63) + 1]), np.uint64)
        at = trie.places(asked)
        assert [words[i] if i >= 0 else None for i in at] == [w if w in words else None for w in asked.tolist()]
        assert trie.count(at).tolist() == [dict(zip(words, counts)).get(w, 0) for w in asked.tolist()]
        tails = sorted({w >> 32 for w in words} | {3})
        parents = np.repeat(np.arange(-1, 40), len(tails))
        below = np.tile(np.array(tails, np.uint32), 41)
        code = trie.pairs.code(trie.pairs.places(parents, below))
        assert code.tolist() == [int(lm.quantise(np.array([(pairs[p, t] - lm.DISCOUNT) / 1000]), lm.SCALE)[0]) if (p, t) in pairs else 0 for p, t in zip(parents.tolist(), below.tolist())]
        context = trie.contexts.places(parents, below)
        total, kinds = collections.Counter(), collections.Counter()
        for (c, _), k in triples.items():
            total[c] += k
            kinds[c] += 1
        assert trie.contexts.code(context).tolist() == [int(lm.quantise(np.array([lm.DISCOUNT * kinds[c] / total[c]]), lm.SCALE)[0]) if c in total else 0 for c in zip(parents.tolist(), below.tolist())]
        for i in range(0, len(context), 13):
            c = (int(parents[i]), int(below[i]))
            got = trie.triples.code(trie.triples.places(np.repeat(context[i], len(tails)), np.array(tails, np.uint32)))
            assert got.tolist() == [int(lm.quantise(np.array([(triples[c, t] - lm.DISCOUNT) / total[c]]), lm.SCALE)[0]) if (c, t) in triples else 0 for t in tails]
    assert not list((tmp_path / "tries").iterdir())
    with lm.mapped(built(counted), None) as trie:
        assert trie.words.n == 40


def by_hand(rows, quantised=True):
    """(doc_id, held out, tokens, known tokens, N, base score, score, tokens after heavy words) of each row, from dictionaries.

    Pairs of heavy words are shares of a bound of their count, which depends on chunks; here they are exact.
    """
    code = (lambda p: lm.values(lm.SCALE)[lm.quantise(np.array([p]), lm.SCALE)[0]]) if quantised else (lambda p: p)
    low = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
    tokens = [[w for w in (t or "").translate(low).replace("\t", " ").replace("\n", " ").split(" ") if w] + [0] for _, t in rows]
    train = [zlib.crc32(str(i if i is not None else "").encode()) % 7 != 2 for i, _ in rows]
    one, two, three = (collections.Counter() for _ in range(3))
    for t, ok in zip(tokens, train):
        if ok:
            s = ["S", "S", *t]
            one.update(t)
            two.update(zip(s[1:], s[2:]))
            three.update(zip(s, s[1:], s[2:]))
    n, v, starts = sum(one.values()), len(one), sum(train)
    kinds2, kinds3, total3 = collections.Counter(x for x, _ in two), collections.Counter(x[:2] for x in three), collections.Counter()
    for x, k in three.items():
        total3[x[:2]] += k
    many = {w for w, k in one.items() if k * 2 * lm.HEAVY >= n} | {"S"}  # their weights are exact
    out = []
    for (i, _), t, ok in zip(rows, tokens, train):
        base = full = 0.0
        after = 0
        for a, b, w in zip(["S", "S", *t], ["S", *t], t):
            p = (one[w] + 1) / (n + v + 1)
            base += math.log10(p)
            c = starts if b == "S" else one[b]
            if c:
                weight = lm.DISCOUNT * kinds2[b] / c
                own = (two[b, w] - lm.DISCOUNT) / c if (b, w) in two else 0.0
                after += b in many
                p = (own if b in many or not own else code(own)) + (weight if b in many else code(weight)) * p
            if (a, b) in kinds3:
                own = code((three[a, b, w] - lm.DISCOUNT) / total3[a, b]) if (a, b, w) in three else 0.0
                p = own + code(lm.DISCOUNT * kinds3[a, b] / total3[a, b]) * p
            full += math.log10(min(p, 1.0))
        out.append((i, not ok, len(t), sum(w in one for w in t), n, base, full, after))
    return sorted(out, key=repr)


@pytest.mark.parametrize("n", [1, 10**4, 10**7, 10**8, 10**9, 10**12, 10**15])
def test_terms_keep_their_size_at_any_number_of_tokens(n):
    scale = lm.scale_of(n)
    assert scale == lm.SCALE if n <= 10**7 else scale >= 14
    step = 10 ** (0.5 / scale)
    # a pair seen once after a context of 1,000 or of as many as there are, a bound of it, and all of a context
    terms = np.array([x for c in (1, 1000, n / 1000, n, lm.REFERENCE * n) if c >= 1 for x in ((1 - lm.DISCOUNT) / c, 1 - lm.DISCOUNT / c)])
    back = lm.values(scale)[lm.quantise(terms, scale)]
    assert (back / terms < step * 1.0001).all() and (terms / back < step * 1.0001).all()
    words = np.array([3 << 40, 9 << 40], np.uint64)
    one, none = np.array([1 << 32 | 7], np.uint64), np.zeros(0, np.uint64)
    trie = lm.TrieShard.build(words, np.array([0, 1000]), one, np.array([1]), none, none, np.zeros(0, np.int64), scale)
    got = lm.values(scale)[trie.pairs.code(trie.pairs.places(np.array([1]), np.array([7], np.uint32)))[0]]
    assert got == pytest.approx(2.5e-4, rel=step - 1 + 1e-4)


def texts(r, n):
    some = ["".join(r.choice("abcdefgh") for _ in range(r.randint(1, 4))) for _ in range(60)]
    return [" ".join(r.choice(some) if r.random() < 0.9 else "The" for _ in range(r.randint(0, 90))) for _ in range(n)]


@pytest.mark.parametrize(("chunk", "shard"), [(8 << 20, 8 << 20), (2000, 3000)])
def test_scores(spark, monkeypatch, chunk, shard):
    monkeypatch.setattr(lm, "SHARD_BYTES", shard)
    monkeypatch.setattr(lm, "CHUNK_BYTES", chunk)
    r = random.Random(6)
    rows = list(enumerate(texts(r, 150))) + [(150, None), (151, ""), (152, " \t "), (None, "a the b"), (7, "again the same id"), (153, "new " * 3000), (154, "é日 本\nx")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("chunk", "shard", "blob", "score")}).repartition(5)
    got = sorted(((x.doc_id, x.held_out, x.n_tokens, x.n_known, x.train_tokens, x.base_score, x.score) for x in lm.score(df).collect()), key=repr)
    for quantised in (True, False):
        want = by_hand(rows, quantised)
        assert [x[:5] for x in got] == [x[:5] for x in want]
        for x, y in zip(got, want):
            assert x[5] == pytest.approx(y[5]) and abs(x[6] - y[6]) <= (1e-6 * x[2] + 0.02 * y[7] if quantised else 0.02 * x[2]) + 1e-9
    assert lm.score(df.where("doc_id = -1")).count() == 0


def test_the_model_tells_repeated_texts_apart(spark):
    r = random.Random(8)
    rows = [(i, t) for i, t in enumerate(texts(r, 120)) if len(t.split()) > 10]
    twice = [(i + 1000, t) for i, t in rows[:10]]
    got = {x.doc_id: x for x in lm.score(spark.createDataFrame(rows + twice, "doc_id long, text string")).collect()}
    of = lambda ids: np.mean([got[i].score / got[i].n_tokens for i in ids if not got[i].held_out])
    assert of([i for i, _ in rows[:10]]) > of([i for i, _ in rows[10:]])
