"""The audit against exact sums over all kept terms, on odd tables, and its joint histograms."""

import collections
import random
import re

import pytest
from pyspark.sql import functions as F

from evalbench.llm import divergence as dv

SCHEMA = "text string, lang string, source string"


def by_loop(rows, min_docs, k):
    rows = [tuple(x or "" for x in r) for r in rows]
    lower = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    texts = [(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t.translate(lower)), lang, s) for t, lang, s in rows]
    out = []
    for lang in {x[1] for x in rows}:
        df = collections.Counter(t for terms, g, _ in texts if g == lang for t in set(terms))
        kept = [t for t, d in df.items() if d >= min_docs]
        v, known = len(kept), set(kept)
        of = {s: collections.Counter(t for terms, g, x in texts if g == lang and x == s for t in terms if t in known) for s in {s for _, g, s in rows if g == lang}}
        every = sum(of.values(), collections.Counter())
        share = lambda c, t: 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * v)  # noqa: E731, B023
        f = lambda p, q: (p - q) ** 2 // (p + q)
        for s, c in of.items():
            pairs = [(x, sum(f(share(c, t), share(d, t)) for t in kept)) for x, d in of.items() if x != s]
            terms = [(t, f(share(c, t), share(every, t))) for t in kept if c[t] and share(c, t) > share(every, t)]
            for part, found, most in (("pair", pairs, None), ("term", terms, k)):
                ranked = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(ranked)]
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(4)
    words = ["the", "The", "é", "Ünder", "日本", "a1b", "x-y", "zoo", "ok", "tail", "😀", "Straße"]
    out = [(" ".join(r.choices(words, weights=range(1, 13), k=r.randrange(0, 30))), r.choice(["en", "de"]), f"s{r.choice([0, 0, 0, 1, 2, 3])}") for _ in range(160)]
    out += [(None, "en", "s9"), ("the the", None, None), ("", None, "x"), ("rare word", "fr", "s1"), ("rare word", "fr", "s2"), (None, "it", "alone")]
    return out + [out[0]] * 30 + [("hot line again and again", "en", "s0")] * 40


def test_equals_exact_sums(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("old") for c in ("term", "n", "total", "v", "a", "b", "value", "rank", "doc_id")})
    got = sorted(tuple(x) for x in dv.audit(df, min_docs=3, k=4).collect())
    assert got == by_loop(rows, 3, 4)
    assert sum(x[2] == "pair" and x[0] == "fr" and x[4] == 0 for x in got) == 2
    assert dv.audit(df.where("lang = 'none'")).count() == 0


def test_cells_hold_every_kept_term(spark, rows):
    kept = dv.Kept(spark.createDataFrame(rows, SCHEMA), 3)
    cells = dv.cells(kept).collect()
    assert all(x.m >= 0 for x in cells)
    v = {x.lang: x.v for x in kept.groups.collect()}
    sums = collections.Counter()
    for x in cells:
        sums[x.lang, x.a, x.b] += x.m
    assert all(m == v[lang] for (lang, _, _), m in sums.items())
    own = collections.defaultdict(collections.Counter)
    for x in kept.terms.collect():
        own[x.lang, x.source][x.term] = x.n
    for lang, a, b in sums:
        terms = set(own[lang, a]) | set(own[lang, b])
        want = collections.Counter((own[lang, a][t], own[lang, b][t]) for t in terms)
        assert want == collections.Counter({(x.x, x.y): x.m for x in cells if (x.lang, x.a, x.b) == (lang, a, b) and (x.x or x.y) and x.m})


def test_shares_beyond_64_bits(spark):
    row = spark.createDataFrame([(10**15, 3 * 10**15, 10**6)], "n long, total long, v long").select(dv.share("n", "total", "v").alias("p")).first()
    assert row.p == 1 + 10**9 * (10**15 + 2) // (3 * 10**15 + 2 * 10**6)
