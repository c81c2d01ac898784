"""What depends on all before it, done without one task or the driver holding all: caps, splits, heading stacks, bins, anchors, ranks, draws."""

import collections
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalbench.operators import admission, chunks, curate, retrieval, stats, validation


@pytest.mark.parametrize("block", [3, 17, 10_000])
def test_caps_equal_a_loop(spark, block):
    r = random.Random(block)
    quotas = {"a": 40, "b": 15, "c": 3, "none": 0}
    rows = [(i, i, r.choice(["a", "a", "b", "c", "none", "other", None]), r.choice(["hot"] * 6 + [f"d{j}" for j in range(20)] + [None])) for i in range(500)]
    df = spark.createDataFrame(rows, "candidate_id long, ord long, kind string, document_id string")
    got = {x.candidate_id: x.accepted for x in curate.admit_with_caps(df.repartition(5), quotas, 4, block).collect()}
    used, left, want = collections.Counter(), dict(quotas), {}
    for i, _, kind, document in rows:
        want[i] = used[document] < 4 and left.get(kind, 0) > 0
        if want[i]:
            used[document] += 1
            left[kind] -= 1
    assert got == want and sum(got.values()) > 40


@pytest.mark.parametrize("block", [2, 30])
def test_validator_caps_equal_a_loop(spark, block):
    r = random.Random(block)
    quotas, per_document, per_page = {"fact": 50, "summary": 8}, 5, 2
    rows = []
    for i in range(400):
        places = [(f"d{r.randrange(12) if r.random() < 0.7 else 0}", r.randrange(5)) for _ in range(r.choice([0, 1, 1, 2, 3]))]
        rows.append((i, r.choice(["fact", "summary", "other"]), places))
    clean = spark.createDataFrame(rows, f"ord long, kind string, places {admission.PLACES}")
    kinds, documents, pages, want = collections.Counter(), collections.Counter(), collections.Counter(), {}
    for i, kind, places in rows:
        held = {d for d, _ in places}
        if kinds[kind] >= quotas.get(kind, 0):
            want[i] = "type_quota_exceeded"
        elif any(documents[d] >= per_document for d in held):
            want[i] = "per_document_cap_exceeded"
        elif any(pages[p] >= per_page for p in places):
            want[i] = "per_page_cap_exceeded"
        else:
            kinds[kind] += 1
            documents.update(held)
            pages.update(set(places))
    assert {x.ord: x.rule for x in validation.admitted(clean, quotas, per_document, per_page, block).collect()} == want and len(set(want.values())) == 3


def test_splits_equal_a_loop(spark):
    r = random.Random(3)
    for seed in (1, 2):
        sizes = [r.choice([1, 1, 1, 2, 2, 3, 7, 40]) for _ in range(300)] + [500]
        rows = [(c * 1000 + i, c) for c, n in enumerate(sizes) for i in range(n)]
        out = curate.allocate_splits(spark.createDataFrame(rows, "item_id long, component long"), ["dev", "gold", "holdout"], seed).collect()
        split = {}
        for x in out:
            assert split.setdefault(x.component, x.split) == x.split  # a component stays whole
        assert len(out) == len(rows)
        level, want = dict.fromkeys(["dev", "gold", "holdout"], 0), []
        order = sorted(range(len(sizes)), key=lambda c: (-sizes[c], hashlib.md5(f"{seed}:{c}".encode()).hexdigest()))
        for c in order:
            name = min(level, key=lambda s: (level[s], hashlib.md5(f"{seed}:{s}:{sizes[c]}".encode()).hexdigest()))
            level[name] += sizes[c]
            want.append(name)
        assert [split[c] for c in order] == want


def test_heading_stacks_equal_a_loop(spark):
    r = random.Random(4)
    rows = []
    for d in range(6):
        for i in range(1, 120):
            head = r.random() < 0.5
            rows.append((d, i, "heading" if head else "text", "#" * r.randrange(0, 9) + f" t{i}" if head else f"text {i}"))
    got = {(x.document_id, x.ord): x.section for x in chunks.section_paths(spark.createDataFrame(rows, "document_id long, ord long, kind string, content string")).collect()}
    for d in range(6):
        stack = []
        for _, i, kind, content in (x for x in rows if x[0] == d):
            if kind == "heading":
                level = max(1, min(6, len(content) - len(content.lstrip("#"))))
                stack = [*stack[: level - 1], content.lstrip("#").strip(" ")]
            assert got[d, i] == stack


def test_bins_hold_every_overlap(spark):
    r = random.Random(5)
    blocks, windows = [], []
    for d in range(3):
        at = 0
        for i in range(300):
            n = r.choice([0, 0, 1, 3, 20, 400 if d == 0 else 5])
            blocks.append((d, i, i // 4, at, n))
            at += n
        windows += [(d, k, a, min(a + 50, at)) for k, a in enumerate(range(0, at, 30))]
    w = spark.createDataFrame(windows, "document_id long, ordinal long, token_start long, token_end long")
    b = spark.createDataFrame(blocks, "document_id long, ord long, page long, base long, n_tokens long")
    got = sorted((x.document_id, x.ordinal, x.ord) for x in chunks.overlapping_blocks(w, b, 64).collect())
    assert got == sorted((d, k, i) for d, k, a, z in windows for e, i, _, base, n in blocks if d == e and base + n > a and base < z)


def test_evidence_is_bound_by_anchors(spark):
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcde") for _ in range(r.randint(1, 3)))
    texts = [(f"d{i % 2}", f"c{i:03d}", i % 5, i % 5 + i % 2, " ".join(word() for _ in range(r.randint(1, 60)))) for i in range(120)]
    spans = []
    for i in range(150):
        d, _, a, z, text = r.choice(texts)
        lo = r.randrange(len(text))
        quote = text[lo : lo + r.choice([1, 3, 8, 20, 60, 200])]
        spans.append((f"s{i}", d, r.randint(a, z), quote.upper() if i % 3 else quote + "zz"))
    s = spark.createDataFrame(spans, "span_id string, document_id string, page int, quote string")
    c = spark.createDataFrame(texts, "document_id string, chunk_id string, page_start int, page_end int, content string")
    got = {x.span_id: x.chunk_id for x in retrieval.bind_evidence(s, c).collect()}
    for name, d, page, quote in spans:
        own = [(len(t) - len(quote.lower().strip(" ")), k) for e, k, a, z, t in texts if e == d and a <= page <= z and quote.lower().strip(" ") in t]
        assert got[name] == (min(own)[1] if own else None)
    assert sum(v is not None for v in got.values()) > 90


def test_ranks_by_one_sort(spark):
    r = random.Random(7)
    rows = [(r.choice(["x", "x", "y", None]), r.randrange(9), r.random()) for _ in range(400)]
    got = {x.g: x.rho for x in stats.spearman(spark.createDataFrame(rows, "g string, a int, b double"), ["g"], "a", "b").collect()}
    for g in ("x", "y", None):
        a, b = (np.array([row[k] for row in rows if row[0] == g]) for k in (1, 2))
        mid = lambda v: np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v])
        assert got[g] == pytest.approx(np.corrcoef(mid(a), mid(b))[0, 1])


def test_draws_by_a_tree(spark):
    r = np.random.RandomState(8)
    d = np.concatenate([r.randn(900), r.randn(100) * 5 + 1])
    df = spark.createDataFrame([(i, float(x), 1) for i, x in enumerate(d)], "place long, s double, n long")
    a, b = stats.bootstrap_tree(df, 3, 400, 64).first(), stats.bootstrap_tree(df.repartition(7), 3, 400, 64).first()
    assert list(a) == pytest.approx(list(b)) and a.rounds == 400 and a.effect == pytest.approx(d.mean())
    means = np.array([d[r.randint(0, 1000, 1000)].mean() for _ in range(4000)])
    low, high = np.percentile(means, [2.5, 97.5])
    assert abs(a.low - low) < 0.25 * (high - low) and abs(a.high - high) < 0.25 * (high - low) and 0.8 < (a.high - a.low) / (high - low) < 1.2
    # every round draws as many as there are: with s = 1 the statistic is the same in each
    ones = spark.createDataFrame([(i, 1.0, 1) for i in range(777)], "place long, s double, n long")
    one = stats.bootstrap_tree(ones, 1, 50, 100).first()
    assert (one.low, one.high) == (1.0, 1.0)
    weighed = spark.createDataFrame([(i, float(i % 5), 1 + i % 5) for i in range(200)], "place long, s double, n long")
    assert stats.bootstrap_tree(weighed, 1, 300, 50).first().low < 0.67 < stats.bootstrap_tree(weighed, 1, 300, 50).first().high
