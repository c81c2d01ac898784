"""Each operator against brute force, and on nulls, empty and long texts, ties, repeats, empty tables and clashing columns."""

import collections
import hashlib
import itertools
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalbench.llm import _text as T
from evalbench.llm import bpe, html, media, mixing, neardup, passages, quality, secrets, topk

#: A small table with every odd case; columns that operators use inside come with other content.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, h string, size string, bucket string, component string"


def prose(n, seed=0):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 8))) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    texts = [None, "", "   ", "word", "The same text twice", "The same text twice", prose(300, 1), prose(20000, 2), "é日本 " * 40, "<|endoftext|> x", prose(60, 3), prose(60, 3)]
    rows = [(i, t, "en", [None, "a", "b"][i % 3], len(t or ""), "s", "h", "z", "b", "c") for i, t in enumerate(texts)]
    rows += [(20, prose(50, 4), None, None, None, None, None, None, None, None), (None, prose(30, 5), "de", "a", 3, "", "", "", "", ""), rows[6]]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("doc_id = -1")


def test_words_and_shingles():
    import pyarrow as pa

    texts = ["Ab  c", "", None, "x\ty\nz w v u", "ab c"]
    data, off = T.utf8(pa.array(texts))
    starts, ends, first = T.words(data, off)
    assert [bytes(data[a:b]).decode() for a, b in zip(starts, ends)] == ["Ab", "c", "x", "y", "z", "w", "v", "u", "ab", "c"]
    h = T.word_hashes(data, starts, ends)
    s, at = T.shingles(h, first)
    assert np.diff(at).tolist() == [1, 0, 0, 2, 1] and s[0] == s[-1] and len(s) == 4


# ---- 1


def test_topk_is_exact(spark):
    r = random.Random(3)
    rows = [(i, [round(r.uniform(-1, 1), 2) for _ in range(16)], "x") for i in range(400)]
    rows += [(500 + i, rows[5][1], "x") for i in range(30)]  # ties
    rows += [(900, None, "x"), (901, [None] * 16, "x"), (902, [float("nan")] * 16, "x"), (903, [0.1] * 8, "x"), (904, [], "x"), (400, [0.5] * 16, "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")
    got = collections.defaultdict(list)
    for x in topk.top_k(df, df.where("vec_id % 100 = 0"), 10).orderBy("query_id", "rank").collect():
        got[x.query_id].append((x.vec_id, x.score))
    floor = {i: [math.floor(1024 * float(np.float32(x))) for x in v] for i, v, _ in rows if v and all(x is not None and x == x for x in v)}
    for q in (0, 100, 200, 300, 400):
        want = sorted(((i, sum(a * b for a, b in zip(floor[q], v))) for i, v in floor.items() if i != q and len(v) == 16), key=lambda p: (-p[1], p[0]))[:10]
        assert got[q] == want
    assert set(got) == {0, 100, 200, 300, 400, 500}
    assert topk.top_k(df.where("vec_id < 0"), df.where("vec_id < 0")).count() == 0


def test_topk_of_ids_on_several_rows(spark):
    rows = [(0, [0.5, 0.5]), (0, [0.25, 0.9]), (1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.1, 0.1]), (100, [0.3, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit("x") for c in ("rank", "score", "query_id")})
    got = sorted((x.query_id, x["rank"], x.vec_id, x.score) for x in topk.top_k(df, df.where("vec_id % 100 = 0")).collect())
    # a query id is asked once, by its least vector, and its rows are no candidates; other repeated rows each count
    floor = lambda v: [math.floor(1024 * float(np.float32(x))) for x in v]
    score = lambda a, b: sum(x * y for x, y in zip(floor(a), floor(b)))
    want = []
    for q, v in ((0, [0.25, 0.9]), (100, [0.3, 0.0])):
        found = sorted(((-score(v, x), i) for i, x in rows if i != q))
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found)]
    assert got == sorted(want)


# ---- 2


def test_secret_base_patterns():
    text = 'x PassWord = "abc123" token: abc api-key api_key=\'Zz/+.=-_9\' AKIA' + "A" * 16 + " AKIA1 " + "0a" * 12 + " " + "f" * 23
    spans = secrets.base_spans(text)
    assert [k for *_, k in spans] == ["assign", "assign", "access", "hex"]
    assert text[spans[0][0] : spans[0][1]] == 'PassWord = "abc123'
    assert secrets.base_spans("") == [] and secrets.base_spans("\u017fecret=abcdefgh to\u212aen=abcdefgh") == []


def test_secret_network_on_held_out_findings():
    net = secrets.trained()
    x, y, of = secrets.labelled_parts(secrets.labelled_findings(1200, seed=99))
    first = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
    p, y = np.maximum.reduceat(net.probability(x), first) >= net.threshold, np.maximum.reduceat(y, first)
    assert p[y == 1].mean() > 0.97 and p[y == 0].mean() < 0.05


def test_secret_table(docs, empty, spark):
    rows = secrets.find(docs).collect()
    assert len(rows) == docs.count() and all(r.base_sha256 == hashlib.sha256(b"").hexdigest() for r in rows if r.doc_id in (0, 1, 2))
    secret = spark.createDataFrame([(1, 'a token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" b', "x"), (2, None, "x"), (3, "clean text", "x")], "doc_id long, text string, spans string")
    out = {r.doc_id: r.text for r in secrets.redact(secret).collect()}
    assert out == {1: 'a [SECRET]" b', 2: None, 3: "clean text"}
    assert secrets.find(empty).count() == 0 and secrets.redact(empty).columns == empty.columns


# ---- 3


def test_main_text():
    page = '<html><head><title>t</title></head><body><nav><ul><li><a href="/a">menu</a></li></ul></nav><div class="cookie-notice"><p>We use cookies.</p></div><article><h1>Head &amp; line</h1><p><b>First  part.<br><p>Second\n part, long enough to be read as such.</p><div class="ad">Buy this now.</div></article><section id="comments"><p>Nice one, I say.</p></section><footer>&copy; me</footer></body></html>'
    assert next(html.extract([page], html.trained())) == "Head & line\n\nFirst part.\n\nSecond part, long enough to be read as such."


def test_main_text_of_held_out_pages():
    pages = html.labelled_pages(120, seed=321)
    exact = 0
    for page, _ in pages:
        want = [t for t in html.parse(page).runs.values() if t.startswith("X")]
        exact += next(html.extract([page], html.trained())).split("\n\n") == want
    assert exact / len(pages) > 0.93


def test_messages_equal_enumeration():
    model, tree = html.trained(), html.parse("<div><p>one two</p><nav><a>x</a></nav></div>")
    forest = html.Forest([tree])
    n, own = len(forest.kind), forest.features @ model.node
    total, marginal = 0.0, np.zeros(n)
    for labels in itertools.product((0, 1), repeat=n):
        w = math.exp(sum(own[i] for i in range(n) if labels[i]) + sum(model.pair[forest.kind[i], labels[forest.parent[i]], labels[i]] for i in range(1, n)))
        total += w
        marginal += w * np.array(labels)
    assert np.allclose(model.infer(forest)[0][:, 1], marginal / total)


def test_broken_pages(spark):
    rows = [(1, "u", None), (2, "u", ""), (3, "u", "<div" * 500), (4, "u", "<p>" * 3000 + "x"), (5, "u", "a < b &am <")]
    out = html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(out) == 5 and all(r.n_chars == len(r.text) for r in out)
    assert [r.text for r in out if r.page_id < 3] == ["", ""]


# ---- 4


def test_targets_and_mixture(docs, empty, spark):
    rows = [(i, " ".join(["w"] * (i % 7 + 1)), ["a", "b", "c", None][0 if i % 3 == 0 else i % 4], None) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size string")
    small = mixing.measured(df, 1).select("doc_id", "source", F.col("__size").alias("size"), F.col("__h").alias("h"))
    out = mixing.decide(small).collect()
    assert len(out) == len(rows)
    by = collections.defaultdict(lambda: [0, 0, 0.0])
    for r in out:
        copies = len(r.shards)
        assert copies <= 3
        by[r.source][0] += r.size
        by[r.source][1] += r.size * copies
        by[r.source][2] = r.target
    total = sum(x[0] for x in by.values())
    names = sorted((s for s in by if s), key=str.encode) + [None]
    weight, capped = {s: i % 3 + 1 for i, s in enumerate(names)}, {}
    while True:
        left, wsum = total - sum(capped.values()), sum(weight[s] for s in names if s not in capped)
        over = {s: 3 * by[s][0] for s in names if s not in capped and left * weight[s] / wsum > 3 * by[s][0]}
        if not over:
            break
        capped |= over
    for s in names:
        assert by[s][2] == pytest.approx(capped.get(s, left * weight[s] / wsum))
        assert abs(by[s][1] - by[s][2]) <= 7
    assert sorted(map(str, out)) == sorted(map(str, mixing.decide(small).collect()))
    mixed = mixing.mix(docs)
    assert mixed.columns == [*docs.columns, "mix_shard", "mix_key"] and mixing.mix(empty).count() == 0


def test_hypergeometric_moments(spark):
    for total, good, drawn in ((50, 20, 25), (10, 9, 5), (4000, 1000, 2000)):
        u = f"(shiftrightunsigned(xxhash64(id), 11) * {2.0**-53!r}D)"
        x = np.array([r.x for r in spark.range(4000).selectExpr(mixing.hypergeometric(f"{total}L", f"{good}L", f"{drawn}L", u) + " as x").collect()])
        mean = drawn * good / total
        var = mean * (1 - good / total) * (total - drawn) / (total - 1)
        assert abs(x.mean() - mean) < 5 * (var / 4000) ** 0.5 and 0.85 < x.var() / var < 1.15


# ---- 5


def test_bpe_is_the_library(docs, empty):
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(bpe.vocabulary_path())
    library.no_truncation()
    library.no_padding()
    r = random.Random(2)
    texts = ["".join(r.choice("abcdeThe  \n\t'sréß日1 2!.<|>\x1c") for _ in range(r.randint(0, 50))) for _ in range(3000)] + ["", "<|endoftext|>", " <|endoftext|> a", "x" * 3000, "I'll they're"]
    own = bpe.TrieBPE(bpe.vocabulary_path())
    for text, want, got in zip(texts, library.encode_batch(texts, add_special_tokens=False), own.encode_batch(texts)):
        ids = np.frombuffer(got, "<u4").tolist()
        assert ids == want.ids and own.decode(ids) == library.decode(ids, skip_special_tokens=False)
    rows = {r.doc_id: r for r in bpe.digests(docs).collect()}
    assert rows[0].n_tokens == 0 and rows[0].decoded_sha256 == hashlib.sha256(b"").hexdigest()
    back = bpe.decode(bpe.encode(docs.select("doc_id", "text"))).collect()
    assert all(r.decoded == (r.text or "") for r in back)
    assert bpe.digests(empty).count() == 0


# ---- 7


def test_compact_windows_cover_every_stretch():
    h = np.random.RandomState(1).randint(0, 1 << 62, 200).astype(np.uint64)
    starts, least = passages.compact_windows(h, np.array([0, 70, 75, 200]), 20)
    assert starts.tolist() == [*range(51), *range(75, 181)]
    assert least.tolist() == [i + int((h[i : i + 20] >> np.uint64(8)).argmin()) for i in starts]


def test_repeated_passages(spark, docs, empty):
    shared, line = prose(55, 70), prose(25, 71)
    rows = [(i, " ".join([prose(80 + i, 100 + i), shared if i < 3 else line, prose(60, 200 + i)]), "x") for i in range(40)]
    rows += [(100, prose(120, 9), "x"), (101, prose(120, 9), "x"), (102, None, "x"), (103, "", "x")]
    got = {r.doc_id: (r.start_word, r.end_word) for r in passages.passages(spark.createDataFrame(rows, "doc_id long, text string, bucket string")).collect()}
    assert set(got) == {0, 1, 2, 100, 101}
    assert got[1] == (81, 136) and got[100] == (0, 120)
    assert {r.doc_id for r in passages.passages(docs).collect()} == {10, 11} and passages.passages(empty).count() == 0


# ---- 8


def test_near_duplicates(spark, docs, empty):
    base = prose(200, 1).split()
    edited = lambda *at: " ".join("zz" if i in at else w for i, w in enumerate(base))
    rows = [(1, edited(), "x"), (2, edited(50), "x"), (3, edited(*range(0, 200, 8)), "x"), (4, edited().upper().replace(" ", "  "), "x"), (5, prose(200, 2), "x"), (6, None, "x"), (7, "", "x"), (8, "a b", "x"), (9, "A  b", "x"), (10, "a b c", "x"), (None, edited(), "x")]
    got = {r.doc_id: r.class_id for r in neardup.classes(spark.createDataFrame(rows, "doc_id long, text string, bucket string")).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 1, 5: 5, 6: 6, 7: 7, 8: 8, 9: 8, 10: 10, None: None}
    assert neardup.classes(empty).count() == 0
    kept = neardup.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [0, 1, 2, 3, 4, 6, 7, 8, 9, 10, 20]


def test_ids_on_several_texts(spark):
    a, b, c = prose(80, 1), prose(80, 2), prose(80, 3)
    near = " ".join(["zz", *b.split()[1:]])
    rows = [(5, a), (5, b), (6, c), (7, near), (7, a.upper()), (5, a), (None, a)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("first", F.lit("x"))
    assert sorted(((r.doc_id, r.text) for r in neardup.keep_one(df).collect()), key=repr) == sorted([(5, a), (5, b), (6, c), (None, a)], key=repr)
    assert collections.Counter((r.doc_id, r.class_id) for r in neardup.classes(df).collect()) == {(5, 5): 3, (6, 6): 1, (7, 5): 2, (None, None): 1}


def test_scores_do_not_depend_on_ids(spark):
    texts = [prose(30 + i % 5, i % 12) for i in range(60)]  # many equal texts with both labels
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 3 != 1][:60]
    out = []
    for names in (ids, ids[::-1]):
        df = spark.createDataFrame(list(zip(names, texts)), "doc_id long, text string")
        labels = spark.createDataFrame([(n, i // 7 % 2) for i, n in enumerate(names)], "doc_id long, quality int")
        out.append({r.text: r.score for r in quality.score(df, quality.fit(df, labels)).collect()})
    assert out[0] == out[1]
    twice = spark.createDataFrame([(ids[0], texts[0]), (ids[0], texts[1]), (ids[1], texts[2])], "doc_id long, text string")
    labels = spark.createDataFrame([(ids[0], 1), (ids[1], 0)], "doc_id long, quality int")
    votes = [sorted((r.text, r.score) for r in quality.score(twice, quality.fit(twice.repartition(n), labels)).collect()) for n in (1, 3)]
    assert votes[0] == votes[1]


def test_large_group_stays_linked(spark):
    base, r = prose(150, 3).split(), random.Random(1)
    rows = [(0, " ".join(base))]
    for i in range(1, 150):
        words = list(base)
        for _ in range(r.randint(1, 2)):
            words[r.randrange(150)] = f"e{i}"
        rows.append((i, " ".join(words)))
    got = [r.class_id for r in neardup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert collections.Counter(got)[0] == 150


def brute_classes(texts, idf):
    """Classes by all pairs; ``idf`` of a number of documents."""
    grams = [collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) for w in (t.split() for t in texts)]
    df = collections.Counter(g for c in grams for g in c)
    weights = [{g: n * idf(df[g]) for g, n in c.items()} for c in grams]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        a, b = weights[i], weights[j]
        shared = sum(min(w, b[g]) for g, w in a.items() if g in b)
        if shared >= 0.8 * (sum(a.values()) + sum(b.values()) - shared):
            p, q = sorted((find(i), find(j)))
            root[q] = p
    return {i: find(i) for i in range(len(texts))}


def test_large_buckets_lose_no_link(spark):
    r, base = random.Random(8), prose(120, 6).split()
    texts = []
    for _ in range(9):  # families of edited copies, each unlike the base and the other families
        own = [f"f{r.random()}" if r.random() < 0.06 else w for w in base[: r.randint(80, 120)]]
        for _ in range(60):
            at = set(r.sample(range(len(own)), r.randint(1, 3)))
            texts.append(" ".join(f"e{r.randrange(30)}" if i in at else w for i, w in enumerate(own)))
    weigh = neardup.Weights(np.zeros(0, np.uint64), np.zeros(0))
    want = brute_classes(texts, lambda df: 1)
    assert len(set(want.values())) > 9
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.id: x.component for x in neardup.links(rows, rows.selectExpr("7L as bucket", "doc_id"), weigh).collect()}
    assert {i: got.get(i, i) for i in want} == want


def test_many_near_copies_have_the_classes_of_all_pairs(spark):
    r, base = random.Random(12), prose(200, 15).split()
    texts = []
    for i in range(300):
        at = set(r.sample(range(200), r.randint(0, 5)))
        texts.append(" ".join(f"e{i}x{j}" if j in at else w for j, w in enumerate(base)))
    texts += [" ".join(["same", *prose(60, 300 + i).split()]) for i in range(40)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = brute_classes(texts, lambda df: math.sqrt(1 + math.log(min(len(texts) / df, 1 / neardup.COMMON))))
    assert 40 < len(set(want.values())) < 340
    assert {x.doc_id: x.class_id for x in neardup.classes(rows).collect()} == want
    # a tie of leaders, and everything twice
    assert {x.doc_id: x.class_id for x in neardup.classes(rows.unionByName(rows)).collect()} == want


def test_many_components_under_a_key_do_not_all_meet(spark, monkeypatch):
    base = [f"w{i}" for i in range(60)]
    texts = [" ".join(f"other{i}" for i in range(60)), *(" ".join([*base[: 5 + i % 50], f"new{i}", *base[6 + i % 50 :]]) for i in range(250)), " ".join(base)]
    checked, plain = spark.sparkContext.accumulator(0), neardup._verify

    def counting(shared, least):
        def run(batches):
            def seen():
                for batch in batches:
                    checked.add(batch.num_rows)
                    yield batch

            yield from plain(shared, least)(seen())

        return run

    monkeypatch.setattr(neardup, "_verify", counting)
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    weigh = neardup.Weights(np.zeros(0, np.uint64), np.zeros(0))
    got = {x.id: x.component for x in neardup.links(rows, rows.selectExpr("7L as bucket", "doc_id"), weigh).collect()}
    # the bucket's leader is like none, and all but the last text are like the last one and few others
    assert {got[i] for i in range(1, len(texts))} == {1}
    assert checked.value < 20 * len(texts)


def test_samples_estimate_similarity():
    r = np.random.RandomState(5)
    a = r.randint(0, 1 << 62, 400).astype(np.uint64)
    b = np.concatenate([a[:300], r.randint(0, 1 << 62, 100).astype(np.uint64)])
    none = neardup.Weights(np.zeros(0, np.uint64), np.zeros(0))
    agree = [np.mean(np.equal(*neardup.Sampler(seed).sample(np.concatenate([a, b]), np.array([0, 400, 800]), none))) for seed in range(12)]
    assert abs(np.mean(agree) - 0.6) < 0.08


# ---- 9


def test_media_round_trip(docs, empty):
    r = random.Random(1)
    payloads = [media.pad(r.randbytes(r.randint(0, 3000))) for _ in range(60)] + [media.pad(b""), media.pad(b"a" * 600_000)]
    files = media.store(payloads)
    for payload, pictures in zip(payloads, media.decode_many(files)):
        assert media.load(pictures, len(payload)) == payload
    with pytest.raises(ValueError):
        media.decode_many([files[0][:200]])
    rows = {r.doc_id: r for r in media.text_media(docs).collect()}
    assert rows[0].payload_bytes == 64 and rows[0].payload_sha256 == hashlib.sha256(bytes(64)).hexdigest() and rows[0].tail_crc32 == zlib.crc32(bytes(64))
    assert rows[4].media_sha256 == rows[5].media_sha256 and rows[4].n_bytes == 19
    assert media.text_media(empty).count() == 0
    seen = media.inspect(media.text_media(docs, keep=True).select("doc_id", "media")).collect()
    assert all(r.width == 512 for r in seen if r.doc_id is not None and r.doc_id < 6)


# ---- 10


def test_quality_on_held_out_documents(spark, docs, empty):
    good = [(i, prose(80, i)) for i in range(300)]
    bad = [(1000 + i, " ".join(f"{w}!!" for w in prose(60, i).upper().split())) for i in range(150)]
    df = spark.createDataFrame(good + bad, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 1000)) for i, _ in good + bad] + [(5, None), (7, 9)], "doc_id long, quality int")
    voter = quality.fit(df, labels)
    out = quality.score(df, voter, ["doc_id"]).collect()
    held = [r for r in out if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert len(held) > 50 and all((r.score >= 0.5) == (r.doc_id < 1000) for r in held)
    assert all(0 <= r.score <= 1 for r in quality.score(docs, voter, ["doc_id", "text"]).collect())
    assert quality.accepted(docs, voter).columns == docs.columns and quality.accepted(empty, voter).count() == 0
    none = quality.fit(df, labels.where("doc_id < 0"))
    assert {r.score for r in quality.score(docs, none, ["doc_id"]).collect()} == {0.5}


def test_topk_memory_does_not_grow_with_queries():
    import tracemalloc

    r = np.random.default_rng(3)
    x = np.floor(1024 * r.normal(size=(1500, 64)))
    peaks = []
    for n in (500, 4000):
        search = topk.Search(np.arange(n) * 100, np.floor(1024 * r.normal(size=(n, 64))), 10)
        tracemalloc.start()
        search.add(np.arange(len(x)), x)
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        exact = search.q @ x.T
        exact[search.ids[:, None] == np.arange(len(x))[None, :]] = -np.inf
        for i in range(0, n, 250):
            assert search.found[i].tolist() == np.lexsort((np.arange(len(x)), -exact[i]))[:10].tolist()
    assert peaks[1] < 1.5 * peaks[0] < 100 << 20, peaks
