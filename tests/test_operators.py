import difflib
import itertools
import random

import pytest
from pyspark.sql import functions as F

from evalbench.functions import text as tx
from evalbench.operators import chunks, curate, ledger, report, stats
from evalbench.sources import files, sinks
from evalbench.streaming import ledger as stream


def test_numeric_answers(spark):
    pairs = [("12.5%", "0.125", True), ("₩1,500", "1,500원", True), ("1.5만원", "15,000원", True), ("2.0 kg", "2000 g", True), ("1,2", "12", False), ("$5", "5", False)]
    df = spark.createDataFrame(pairs, "a string, b string, want boolean")
    got = df.select(F.coalesce(stats.numeric_value(F.col("a")) == stats.numeric_value(F.col("b")), F.lit(False)).alias("same"), "want").collect()
    assert [r.same for r in got] == [r.want for r in got]


def test_claims_without_denominator_are_null(spark):
    rows = [("q", [("c1", True, ["e1"]), ("c2", False, [])], {"c1": ["e1", "e9"]}), ("none", [], {})]
    df = spark.createDataFrame(rows, "question_id string, claims array<struct<id:string,supported:boolean,evidence:array<string>>>, citations map<string,array<string>>")
    got = {r.question_id: (r.faithfulness, r.citation_precision, r.citation_recall) for r in stats.claim_metrics(df).collect()}
    assert got == {"q": (0.5, 0.5, 0.5), "none": (None, None, None)}


def test_kappa_golden(spark):
    rows = [(i < 30, (i < 26) or (30 <= i < 49 and False) or (i == 49)) for i in range(50)]
    got = stats.kappa(spark.createDataFrame(rows, "a boolean, b boolean")).first()
    assert got.observed == pytest.approx(0.9) and got.kappa == pytest.approx(0.7967479675)


def test_cluster_bootstrap_repeats(spark):
    df = spark.createDataFrame([(f"d{i // 5}", 0.8 + i % 3 * 0.01, 0.7 + i % 2 * 0.01) for i in range(30)], "cluster string, left double, right double")
    a, b = (stats.bootstrap_clusters(df, 3, 500).first() for _ in range(2))
    assert a == b and a.effect == pytest.approx(0.105) and a.low <= a.effect <= a.high


def test_furniture_and_sections(spark):
    rows = [(1, p, p * 2, "header", "H") for p in range(1, 4)] + [(1, 1, 10, "footer", "F"), (1, 2, 11, "footer", "F")]
    df = spark.createDataFrame(rows, "document_id int, page int, ord int, kind string, content string")
    assert [r.content for r in chunks.repeated_furniture(df).collect()] == ["H"]
    heads = [(1, 1, "heading", "### A"), (1, 2, "text", "x"), (1, 3, "heading", "## B"), (1, 4, "text", "y")]
    got = chunks.section_paths(spark.createDataFrame(heads, "document_id int, ord long, kind string, content string")).orderBy("ord").collect()
    assert [r.section for r in got] == [["A"], ["A"], ["A", "B"], ["A", "B"]]


@pytest.mark.parametrize("n", [1, 99, 100, 101, 250, 301])
def test_windows_cover(spark, n):
    df = spark.createDataFrame([("d", " ".join(["w"] * n))], "document_id string, content string")
    w = [(r.token_start, r.token_end) for r in chunks.windows(df, 100, 30).orderBy("ordinal").collect()]
    assert w[0][0] == 0 and w[-1][1] == n and all(b[0] == a[0] + 70 and b[0] <= a[1] for a, b in zip(w, w[1:]))


def test_greedy_batches(spark):
    df = spark.createDataFrame([("g", i, t) for i, t in enumerate([5, 5, 5, 20, 1, 1, 1])], "grp string, ord long, tokens long")
    assert [r.batch for r in chunks.pack_batches(df, 3, 12).orderBy("ord").collect()] == [0, 0, 1, 2, 3, 3, 3]


@pytest.fixture
def checkpoint(tmp_path):
    count = iter(range(1000))

    def put(df):
        path = f"file://{tmp_path}/{next(count)}"
        df.write.parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)

    return put


def test_components_and_splits(spark, checkpoint):
    items = spark.createDataFrame([(1, "x"), (2, "x"), (2, "y"), (3, "y"), (9, "z"), (8, "z")], "item_id long, token string")
    got = {r.id: r.component for r in curate.min_label_components(curate.shared_token_links(items), checkpoint).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 8: 8, 9: 8}
    split = curate.allocate_splits(spark.createDataFrame([*got.items(), (10, 10)], "id long, component long"), ["dev", "gold"], 1)
    assert split.groupBy("component").agg(F.countDistinct("split").alias("n")).where("n > 1").count() == 0
    # 3 go to one split, then 2 and 1 to the other, which has less
    assert sorted(r["count"] for r in split.groupBy("split").count().collect()) == [3, 3]


@pytest.mark.parametrize("copies", [5, 50, 200])
def test_duplicate_groups_equal_all_pairs(spark, checkpoint, copies):
    r = random.Random(copies)
    letters = "abcdefghijklmnop0123456789"
    base = "".join(r.choice(letters) for _ in range(60))
    texts = []
    for _ in range(copies):  # a group in which each gram is held by many
        t = list(base)
        for _ in range(r.randint(0, 5)):
            i = r.randrange(len(t))
            t[i : i + 1] = r.choice([[], [r.choice(letters)], [t[i], r.choice(letters)]])
        texts.append("".join(t))
    texts += ["".join(r.choice(letters) for _ in range(n)) for n in (1, 2, 5, 40, 60)]
    texts += ["abcdefghijkl", "abcdefxghijkl", "abcd1efgh2ijkl", "abc", "abc", "", "", "abcdefghijklm", "abcdxefghijklm", "abcdefghiyjklm"]
    root = list(range(len(texts)))
    for a, b in itertools.combinations(range(len(texts)), 2):
        if root[a] != root[b] and difflib.SequenceMatcher(None, texts[a], texts[b]).ratio() >= 0.92:
            lo, hi = sorted((root[a], root[b]))
            root = [lo if x == hi else x for x in root]
    many = {x for x in root if root.count(x) > 1}
    df = spark.createDataFrame(list(enumerate(texts)), "item_id long, question string")
    got = {x.item_id: (x.group_id, x.rejected) for x in curate.duplicate_groups(df, 0.92, checkpoint).collect()}
    assert got == {i: (x, i != x) for i, x in enumerate(root) if x in many}


def test_long_duplicate_groups_equal_all_pairs(spark, checkpoint):
    r = random.Random(5)
    many, few = "abcdefghijklmnopqrstuvwxyz0123456789", "aaaaaaaeeeeeettttooonnniiissrrhhllddccuummffppggwwyyb"
    texts = []
    for letters, n, heavy in ((few + "vk", 900, 0), (few, 260, 0), (many, 230, 1), (few + many, 400, 1), (few + "vkjxqz", 195, 1)):
        words = ["".join(r.choice(letters) for _ in range(r.randint(2, 9))) for _ in range(40)]
        for _ in range(3):
            base = ""
            while len(base) < n:
                base += r.choice(words)
            texts.append(base)
            for edits in (1, 3, n // 40, n // 26, n // 24, n // 12):
                t = list(base)
                for _ in range(edits * (1 + heavy)):
                    i = r.randrange(len(t))
                    t[i : i + 1] = r.choice([[], [r.choice(letters)], [t[i], r.choice(letters)]])
                texts.append("".join(t))
            texts.append(base + base[: n // 7])
            texts.append(base[n // 9 :])
    r.shuffle(texts)
    texts.append(texts[3])
    root = list(range(len(texts)))
    linked = 0
    for a, b in itertools.combinations(range(len(texts)), 2):
        # equal texts have one place, so a later copy is compared under the first's
        if texts[a] == texts[b] or difflib.SequenceMatcher(None, texts[a], texts[b]).ratio() >= 0.92 and texts.index(texts[b]) == b:
            linked += 1
            lo, hi = sorted((root[a], root[b]))
            root = [lo if x == hi else x for x in root]
    many = {x for x in root if root.count(x) > 1}
    df = spark.createDataFrame(list(enumerate(texts)), "item_id long, question string")
    got = {x.item_id: (x.group_id, x.rejected) for x in curate.duplicate_groups(df, 0.92, checkpoint).collect()}
    assert got == {i: (x, i != x) for i, x in enumerate(root) if x in many} and linked > 100


def test_duplicate_groups_of_documents_are_of_whole_texts(spark, tmp_path):
    from evalbench.plans import catalog

    r = random.Random(8)
    start, rest = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n)) for n in (130, 3000)]
    texts = [start + rest, start + rest[::-1], start + rest[:2900] + "x" + rest[2900:], rest[:50]]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = catalog.queries()["b6_near_duplicate_groups"](spark, str(tmp_path)).collect()
    assert sorted(tuple(x) for x in got) == [(0, 0, False), (2, 0, True)]


def test_texts_that_are_alike_share_their_pieces():
    r = random.Random(9)
    for trial in range(300):
        letters = r.choice(["aaaaaaaaaeeeeeeettttttooooonnnnvk", "abcdefghijklmnopqrstuvwxyz0123456789", "ab"])
        a = [r.choice(letters) for _ in range(r.randint(200, 700))]
        b = list(a)
        for _ in range(r.randint(0, len(a) // 11)):
            i = r.randrange(len(b))
            b[i : i + 1] = r.choice([[], [r.choice(letters)], [b[i], r.choice(letters)]])
        a, b = "".join(a), "".join(b)
        if len(b) >= tx.INDEXED and difflib.SequenceMatcher(None, a, b).ratio() >= 0.92:
            for size in tx.PIECE_SIZES:
                assert len(set(tx._bag(a, size).tolist()) & set(tx._bag(b, size).tolist())) >= tx._common_pieces(len(a) + len(b), tx._rare(b), 0.92, size)
            size, agree = tx._piece_size(b, 0.92)
            x, y = set(tx._bag(a, size).tolist()), set(tx._bag(b, size).tolist())
            assert len(x & y) >= tx.SHARED * len(x | y) and agree > 0


def test_planned_jobs_equal_a_loop_over_all_windows(spark):
    r = random.Random(6)
    windows = [(f"w{i:03d}", f"d{r.randrange(7)}", r.randrange(3)) for i in range(60)]
    df = spark.createDataFrame(windows, "window_id string, document_id string, page int")
    for quotas, per_document, per_page in (({"b": 3, "a": 2}, 1, 1), ({"a": 12, "c": 9}, 4, 2), ({"a": 0}, 2, 2)):
        order, used, pages, want, at = sorted({d for _, d, _ in windows}), {}, {}, [], 0
        left = {d: sorted((p, w) for w, x, p in windows if x == d) for d in order}
        for kind in [k for k in sorted(quotas) for _ in range(quotas[k])]:
            while True:
                d = order[at % len(order)]
                at += 1
                free = next(((p, w) for p, w in left[d] if used.get(d, 0) < per_document and pages.get((d, p), 0) < per_page), None)
                if free:
                    left[d].remove(free)
                    used[d], pages[d, free[0]] = used.get(d, 0) + 1, pages.get((d, free[0]), 0) + 1
                    want.append((kind, free[1]))
                    break
        assert [(x.kind, x.window_id) for x in curate.plan_jobs(df, quotas, per_document, per_page).orderBy("ordinal").collect()] == want
    with pytest.raises(ValueError):
        curate.plan_jobs(df, {"a": 8}, 1, 1)


def test_top_three_and_pareto(spark):
    r = random.Random(31)
    rows = [(f"c{i}", round(0.4 + 0.05 * i, 3), 0.0, 0.0, float(r.randint(1, 99))) for i in range(9)]
    rows = [(i, q, q - 0.12, q + 0.12, cost) for i, q, _, _, cost in rows]
    df = spark.createDataFrame(rows, "id string, quality double, ci_low double, ci_high double, cost double")
    order = sorted(rows, key=lambda x: -x[1])
    third = min((x for x in order[2:] if x[3] >= order[0][2]), key=lambda x: x[4])
    assert [x.id for x in report.top_three(df).orderBy("place").collect()] == [order[0][0], order[1][0], third[0]]
    front = {a[0] for a in rows if not any(b[1] >= a[1] and b[4] <= a[4] and (b[1] > a[1] or b[4] < a[4]) for b in rows)}
    assert {x.id for x in report.pareto(df, "id", "quality", "cost").collect()} == front and len(front) < len(rows)


def test_reaching_the_cap_is_rejected_and_reserves_nothing(spark):
    rows = [("x", 1, "4"), ("x", 2, "6"), ("x", 3, "1"), ("x", 4, "5"), ("x", 5, "4.999999"), ("y", 3, "9"), ("y", 1, "10"), ("y", 4, None), ("y", 5, "0.5")]
    df = spark.createDataFrame(rows, "account string, ord int, amount string").withColumn("amount", F.col("amount").cast("decimal(12,6)"))
    got = {a: [(r.accepted, str(r.spent)) for r in ledger.replay(df, "10").where(F.col("account") == a).orderBy("ord").collect()] for a in "xy"}
    assert [x for x, _ in got["x"]] == [True, False, True, False, True] and got["x"][-1][1] == "9.999999"
    assert [x for x, _ in got["y"]] == [False, True, False, True]
    assert ledger.replay(df.where("ord > 9"), "10").count() == 0


def test_files(spark, tmp_path):
    df = spark.createDataFrame([("c1", "d", "t", 1, 1, "p", "s"), ("c2", "d", "u", 1, 2, "p", "s")], files.CHUNKS)
    path = sinks.immutable_json(df, f"file://{tmp_path}/out")
    assert sinks.immutable_json(df.orderBy(F.col("chunk_id").desc()), f"file://{tmp_path}/out") == path
    assert files.chunk_dataset(spark, path).count() == 2
    df.unionByName(df).write.json(f"file://{tmp_path}/twice")
    with pytest.raises(ValueError):
        files.chunk_dataset(spark, f"file://{tmp_path}/twice")
    assert sinks.manifest(spark, path).where("path like '%json'").count() >= 1


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"2024-01-01 {i % 5:02d}:10:00", "generate", 1.5) for i in range(20)], "usage_id long, ts string, operation string, cost double").withColumn("ts", F.col("ts").cast("timestamp"))
    rows.write.parquet(f"file://{tmp_path}/in")
    source = spark.readStream.schema(rows.schema).parquet(f"file://{tmp_path}/in")
    q = stream.windowed_usage(source).writeStream.format("memory").queryName("usage").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    want = sorted((str(r.start), r.calls) for r in stream.windowed_usage(rows).collect())
    assert sorted((str(r.start), r.calls) for r in spark.table("usage").collect()) == want
