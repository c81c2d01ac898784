"""Validation rules and parse runs on small relations, against plain loops."""

import difflib
import itertools
import random

import pytest
from pyspark.sql import functions as F

from evalbench.functions import text as tx
from evalbench.operators import curate, parsing, validation

UNITS = "document_id string, page int, chunk_id string, content string"
SPANS = "ord long, document_id string, page int, chunk_id string, quote string"


@pytest.fixture
def checkpoint(tmp_path):
    count = itertools.count()

    def put(df):
        path = f"file://{tmp_path}/{next(count)}"
        df.write.parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)

    return put


def test_nearly_contains_is_a_sliding_window(spark):
    r = random.Random(5)
    rows = []
    for i in range(200):
        text = "".join(r.choice("abcd") for _ in range(r.randint(0, 120)))
        at, n = r.randint(0, max(0, len(text) - 40)), r.randint(1, 45)
        needle = list(text[at : at + n] or "a")
        for _ in range(r.randint(0, 3)):
            needle[r.randrange(len(needle))] = r.choice("abcd")
        rows.append((i, "".join(needle), text))
    for least in (0.8, 0.96):
        got = {x.i: x.ok for x in spark.createDataFrame(rows, "i int, n string, t string").select("i", tx.nearly_contains(least)("n", "t").alias("ok")).collect()}
        for i, needle, text in rows:
            step = max(1, len(needle) // 10)
            assert got[i] == any(difflib.SequenceMatcher(None, needle, text[k : k + len(needle)]).ratio() >= least for k in range(0, len(text) - len(needle) + 1, step))


def test_evidence_rules(spark):
    units = spark.createDataFrame([("d", 1, "a", "Quick brown fox jumps over the lazy dog again and again"), ("d", 1, "b", "other"), ("d", 2, "a", "text")], UNITS)
    long = "quick brown fox jumps over the lazy dog again and"
    spans = [(1, "d", 1, "a", "QUICK brown"), (2, "x", 1, "a", "quick"), (3, "d", 9, "a", "quick"), (4, "d", 1, "z", "quick"), (5, "d", 2, "a", "quick"), (6, "d", 1, "a", long.replace("lazy", "lezy")), (7, "d", 1, "a", "!?"), (8, "d", 1, "a", "ｑｕｉｃｋ")]
    got = {x.ord: x.rule for x in validation.evidence(spark.createDataFrame(spans, SPANS), units).collect()}
    assert got == {2: "impossible_page", 3: "impossible_page", 4: "impossible_chunk", 5: "evidence_not_found", 7: "evidence_not_found"}


def test_answers_and_negations(spark):
    rows = [(1, "fact", "how many", "12,000", True), (2, "fact", "is it 12", "12", True), (3, "summary", "q", "gut 못 해요", True), (4, "summary", "q", "brown quick", True), (5, "fact", "q", None, True), (6, "fact", "q", "zz", False)]
    spans = [(1, "d", 1, "a", "there are 12000"), (2, "d", 1, "a", "12"), (3, "d", 1, "a", "gut 해요"), (4, "d", 1, "a", "quick brown")]
    c = spark.createDataFrame(rows, "ord long, kind string, question string, answer string, answerable boolean")
    got = sorted((x.ord, x.rule) for x in validation.answers(c, spark.createDataFrame(spans, SPANS)).collect())
    assert got == [(2, "answer_leaked_in_question"), (3, "answer_not_supported"), (4, "answer_not_supported")]
    assert spark.range(1).select(curate.content_tokens(F.lit("안 못 나 a bc")).alias("t")).first().t == ["안", "못", "bc"]


def test_quotas_and_caps_in_order(spark):
    r = random.Random(3)
    rows = [(i, r.choice("ab"), [(f"d{r.randrange(4)}", r.randrange(2)) for _ in range(r.randint(0, 2))]) for i in range(60)]
    clean = spark.createDataFrame(rows, "ord long, kind string, places array<struct<document_id:string,page:int>>")
    quotas, kinds, documents, pages, want = {"a": 9, "b": 4}, {}, {}, {}, {}
    for i, kind, places in rows:
        own, held = set(places), {d for d, _ in places}
        if kinds.get(kind, 0) >= quotas[kind]:
            want[i] = "type_quota_exceeded"
        elif any(documents.get(d, 0) >= 3 for d in held):
            want[i] = "per_document_cap_exceeded"
        elif any(pages.get(p, 0) >= 2 for p in own):
            want[i] = "per_page_cap_exceeded"
        else:
            for store, keys in ((kinds, [kind]), (documents, held), (pages, own)):
                for k in keys:
                    store[k] = store.get(k, 0) + 1
    assert {x.ord: x.rule for x in validation.admitted(clean.orderBy(F.rand(1)), quotas, 3, 2).collect()} == want and len(set(want.values())) == 3


def test_validator_joins_all_rules(spark, checkpoint):
    c = [(1, "x", "fact", "Who is the first", "fox", True), (2, "x", "fact", "Where was it then", "fox", True), (3, "y", "fact", "Who is the first", "fox", True), (4, "z", "fact", "Which fox", "fox", True), (5, "u", "fact", "Is 13 right here", None, False), (6, "v", "fact", "Something else is new", "fox", True)]
    candidates = spark.createDataFrame(c, "ord long, candidate_id string, kind string, question string, answer string, answerable boolean")
    units = spark.createDataFrame([("d", 1, "a", "the quick fox is 12"), ("e", 1, "a", "fox")], UNITS)
    spans = spark.createDataFrame([(i, "d", 1, "a", "quick fox") for i in (1, 2, 3, 4)] + [(6, "e", 1, "a", "fox")], SPANS)
    changes = spark.createDataFrame([(5, "d", 1, "a", "is 12", "Is 13")], "ord long, document_id string, page int, chunk_id string, original string, changed string")
    got = {x.ord: (x.accepted, x.rules) for x in validation.validate(candidates, spans, units, changes, checkpoint, {"fact": 9}, 1, 1).collect()}
    assert got == {1: (True, []), 2: (False, ["duplicate_candidate_id"]), 3: (False, ["duplicate_question"]), 4: (False, ["answer_leaked_in_question"]), 5: (False, ["per_document_cap_exceeded"]), 6: (True, [])}


def test_merged_parts(spark):
    parts = spark.createDataFrame([("d", 0, 0), ("d", 1, 3), ("d", 2, 4)], "document_id string, part int, start int")
    elements = [("d", 0, 0, 0, 1, "<p id='0'>a</p>"), ("d", 0, 1, 4, 3, None), ("d", 1, 0, None, 1, '<b id="2" data-id="7">'), ("d", 2, 0, 1, 1, "<i id='1'><i id=\"0\">")]
    got = parsing.merged(parts, spark.createDataFrame(elements, "document_id string, part int, idx int, id int, page int, html string")).orderBy("part", "idx").collect()
    assert [(x.id, x.page, x.html) for x in got] == [(0, 1, "<p id='0'>a</p>"), (4, 3, None), (None, 4, '<b id="7" data-id="12">'), (6, 5, "<i id='6'><i id=\"5\">")]


def test_parse_costs_round_up(spark):
    row = spark.createDataFrame([(3,)], "n int").select(parsing.cost(F.col("n"), "0.0000011").cast("string").alias("a"), parsing.cost(F.col("n"), "0.01", "0.10").cast("string").alias("b")).first()
    assert (row.a, row.b) == ("0.000003", "0.033000")
