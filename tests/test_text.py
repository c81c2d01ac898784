"""Scalar expressions against Python."""

import datetime
import time
import uuid

import pytest
from pyspark.sql import functions as F

from evalbench.functions import text as tx
from evalbench.operators import gates
from evalbench.sources import files


def column(spark, values, schema="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {schema}")


def test_uuid5(spark):
    urls = ["https://a.example/x?y=1", "", "http://münchen.example/ß", None]
    got = {r.i: r.id for r in column(spark, urls).select("i", tx.uuid5_url(F.col("v")).alias("id")).collect()}
    assert [got[i] for i in range(3)] == [str(uuid.uuid5(uuid.NAMESPACE_URL, u)) for u in urls[:3]]


def test_urls_and_dates(spark):
    urls = {"https://a.example": True, "http://a.example:80/x y": False, "ftp://a.example": False, "https://": False, "https:///x": False, "//a.example": False, "https://a.example/é?q=[1]": None}
    got = {r.v: r.ok for r in column(spark, [*urls, None]).select("v", tx.valid_url(F.col("v")).alias("ok")).collect()}
    assert all(got[u] == ok for u, ok in urls.items() if ok is not None) and got[None] is False
    days = {"2024-02-29": datetime.date(2024, 2, 29), "2023-02-29": None, "2024-2-9": None, "20240209": None, "2024-02-09T00:00": None, "": None}
    got = {r.v: r.d for r in column(spark, list(days)).select("v", tx.iso_date(F.col("v")).alias("d")).collect()}
    assert got == days


def test_squash_is_the_plain_pattern_and_spares_it_the_blanks(spark):
    wide, ascii_ = "".join(map(chr, range(0xFF01, 0xFF5F))), "".join(map(chr, range(0x21, 0x7F)))
    plain = lambda c: F.regexp_replace(F.lower(F.translate(c, wide, ascii_)), "[^0-9a-z가-힣]", "")
    code = [c for c in range(0x11000) if not 0xD800 <= c < 0xE000]
    df = spark.createDataFrame([(f"a{chr(c)}B",) for c in [*code, 0x1F600, 0x10FFFF]] + [("A\u03a3 B\u03a3",), (None,), ("",)], "v string")
    assert df.where(~plain(F.col("v")).eqNullSafe(tx.squash(F.col("v")))).count() == 0
    texts = spark.range(0, 4000, 1, 4).select(F.repeat(F.concat(F.col("id").cast("string"), F.lit(" ab, ")), 400).alias("v")).localCheckpoint()

    def seconds(c):
        began = time.perf_counter()
        texts.agg(F.sum(F.length(c))).collect()
        return time.perf_counter() - began

    assert min(seconds(tx.squash(F.col("v"))) for _ in range(3)) < 0.7 * min(seconds(plain(F.col("v"))) for _ in range(3))


def test_squash_of_wide_forms(spark):
    df = column(spark, ["ＡＢＣ－１２３ 가나", "x²", "ﬁn"])
    assert [r[0] for r in df.orderBy("i").select(tx.squash(F.col("v"))).collect()] == ["abc123가나", "x", "n"]
    assert [r[0] for r in df.orderBy("i").select(tx.squash(F.col("v"), unicode_forms=True)).collect()] == ["abc123가나", "x2", "fin"]


def test_gates():
    assert gates.semantic_hash({"name": "a", "k": 1, "z": {"b": 2, "a": 1}}) == gates.semantic_hash({"z": {"a": 1, "b": 2}, "k": 1, "output_dir": "/x"})
    assert gates.semantic_hash({"k": 1}) != gates.semantic_hash({"k": 2})
    assert [gates.gold_refusal(*x) for x in (("1", True, "evaluate-gold"), (None, True, "evaluate-gold"), ("1", False, "evaluate-gold"), ("1", True, "x"))] == [None, "environment", "not_explicit", "command"]


def test_yaml_keys_are_unique(spark):
    assert files.yaml_mapping("a: 1\nb: {c: 2}") == {"a": 1, "b": {"c": 2}}
    for bad in ("a: 1\na: 2", "b: {c: 1, c: 2}", "- 1"):
        with pytest.raises(ValueError):
            files.yaml_mapping(bad)
    with pytest.raises(ValueError):
        files.yaml_rows(spark, "rows: [{a: 1, x: 2}]", "rows", "a int")


def test_broken_window_lines_are_named(spark, tmp_path):
    good = '{"window_id":"w","document_id":"d","page_start":1,"page_end":2,"content":"c"}'
    path = tmp_path / "w.jsonl"
    path.write_text("\n".join([good, good, "nope", good, good.replace('"page_end":2', '"page_end":0'), good.replace('"content":"c"', '"content":null')]))
    with pytest.raises(ValueError, match="line 3, 5, 6$"):
        files.source_windows(spark, f"file://{path}")
    path.write_text("\n".join([good] * 4))
    assert files.source_windows(spark, f"file://{path}").count() == 4
