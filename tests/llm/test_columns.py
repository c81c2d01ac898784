"""Columns that clash with what operators add, odd rows in the pipeline's stages, and votes by a plain loop."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from evalbench.llm import bpe, media, mixing, quality


def prose(n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 8))) for _ in range(n))


def test_added_columns_take_the_place_of_clashing_ones(spark):
    rows = spark.createDataFrame([(1, "some text", "a"), (2, None, "b"), (None, "", None)], "doc_id long, text string, source string")
    clash = rows.withColumns({c: F.lit("old") for c in ("score", "ids", "decoded", "mix_shard", "MIX_KEY", "width", "height", "thumbnail", "thumbnail_hash", "row", "size", "h")})
    ids = bpe.decode(bpe.encode(clash))
    assert ids.columns.count("ids") == ids.columns.count("decoded") == 1
    assert sorted(x.decoded for x in ids.collect()) == ["", "", "some text"]
    voter = quality.fit(rows, spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int"))
    scored = quality.score(clash, voter)
    assert scored.columns.count("score") == 1 and all(0 <= x.score <= 1 for x in scored.collect())
    mix = mixing.mix(clash)
    assert mix.columns.count("mix_shard") == mix.columns.count("mix_key") == 1 and "MIX_KEY" not in mix.columns
    assert all(isinstance(x.mix_shard, int) and x["size"] == "old" for x in mix.collect())
    assert mixing.mixed(clash).columns == clash.columns and {x.mix_shard for x in mixing.mixed(clash).collect()} == {"old"}
    seen = media.inspect(media.text_media(rows, keep=True).withColumns({c: F.lit("old") for c in ("width", "thumbnail")}))
    assert seen.columns.count("width") == seen.columns.count("thumbnail") == 1 and all(isinstance(x.width, int) for x in seen.collect())


def test_a_shard_stands_together_in_shuffled_order(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_WORDS", 500)
    rows = spark.createDataFrame([(i, prose(40, i), "ab"[i % 2]) for i in range(400)], "doc_id long, text string, source string")
    parts = mixing.mix(rows).select("mix_shard", "mix_key", F.spark_partition_id().alias("p")).collect()
    assert len({x.mix_shard for x in parts}) >= 2 and all(len({x.p for x in parts if x.mix_shard == s}) == 1 for s in {x.mix_shard for x in parts})
    for p in {x.p for x in parts}:
        own = [(x.mix_shard, x.mix_key) for x in parts if x.p == p]
        assert own == sorted(own)


def test_running_sums_by_parts(spark):
    r = random.Random(2)
    rows = [(i % 3 if i % 3 else 0, i, r.randrange(50)) for i in range(500)]
    df = spark.createDataFrame(rows, "sid long, at long, n long")
    got = {x["at"]: x.before for x in mixing.upto(df, "sid", F.floor(F.col("at") / 7), ["at"], F.col("n"), "before").collect()}
    assert got == {at: sum(n for s, a, n in rows if s == sid and a < at) for sid, at, _ in rows}


def test_rows_without_ids_are_mixed_apart(spark):
    rows = spark.createDataFrame([(None, prose(30, i), "a") for i in range(2000)], "doc_id long, text string, source string")
    assert mixing.measured(rows, 1).select("__h").distinct().count() == 2000


def test_votes_equal_a_plain_loop():
    r = np.random.RandomState(3)
    voter = quality.Voter.__new__(quality.Voter)
    voter.vectors = np.repeat(r.randint(-2, 3, (40, 4)), 3, axis=0).astype(np.float32)  # with ties
    voter.labels = r.randint(0, 2, 120).astype(np.float32)
    asked = r.randint(-2, 3, (50, 4)).astype(np.float32)
    for vector, got in zip(asked, voter.votes(asked)):
        near = sorted(((-max(float(v @ vector), 0.0), i) for i, v in enumerate(voter.vectors)))[: quality.NEIGHBOURS]
        total = sum((-s) ** quality.SHARPNESS for s, _ in near)
        want = sum((-s) ** quality.SHARPNESS * voter.labels[i] for s, i in near) / total if total else voter.labels.mean()
        assert got == pytest.approx(want, rel=1e-6)


def test_pipeline_stages_on_odd_and_empty_tables(spark, tmp_path):
    rows = [(i, t, "en", s, len(t or "")) for i, (t, s) in enumerate([(None, None), ("", "a"), ("word", "a"), (prose(80, 1), "b"), (prose(80, 1), "b"), (prose(20_000, 2), None), ("token = abcdef123456", "a"), ("é日本 " * 30, "b")])]
    rows += [rows[3], (None, prose(60, 4), None, "a", 3), (None, prose(60, 5), None, None, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(3, 1, 0), (6, 1, 0), (5, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    for kept in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        docs = kept
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, f"file://{tmp_path}")
            assert docs.columns == kept.columns
        out = corpus_pipeline.STAGES[-1][1](spark, docs, f"file://{tmp_path}").collect()
        assert all(x.n_tokens == len(x.ids) for x in out) and (len(out) > 0) == (kept.count() > 0)
