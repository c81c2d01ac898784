"""Versions are whole or absent, writers that meet, idempotent and replacing writes, and a screening run's life."""

import glob
import json
import os
import threading

import pytest
from pyspark.sql import functions as F

from evalbench.operators.screening import Screening
from evalbench.sources.store import Store, Taken

TABLES = {"a": "id long, v string", "b": "id long"}


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/store", TABLES)


def frame(spark, *values):
    return spark.createDataFrame(list(values), TABLES["a"])


def test_versions_and_reads(spark, store):
    assert store.version() == 0 and rows(store.read("a")) == []
    one = store.commit(0, "x", {"a": frame(spark, (1, "p")), "b": spark.createDataFrame([(7,)], "id long")})
    two = store.commit(one, "y", {"a": frame(spark, (2, None))})
    assert (one, two) == (1, 2)
    assert rows(store.read("a", 1)) == [(1, "p")] and rows(store.read("a")) == [(1, "p"), (2, None)] and rows(store.read("b")) == [(7,)]
    assert rows(store.read("a", 0)) == []
    three = store.compact("a")
    assert rows(store.read("a", three)) == rows(store.read("a", two)) and len(store.manifest(three)["folders"]["a"]) == 1
    assert store.vacuum() > 0 and store.versions() == [3] and rows(store.read("a")) == [(1, "p"), (2, None)]


def test_a_writer_that_dies_leaves_the_last_version(spark, store, monkeypatch):
    store.commit(0, "x", {"a": frame(spark, (1, "p"))})
    with monkeypatch.context() as m:
        m.setattr(store, "_put", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):
            store.commit(1, "y", {"a": frame(spark, (2, "q"))})
    base = store.base.removeprefix("file://")
    open(f"{base}/log/.draft-dead", "w").write('{"half')
    assert store.version() == 1 and rows(store.read("a")) == [(1, "p")]
    assert len(os.listdir(f"{base}/data")) == 2 and store.vacuum() == 1 and len(os.listdir(f"{base}/data")) == 1
    assert store.commit(1, "y", {"a": frame(spark, (3, "r"))}) == 2 and rows(store.read("a")) == [(1, "p"), (3, "r")]


def test_a_version_is_written_once(spark, store):
    store.commit(0, "x", {"a": frame(spark, (1, "p"))})
    with pytest.raises(Taken):
        store.commit(0, "late", {"a": frame(spark, (2, "q"))})
    assert rows(store.read("a")) == [(1, "p")]
    errors = []

    def write(i):
        try:
            Store(spark, store.base, TABLES).insert("a", frame(spark, (i, "w")), ["id"])
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    threads = [threading.Thread(target=write, args=(i,)) for i in (10, 11, 12)]
    [t.start() for t in threads], [t.join() for t in threads]
    assert not errors and rows(store.read("a")) == [(1, "p"), (10, "w"), (11, "w"), (12, "w")] and store.version() == 4


def test_a_changed_manifest_is_refused(spark, store):
    store.commit(0, "x", {"a": frame(spark, (1, "p"))})
    path = glob.glob(store.base.removeprefix("file://") + "/log/*.json")[0]
    found = json.load(open(path))
    found["folders"]["a"] = []
    os.remove(path)
    json.dump(found, open(path, "w"))
    for crc in glob.glob(os.path.dirname(path) + "/.*.crc"):
        os.remove(crc)
    with pytest.raises(ValueError, match="changed"):
        store.read("a")


def test_insert_and_upsert(spark, store):
    assert store.insert("a", frame(spark, (1, "p"), (2, None)), ["id"]) == 1
    assert store.insert("a", frame(spark, (1, "p"), (2, None)), ["id"]) == 1  # nothing new: no version
    assert store.insert("a", frame(spark, (1, "p"), (3, "r")), ["id"]) == 2
    with pytest.raises(ValueError, match="other content"):
        store.insert("a", frame(spark, (2, "x"), (4, "s")), ["id"])
    assert rows(store.read("a")) == [(1, "p"), (2, None), (3, "r")]
    store.upsert("a", frame(spark, (2, "new"), (9, "z")), ["id"])
    assert rows(store.read("a")) == [(1, "p"), (2, "new"), (3, "r"), (9, "z")] and rows(store.read("a", 2)) == [(1, "p"), (2, None), (3, "r")]


def test_screening_runs(spark, tmp_path):
    s = Screening(spark, f"file://{tmp_path}/runs")
    runs = spark.createDataFrame([("r1", "c1", "q"), ("r2", "c2", "q")], "run_id string, config_hash string, question_hash string")
    expected = spark.createDataFrame([(r, q) for r in ("r1", "r2") for q in ("a", "b", "c")], "run_id string, question_id string")
    asked = lambda *x: spark.createDataFrame(list(x), "run_id string, question_id string, latency_ms double")
    hits = lambda *x: spark.createDataFrame(list(x), "run_id string, question_id string, chunk_id string, rank int, score double")
    s.begin(runs, expected)
    first = s.answer(asked(("r1", "a", 1.0), ("r2", "a", 2.0)), hits(("r1", "a", "k", 1, 0.5), ("r1", "a", "l", 2, 0.4)))
    s.interrupt(runs.where("run_id = 'r1'").select("run_id"))
    state = lambda v=None: {r.run_id: (r.status, r.expected, r.completed, r.hits) for r in s.state(v).collect()}
    assert state() == {"r1": ("interrupted", 3, 1, 2), "r2": ("running", 3, 1, 0)} and state(first)["r1"][0] == "running"
    with pytest.raises(ValueError, match="other inputs"):
        s.begin(runs.withColumn("config_hash", F.lit("else")), expected)
    with pytest.raises(ValueError, match="other questions"):
        s.begin(runs, expected.where("question_id <> 'c'"))
    for bad, problem in ((asked(("r9", "a", 1.0)), "unknown"), (asked(("r1", "z", 1.0)), "outside"), (asked(("r1", "b", -1.0)), "latency"), (asked(("r1", "b", float("nan"))), "latency"), (asked(("r1", "b", 1.0), ("r1", "b", 1.0)), "twice")):
        with pytest.raises(ValueError, match=problem):
            s.answer(bad, hits(("r1", "b", "k", 1, 0.1)).where("false"))
    for bad in (hits(("r1", "b", "k", 2, 0.1)), hits(("r1", "b", "k", 1, 0.1), ("r1", "b", "k", 2, 0.1)), hits(("r1", "b", "k", 1, float("nan")))):
        with pytest.raises(ValueError, match="no ranking"):
            s.answer(asked(("r1", "b", 1.0)), bad)
    s.begin(runs, expected)
    with pytest.raises(ValueError, match="not answered"):
        s.finish(spark.createDataFrame([("r1", "{}")], "run_id string, evaluation string"))
    # answered again: the first answer stays
    s.answer(asked(*[("r1", q, 5.0) for q in "abc"]), hits(("r1", "a", "other", 1, 9.0), ("r1", "b", "k", 1, 0.3)))
    s.finish(spark.createDataFrame([("r1", "{}")], "run_id string, evaluation string"))
    assert state() == {"r1": ("complete", 3, 3, 3), "r2": ("running", 3, 1, 0)}
    assert rows(s.store.read("hits").select("question_id", "chunk_id")) == [("a", "k"), ("a", "l"), ("b", "k")]
    assert rows(s.pending()) == [("r2", "b"), ("r2", "c")]
    before = s.store.version()
    s.begin(runs, expected)  # a complete run stays complete
    assert state()["r1"][0] == "complete" and s.store.version() == before + 1
