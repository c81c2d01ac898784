"""The stop rule over micro-batches: equal to a plain loop however the outcomes are cut, and after restarts."""

import random

import pytest
from pyspark.sql import functions as F

from evalbench.operators import lifecycle
from evalbench.streaming import ledger, runner

SCHEMA = "run_id string, step long, outcome string"


def by_loop(rows, window, schema, provider):
    out = {}
    for run in sorted({r for r, _, _ in rows}):
        recent, stopped, reason, at, n = [], False, None, None, [0, 0, 0]
        for _, step, what in sorted(x for x in rows if x[0] == run):
            if what.startswith("resume"):
                if stopped and (not reason.endswith("_threshold") or what == "resume_acknowledged"):
                    recent, stopped, reason, at = [], False, None, None
            elif stopped:
                n[2] += what != "cancel"
            elif what in ("cancel", "budget"):
                stopped, reason, at = True, {"cancel": "operator_cancelled", "budget": "budget_exhausted"}[what], step
                n[1] += what == "budget"
            else:
                recent.append(what)
                n[what != "ok"] += 1
                last = recent[-window:]
                if what != "ok" and len(last) == window:
                    for kind, rate in (("schema", schema), ("provider", provider)):
                        if not stopped and last.count(kind) / window >= rate:
                            stopped, reason, at = True, f"{kind}_error_threshold", step
        out[run] = ("stopped" if stopped else "running", reason, at, *n)
    return out


@pytest.mark.parametrize("parts", [1, 3])
def test_equals_a_loop_after_restarts(spark, tmp_path, parts):
    r = random.Random(6)
    kinds = ["ok"] * 12 + ["schema"] * 4 + ["provider"] * 3 + ["other"] * 2 + ["budget", "cancel", "resume", "resume_acknowledged"]
    rows = [(f"r{i % 7}", i, r.choice(kinds if i % 7 else kinds[:21])) for i in range(900)]
    source, out, checkpoint = (f"file://{tmp_path}/{x}" for x in ("in", "out", "checkpoint"))
    for part in range(parts):
        own = [x for x in rows if x[1] * parts // 900 == part]
        r.shuffle(own)  # in any order within a part
        spark.createDataFrame(own, SCHEMA).write.mode("append").parquet(source)
        ledger.run_once(runner.run_states(spark.readStream.schema(SCHEMA).parquet(source), 6, 0.5, 0.5), out, checkpoint)
    got = lifecycle.newest(spark.read.schema(runner.ROWS).parquet(out), ["run_id"], [F.col("step").desc()]).collect()
    assert {x.run_id: (x.status, x.reason, x.stop_step, x.answered, x.failed, x.skipped) for x in got} == by_loop(rows, 6, 0.5, 0.5)
    # nothing new: nothing changes
    before = spark.read.parquet(out).count()
    ledger.run_once(runner.run_states(spark.readStream.schema(SCHEMA).parquet(source), 6, 0.5, 0.5), out, checkpoint)
    assert spark.read.parquet(out).count() == before


def test_arguments(spark):
    df = spark.createDataFrame([], SCHEMA)
    for bad in ((0, 0.5, 0.5), (5, 0.0, 0.5), (5, 0.5, 1.5)):
        with pytest.raises(ValueError):
            runner.run_states(df, *bad)
