"""Screening runs in a versioned store: begun, answered question by question, interrupted, resumed and finished.

Each method takes many runs at once and is one commit, which holds all of it or nothing. What a run is given (its
configuration, its questions) never changes; a question counts once, with the hits it had first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evalbench.operators import lifecycle
from evalbench.sources.store import Store

TABLES = {
    "runs": "run_id string, config_hash string, question_hash string",
    "expected": "run_id string, question_id string",
    "steps": "run_id string, version long, action string",
    "questions": "run_id string, question_id string, latency_ms double",
    "hits": "run_id string, question_id string, chunk_id string, rank int, score double",
    "evaluations": "run_id string, evaluation string",
}


def _refuse(rows: DataFrame, what: str, *columns: str) -> None:
    found = [tuple(r) for r in rows.select(*columns).limit(5).collect()]
    if found:
        raise ValueError(f"{what}: {found}")


class Screening:
    def __init__(self, spark: SparkSession, base: str):
        self.store = Store(spark, base, TABLES)

    def begin(self, runs: DataFrame, expected: DataFrame) -> int:
        """Start or resume ``runs`` (run_id, config_hash, question_hash) over their ``expected`` (run_id, question_id).

        A run that is stored with other inputs raises, and none of them is begun; a complete run stays complete.
        """
        _refuse(lifecycle.duplicates(runs, ["run_id"]), "runs given twice", "run_id")
        _refuse(lifecycle.duplicates(expected, ["run_id", "question_id"]), "questions expected twice", "run_id", "question_id")

        def change(parent: int) -> int:
            known, asked = self.store.read("runs", parent), self.store.read("expected", parent)
            same = known.withColumnsRenamed({"config_hash": "c", "question_hash": "q"}).join(runs, "run_id")
            _refuse(same.where(~(F.col("c").eqNullSafe(F.col("config_hash")) & F.col("q").eqNullSafe(F.col("question_hash")))), "stored with other inputs", "run_id")
            given = expected.join(known, "run_id", "left_semi").select("run_id", "question_id")
            stored = asked.join(runs, "run_id", "left_semi").select("run_id", "question_id")
            _refuse(given.exceptAll(stored).unionByName(stored.exceptAll(given)), "stored with other questions", "run_id", "question_id")
            open_ = runs.join(self.state(parent).where("status = 'complete'"), "run_id", "left_anti")
            new = runs.join(known, "run_id", "left_anti")
            return self.store.commit(parent, "begin", {"runs": new, "expected": expected.join(known, "run_id", "left_anti"), "steps": self._step(open_, parent, "begin")})

        return self.store.retried(change)

    def _step(self, runs: DataFrame, parent: int, action: str) -> DataFrame:
        return runs.select("run_id", F.lit(parent + 1).cast("long").alias("version"), F.lit(action).alias("action"))

    def answer(self, questions: DataFrame, hits: DataFrame) -> int:
        """Store answered ``questions`` (run_id, question_id, latency_ms) with their ``hits``; those answered before are left out."""
        _refuse(lifecycle.duplicates(questions, ["run_id", "question_id"]), "answered twice", "run_id", "question_id")
        late = ~F.coalesce((F.col("latency_ms") >= 0) & (F.col("latency_ms") < float("inf")), F.lit(False))
        _refuse(questions.where(late), "no latency", "run_id", "question_id")
        _refuse(hits.join(questions, ["run_id", "question_id"], "left_anti"), "hits of no answer", "run_id", "question_id")
        _refuse(ranking_problems(hits), "no ranking", "run_id", "question_id")

        def change(parent: int) -> int:
            state = self.state(parent)
            _refuse(questions.join(state, "run_id", "left_anti"), "unknown runs", "run_id")
            _refuse(questions.join(self.store.read("expected", parent), ["run_id", "question_id"], "left_anti"), "outside the questions of the run", "run_id", "question_id")
            new = questions.join(self.store.read("questions", parent), ["run_id", "question_id"], "left_anti")
            return self.store.commit(parent, "answer", {"questions": new, "hits": hits.join(new, ["run_id", "question_id"], "left_semi")})

        return self.store.retried(change)

    def interrupt(self, runs: DataFrame) -> int:
        """``runs`` (run_id) stop where they are."""

        def change(parent: int) -> int:
            _refuse(runs.join(self.store.read("runs", parent), "run_id", "left_anti"), "unknown runs", "run_id")
            return self.store.commit(parent, "interrupt", {"steps": self._step(runs, parent, "interrupt")})

        return self.store.retried(change)

    def finish(self, evaluations: DataFrame) -> int:
        """Close runs (run_id, evaluation); all their questions have to be answered."""

        def change(parent: int) -> int:
            _refuse(evaluations.join(self.store.read("runs", parent), "run_id", "left_anti"), "unknown runs", "run_id")
            _refuse(self.pending(parent).join(evaluations, "run_id", "left_semi"), "not answered", "run_id", "question_id")
            return self.store.commit(parent, "finish", {"evaluations": evaluations, "steps": self._step(evaluations, parent, "finish")})

        return self.store.retried(change)

    def pending(self, version: int | None = None) -> DataFrame:
        """run_id, question_id that are still to be answered."""
        return self.store.read("expected", version).join(self.store.read("questions", version), ["run_id", "question_id"], "left_anti")

    def state(self, version: int | None = None) -> DataFrame:
        """run_id, status (running, interrupted, complete), expected, completed and hits of each run at a version."""
        last = self.store.read("steps", version).groupBy("run_id").agg(F.max(F.struct("version", "action")).alias("s"), F.max(F.col("action") == "finish").alias("done"))
        status = F.when(F.col("done"), "complete").when(F.col("s.action") == "interrupt", "interrupted").otherwise("running")
        count = lambda table, name: self.store.read(table, version).groupBy("run_id").agg(F.count(F.lit(1)).alias(name))
        rows = last.select("run_id", status.alias("status"))
        for table, name in (("expected", "expected"), ("questions", "completed"), ("hits", "hits")):
            rows = rows.join(count(table, name), "run_id", "left")
        return rows.fillna(0, ["expected", "completed", "hits"])


def ranking_problems(hits: DataFrame) -> DataFrame:
    """run_id, question_id of rankings whose ranks are not 1 to n, with a chunk twice or a score that is no number."""
    w = Window.partitionBy("run_id", "question_id")
    rows = hits.withColumn("place", F.row_number().over(w.orderBy("rank", "chunk_id"))).withColumn("again", F.count(F.lit(1)).over(Window.partitionBy("run_id", "question_id", "chunk_id")))
    bad = (F.col("place") != F.col("rank")) | (F.col("again") > 1) | ~F.coalesce(F.abs("score") < float("inf"), F.lit(False)) | F.isnan("score")
    return rows.where(F.coalesce(bad, F.lit(True))).select("run_id", "question_id").distinct()
