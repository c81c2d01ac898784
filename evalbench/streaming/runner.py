"""A run's questions as a stream: outcomes arrive, a stop rule holds over micro-batches and restarts.

``outcomes`` (run_id, step, outcome) come in the order of their steps from one micro-batch to the next, and in any order
within one. An outcome is ``ok``, ``schema``, ``provider`` or ``other`` (failures), ``budget`` (the run is out of money)
or ``cancel``; ``resume`` and ``resume_acknowledged`` start a stopped run again. A failure stops its run once the last
``window`` outcomes are there and the part of schema or of provider errors among them reaches its threshold; budget and
cancel stop it at once. What comes while a run is stopped is not asked and counts as skipped. A run that a threshold has
stopped goes on only if that is acknowledged; going on begins a new window.

The state of a run is its last ``window`` outcomes and some counts. A micro-batch is as large as the source's limit, and
a run's rows of it are sorted in its task.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LETTERS = {"ok": "o", "schema": "s", "provider": "p", "other": "x"}
STATE = "recent string, status string, reason string, stop_step long, answered long, failed long, skipped long"
ROWS = "run_id string, step long, status string, reason string, stop_step long, answered long, failed long, skipped long"


def advance(state: tuple, step: int, outcome: str, window: int, schema_rate: float, provider_rate: float) -> tuple:
    """The state of a run after one more outcome."""
    recent, status, reason, stop_step, answered, failed, skipped = state
    if outcome in ("resume", "resume_acknowledged"):
        if status != "stopped" or (reason.endswith("_threshold") and outcome != "resume_acknowledged"):
            return state
        return "", "running", None, None, answered, failed, skipped
    if status == "stopped":
        return recent, status, reason, stop_step, answered, failed, skipped + (outcome != "cancel")
    if outcome == "cancel":
        return recent, "stopped", "operator_cancelled", step, answered, failed, skipped
    if outcome == "budget":
        return recent, "stopped", "budget_exhausted", step, answered, failed + 1, skipped
    recent = (recent + LETTERS[outcome])[-window:]
    if outcome == "ok":
        return recent, status, reason, stop_step, answered + 1, failed, skipped
    failed += 1
    if len(recent) == window:
        for letter, rate, name in (("s", schema_rate, "schema_error_threshold"), ("p", provider_rate, "provider_error_threshold")):
            if recent.count(letter) >= rate * window:
                return recent, "stopped", name, step, answered, failed, skipped
    return recent, status, reason, stop_step, answered, failed, skipped


def run_states(outcomes: DataFrame, window: int = 10, schema_rate: float = 0.5, provider_rate: float = 0.5) -> DataFrame:
    """After each micro-batch the state of the runs it concerned; ``step`` is the last one seen, the newest row of a run counts."""
    if window < 1 or not 0 < schema_rate <= 1 or not 0 < provider_rate <= 1:
        raise ValueError("the window has a row at least, rates lie above 0 and up to 1")

    def step(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        state = held.get if held.exists else ("", "running", None, None, 0, 0, 0)
        rows = sorted((int(s), o) for b in batches for s, o in zip(b["step"], b["outcome"], strict=True))
        for at, outcome in rows:
            state = advance(state, at, outcome, window, schema_rate, provider_rate)
        held.update(state)
        _, status, reason, stop_step, *counts = state
        row = (key[0], rows[-1][0], status, reason or "", -1 if stop_step is None else stop_step, *counts)
        yield pd.DataFrame([row], columns=[c.split(" ")[0] for c in ROWS.split(", ")])

    out = outcomes.groupBy("run_id").applyInPandasWithState(step, ROWS, STATE, "append", GroupStateTimeout.NoTimeout)
    return out.withColumns({"stop_step": F.when(F.col("reason") != "", F.col("stop_step")), "reason": F.nullif("reason", F.lit(""))})
