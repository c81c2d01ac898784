"""Checks of requests and configurations that need no table."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from evalbench.functions import text as tx

#: Fields of a configuration that name a run and do not change its result.
NAMES = ("name", "output_dir")
GOLD_COMMANDS = ("evaluate-gold", "sealed-gold-test")
MOST_QUERY, MOST_HITS = 10_000, 100


def semantic_hash(config: dict) -> str:
    """SHA-256 of a configuration as JSON with sorted keys, without what only names the run."""
    kept = {k: v for k, v in config.items() if k not in NAMES}
    return hashlib.sha256(json.dumps(kept, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def search_problem(query: Column, top_k: Column) -> Column:
    """What is wrong with a search request: a blank or long query, a number of hits out of bounds."""
    blank = F.coalesce(F.trim(query) == "", F.lit(True))
    return F.when(blank, "blank_query").when(F.length(query) > MOST_QUERY, "long_query").when(~F.coalesce(top_k.between(1, MOST_HITS), F.lit(False)), "top_k")


def campaign_hash(plan_hash: Column, rounds: Column, reduced: Column) -> Column:
    """What an operator confirms before a generation campaign: its plan, its replacement rounds and whether it may end short."""
    return tx.canonical_hash(initial_plan_hash=plan_hash, max_replacement_rounds=rounds, allow_reduced_scope=reduced)


def gold_refusal(allowed: str | None, explicit: bool, command: str) -> str | None:
    """Why gold items stay closed: the environment's switch is not 1, no explicit flag, a command that may not read them."""
    if allowed != "1":
        return "environment"
    if not explicit:
        return "not_explicit"
    return None if command in GOLD_COMMANDS else "command"
