"""Parse runs: plans that reuse checkpoints, provider responses into checkpoints, merged partial parses.

Money is decimal and rounded up once, at 6 places.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType
from pyspark.sql.window import Window


def cost(pages: Column, rate: str, buffer: str = "0") -> Column:
    """Pages at a rate, rounded up; with a buffer for taxes on top, rounded up again."""
    up = lambda c: F.ceil(c.cast("decimal(38,12)"), F.lit(6)).cast("decimal(38,6)")
    base = up(pages.cast("decimal(20,0)") * F.lit(rate).cast("decimal(12,6)"))
    return up(base * (F.lit(1).cast("decimal(6,4)") + F.lit(buffer).cast("decimal(6,4)"))) if buffer != "0" else base


def plan(documents: DataFrame, checkpoints: DataFrame, snapshot: str, mode: str, model: str, version: str) -> DataFrame:
    """document_id, source_sha256, pages, cache_hit and corrupt for each document of a snapshot.

    ``documents``: document_id, source_sha256, pages; ``checkpoints``: snapshot_id, document_id, source_sha256, pages,
    mode, model_id, model_version, status, payload, payload_hash. A checkpoint is found by snapshot, source, mode and
    model; it is a hit if it succeeded, its payload still has its hash and it is of the same document and pages.
    A success that is no hit is corrupt.
    """
    key = (F.col("snapshot_id") == snapshot) & (F.col("mode") == mode) & (F.col("model_id") == model) & (F.col("model_version") == version)
    found = checkpoints.where(key).select("source_sha256", F.col("document_id").alias("__document"), F.col("pages").alias("__pages"), "status", (F.sha2("payload", 256) == F.col("payload_hash")).alias("whole"))
    met = documents.join(found, "source_sha256", "left")
    success = F.coalesce(F.col("status") == "succeeded", F.lit(False))
    valid = success & F.coalesce(F.col("whole"), F.lit(False)) & (F.col("__document") == F.col("document_id")) & (F.col("__pages") == F.col("pages"))
    return met.select("document_id", "source_sha256", "pages", F.coalesce(valid, F.lit(False)).alias("cache_hit"), (success & ~F.coalesce(valid, F.lit(False))).alias("corrupt"))


def plan_totals(planned: DataFrame, rate: str, buffer: str, budget: str, settled: str) -> DataFrame:
    """New calls, billable pages, base and worst cost, what remains of the budget, corrupt checkpoints."""
    new = ~F.col("cache_hit")
    t = planned.agg(F.count(F.when(new, 1)).alias("new_calls"), F.coalesce(F.sum(F.when(new, F.col("pages"))), F.lit(0)).alias("billable_pages"), F.count(F.when(F.col("corrupt"), 1)).alias("corrupt"))
    t = t.withColumn("base", cost(F.col("billable_pages"), rate)).withColumn("worst", cost(F.col("billable_pages"), rate, buffer))
    return t.withColumn("remaining", (F.lit(budget).cast("decimal(20,6)") - F.lit(settled).cast("decimal(20,6)") - F.col("worst")).cast("decimal(38,6)"))


RESPONSE = "model string, elements array<struct<id:int,page:int,category:string,content:string>>, usage struct<pages:int>, content struct<markdown:string,html:string>"


def checkpoints(calls: DataFrame, version: str, rate: str, buffer: str) -> DataFrame:
    """document_id, pages, status, problem, payload_hash, mapped_pages, cost of each call (document_id, pages, raw; null raw: no response).

    A response counts as paid, so one that fails a check needs reconciliation: model version, elements that are no
    list of objects, page count, nothing recognised in it, elements beyond the pages.
    """
    rows = calls.withColumn("r", F.from_json("raw", RESPONSE)).withColumn("__kind", F.get_json_object("raw", "$.elements"))
    own = F.coalesce(F.col("r.elements"), F.array().cast("array<struct<id:int,page:int,category:string,content:string>>"))
    pages = F.array_distinct(F.transform(own, lambda e: e["page"]))
    malformed = F.col("__kind").isNotNull() & (F.col("r.elements").isNull() | F.exists(F.col("r.elements"), lambda e: e.isNull()))
    nothing = F.col("__kind").isNull() & F.col("r.usage.pages").isNull() & (F.coalesce(F.col("r.content.markdown"), F.lit("")) == "") & (F.coalesce(F.col("r.content.html"), F.lit("")) == "")
    problem = (
        F.when(F.col("raw").isNull(), "no_response")
        .when(F.get_json_object("raw", "$").isNull(), "not_json")
        .when(~F.coalesce(F.col("r.model") == version, F.lit(False)), "model_version")
        .when(malformed, "elements")
        .when(F.col("r.usage.pages") != F.col("pages"), "page_count")
        .when(nothing, "no_evidence")
        .when(F.exists(pages, lambda p: (p < 1) | (p > F.col("pages"))), "page_range")
    )
    rows = rows.withColumn("problem", problem)
    status = F.when(F.col("problem").isNull(), "succeeded").when(F.col("problem") == "no_response", "failed").otherwise("reconciliation_required")
    charged = F.when(status == "failed", F.lit(0).cast("decimal(38,6)")).otherwise(cost(F.col("pages"), rate, buffer))
    return rows.select("document_id", "pages", status.alias("status"), "problem", F.sha2("raw", 256).alias("payload_hash"), F.when(status == "succeeded", F.size(F.array_compact(pages))).alias("mapped_pages"), charged.alias("cost"))


def run_summary(planned: DataFrame, made: DataFrame) -> DataFrame:
    """Documents, pages, hits, successes and failures of a run, with their pages: a hit or a new success completes a document."""
    met = planned.select("document_id", F.col("pages").alias("p"), "cache_hit", "corrupt").join(made.select("document_id", "status"), "document_id", "left")
    hit, good = F.col("cache_hit"), ~F.col("cache_hit") & F.coalesce(F.col("status") == "succeeded", F.lit(False))
    bad = ~F.col("cache_hit") & F.col("status").isNotNull() & (F.col("status") != "succeeded")
    n = lambda c, name: F.count(F.when(c, 1)).alias(name)
    pages = lambda c, name: F.coalesce(F.sum(F.when(c, F.col("p"))), F.lit(0)).alias(name)
    return met.agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum("p"), F.lit(0)).alias("pages"), n(hit, "cache_hits"), pages(hit, "cached_pages"), n(good, "new_successes"), n(hit | good, "completed"), pages(hit | good, "completed_pages"), n(bad, "failures"), pages(bad, "failed_pages"), n(F.col("corrupt"), "corrupt"))


@F.pandas_udf(StringType())
def _offset_ids(html: pd.Series, offset: pd.Series) -> pd.Series:
    return pd.Series([x if x is None or not k else re.sub(r"""\bid=(["'])([0-9]+)\1""", lambda m, k=k: f"id={m[1]}{int(m[2]) + int(k)}{m[1]}", x) for x, k in zip(html, offset, strict=True)], dtype="object")


def merged(parts: DataFrame, elements: DataFrame) -> DataFrame:
    """document_id, part, idx, id, page, html of all elements of a document that was parsed in parts.

    ``parts``: document_id, part, start (pages before it); ``elements``: document_id, part, idx, id (or null), page, html.
    Pages go up by the start. Ids go up by the ids of the parts before it, so they stay unique, and the ids in the
    markup go with them.
    """
    most = elements.groupBy("document_id", "part").agg((F.max("id") + 1).alias("ids"))
    order = Window.partitionBy("document_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    moved = parts.join(most, ["document_id", "part"], "left").withColumn("shift", F.coalesce(F.sum(F.coalesce("ids", F.lit(0))).over(order), F.lit(0)))
    out = elements.join(moved.select("document_id", "part", "start", "shift"), ["document_id", "part"])
    return out.select("document_id", "part", "idx", (F.col("id") + F.col("shift")).alias("id"), (F.col("page") + F.col("start")).alias("page"), _offset_ids("html", "shift").alias("html"))


def snapshot_problems(checkpoints: DataFrame) -> DataFrame:
    """(problem, n) of what keeps a set of checkpoints from being chunked; empty if it may be.

    ``checkpoints``: snapshot_id, document_id, source_sha256, mode, status, pages, mapped array<int>, payload_hash, model_id,
    model_version. All have succeeded, are of one corpus snapshot and one of the two modes, map just the pages 1 to n
    and are identified; each mode has a document once, and both have the same ones.
    """
    wanted = F.sequence(F.lit(1), F.greatest("pages", F.lit(1)))
    pages = (F.col("pages") > 0) & (F.size(F.array_except(wanted, F.array_distinct("mapped"))) == 0) & (F.size(F.array_except(F.array_distinct("mapped"), wanted)) == 0)
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    known = F.col("mode").isin("standard", "enhanced")
    rules = F.array_compact(F.array(
        F.when(~F.coalesce(F.col("status") == "succeeded", F.lit(False)), "not_succeeded"), F.when(~F.coalesce(known, F.lit(False)), "unknown_mode"),
        F.when(~F.coalesce(pages, F.lit(False)), "incomplete_pages"), F.when(blank("payload_hash") | blank("model_id") | blank("model_version"), "no_identity"),
    ))
    own = checkpoints.select(F.explode(rules).alias("problem")).groupBy("problem").agg(F.count(F.lit(1)).alias("n"))
    by = checkpoints.where(known).groupBy("document_id", "source_sha256").agg(F.count(F.when(F.col("mode") == "standard", 1)).alias("s"), F.count(F.when(F.col("mode") == "enhanced", 1)).alias("e"))
    count = lambda rows, name: rows.agg(F.lit(name).alias("problem"), F.count(F.lit(1)).alias("n"))
    more = count(by.where("s > 1 or e > 1"), "duplicate").unionByName(count(by.where("s = 0 or e = 0"), "not_in_both_modes")).unionByName(count(checkpoints.select("snapshot_id").distinct().offset(1), "mixed_snapshots"))
    return own.unionByName(more).where("n > 0")
