"""Answer scoring and statistics: matching, citations, agreement, bootstrap, calibration."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evalbench.functions import text as tx
from evalbench.operators import order

#: Units, their dimension and their factor.
UNITS = {"원": ("krw", 1), "천원": ("krw", 1000), "만원": ("krw", 10000), "kg": ("mass-g", 1000), "킬로그램": ("mass-g", 1000), "g": ("mass-g", 1), "그램": ("mass-g", 1), "%": ("scalar", 0.01), "퍼센트": ("scalar", 0.01)}
NUMBER = r"^([₩￦$])?([+-]?[0-9]+(?:\.[0-9]+)?)(원|천원|만원|kg|킬로그램|g|그램|%|퍼센트)?$"
GROUPED = r"^[₩￦$]?[+-]?[0-9]{1,3}(,[0-9]{3})+(\.[0-9]+)?[^0-9,]*$"


def numeric_value(answer: Column) -> Column:
    """struct(value decimal, dimension) of an answer that is a number with an optional sign of money or unit; else null."""
    compact = F.regexp_replace(F.lower(answer), r"\s+", "")
    plain = F.regexp_replace(compact, ",", "")
    prefix, unit = F.regexp_extract(plain, NUMBER, 1), F.regexp_extract(plain, NUMBER, 3)
    number = F.regexp_extract(plain, NUMBER, 2).try_cast("decimal(30,8)") if hasattr(answer, "try_cast") else F.regexp_extract(plain, NUMBER, 2).cast("decimal(30,8)")
    factor, dimension = F.lit(1.0).cast("decimal(12,4)"), F.lit("scalar")
    for name, (kind, times) in UNITS.items():
        factor = F.when(unit == name, F.lit(str(times)).cast("decimal(12,4)")).otherwise(factor)
        dimension = F.when(unit == name, F.lit(kind)).otherwise(dimension)
    money = prefix != ""
    factor = F.when(money, F.lit("1").cast("decimal(12,4)")).otherwise(factor)
    dimension = F.when(prefix == "$", "usd").when(money, "krw").otherwise(dimension)
    ok = F.regexp_like(plain, F.lit(NUMBER)) & (~F.contains(compact, F.lit(",")) | F.regexp_like(compact, F.lit(GROUPED)))
    return F.when(ok, F.struct((number * factor).cast("decimal(38,8)").alias("value"), dimension.alias("dimension")))


def match_answers(cases: DataFrame) -> DataFrame:
    """``cases`` (predicted, expected, aliases array) with exact, numeric, alias and correct."""
    key = lambda c: tx.answer_key(c)
    out = cases.withColumn("__p", key(F.col("predicted"))).withColumn("__g", key(F.col("expected")))
    left, right = numeric_value(F.col("predicted")), numeric_value(F.col("expected"))
    out = out.withColumn("exact", (F.col("__p") != "") & (F.col("__p") == F.col("__g")))
    out = out.withColumn("numeric", F.coalesce(left == right, F.lit(False)))
    out = out.withColumn("alias", F.exists("aliases", lambda a: (key(a) == F.col("__p")) & (F.col("__p") != F.col("__g"))))
    return out.withColumn("correct", F.col("exact") | F.col("numeric") | F.col("alias")).drop("__p", "__g")


def claim_metrics(cases: DataFrame) -> DataFrame:
    """Faithfulness, citation precision and recall of ``cases`` (question_id, claims array<struct(id, supported, evidence)>, citations map<claim, array>); null without a denominator."""
    n = F.size("claims")
    share = lambda part, whole: F.when(whole > 0, part / whole)
    supported = F.size(F.filter("claims", lambda c: c["supported"]))
    cited = lambda c: F.coalesce(F.try_element_at(F.col("citations"), c["id"]), F.array().cast("array<string>"))
    all_cited = F.aggregate("claims", F.lit(0), lambda a, c: a + F.size(cited(c)))
    good = F.aggregate("claims", F.lit(0), lambda a, c: a + F.size(F.filter(cited(c), lambda e: F.array_contains(c["evidence"], e))))
    covered = F.size(F.filter("claims", lambda c: F.arrays_overlap(cited(c), c["evidence"])))
    return cases.select("question_id", share(supported, n).alias("faithfulness"), share(good, all_cited).alias("citation_precision"), share(covered, n).alias("citation_recall"))


def abstention(answerable: Column, abstained: Column) -> dict[str, Column]:
    return {"abstention_accuracy": (abstained == ~answerable).cast("double"), "false_answer": (~answerable & ~abstained).cast("double"), "false_abstention": (answerable & abstained).cast("double")}


def aggregate_generation(metrics: DataFrame, by: list[str]) -> DataFrame:
    """Means of what is defined; error rates within their class, null where the class is empty."""
    return metrics.groupBy(*by).agg(
        F.count(F.lit(1)).alias("questions"), F.count("correctness").alias("scorable"), F.avg("correctness").alias("correctness"), F.avg("faithfulness").alias("faithfulness"),
        F.avg("abstention_accuracy").alias("abstention_accuracy"), F.avg(F.when(~F.col("answerable"), F.col("false_answer"))).alias("false_answer_rate"), F.avg(F.when(F.col("answerable"), F.col("false_abstention"))).alias("false_abstention_rate"),
    )


def percentiles(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """p50, p95 and p99 by linear interpolation."""
    p = F.percentile(value, F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)))
    return rows.groupBy(*by).agg(p.alias("p")).select(*by, *[F.element_at("p", i + 1).alias(n) for i, n in enumerate(("p50", "p95", "p99"))])


def kappa(pairs: DataFrame) -> DataFrame:
    """Raw agreement and Cohen's kappa of ``pairs`` (a, b); 1 where both raters always say the same."""
    n = pairs.agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("a") == F.col("b")).cast("double")).alias("observed"))
    side = lambda c: pairs.groupBy(F.col(c).alias("v")).agg(F.count(F.lit(1)).alias(f"n_{c}"))
    expected = side("a").join(side("b"), "v").agg(F.sum(F.col("n_a") * F.col("n_b")).alias("both"))
    out = n.join(F.broadcast(expected)).withColumn("expected", F.coalesce("both", F.lit(0)) / (F.col("n") * F.col("n")))
    return out.select("n", "observed", "expected", F.when(F.col("expected") == 1, 1.0).otherwise((F.col("observed") - F.col("expected")) / (1 - F.col("expected"))).alias("kappa"))


def mid_ranks(rows: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """``rows`` with the mean rank (from 1) of those of their group that have the same ``value``; see ``order.placed``."""
    placed = order.placed(rows, by, [F.asc_nulls_first(value)], "__place")
    keys = [*by, value]
    mid = placed.groupBy(*keys).agg(((F.min("__place") + F.max("__place")) / 2 + 1).alias(name)).withColumnsRenamed({k: f"__of_{k}" for k in keys})
    return placed.join(mid, order.same(keys, "__of_")).select(*rows.columns, name)


def spearman(rows: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """Pearson correlation of mid-ranks within each group."""
    ranked = mid_ranks(mid_ranks(rows.select(*by, a, b), by, a, "__a"), by, b, "__b")
    return ranked.groupBy(*by).agg(F.corr("__a", "__b").alias("rho"))


def threshold_agreement(rows: DataFrame, a: str, b: str, at: float) -> DataFrame:
    """Agreement and F1 of two scores read as at least ``at``; F1 is 0 without positives."""
    left, right = F.col(a) >= at, F.col(b) >= at
    out = rows.agg(F.avg((left == right).cast("double")).alias("agreement"), F.count(F.when(left & right, 1)).alias("tp"), F.count(F.when(left & ~right, 1)).alias("fp"), F.count(F.when(~left & right, 1)).alias("fn"))
    return out.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0)))


def normal_interval(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean and 1.96 standard errors; a point below two rows."""
    half = F.coalesce(1.96 * F.stddev_samp(value) / F.sqrt(F.count(value)), F.lit(0.0))
    return rows.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("effect"), (F.avg(value) - half).alias("low"), (F.avg(value) + half).alias("high"))


#: Draws that a task makes at once, and places of a block: a place within a block takes two bytes.
DRAWS, PLACES = 1 << 20, 1 << 16


def bootstrap_observations(pairs: DataFrame, seed: int, rounds: int) -> DataFrame:
    """Percentile interval of the mean of left - right; observations by place, drawn by a hash of (seed, round, draw).

    ``pairs``: place (from 0, without gaps), left, right. No draw is a row: a task makes up to ``DRAWS`` draws of a round
    and sends those of each block of places on as two bytes each; a block sums its rows by round.
    """
    base = pairs.select("place", (F.col("left") - F.col("right")).alias("d"))
    n = base.count()
    pieces = -(-n // DRAWS)

    def draw(batches):
        for pdf in batches:
            for i in pdf["id"]:
                i_round, first = divmod(int(i), pieces)
                head, md5 = f"{seed}:{i_round}:".encode() + b"%d", hashlib.md5
                digests = b"".join([md5(head % k).digest() for k in range(first * DRAWS, min(n, (first + 1) * DRAWS))])
                places = np.sort(np.frombuffer(digests, ">u4")[::4].astype(np.int64) % n)
                blocks, starts = np.unique(places // PLACES, return_index=True)
                own = [x.astype("<u2").tobytes() for x in np.split(places % PLACES, starts[1:])]
                yield pd.DataFrame({"block": blocks, "round": np.full(len(blocks), i_round, np.int32), "drawn": own})

    def total(key: tuple, rows: pd.DataFrame, drawn: pd.DataFrame) -> pd.DataFrame:
        at, d = rows["place"].to_numpy(np.int64) % PLACES, rows["d"].to_numpy(float)
        there = rows["known"].to_numpy(bool)
        sums, counts = np.bincount(at[there], d[there], PLACES), np.bincount(at[there], minlength=PLACES)
        got = [(sums[x].sum(), int(counts[x].sum())) for x in (np.frombuffer(b, "<u2") for b in drawn["drawn"])]
        return pd.DataFrame({"round": drawn["round"], "s": [g[0] for g in got], "n": [g[1] for g in got]})

    tasks = rounds * pieces
    drawn = base.sparkSession.range(0, tasks, 1, max(1, min(tasks, -(-rounds * n // (4 * DRAWS))))).mapInPandas(draw, "block long, round int, drawn binary")
    held = base.where(F.col("place").between(0, n - 1)).select("place", F.col("d").isNotNull().alias("known"), F.coalesce("d", F.lit(0.0)).alias("d"))
    parts = held.groupBy(F.floor(F.col("place") / PLACES).cast("long").alias("block")).cogroup(drawn.groupBy("block")).applyInPandas(total, "round int, s double, n long")
    means = parts.groupBy("round").agg(F.try_divide(F.sum("s"), F.sum("n")).alias("m"))
    return _interval(means.where("m is not null"), base.agg(F.avg("d").alias("effect")))


def bootstrap_clusters(pairs: DataFrame, seed: int, rounds: int) -> DataFrame:
    """The same with whole clusters drawn: ``pairs`` (cluster, left, right); a statistic is the mean over drawn observations."""
    sums = pairs.groupBy("cluster").agg(F.sum(F.col("left") - F.col("right")).alias("s"), F.count(F.lit(1)).alias("n"))
    placed = sums.withColumn("place", (F.row_number().over(Window.orderBy("cluster")) - 1).cast("long"))  # one row a cluster
    k = sums.count()
    draws = sums.sparkSession.range(rounds * k).select(F.floor(F.col("id") / k).alias("round"), (F.col("id") % k).alias("draw"))
    drawn = draws.withColumn("place", tx.hash_index(F.concat_ws(":", F.lit(seed), "round", "draw"), F.lit(k)))
    means = drawn.join(placed, "place").groupBy("round").agg((F.sum("s") / F.sum("n")).alias("m"))
    return _interval(means, sums.agg((F.sum("s") / F.sum("n")).alias("effect")))


BLOCK_ROWS = 65_536


def bootstrap_tree(sums: DataFrame, seed: int, rounds: int, block: int = BLOCK_ROWS) -> DataFrame:
    """The interval of sum(s) / sum(n) over drawn rows of ``sums`` (place from 0 without gaps, s, n): observations have n = 1, clusters their sums.

    A round draws as many rows as there are, with replacement. How many of them fall into a block of places comes from a
    tree of binomial splits, each of which has random numbers of its own, so a block finds its count by walking down
    to itself; within it the draws are uniform. So a round is multinomial, reruns agree, and what is shuffled is a row
    a block and round, whatever the rows: no draw is a row.
    """
    total = sums.count()

    def drawn(lo: int, hi: int) -> np.ndarray:
        """Draws of each round that fall into the places lo to hi - 1."""
        a, b, n = 0, total, np.full(rounds, total)
        while (a, b) != (lo, hi):
            middle = a + -(-((b - a) // block + ((b - a) % block > 0)) // 2) * block
            left = np.random.Generator(np.random.PCG64([seed, a, b])).binomial(n, (middle - a) / (b - a))
            a, b, n = (a, middle, left) if hi <= middle else (middle, b, n - left)
        return n

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        lo = int(key[0]) * block
        pdf = pdf.sort_values("place")
        both, size = pdf[["s", "n"]].to_numpy(float), len(pdf)
        r = np.random.Generator(np.random.PCG64([seed, lo, total, 1]))
        out = np.empty((rounds, 2))
        for i, k in enumerate(drawn(lo, min(total, lo + block))):
            out[i] = np.bincount(r.integers(0, size, k), minlength=size) @ both
        return pd.DataFrame({"round": range(rounds), "s": out[:, 0], "n": out[:, 1]})

    parts = sums.select("place", "s", "n").groupBy(F.floor(F.col("place") / block).cast("long")).applyInPandas(run, "round int, s double, n double")
    means = parts.groupBy("round").agg((F.sum("s") / F.sum("n")).alias("m"))
    return _interval(means, sums.agg((F.sum("s") / F.sum("n")).alias("effect")))


def _interval(means: DataFrame, effect: DataFrame) -> DataFrame:
    p = means.agg(F.percentile("m", F.array(F.lit(0.025), F.lit(0.975))).alias("p"), F.count(F.lit(1)).alias("rounds"))
    return p.join(F.broadcast(effect)).select("effect", F.element_at("p", 1).alias("low"), F.element_at("p", 2).alias("high"), "rounds")


def adjudicate(reviews: DataFrame) -> DataFrame:
    """``reviews`` (question_id, reviewer_id, decision): agreed decision, or what is missing."""
    g = reviews.groupBy("question_id").agg(F.countDistinct("reviewer_id").alias("reviewers"), F.count(F.lit(1)).alias("n"), F.countDistinct("decision").alias("decisions"), F.min("decision").alias("decision"))
    status = F.when((F.col("reviewers") != 2) | (F.col("n") != 2), "needs_two_reviewers").when(F.col("decisions") > 1, "needs_adjudication").otherwise("agreed")
    return g.select("question_id", status.alias("status"), F.when(status == "agreed", F.col("decision")).alias("decision"))
