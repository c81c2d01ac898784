"""Operator 11: source divergence audit by joint histograms of term counts.

Terms are maximal runs of ASCII letters and of code points from U+0080 on, with A-Z lower-cased. A language keeps
the V terms that at least ``MIN_DOCS`` of its documents hold. A group (language, source) and the whole language give
each kept term, with c occurrences there, the share p = 1 + floor(10^9 (c + 2) / (N + 2 V)), N being all its
occurrences of kept terms. Two shares differ by f = floor((p - q)^2 / (p + q)).

``pairs``: two sources of a language differ by the sum of f over all kept terms. A share depends on the count alone,
so a pair is summed from its joint histogram: how many terms have the counts (x, y) in the two. Only terms that both
hold are met, by a join on the term whose rows fall into partial counts at once. Cells with a zero are implied: a
pair's cell (x, 0) is the number of terms of count x in the first source less those that were met with it, and (0, 0)
is what is left of V. Written as signed multiplicities these are rows of the same aggregation, and f is evaluated once
a cell. f is symmetric, so a pair is counted once and reported in both directions.

``excess``: the terms of a group whose share passes the language's, the ``k`` with the greatest f.

Counts run through partial aggregates on (language, source, term), so a hot source, a frequent term and a repeated
document shrink before the shuffle; tables by group join by key. The result has a row for each ordered pair of sources
of a language; work on a term grows with the square of the number of sources that hold it, which is at most that.

Defined results: null text, lang and source read as ''; a group without terms has N = 0 and is compared like others;
a language without kept terms gives its pairs the value 0 and no terms; a source alone in its language has no pairs;
rows repeated in full count as documents of their own; ties go to the smaller item in UTF-8 order; an empty table
gives no rows; other columns are not read. Counts multiply as decimals, so they are exact beyond 64 bits.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evalbench.llm._spark import stash, table

MIN_DOCS = 10
TOP_TERMS = 10
TERMS = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
SHARE = 1_000_000_000


def counts(docs: DataFrame) -> DataFrame:
    """``lang, source, term, n`` (occurrences), ``d`` (documents that hold it)."""
    text = F.translate(F.coalesce("text", F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    named = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), F.regexp_extract_all(text, F.lit(TERMS), F.lit(0)).alias("terms"))
    # a document's terms, and after them each of its distinct terms once more
    both = named.select("lang", "source", F.size("terms").alias("__all"), F.posexplode(F.concat("terms", F.array_distinct("terms"))).alias("__at", "term"))
    each = (F.col("__at") < F.col("__all")).cast("long")
    return both.groupBy("lang", "source", "term").agg(F.sum(each).alias("n"), F.sum(1 - each).alias("d"))


class Kept:
    """Counts of the kept terms, and what groups and languages add up to."""

    def __init__(self, docs: DataFrame, min_docs: int = MIN_DOCS):
        found = stash(counts(docs), "divergence-counts")
        terms = found.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("d").alias("d")).where(F.col("d") >= min_docs).drop("d")
        #: lang, term, source, n (from 1), lang_n
        self.terms = stash(found.join(terms, ["lang", "term"]).select("lang", "term", "source", "n", "lang_n"), "divergence-kept")
        each = self.terms.groupBy("lang", "source").agg(F.sum("n").alias("total"))
        langs = self.terms.select("lang", "term", "lang_n").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("lang_n").alias("lang_total"))
        groups = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source")).distinct()
        zero = {"total": 0, "v": 0, "lang_total": 0}
        #: lang, source, total, v, lang_total; every group of the table
        self.groups = stash(groups.join(each, ["lang", "source"], "left").join(langs, "lang", "left").fillna(zero), "divergence-groups")


def share(n: Column | str, total: str, v: str) -> Column:
    """The share of a term with ``n`` occurrences among ``total`` of ``v`` terms; ``v`` is above 0."""
    return F.expr(f"1 + (cast({SHARE} as decimal(10,0)) * (cast({n} as decimal(19,0)) + 2)) div (cast({total} as decimal(19,0)) + 2 * cast({v} as decimal(18,0)))")


def difference(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def cells(kept: Kept) -> DataFrame:
    """``lang, a, b, x, y, m``: of sources a < b, how many kept terms occur x times in a and y times in b; m may be 0."""
    left, right = kept.terms.select("lang", "term", F.col("source").alias("a"), F.col("n").alias("x")), kept.terms.select("lang", "term", F.col("source").alias("b"), F.col("n").alias("y"))
    met = left.join(right, ["lang", "term"]).where("a < b").groupBy("lang", "a", "b", "x", "y").agg(F.count(F.lit(1)).alias("m"))
    own = stash(kept.terms.groupBy("lang", "source", "n").agg(F.count(F.lit(1)).alias("m")), "divergence-histograms")
    first, second = kept.groups.select("lang", F.col("source").alias("a"), "v"), kept.groups.select("lang", F.col("source").alias("b"))
    pair = stash(first.join(second, "lang").where("a < b"), "divergence-pairs")
    cell = lambda x, y, m: F.struct(F.expr(x).cast("long").alias("x"), F.expr(y).cast("long").alias("y"), F.expr(m).cast("long").alias("m"))
    split = lambda df, *parts: df.select("lang", "a", "b", F.explode(F.array(*parts)).alias("c")).select("lang", "a", "b", "c.*")
    parts = [
        split(met, cell("x", "y", "m"), cell("x", "0", "-m"), cell("0", "y", "-m"), cell("0", "0", "m")),
        split(pair.join(own.withColumnRenamed("source", "a"), ["lang", "a"]), cell("n", "0", "m"), cell("0", "0", "-m")),
        split(pair.join(own.withColumnRenamed("source", "b"), ["lang", "b"]), cell("0", "n", "m"), cell("0", "0", "-m")),
        split(pair, cell("0", "0", "v")),
    ]
    rows = parts[0]
    for more in parts[1:]:
        rows = rows.unionByName(more)
    return rows.groupBy("lang", "a", "b", "x", "y").agg(F.sum("m").alias("m"))


def pairs(kept: Kept) -> DataFrame:
    """``lang, source, item, value`` for each ordered pair of sources of a language."""
    first = kept.groups.select("lang", F.col("source").alias("a"), F.col("total").alias("total_a"), "v")
    second = kept.groups.select("lang", F.col("source").alias("b"), F.col("total").alias("total_b"))
    with_totals = cells(kept).join(first, ["lang", "a"]).join(second, ["lang", "b"])
    shares = with_totals.withColumn("p", F.when(F.col("v") > 0, share("x", "total_a", "v"))).withColumn("q", F.when(F.col("v") > 0, share("y", "total_b", "v")))
    value = F.coalesce(F.sum(difference("p", "q") * F.col("m")), F.lit(0)).cast("long")
    once = shares.groupBy("lang", "a", "b").agg(value.alias("value"))
    ways = F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))
    return once.select("lang", "value", F.explode(ways).alias("w")).select("lang", "w.source", "w.item", "value")


def excess(kept: Kept) -> DataFrame:
    """``lang, source, item, value`` of each term of a group whose share passes the language's."""
    rows = kept.terms.join(kept.groups, ["lang", "source"])
    rows = rows.withColumn("p", share("n", "total", "v")).withColumn("q", share("lang_n", "lang_total", "v")).where("p > q")
    return rows.select("lang", "source", F.col("term").alias("item"), difference("p", "q").alias("value"))


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, k: int = TOP_TERMS) -> DataFrame:
    """``lang, source, part, item, value, rank``: all pairs of sources of a language and the ``k`` first terms of each group."""
    kept = Kept(docs, min_docs)
    ranked = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", F.col("value").cast("long").alias("value"), F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).alias("rank"))
    return ranked(pairs(kept), "pair").unionByName(ranked(excess(kept), "term").where(F.col("rank") <= k))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents").select("text", "lang", "source"))


SQL = rf"""
with t as (select coalesce(lang, '') as lang, coalesce(source, '') as source, row_number() over () as id,
        regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '{TERMS}') as terms from documents),
    words as (select lang, source, id, unnest(terms) as term from t),
    kept as (select lang, term from words group by lang, term having count(distinct id) >= {MIN_DOCS}),
    langs as (select lang, count(*) as v from kept group by lang),
    groups as (select distinct lang, source from t),
    seen as (select lang, source, term, count(*) as n from words join kept using (lang, term) group by all),
    cells as (select g.lang, g.source, k.term, coalesce(s.n, 0) as n from groups g join kept k using (lang) left join seen s on s.lang = g.lang and s.source = g.source and s.term = k.term),
    totals as (select lang, source, sum(n) as total from cells group by all),
    shares as (select lang, source, term, n, cast(1 + ({SHARE}::hugeint * (n + 2)) // (total::hugeint + 2 * v) as bigint) as p from cells join totals using (lang, source) join langs using (lang)),
    whole as (select lang, term, cast(1 + ({SHARE}::hugeint * (sum(n)::hugeint + 2)) // ((sum(sum(n)) over (partition by lang))::hugeint + 2 * any_value(v)) as bigint) as q from cells join langs using (lang) group by lang, term),
    diverge as (select a.lang, a.source, b.source as item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) as value from shares a join shares b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
    rows as (select a.lang, a.source, 'pair' as part, b.source as item, cast(coalesce(d.value, 0) as bigint) as value
            from groups a join groups b on a.lang = b.lang and a.source <> b.source left join diverge d on d.lang = a.lang and d.source = a.source and d.item = b.source
        union all select lang, source, 'term', term, ((p - q) * (p - q)) // (p + q) from shares join whole using (lang, term) where n > 0 and p > q)
select lang, source, part, item, value, cast(row_number() over (partition by lang, source, part order by value desc, item) as integer) as rank from rows
qualify part = 'pair' or rank <= {TOP_TERMS}
"""
