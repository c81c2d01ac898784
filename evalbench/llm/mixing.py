"""Operator 4: mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Only DataFrame and SQL functions. Every source's documents are dealt into blocks by a hash; the blocks of a
source, put in a hashed order for each pass over it, are its sequence of draws: as many whole passes as its
target holds, then whole blocks of a last pass, then a block of which a hashed prefix of the documents fits.
The draws are shared out among output shards by a binary tree: a node holds the number of draws of each
source; its left child gets half of all, source by source from the hypergeometric distribution given what
is left (drawn by inversion from the mode, with a hashed uniform number), and the right child the rest. So
every split is exact: quotas of a source add up to its draws. A shard then takes the next draws of each
source, which are disjoint, and orders its rows by a hash: they are dealt to tasks by shard and sorted there.

Blocks hold about ``BLOCK_WORDS`` words or ``BLOCK_DOCS`` documents, so a hot source is many blocks and no
task holds a source's documents together. Running sums over a source's blocks, draws and shards go in two levels,
so no task holds these together either. Tables by source or by block are aggregates.

Targets: the sources' sizes sum to the budget, weights 1, 2, 3 repeat over the sources in code point order
with null last, no target passes 3 times its source's size, and what is cut is shared again by weight. With
the sources ordered by limit / weight those at their limit are a prefix, so two running sums give the result.

Defined results: a null text counts 0 words; a null source is a source; a source without words has target 0
and is not drawn; no rows give no rows; rows repeated in full are separate documents that fall into the same
block; a very long document is one unit and taken whole or not; ``mix`` keeps all columns of ``docs``.
Everything derives from hashes of ids and a seed, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evalbench.llm._spark import stash, table

BLOCK_WORDS = 100_000
BLOCK_DOCS = 1_000
SHARD_DRAWS = 8
SPAN = 4096  # blocks, draws or shards of a source that one window holds
MOST = 3
WORDS = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """Of ``source, source_size, docs``: also ``sid`` (from 0), ``weight`` and ``target``."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    by_limit = Window.orderBy("limit_per_weight", "sid")
    upto = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    after = by_limit.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    limit = F.col("source_size") * F.lit(float(MOST))
    s = sizes.withColumn("sid", (F.row_number().over(order) - 1).cast("long")).withColumn("weight", (F.col("sid") % 3 + 1).cast("double"))
    s = s.withColumn("limit_per_weight", limit / F.col("weight")).withColumn("total", F.sum("source_size").over(everything).cast("double"))
    level = (F.col("total") - F.coalesce(F.sum(limit).over(upto), F.lit(0.0))) / F.sum("weight").over(after)
    s = s.withColumn("level", level)
    free = F.min(F.when(F.col("limit_per_weight") >= F.col("level"), F.struct("limit_per_weight", "sid", "level"))).over(everything)
    s = s.withColumn("free", free)
    below = F.col("free").isNull() | (F.struct("limit_per_weight", "sid") < F.struct(F.col("free.limit_per_weight"), F.col("free.sid")))
    target = F.when(below, limit).otherwise(F.least(limit, F.col("weight") * F.col("free.level")))
    return s.select("source", "sid", "source_size", "docs", "weight", target.alias("target"))


def upto(rows: DataFrame, by: str, span: Column, order: list[Column | str], value: Column, name: str) -> DataFrame:
    """``rows`` with the sum of ``value`` over those of the same ``by`` that come before, in two levels.

    ``span`` cuts the order into parts of bounded size: sums by part run ahead, and a window stays within a part. So
    no task holds all rows of a hot ``by``.
    """
    rows = rows.withColumn("__span", span).withColumn("__value", value)
    parts = rows.groupBy(by, "__span").agg(F.sum("__value").alias("__sum"))
    ahead = Window.partitionBy(by).orderBy("__span").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(by, "__span", F.coalesce(F.sum("__sum").over(ahead), F.lit(0)).alias("__ahead"))
    inside = Window.partitionBy(by, "__span").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = rows.withColumn("__inside", F.coalesce(F.sum("__value").over(inside), F.lit(0))).join(parts, [by, "__span"])
    return out.withColumn(name, F.col("__ahead") + F.col("__inside")).drop("__span", "__value", "__inside", "__ahead")


def part_of(h: Column, blocks: Column) -> Column:
    """The part of a hashed order that a place falls into: as many equal ranges of hashes as give ``SPAN`` blocks each."""
    return F.floor((h / F.lit(2.0**64) + 0.5) * F.ceil(blocks / SPAN)).cast("long")


#: ln x! by Stirling's series at x + 10, brought down again.
LOG_FACTORIAL = "(x + 10.5D) * ln(x + 10D) - x - 10D + 0.9189385332046727D + 1D/(12D*(x + 10D)) - 1D/(360D*pow(x + 10D, 3)) - ln((x+1D)*(x+2D)*(x+3D)*(x+4D)*(x+5D)*(x+6D)*(x+7D)*(x+8D)*(x+9D)*(x+10D))"


def hypergeometric(total: str, good: str, drawn: str, uniform: str) -> str:
    """SQL: the number of ``good`` among ``drawn`` of ``total`` items, by inversion from the mode outwards.

    Steps reach 12 standard deviations to either side; what lies beyond has less than 1e-30 and falls to the mode.
    """
    mode = "least(least(g.k, g.m), greatest(greatest(0D, g.m + g.k - g.n), floor((g.m + 1D) * (g.k + 1D) / (g.n + 2D))))"
    logs = f"transform(array(f.n, f.k, f.n - f.k, f.m, f.n - f.m, f.x, f.k - f.x, f.m - f.x, f.n - f.k - f.m + f.x), x -> {LOG_FACTORIAL})"
    at_mode = "exp(l[1] - l[5] - l[6] + l[2] - l[7] - l[8] - l[0] + l[3] + l[4])"
    steps = "cast(20 + ceil(12D * sqrt(h.m * (h.k / h.n) * (1D - h.k / h.n))) as int)"
    up = "if(a.up_x < least(h.k, h.m), a.up * (h.k - a.up_x) * (h.m - a.up_x) / ((a.up_x + 1D) * (h.n - h.k - h.m + a.up_x + 1D)), 0D)"
    down = "if(a.down_x > greatest(0D, h.m + h.k - h.n), a.down * a.down_x * (h.n - h.k - h.m + a.down_x) / ((h.k - a.down_x + 1D) * (h.m - a.down_x + 1D)), 0D)"
    start = "named_struct('left', h.u - h.p, 'up', h.p, 'down', h.p, 'up_x', h.x, 'down_x', h.x, 'out', if(h.u < h.p, h.x, -1D))"
    step = f"""transform(array(named_struct('up', {up}, 'down', {down}, 'up_x', a.up_x + 1D, 'down_x', a.down_x - 1D)), t ->
        named_struct('left', a.left - t.up - t.down, 'up', t.up, 'down', t.down, 'up_x', t.up_x, 'down_x', t.down_x,
        'out', case when a.out >= 0D then a.out when t.up > 0D and a.left < t.up then t.up_x when t.down > 0D and a.left < t.up + t.down then t.down_x else -1D end))[0]"""
    given = f"array(named_struct('n', cast({total} as double), 'k', cast({good} as double), 'm', cast({drawn} as double), 'u', {uniform}))"
    with_mode = f"transform({given}, g -> named_struct('n', g.n, 'k', g.k, 'm', g.m, 'u', g.u, 'x', cast({mode} as double)))"
    with_p = f"transform({with_mode}, f -> named_struct('n', f.n, 'k', f.k, 'm', f.m, 'u', f.u, 'x', f.x, 'p', transform(array({logs}), l -> {at_mode})[0]))"
    return f"""(case when {good} <= 0 or {drawn} <= 0 then 0L when {drawn} >= {total} then cast({good} as long) when {good} >= {total} then cast({drawn} as long) else
        transform({with_p}, h -> aggregate(sequence(1, {steps}), {start}, (a, i) -> {step}, a -> cast(if(a.out >= 0D, a.out, h.x) as long)))[0] end)"""


def split(nodes: DataFrame, seed: int, level: int) -> DataFrame:
    """Each node (node, draws array<long>) into its children 2 * node and 2 * node + 1."""
    uniform = f"(shiftrightunsigned(xxhash64({seed}L, {level}L, node, cast(s.i as long)), 11) * {2.0**-53!r}D)"
    draw = hypergeometric("s.total", "k", "s.half", uniform)
    fold = f"""aggregate(draws,
        named_struct('i', 0, 'total', aggregate(draws, 0L, (x, y) -> x + y), 'half', cast(floor(aggregate(draws, 0L, (x, y) -> x + y) / 2) as long), 'out', cast(array() as array<bigint>)),
        (s, k) -> transform(array({draw}), d -> named_struct('i', s.i + 1, 'total', s.total - k, 'half', s.half - d, 'out', concat(s.out, array(d))))[0],
        s -> s.out)"""
    halves = nodes.select("node", "draws", F.expr(fold).alias("a"))
    both = F.array(F.struct((F.col("node") * 2).alias("node"), F.col("a").alias("draws")), F.struct((F.col("node") * 2 + 1).alias("node"), F.zip_with("draws", "a", lambda x, y: x - y).alias("draws")))
    return halves.select(F.explode(both).alias("c")).select("c.node", "c.draws")


def shards(draws: DataFrame, seed: int) -> DataFrame:
    """From ``sid, draws`` (of every source, 0 too): ``sid, draw`` (from 0) and the ``shard`` it goes to."""
    total = draws.agg(F.sum("draws")).first()[0] or 0
    levels = max(0, (max(1, -(-total // SHARD_DRAWS)) - 1).bit_length())
    # one array, by source: its length is the number of sources, not of documents
    node = draws.agg(F.array_sort(F.collect_list(F.struct("sid", "draws"))).alias("all")).select(F.lit(0).cast("long").alias("node"), F.col("all.draws").alias("draws"))
    for level in range(levels):
        node = split(node, seed, level)
        if level % 4 == 3:  # short plans, and many tasks from 16 nodes on
            node = stash(node.repartition("node"), "mix-tree")
    # sources are numbered from 0 without gaps, so a place in the array is a source
    quotas = node.select(F.col("node").alias("shard"), F.posexplode("draws").alias("place", "n")).select("shard", F.col("place").cast("long").alias("sid"), "n")
    quotas = upto(quotas, "sid", F.floor(F.col("shard") / SPAN), ["shard"], F.col("n"), "first").where("n > 0")
    return quotas.select("sid", "shard", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("draw"))


def plan(rows: DataFrame, seed: int) -> tuple[DataFrame, DataFrame]:
    """The sources with their targets, and the blocks with their draws, for ``rows`` of source, size and h."""
    sources = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs")))
    pieces = F.greatest(F.ceil(F.col("source_size") / BLOCK_WORDS), F.ceil(F.col("docs") / BLOCK_DOCS), F.lit(1)).cast("long")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(ratio + 1e-12).cast("long")
    sources = sources.withColumn("blocks", pieces).withColumn("passes", whole)
    sources = stash(sources.withColumn("rest", F.greatest(F.lit(0.0), F.col("target") - F.col("passes") * F.col("source_size"))), "mix-sources")
    dealt = rows.join(sources, rows.source.eqNullSafe(sources.source)).select("sid", F.pmod("h", "blocks").alias("block"), "size", "passes", "rest", "blocks")
    blocks = dealt.groupBy("sid", "block").agg(F.sum("size").alias("words"), *[F.first(c).alias(c) for c in ("passes", "rest", "blocks")])
    blocks = blocks.withColumn("order", F.xxhash64(F.lit(seed), F.lit("last"), "sid", "block"))
    blocks = upto(blocks, "sid", part_of(F.col("order"), F.col("blocks")), ["order", "block"], F.col("words"), "begin")
    begin, blocks = F.col("begin"), blocks.withColumn("end", F.col("begin") + F.col("words"))
    blocks = blocks.select(
        "sid", "block", "passes", "blocks",
        ((F.col("end") <= F.col("rest")) & (F.col("words") > 0)).alias("again"),
        F.when((F.col("end") > F.col("rest")) & (begin < F.col("rest")), F.col("rest") - begin).alias("budget"),
    )
    blocks = stash(blocks, "mix-blocks")
    last = F.col("again") | F.col("budget").isNotNull()
    draws = blocks.select("sid", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("passes") + last.cast("long"))).alias("pass"), "passes", "again", "budget", "blocks")
    draws = draws.where((F.col("pass") < F.col("passes")) | ((F.col("pass") == F.col("passes")) & last))
    # the last pass keeps its order: whole blocks first, the shared one after them
    draws = draws.withColumn("partial", (F.col("pass") == F.col("passes")) & F.col("budget").isNotNull()).withColumn("order", F.xxhash64(F.lit(seed), "pass", "sid", "block"))
    numbered = upto(draws, "sid", F.struct("pass", "partial", part_of(F.col("order"), F.col("blocks")).alias("part")), ["order", "block"], F.lit(1).cast("long"), "draw")
    numbered = numbered.select("sid", "block", "draw", "partial")
    counts = numbered.groupBy("sid").agg(F.count(F.lit(1)).alias("draws"))
    counts = sources.select("sid").join(counts, "sid", "left").select("sid", F.coalesce("draws", F.lit(0)).cast("long").alias("draws"))
    where = shards(counts, seed)
    placed = numbered.join(where, ["sid", "draw"]).groupBy("sid", "block").agg(
        F.sort_array(F.collect_list(F.when(~F.col("partial"), F.col("shard")))).alias("shards"), F.max(F.when(F.col("partial"), F.col("shard"))).alias("last_shard")
    )
    return sources, stash(blocks.select("sid", "block", "budget").join(placed, ["sid", "block"], "left"), "mix-placed")


def decide(rows: DataFrame, seed: int = 1, small: DataFrame | None = None) -> DataFrame:
    """``rows`` (source, size, h and others) with source_size, target and ``shards``: the shard of each copy taken.

    ``small`` may give the same rows' source, size and h, where ``rows`` are costly to read.
    """
    sources, blocks = plan(rows.select("source", "size", "h") if small is None else small, seed)
    keyed = rows.join(sources.withColumnRenamed("source", "__source"), rows.source.eqNullSafe(F.col("__source"))).drop("__source")
    keyed = keyed.withColumn("block", F.pmod("h", "blocks")).drop("docs", "weight", "blocks", "passes", "rest")
    keyed = keyed.join(blocks, ["sid", "block"], "left").withColumn("shards", F.coalesce("shards", F.array().cast("array<long>")))
    whole = keyed.where(F.col("budget").isNull())
    # the shared block of a source, which is bounded: a prefix in hashed order, then the smallest ones that still fit
    ties = ["h", "size", *(["doc_id"] if "doc_id" in rows.columns else [])]
    block = Window.partitionBy("sid", "block")
    upto = (Window.unboundedPreceding, Window.currentRow)
    shared = keyed.where(F.col("budget").isNotNull()).withColumn("__upto", F.sum("size").over(block.orderBy(*ties).rowsBetween(*upto)))
    shared = shared.withColumn("__prefix", F.col("__upto") <= F.col("budget"))
    shared = shared.withColumn("__used", F.coalesce(F.max(F.when(F.col("__prefix"), F.col("__upto"))).over(block), F.lit(0)))
    more = F.sum(F.when(F.col("__prefix"), 0).otherwise(F.col("size"))).over(block.orderBy("__prefix", "size", *ties).rowsBetween(*upto))
    shared = shared.withColumn("fits", F.col("__prefix") | (more <= F.col("budget") - F.col("__used"))).drop("__upto", "__prefix", "__used")
    shared = shared.withColumn("shards", F.when(F.col("fits") & (F.col("size") > 0), F.concat("shards", F.array("last_shard"))).otherwise(F.col("shards"))).drop("fits")
    out = whole.unionByName(shared)
    return out.withColumn("shards", F.when(F.col("size") > 0, F.col("shards")).otherwise(F.array().cast("array<long>"))).drop("sid", "block", "budget", "last_shard")


def measured(docs: DataFrame, seed: int) -> DataFrame:
    # rows without an id are told apart by their texts, else all would be one block
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit(":"), F.col("text")), F.lit(""))
    return docs.select("*", word_count(F.col("text")).alias("__size"), F.xxhash64(F.lit(seed), F.lit("doc"), name).alias("__h"))


def copies(docs: DataFrame, seed: int) -> DataFrame:
    """``row`` (a struct of the columns of ``docs``), ``mix_shard`` and ``mix_key``, once a copy taken, shard by shard in the order of the key."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *[F.col(c) for c in ("doc_id", "source", "text")])
    rows = measured(packed, seed).select("row", F.col("doc_id"), "source", F.col("__size").alias("size"), F.col("__h").alias("h"))
    small = stash(rows.select("source", "size", "h"), "mix-rows")
    taken = decide(rows, seed, small).select("row", "h", F.posexplode("shards").alias("copy", "mix_shard"))
    keyed = taken.select("row", "mix_shard", F.xxhash64(F.lit(seed), "h", "copy", "mix_shard").alias("mix_key"))
    return keyed.repartition("mix_shard").sortWithinPartitions("mix_shard", "mix_key")


def mix(docs: DataFrame, seed: int = 1) -> DataFrame:
    """The mixture: each row of ``docs`` once a copy taken, with ``mix_shard`` and ``mix_key`` (its place by order within the shard), in place of columns of these names."""
    own = [c for c in docs.columns if c.lower() not in ("mix_shard", "mix_key")]
    return copies(docs, seed).select(*[F.col(f"row.`{c}`").alias(c) for c in own], "mix_shard", "mix_key")


def mixed(docs: DataFrame, seed: int = 1) -> DataFrame:
    """The rows of the mixture with the columns of ``docs`` alone; a shard's rows stand together, in their shuffled order."""
    return copies(docs, seed).select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "source", "text")
    rows = stash(measured(docs, 1).select("doc_id", "source", F.col("__size").alias("size"), F.col("__h").alias("h")), "mix-rows")
    out = decide(rows)
    return out.select("doc_id", "size", F.col("source_size").cast("long").alias("source_size"), "target", (F.col("size") * F.size("shards")).cast("long").alias("taken"), "shards")
