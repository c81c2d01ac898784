"""Operator 12: sharding by a consistent-hash ring with virtual nodes and bounded loads.

Every shard stands at ``VNODES`` hashed places of a ring of 64-bit numbers; a row's key is hashed onto the ring and
belongs to the next place clockwise. A shard takes only what it has room for. Rows are inserted in this order: first
all rows, in ring order, that their own shard has room for; then the others, in ring order, each of which goes on
clockwise to the first place whose shard still has room. With ``law`` "rows" the room of a shard is its exact part of
all rows (the first n mod m shards take one more), so counts are at most one apart. With "bytes" it is the m-th part
of all bytes, and a row goes where its first byte falls, so a shard passes its room by less than the rows at the ends
of its stretches. ``slack`` widens the room to (1 + slack) of the mean: balance is then within it, and fewer rows move
when a shard is added.

Rows of one arc (between two places) that end up together are a stretch of the ring order, so the insertion needs only
the load of each arc: at most shards x VNODES + 1 numbers, which the driver walks; full places are skipped by pointers
to the next open one. A row then finds its shard by the loads before it on its arc. These come from one sort by range:
rows are dealt by (place, tie, a number of their own), so a repeated key or row is many ranges and no task holds it
whole, and sums by range and arc give the rest. Broadcasts are the tables of arcs and of cells of the ring, bounded by
shards x VNODES.

Defined results: a null key stands where its text's hash is; a null text has 0 bytes and counts like others; rows
repeated in full and equal texts are separate rows and need not share a shard; ties on the ring go by the text's hash;
a row larger than a shard's room is placed like others; an empty table gives no rows; columns of ``docs`` named shard
or slot are replaced, others kept. Slots number a shard's rows from 0 without gaps. Everything derives from hashes, so
reruns agree.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evalbench.llm import _text as T
from evalbench.llm._spark import stash, table

SHARDS = 40
VNODES = 128
CELL_BITS = 12
ROW_BYTES = 16  # what a row counts besides its text


def ring(shards: int, vnodes: int = VNODES, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Places in order, and the shard at each. A shard's places do not depend on how many shards there are."""
    number = (np.arange(shards, dtype=np.uint64)[:, None] << np.uint64(32)) + np.arange(vnodes, dtype=np.uint64)
    place = T.signed(T.mix(number.ravel() * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)))
    order = np.argsort(place, kind="stable")
    return place[order], np.repeat(np.arange(shards), vnodes)[order]


def capacities(total: int, shards: int, slack: float = 0.0, even: bool = True) -> list[int]:
    """Room of each shard; ``even`` deals out the total exactly where there is no slack."""
    if even and not slack:
        return [total // shards + (s < total % shards) for s in range(shards)]
    return [-(-int(total * (1 + slack)) // shards) + 1] * shards


def stretches(loads: list[int], owners: list[int], room: list[int]) -> list[tuple[int, int, int]]:
    """(arc, load up to which, shard): who takes which part of each arc's load. ``owners`` has the shard at the end of each arc."""
    room, n = list(room), len(owners)
    taken: list[list[tuple[int, int]]] = []
    for load, shard in zip(loads, owners, strict=True):
        own = min(load, room[shard])
        room[shard] -= own
        taken.append([(own, shard)])
    onward = list(range(1, n + 1))  # a full place's next one; paths are shortened as they are walked

    def open_from(j: int) -> int:
        path = []
        while room[owners[j % n]] == 0:
            path.append(j % n)
            j = onward[j % n]
        for k in path:
            onward[k] = j
        return j % n

    for arc, load in enumerate(loads):
        upto = taken[arc][0][0]
        while upto < load:
            shard = owners[open_from(arc + 1)]
            more = min(load - upto, room[shard])
            room[shard] -= more
            upto += more
            taken[arc].append((upto, shard))
    return [(arc, upto, shard) for arc, parts in enumerate(taken) for upto, shard in parts]


def _arcs(rows: DataFrame, places: np.ndarray) -> DataFrame:
    """``rows`` with the ``arc`` of ``h``: the number of places below it, looked up by the leading bits."""
    shift = 64 - CELL_BITS
    cell = places >> np.int64(shift)
    numbers = range(-(1 << CELL_BITS - 1), 1 << CELL_BITS - 1)
    starts = np.searchsorted(cell, [*numbers, 1 << CELL_BITS - 1])
    cells = [(c, int(a), [int(x) for x in places[a:b]]) for c, a, b in zip(numbers, starts[:-1], starts[1:], strict=True)]
    known = rows.sparkSession.createDataFrame(cells, "cell int, below int, inside array<long>")
    looked = rows.withColumn("cell", F.shiftright("h", shift).cast("int")).join(F.broadcast(known), "cell")
    return looked.withColumn("arc", F.col("below") + F.expr("size(filter(inside, x -> x < h))")).drop("cell", "below", "inside")


def assign(rows: DataFrame, shards: int = SHARDS, law: str = "rows", slack: float = 0.0, vnodes: int = VNODES, seed: int = 1) -> DataFrame:
    """Of ``row`` (any struct), ``key`` (string), ``tie`` (long) and ``size`` (long): ``row, shard, slot``."""
    if law not in ("rows", "bytes"):
        raise ValueError(f"law {law!r}: rows or bytes")
    spark, (places, owners) = rows.sparkSession, ring(shards, vnodes, seed)
    hashed = rows.select("row", "size", "tie", F.xxhash64(F.lit(seed), F.coalesce("key", F.col("tie").cast("string"))).alias("h"))
    numbered = stash(_arcs(hashed, places), "ring-rows").withColumn("own", F.monotonically_increasing_id())
    ordered = numbered.repartitionByRange("h", "tie", "own").sortWithinPartitions("h", "tie", "own")
    ordered = stash(ordered.select("row", "size", "arc", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("at")), "ring-order")
    load = F.count(F.lit(1)) if law == "rows" else F.sum("size")
    runs = ordered.groupBy("arc", "part").agg(load.alias("load"), F.min("at").alias("first"))
    ahead = F.coalesce(F.sum("load").over(Window.partitionBy("arc").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = stash(runs.select("arc", "part", "load", "first", ahead.alias("ahead")), "ring-runs")
    # the last arc runs on to the first place
    loads = dict(runs.groupBy("arc").agg(F.sum("load")).collect())
    loads = [loads.get(arc, 0) for arc in range(len(places) + 1)]
    parts = stretches(loads, [*owners.tolist(), int(owners[0])], capacities(sum(loads), shards, slack, law == "rows"))
    known = spark.createDataFrame([(arc, upto, shard, i) for i, (arc, upto, shard) in enumerate(parts)], "arc int, upto long, shard int, stretch int")
    known = known.groupBy("arc").agg(F.array_sort(F.collect_list(F.struct("upto", "stretch", "shard"))).alias("parts"))
    if law == "rows":
        inside = F.col("at") - F.col("first")
    else:
        before = Window.partitionBy("part", "arc").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
        inside = F.coalesce(F.sum("size").over(before), F.lit(0))
    found = ordered.join(runs.drop("load"), ["arc", "part"]).withColumn("before", F.col("ahead") + inside).join(F.broadcast(known), "arc")
    placed = found.select("row", "part", "at", F.expr("filter(parts, p -> before < p.upto)[0]").alias("p")).select("row", "part", "at", "p.stretch", "p.shard")
    counts = placed.groupBy("stretch", "part", "shard").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("from"))
    base = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("stretch", "part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = stash(counts.select("stretch", "part", "from", base.alias("base")), "ring-slots")
    return placed.join(counts, ["stretch", "part"]).select("row", "shard", (F.col("base") + F.col("at") - F.col("from")).alias("slot"))


def text_size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES).cast("long")


def place(docs: DataFrame, shards: int = SHARDS, law: str = "rows", slack: float = 0.0, vnodes: int = VNODES, seed: int = 1) -> DataFrame:
    """``docs`` (doc_id, text and others) with ``shard`` and ``slot``."""
    own = [c for c in docs.columns if c.lower() not in ("shard", "slot")]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("row"), F.col("doc_id").cast("string").alias("key"), F.xxhash64("text").alias("tie"), text_size(F.col("text")).alias("size"))
    return assign(rows, shards, law, slack, vnodes, seed).select(*[F.col(f"row.`{c}`").alias(c) for c in own], "shard", "slot")


def write(placed: DataFrame, path: str) -> None:
    """A folder a shard, its rows in the order of their slots; a large shard is several files."""
    placed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), text_size(F.col("text")).alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"), F.xxhash64("text").alias("tie"))
    rows = docs.select(F.struct("doc_id", "size", "text_crc32").alias("row"), F.col("doc_id").cast("string").alias("key"), "tie", "size")
    out = assign(rows)
    return out.select("row.doc_id", "row.size", "row.text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
