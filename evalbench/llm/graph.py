"""Connected components of verified links, without collecting links or labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalbench.llm._spark import stash


def components(links: DataFrame) -> DataFrame:
    """``id, component`` (the smallest id reached) for every id in ``links`` (a long, b long).

    Alternates two steps until nothing changes. Large star: every vertex hooks its larger neighbours to the
    smallest of its neighbours and itself; small star: the same with its smaller neighbours. Each keeps the
    components, and both are joins and minima on vertex ids that Spark can split where an id is hot. A round
    is written to the shared folder, so lineage stays short.
    """
    edges = stash(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links")
    before = None
    while True:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = stash(both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "links-large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        hooked = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stash(hooked.where("u <> v").unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "links-small")
        # a star is a fixed point: the same edges, told by their number and two sums of hashes
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("v", "u"))).first()
        if now == before:
            break
        before = now
    roots = edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)
