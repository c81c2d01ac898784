"""Places by one sort, and batches of hot groups in parts, against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from evalbench.operators import chunks, order


def test_places(spark):
    r = random.Random(1)
    rows = [(r.choice([None, "a", "a", "a", "b"]), r.choice([None, *range(30)]), i) for i in range(600)]
    df = spark.createDataFrame(rows, "g string, v long, i long")
    got = order.placed(df, ["g"], [F.desc_nulls_last("v")]).collect()
    assert sorted((x.i, x.g, x.v) for x in got) == sorted((i, g, v) for g, v, i in rows)
    for g in (None, "a", "b"):
        own = sorted((x.place, x.v) for x in got if x.g == g)
        assert [p for p, _ in own] == list(range(len(own)))
        values = [-1 if v is None else v for _, v in own]
        assert values == sorted(values, reverse=True)
    everything = order.placed(df, [], [F.col("i")], "at").collect()
    assert [x.i for x in sorted(everything, key=lambda x: x["at"])] == list(range(600))
    assert order.placed(df.where("false"), ["g"], [F.col("v")]).count() == 0


def by_loop(rows, most_items, most_tokens):
    out = {}
    for g in {g for g, _, _ in rows}:
        batch, n, total = 0, 0, 0
        for _, o, t in sorted((x for x in rows if x[0] == g), key=lambda x: x[1]):
            t = t or 0
            if n and (n + 1 > most_items or total + t > most_tokens):
                batch, n, total = batch + 1, 0, 0
            n, total = n + 1, total + t
            out[g, o] = batch
    return out


@pytest.mark.parametrize("most_items,most_tokens,part,fan", [(7, 100, 16, 3), (20, 50, 20, 2), (3, 10**9, 4, 5), (50, 60, 8, 4)])
def test_hot_groups_are_packed_in_parts(spark, most_items, most_tokens, part, fan):
    r = random.Random(most_items)
    rows = [("hot", i * 3, r.choice([0, 1, 5, 20, 40, None, 500])) for i in range(900)] + [(None, i, r.randrange(30)) for i in range(130)]
    rows += [(f"g{i % 9}", i, r.randrange(60)) for i in range(60)] + [("edge", i, 1) for i in range(max(part, most_items) + 1)]
    df = spark.createDataFrame(rows, "grp string, ord long, tokens long")
    got = chunks.pack_batches(df, most_items, most_tokens, part, fan).collect()
    assert len(got) == len(rows) and {(x.grp, x.ord): x.batch for x in got} == by_loop(rows, most_items, most_tokens)


def test_packing_arguments(spark):
    with pytest.raises(ValueError):
        chunks.pack_batches(spark.createDataFrame([], "grp string, ord long, tokens long"), 0, 5)
