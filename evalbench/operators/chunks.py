"""Parsed elements to blocks, blocks to chunks.

Relations: elements (document_id, page, idx, category, content), blocks (document_id, ord, page, kind, content,
section array), tokens of blocks. Order is always a column, never the order of rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evalbench.functions import text as tx
from evalbench.operators import order
from evalbench.sources.shared import rewritten

#: Element categories and their kinds.
KINDS = {
    "heading1": "heading", "heading2": "heading", "heading3": "heading", "heading": "heading", "paragraph": "text", "list": "list", "list_item": "list", "table": "table",
    "figure": "figure", "chart": "figure", "equation": "equation", "caption": "caption", "header": "header", "footer": "footer",
}


def block_kind(category: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair]), category), F.lit("other"))


def content_of(markdown: Column, text: Column, html: Column) -> Column:
    """First of the given forms that is there and not empty."""
    return F.coalesce(F.nullif(markdown, F.lit("")), F.nullif(text, F.lit("")), F.nullif(html, F.lit("")), F.lit(""))


def repeated_furniture(blocks: DataFrame, least_pages: int = 3) -> DataFrame:
    """document_id, kind, content of headers and footers on ``least_pages`` pages or more, once a page."""
    g = blocks.where(F.col("kind").isin("header", "footer")).groupBy("document_id", "kind", "content").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("page").alias("pages"))
    return g.where((F.col("pages") >= least_pages) & (F.col("n") == F.col("pages"))).select("document_id", "kind", "content")


def flag_boilerplate(blocks: DataFrame) -> DataFrame:
    return blocks.join(repeated_furniture(blocks).withColumn("is_boilerplate", F.lit(True)), ["document_id", "kind", "content"], "left").withColumn("is_boilerplate", F.coalesce("is_boilerplate", F.lit(False)))


def keep_content(blocks: DataFrame) -> DataFrame:
    return blocks.where(~F.col("is_boilerplate") & (F.col("content") != ""))


def complete_pages(elements: DataFrame, pages: DataFrame) -> DataFrame:
    """Elements by page in order; a page without any has one ``empty_page``. ``pages``: document_id, page_count."""
    every = pages.select("document_id", F.explode(F.sequence(F.lit(1), "page_count")).alias("page"))
    return every.join(elements, ["document_id", "page"], "left").withColumn("category", F.coalesce("category", F.lit("empty_page"))).withColumn("content", F.coalesce("content", F.lit("")))


def page_mapping(elements: DataFrame, pages: DataFrame) -> DataFrame:
    """Number and indexes of the elements of every page."""
    every = pages.select("document_id", F.explode(F.sequence(F.lit(1), "page_count")).alias("page"))
    g = elements.groupBy("document_id", "page").agg(F.count(F.lit(1)).alias("element_count"), F.sort_array(F.collect_list("idx")).alias("element_indexes"))
    return every.join(g, ["document_id", "page"], "left").select("document_id", "page", F.coalesce("element_count", F.lit(0)).alias("element_count"), F.coalesce("element_indexes", F.array().cast("array<long>")).alias("element_indexes"))


LEVELS = 6  # of headings


def section_paths(blocks: DataFrame) -> DataFrame:
    """Running stack of headings: a heading of level n cuts the stack to n - 1 entries and is put on top.

    Its place in the stack is n, or one more than the place of the heading before if that is less: so for the i-th heading
    the least of n_j + (i - j) over those up to it, and i. An entry stays until a heading comes to its place or a lower
    one. So the path is, place by place, the last heading there if none came to a lower place since: all running
    aggregates over the document's blocks, without lists that grow.
    """
    by = Window.partitionBy("document_id").orderBy("ord")
    head = F.col("kind") == "heading"
    rows = blocks.withColumn("__i", F.sum(head.cast("long")).over(by))
    ahead = F.min(F.when(head, tx.heading_level(F.col("content")) - F.col("__i"))).over(by)
    rows = rows.withColumn("__depth", F.when(head, F.least(F.lit(LEVELS), F.col("__i"), F.col("__i") + ahead)))
    title = F.trim(F.regexp_replace("content", "^#+", ""))
    last = [F.max(F.when(F.col("__depth") == k, F.struct("ord", title.alias("title")))).over(by).alias(f"__h{k}") for k in range(1, LEVELS + 1)]
    rows = rows.select("*", *last)
    entries, lower = [], None
    for k in range(1, LEVELS + 1):
        own = F.col(f"__h{k}")
        there = own.isNotNull() if lower is None else own.isNotNull() & F.coalesce(own["ord"] > lower, F.lit(True))
        entries.append(F.when(there, own["title"]))
        lower = own["ord"] if lower is None else F.greatest(lower, own["ord"])
    return rows.withColumn("section", F.array_compact(F.array(*entries))).select(*blocks.columns, "section")


def section_runs(blocks: DataFrame) -> DataFrame:
    """Consecutive blocks of one section share ``run``."""
    w = Window.partitionBy("document_id").orderBy("ord")
    change = F.coalesce((~F.col("section").eqNullSafe(F.lag("section").over(w))).cast("int"), F.lit(1))
    return blocks.withColumn("__c", change).withColumn("run", F.sum("__c").over(w)).drop("__c")


def token_offsets(blocks: DataFrame, by: list[str], tokens: Column) -> DataFrame:
    """``n_tokens`` of each block and ``base``, the tokens before it."""
    w = Window.partitionBy(*by).orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    return blocks.withColumn("n_tokens", F.size(tokens)).withColumn("base", F.coalesce(F.sum("n_tokens").over(w), F.lit(0)))


def spans(n: Column, size: int, overlap: int) -> Column:
    """Array of (ordinal, token_start, token_end) of the windows over ``n`` tokens: they overlap, and the last one ends the text."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be smaller than size")
    step = size - overlap
    count = F.greatest(F.lit(1), F.ceil((n - F.lit(overlap)) / F.lit(step)).cast("int"))
    return F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.struct(i.alias("ordinal"), (i * step).alias("token_start"), F.least(i * step + size, n).alias("token_end")))


def windows(texts: DataFrame, size: int, overlap: int, tokens: Column | None = None, key: str = "document_id") -> DataFrame:
    """key, ordinal, token_start, token_end (exclusive), token_count of the windows of each text that has tokens."""
    n = texts.select(key, F.size(tokens if tokens is not None else tx.tokens(F.col("content"))).alias("n")).where("n > 0")
    w = n.select(key, F.explode(spans(F.col("n"), size, overlap)).alias("w")).select(key, "w.*")
    return w.withColumn("token_count", F.col("token_end") - F.col("token_start"))


def fixed_chunks(texts: DataFrame, size: int, overlap: int, snapshot: str, strategy: str) -> DataFrame:
    """Windows with their text (tokens joined by blanks) and a content-based id. One pass: the windows are cut beside the tokens."""
    t = texts.select("document_id", tx.tokens(F.col("content")).alias("t")).where(F.size("t") > 0)
    cut = F.transform(spans(F.size("t"), size, overlap), lambda w: F.struct(w["ordinal"].alias("ordinal"), w["token_start"].alias("token_start"), w["token_end"].alias("token_end"), (w["token_end"] - w["token_start"]).alias("token_count"), F.array_join(F.slice("t", w["token_start"] + 1, w["token_end"] - w["token_start"]), " ").alias("content")))
    out = t.select("document_id", F.explode(cut).alias("w")).select("document_id", "w.*")
    name = F.concat_ws("|", "document_id", F.col("token_start").cast("string"), F.col("token_end").cast("string"), "content")
    return out.withColumn("chunk_id", F.concat_ws(":", F.lit(snapshot), F.lit(strategy), F.substring(F.sha2(name, 256), 1, 24)))


def snapshot_chunks(texts: DataFrame, sections: DataFrame, strategies: list[tuple[str, int, int]]) -> DataFrame:
    """snapshot_id, chunk_id, document_id, ordinal, token_count and content of every mode and strategy's chunks, in one pass over ``texts`` and one over ``sections``.

    Both hold parse_mode, document_id and content, a section also its ``run`` within the document.
    """
    out = None
    for kind, rows in (("fixed", texts.withColumn("run", F.lit(0).cast("long"))), ("heading", sections)):
        own = [(k, size, overlap) for k, size, overlap in strategies if k == kind]
        if not own:
            continue
        t = rows.select("parse_mode", "document_id", "run", tx.tokens(F.col("content")).alias("t")).where(F.size("t") > 0)
        cut = lambda w: F.struct(w["ordinal"].alias("ordinal"), w["token_start"].alias("token_start"), (w["token_end"] - w["token_start"]).alias("token_count"), F.array_join(F.slice("t", w["token_start"] + 1, w["token_end"] - w["token_start"]), " ").alias("content"))
        parts = F.array(*[F.struct(F.lit(f"{k}-{size}-{overlap}").alias("strategy"), F.transform(spans(F.size("t"), size, overlap), cut).alias("w")) for k, size, overlap in own])
        made = t.select("parse_mode", "document_id", "run", F.explode(parts).alias("s")).select("parse_mode", "document_id", "run", "s.strategy", F.explode("s.w").alias("w")).select("parse_mode", "document_id", "run", "strategy", "w.*")
        out = made if out is None else out.unionByName(made)
    snapshot, document = F.concat_ws(":", "parse_mode", "strategy"), F.col("document_id").cast("string")
    name = F.concat_ws("|", document, F.col("run").cast("string"), F.col("token_start").cast("string"), F.col("token_count").cast("string"), "content")
    return out.select(snapshot.alias("snapshot_id"), F.concat_ws(":", snapshot, F.substring(F.sha2(name, 256), 1, 24)).alias("chunk_id"), document.alias("document_id"), "ordinal", F.col("token_count").cast("int").alias("token_count"), "content", "parse_mode", "strategy")


def in_modes(chunks: DataFrame, modes: list[str]) -> DataFrame:
    """``chunks`` of ``snapshot_chunks`` once for each of ``modes``, for modes whose texts are the same; copies stand side by side."""
    each = chunks.withColumn("parse_mode", F.explode(F.array(*[F.lit(m) for m in modes])))
    snapshot = F.concat_ws(":", "parse_mode", "strategy")
    return each.withColumns({"snapshot_id": snapshot, "chunk_id": F.concat_ws(":", snapshot, F.substring_index("chunk_id", ":", -1))})


def snapshot_counts(texts: DataFrame, sections: DataFrame, strategies: list[tuple[str, int, int]]) -> DataFrame:
    """parse_mode, strategy, chunks, documents, least, most and mean tokens for each mode and strategy, in one pass over the texts.

    ``texts`` (parse_mode, document_id, n) and ``sections`` (the same, a row a section) hold numbers of tokens;
    a strategy is its kind (fixed or heading), size and overlap.
    """
    out = None
    for kind in ("fixed", "heading"):
        own = [F.struct(F.lit(f"{k}-{size}-{overlap}").alias("strategy"), spans(F.col("n"), size, overlap).alias("w")) for k, size, overlap in strategies if k == kind]
        if own:
            rows = (texts if kind == "fixed" else sections).where("n > 0").select("parse_mode", "document_id", F.explode(F.array(*own)).alias("s"))
            rows = rows.select("parse_mode", "document_id", "s.strategy", F.explode("s.w").alias("w")).withColumn("tokens", F.col("w.token_end") - F.col("w.token_start"))
            out = rows if out is None else out.unionByName(rows)
    return out.groupBy("parse_mode", "strategy").agg(F.count(F.lit(1)).alias("chunks"), F.count_distinct("document_id").alias("documents"), F.min("tokens").alias("least"), F.max("tokens").alias("most"), F.avg("tokens").alias("mean"))


BIN_TOKENS = 1024


def overlapping_blocks(windows: DataFrame, offsets: DataFrame, width: int = BIN_TOKENS) -> DataFrame:
    """Windows and the blocks (with base and n_tokens) that they touch: equal document, overlapping spans.

    Both are dealt to bins of ``width`` tokens of their document, and a pair counts in the bin where the later of the two
    begins. So a long document is as many groups as bins, each with the windows and blocks of its tokens.
    """
    cells = lambda first, last: F.explode(F.sequence(F.floor(first / width), F.greatest(F.floor(first / width), F.floor((last - 1) / width)))).alias("__bin")
    b = offsets.select("document_id", "ord", "page", "base", (F.col("base") + F.col("n_tokens")).alias("stop"))
    b = b.select("*", cells(F.col("base"), F.col("stop")))
    w = windows.select("*", cells(F.col("token_start"), F.col("token_end")))
    met = w.join(b, ["document_id", "__bin"]).where("stop > token_start and base < token_end")
    return met.where(F.floor(F.greatest("token_start", "base") / width) == F.col("__bin")).drop("__bin")


def contiguity_violations(windows: DataFrame) -> DataFrame:
    """Gaps in ordinals or tokens between a document's windows."""
    w = Window.partitionBy("document_id").orderBy("ordinal")
    out = windows.withColumn("before_end", F.lag("token_end").over(w)).withColumn("before", F.lag("ordinal").over(w))
    bad = (F.col("ordinal") != F.coalesce(F.col("before") + 1, F.lit(0))) | (F.col("token_start") > F.coalesce("before_end", F.lit(0)))
    return out.where(bad).select("document_id", "ordinal")


def joined(rows: DataFrame, by: str, order: str, value: str, separator: str) -> DataFrame:
    """Texts of a group in order; the group is one document."""
    return rows.groupBy(by).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v")))), lambda x: x["v"]), separator).alias(value))


#: A group of more rows is packed by many tasks; each holds about so many rows.
PACK_ROWS = 8192
PACK_FAN = 256


def _stops(tokens: pd.Series, most_items: int, most_tokens: int) -> list[int]:
    """Where a batch that begins at each row ends."""
    sums = np.concatenate([[0], np.cumsum(tokens.to_numpy(np.int64))])
    at = np.arange(len(tokens))
    by_tokens = np.searchsorted(sums, sums[:-1] + most_tokens, side="right") - 1
    return np.maximum(at + 1, np.minimum(np.minimum(at + most_items, by_tokens), len(tokens))).tolist()


def pack_batches(items: DataFrame, most_items: int, most_tokens: int, part: int = PACK_ROWS, fan: int = PACK_FAN) -> DataFrame:
    """``grp, ord, batch``: greedy batches in order within ``grp``; a new one starts where either limit would be passed.

    A group of at most ``part`` rows is read in order by one task. A larger one is cut into parts. Where a part's first
    batch begins is among its first ``most_items`` rows, so for each of these the part tells, on its own, how many batches
    begin in it and where the next part's first one begins. ``fan`` such tables in a row are one table of the same
    kind, and so on up to one for the group; on the way back each part learns its true beginning and number of batches
    before it, and numbers its rows. A null number of tokens counts as 0, and an item beyond the limit is a batch.
    """
    if most_items < 1 or most_tokens < 1:
        raise ValueError("limits must be positive")
    part = max(part, most_items)
    items = items.select("grp", "ord", F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens"))
    large = rewritten(items.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > part).select(F.col("grp").alias("__of_grp")), "pack-large")
    if large.isEmpty():
        return _packed_alone(items, most_items, most_tokens)
    rest = items.join(large, order.same(["grp"], "__of_"), "left_anti")
    rows = order.placed(items.join(large, order.same(["grp"], "__of_"), "left_semi"), ["grp"], [F.col("ord")])
    return _packed_alone(rest, most_items, most_tokens).unionByName(_packed_in_parts(rows, most_items, most_tokens, part, fan))


def _packed_alone(items: DataFrame, most_items: int, most_tokens: int) -> DataFrame:
    def run(batches):
        group, batch, n, total = object(), 0, 0, 0
        for rows in batches:
            out = []
            for g, tokens in zip(rows.column(0).to_pylist(), rows.column(2).to_pylist(), strict=True):
                if g != group:
                    group, batch, n, total = g, 0, 0, 0
                if n and (n + 1 > most_items or total + tokens > most_tokens):
                    batch, n, total = batch + 1, 0, 0
                n, total = n + 1, total + tokens
                out.append(batch)
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(out, pa.int64())], ["grp", "ord", "batch"])

    rows = items.repartition("grp").sortWithinPartitions("grp", "ord")
    return rows.mapInArrow(run, f"grp {_kind(items, 'grp')}, ord {_kind(items, 'ord')}, batch long")


def _kind(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def _packed_in_parts(rows: DataFrame, most_items: int, most_tokens: int, part: int, fan: int) -> DataFrame:
    grp = f"grp {_kind(rows, 'grp')}"
    rows = rows.withColumn("node", F.floor(F.col("place") / part).cast("long"))
    # the first rows of a part also go to the part before it, whose last batch may end there
    both = (F.col("place") % part < most_items) & (F.col("node") > 0)
    seen = rows.withColumn("node", F.explode(F.when(both, F.array(F.col("node") - 1, "node")).otherwise(F.array("node"))))

    def table(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        stops = _stops(pdf.sort_values("place")["tokens"], most_items, most_tokens)
        own = min(part, len(stops))
        leave, count = [0] * own, [0] * own
        for i in range(own - 1, -1, -1):
            stop = stops[i]
            leave[i], count[i] = (stop - part, 1) if stop >= own else (leave[stop], count[stop] + 1)
        n = min(own, most_items)
        return pd.DataFrame({"grp": [key[0]] * n, "node": key[1], "entry": range(n), "leave": leave[:n], "n": count[:n]})

    def joined_tables(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        tables = _tables(pdf)
        out = []
        for entry in tables[min(tables)]:
            at, n = entry, 0
            for node in sorted(tables):
                at, more = tables[node].get(at, (at - part, 0))  # no batch begins in a part that is shorter
                n += more
            out.append((key[0], key[1], entry, at, n))
        return pd.DataFrame(out, columns=["grp", "node", "entry", "leave", "n"])

    def spread(key: tuple, parent: pd.DataFrame, pdf: pd.DataFrame) -> pd.DataFrame:
        at, before = int(parent["entry"].iloc[0]), int(parent["before"].iloc[0])
        tables, out = _tables(pdf), []
        for node in sorted(tables):
            out.append((key[0], node, at, before))
            at, more = tables[node].get(at, (at - part, 0))
            before += more
        return pd.DataFrame(out, columns=["grp", "node", "entry", "before"])

    def numbered(key: tuple, start: pd.DataFrame, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("place")
        at, batch = int(start["entry"].iloc[0]), int(start["before"].iloc[0])
        stops, out = _stops(pdf["tokens"], most_items, most_tokens), [batch - 1] * min(at, len(pdf))
        while at < len(stops):
            out += [batch] * (stops[at] - at)
            at, batch = stops[at], batch + 1
        return pd.DataFrame({"grp": pdf["grp"], "ord": pdf["ord"], "batch": out})

    kind = f"{grp}, node long, entry long, leave long, n long"
    levels = [rewritten(seen.groupBy("grp", "node").applyInPandas(table, kind), "pack-parts")]
    while (levels[-1].agg(F.max("node")).first()[0] or 0) > 0:
        up = levels[-1].groupBy("grp", F.floor(F.col("node") / fan).cast("long").alias("up"))
        levels.append(rewritten(up.applyInPandas(joined_tables, kind), "pack-tables"))
    starts = levels[-1].select("grp", "node").distinct().select("grp", "node", F.lit(0).cast("long").alias("entry"), F.lit(0).cast("long").alias("before"))
    for level in reversed(levels[:-1]):
        own = level.withColumn("up", F.floor(F.col("node") / fan).cast("long"))
        starts = rewritten(starts.groupBy("grp", "node").cogroup(own.groupBy("grp", "up")).applyInPandas(spread, f"{grp}, node long, entry long, before long"), "pack-starts")
    return starts.groupBy("grp", "node").cogroup(rows.groupBy("grp", "node")).applyInPandas(numbered, f"{grp}, ord {_kind(rows, 'ord')}, batch long")


def _tables(pdf: pd.DataFrame) -> dict[int, dict[int, tuple[int, int]]]:
    """node -> entry -> (where the next part is entered, batches that begin here)"""
    out: dict[int, dict[int, tuple[int, int]]] = {}
    for node, entry, leave, n in zip(pdf["node"], pdf["entry"], pdf["leave"], pdf["n"], strict=True):
        out.setdefault(int(node), {})[int(entry)] = (int(leave), int(n))
    return out
