"""Benchmark building: evidence and answer rules, duplicates, leakage components, splits, sampling."""

from __future__ import annotations

import functools
import math
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evalbench.functions import text as tx
from evalbench.operators import admission, order
from evalbench.sources.shared import spread


def evidence_rules(candidates: DataFrame, windows: DataFrame) -> DataFrame:
    """candidate_id and the first rule its evidence breaks: impossible page, impossible chunk, quote not found.

    ``candidates``: candidate_id, document_id, page, chunk_id, quote; ``windows``: document_id, page, chunk_id, content.
    """
    pages = windows.select("document_id", "page").distinct().withColumn("has_page", F.lit(True))
    chunks = windows.groupBy("document_id", "page", "chunk_id").agg(F.first("content").alias("content"))
    out = candidates.join(pages, ["document_id", "page"], "left").join(chunks, ["document_id", "page", "chunk_id"], "left")
    found = F.contains(tx.squash(F.col("content")), tx.squash(F.col("quote")))
    rule = F.when(F.col("has_page").isNull(), "impossible_page").when(F.col("content").isNull(), "impossible_chunk").when(~found, "evidence_not_found")
    return out.select("candidate_id", rule.alias("rule"))


#: One-letter words that negate and so count as content.
NEGATIONS = ("안", "못")


def content_tokens(text: Column) -> Column:
    """Words of two letters or more, and the negations."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"[0-9a-z가-힣]+"), 0), lambda t: (F.length(t) >= 2) | t.isin(*NEGATIONS))


def bigrams(tokens: Column) -> Column:
    """Distinct pairs of adjacent tokens."""
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(tokens) - 1, F.lit(1))), lambda i: F.concat_ws(" ", F.slice(tokens, i, 2)))
    return F.when(F.size(tokens) > 1, F.array_distinct(pairs)).otherwise(F.array().cast("array<string>"))


def answer_rules(rows: DataFrame) -> DataFrame:
    """``rows`` (question, answer, quote, kind) with the first broken rule: leaked, numbers that the quote lacks, unsupported."""
    leaked = F.contains(tx.squash(F.col("question")), tx.squash(F.col("answer"))) & (tx.squash(F.col("answer")) != "")
    numbers = F.size(F.array_except(tx.numbers(F.col("answer")), tx.numbers(F.col("quote")))) > 0
    inside = F.contains(tx.squash(F.col("quote")), tx.squash(F.col("answer")))
    rows = rows.withColumn("__a", content_tokens(F.col("answer"))).withColumn("__q", content_tokens(F.col("quote")))
    pairs = F.size(F.array_except(bigrams(F.col("__a")), bigrams(F.col("__q")))) == 0
    supported = F.when(F.col("kind").isin("fact", "numeric"), inside).otherwise(pairs)
    return rows.withColumn("rule", F.when(leaked, "answer_leaked_in_question").when(numbers, "numeric_mismatch").when(~supported, "answer_not_supported")).drop("__a", "__q")


def contaminated(questions: DataFrame, terms: list[str]) -> DataFrame:
    """Rows whose question or answer holds one of a bounded list of terms."""
    both = F.lower(F.concat_ws(" ", "question", "answer"))
    return questions.where(F.exists(F.array(*[F.lit(t.lower()) for t in terms]), lambda t: F.contains(both, t)))


def exact_duplicates(questions: DataFrame) -> DataFrame:
    """Pairs (a, b) of equal fingerprints: each later item with the first one."""
    f = questions.select("item_id", tx.fingerprint(F.col("question")).alias("f"))
    first = f.groupBy("f").agg(F.min("item_id").alias("a"))
    return f.join(first, "f").where("item_id <> a").select("a", F.col("item_id").alias("b"))


#: Places of a piece that share a key; hashes of five letters that link near copies first; leaders of a component under a key.
PLACES, MARKS, LEADERS = 16, 8, 8


def duplicate_groups(questions: DataFrame, least: float, checkpoint, leaders: int = LEADERS) -> DataFrame:
    """item_id, group_id (its smallest item) and rejected (all but that one) of every item that is like another.

    Fingerprints are alike with a matching-blocks ratio of ``least`` or more, and a group is what such pairs connect.
    Equal fingerprints are one from the start. Texts of n >= m characters with ratio r leave at most u = (1 - r)(n + m)
    characters unmatched in both together. Each of these breaks at most one of u + 1 pieces of the longer text, so
    one piece at least is in the other text, at a place before by what the longer lost or after by what it gained: pairs
    meet under such a piece and a range of places. Where they meet, bits of their letters and pairs of letters bound the
    ratio from above (see ``text.letter_bits``). Only what passes is a row; of these the edit distance, which is at most u,
    leaves those whose matching blocks are counted.

    Near copies are linked before that, each with the first text of its least hashes of five letters, so that under
    a piece ``leaders`` of each component meet those of other components, and then all that is left does. Pairs whose later
    text is long, as SequenceMatcher has it, meet by ``long_links`` instead. No pair of two groups is left out, of long ones
    but for the chance given there. No join is a broadcast, so the driver holds no rows.
    """
    if least <= 0.5:
        raise ValueError("least has to be above 0.5")
    f = questions.select("item_id", tx.fingerprint(F.col("question")).alias("f"))
    one = f.where("f is not null").groupBy("f").agg(F.min("item_id").alias("item_id")).withColumn("n", F.length("f"))
    bits, over = [f"s{i}" for i in range(2 * tx.BIT_WORDS)], ["over0", "over1"]
    short = math.floor((tx.INDEXED - 1) * (2 - least) / least + 1e-6)  # the longest text before one that is not long
    one = one.withColumn("s", tx.letter_bits(F.when(F.col("n") <= short, F.col("f")).otherwise("")))
    one = checkpoint(one.select("item_id", "f", "n", *[F.get("s", F.lit(i)).alias(c) for i, c in enumerate([*bits, *over])]))
    texts, some = one.select("item_id", "f"), one.where((F.col("n") > 0) & (F.col("n") <= short))
    own = ["n", *bits, *over]

    def side(name: str) -> list[Column]:
        return [F.col("item_id").alias(name), *[F.col(c).alias(f"{c}_{name}") for c in own]]

    total = F.col("n_x") + F.col("n_y")
    u, more_x = F.floor((1 - least) * total + 1e-6), F.col("n_x") - F.col("n_y")
    common = []  # letters, and pairs of adjacent ones
    for j, c in enumerate(over):
        words = [F.bit_count(F.col(f"{w}_x").bitwiseAND(F.col(f"{w}_y"))) for w in bits[j * tx.BIT_WORDS : (j + 1) * tx.BIT_WORDS]]
        common.append(functools.reduce(operator.add, words, F.least(f"{c}_x", f"{c}_y")))
    # matched letters are in at most u + 1 blocks
    near = (F.abs(more_x) <= u) & (2 * common[0] >= (least - 1e-9) * total) & (2 * common[1] >= total - 2 - 3 * u)

    def verified(pairs: DataFrame) -> DataFrame:
        # the earlier text comes first, as the ratio is not symmetric
        both = pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        both = both.join(texts.select(F.col("item_id").alias("a"), F.col("f").alias("fa")).hint("merge"), "a").join(texts.select(F.col("item_id").alias("b"), F.col("f").alias("fb")).hint("merge"), "b")
        changed = F.call_function("levenshtein", "fa", "fb", F.floor((1 - least) * (F.length("fa") + F.length("fb")) + 1e-6).cast("int"))
        both = checkpoint(both.where(F.when(F.length("fb") >= tx.INDEXED, True).otherwise(changed >= 0)))
        return checkpoint(spread(both).withColumn("ratio", tx.ratio_of_at_least(least)("fa", "fb")).where("ratio is not null").select("a", "b"))

    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.col("n") - 4, F.lit(1))), lambda i: F.substring("f", i, 5))
    marks = F.array(*[F.array_min(F.transform("grams", lambda g, k=k: F.xxhash64(F.lit(k), g))) for k in range(MARKS)])
    marked = some.withColumn("grams", grams).select(*side("y"), F.explode(marks).alias("mark"))
    first = marked.groupBy("mark").agg(F.min(F.struct("y", *[f"{c}_y" for c in own])).alias("h"), F.count(F.lit(1)).alias("c")).where("c > 1")
    first = first.select("mark", F.col("h.y").alias("x"), *[F.col(f"h.{c}_y").alias(f"{c}_x") for c in own])
    found = verified(marked.join(first.hint("merge"), "mark").where((F.col("x") != F.col("y")) & near))
    found = found.unionByName(long_links(one.select("item_id", "f", "n"), least, checkpoint))

    n, longest = F.col("n"), F.floor(F.col("n") * ((2 - least) / least) + 1e-6).cast("int")
    pieces = lambda n: F.floor(2 * (1 - least) * n + 1e-6).cast("int") + 1
    width = lambda n: F.floor(n / pieces(n)).cast("int")
    key = lambda g, block: F.xxhash64(g, block)
    block = lambda place: F.floor(place / PLACES).cast("int")
    gained = F.floor((1 - least) * n + 1e-6).cast("int")
    cut = F.transform(F.sequence(F.lit(0), pieces(n) - 1), lambda i: F.struct(F.substring("f", i * width(n) + 1, width(n)).alias("g"), (i * width(n)).alias("at")))
    # the widths of all texts that may be the longer of a pair
    widths = F.array_distinct(F.transform(F.sequence(n, F.greatest(n, longest)), width))
    rest, labels = None, None
    for most in (leaders, None):
        labels = None if found.isEmpty() else min_label_components(found, checkpoint)
        named = some.withColumn("component", F.col("item_id"))
        if labels is not None:
            named = checkpoint(some.join(labels.withColumnRenamed("id", "item_id").hint("merge"), "item_id", "left").withColumn("component", F.coalesce("component", "item_id")))
        if rest is None:
            left = named.select(*side("x"), F.col("component").alias("cx"), pieces(n).alias("off"), gained.alias("gained"), F.explode(cut).alias("e"))
            blocks = F.explode(F.sequence(block(F.greatest(F.col("e.at") - F.col("off") + 1, F.lit(0))), block(F.col("e.at") + F.col("gained")))).alias("block")
            left = left.select("*", blocks).withColumn("key", key(F.col("e.g"), F.col("block"))).withColumn("at", F.col("e.at")).drop("e", "off", "gained", "block")
            turn = F.row_number().over(Window.partitionBy("key", "cx").orderBy("x", "at"))
            left = checkpoint(left.withColumn("turn", turn))
            lead, rest = left.where(F.col("turn") <= most).drop("turn"), left.where(F.col("turn") > most).drop("turn")
        else:
            lead = rest.drop("cx").join(named.select(F.col("item_id").alias("x"), F.col("component").alias("cx")).hint("merge"), "x")
        place = F.posexplode(F.transform(F.sequence(F.lit(1), n - F.col("w") + 1), lambda i: F.substring("f", i, F.col("w")))).alias("place", "g")
        right = named.withColumn("w", F.explode(widths)).where("w <= n").select(*side("y"), F.col("component").alias("cy"), place)
        right = right.withColumn("key", key(F.col("g"), block(F.col("place")))).drop("g")
        held = lead.groupBy("key").agg(F.min("cx").alias("lo"), F.max("cx").alias("hi"))
        right = right.join(held.hint("merge"), "key").where("cy <> lo or cy <> hi").drop("lo", "hi")
        moved = F.col("place") - F.col("at")
        fits = ((more_x > 0) | ((more_x == 0) & (F.col("x") < F.col("y")))) & (F.col("cx") != F.col("cy")) & (2 * moved <= u - more_x) & (-2 * moved <= u + more_x)
        more = verified(right.join(lead.hint("merge"), "key").where(fits & near).select("x", "y"))
        if not more.isEmpty():
            found = found.unionByName(more)
        if most is None or rest.isEmpty():
            break
    if not found.isEmpty():
        labels = min_label_components(found, checkpoint)
    first = f.join(one.select("f", F.col("item_id").alias("first")).hint("merge"), "f").select("item_id", "first")
    if labels is not None:
        first = first.join(labels.select(F.col("id").alias("first"), "component").hint("merge"), "first", "left").select("item_id", F.coalesce("component", "first").alias("first"))
    many = first.groupBy("first").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("first")
    return first.join(many.hint("merge"), "first").select("item_id", F.col("first").alias("group_id"), (F.col("item_id") != F.col("first")).alias("rejected"))


def long_links(texts: DataFrame, least: float, checkpoint) -> DataFrame:
    """Links (a, b) of ``texts`` (item_id, f, n) whose later one is long, enough of them to connect what is alike.

    Texts that are alike share a part of their bags of pieces that has a bound, with pieces as long as the later text allows
    (see ``text.piece_size``). So they agree in a number of the hashes of these bags, but for a chance of ``text.MISSED`` a
    pair. Near copies are linked first, each with the first text of some hashes; then all texts of different components meet.
    """
    none = texts.select(F.col("item_id").alias("a"), F.col("item_id").alias("b")).where("false")
    texts = texts.where(F.col("n") >= math.floor(tx.INDEXED * least / (2 - least) - 1e-6))
    texts = checkpoint(spread(texts).withColumn("s", tx.piece_size(least)("f")).select("item_id", "f", "n", "s.size", "s.agree"))
    sizes = sorted(r["size"] for r in texts.where("size is not null").select("size").distinct().collect())  # as many as there are piece sizes
    if not sizes:
        return none
    hashed = lambda size: F.transform(tx.bag_hashes(size)("f"), lambda h, j: F.struct(F.xxhash64(F.lit(size), j, h).alias("key"), j.alias("j")))
    rows = checkpoint(spread(texts).select("item_id", "n", "size", "agree", *[hashed(size).alias(f"h{size}") for size in sizes]))
    every = F.explode(F.concat(*[f"h{size}" for size in sizes])).alias("h")
    own = F.explode(F.coalesce(*[F.when(F.col("size") == size, F.col(f"h{size}")) for size in sizes])).alias("h")
    early = rows.select(F.col("item_id").alias("x"), F.col("n").alias("nx"), every).select("x", "nx", "h.key", "h.j")
    late = rows.where("size is not null").select(F.col("item_id").alias("y"), F.col("n").alias("ny"), "agree", own).select("y", "ny", "agree", "h.key", "h.j")
    fits = (F.col("x") < F.col("y")) & (F.abs(F.col("nx") - F.col("ny")) <= F.floor((1 - least) * (F.col("nx") + F.col("ny")) + 1e-6))

    def verified(pairs: DataFrame) -> DataFrame:
        # by the later text, which is prepared once for all earlier ones; pairs and their texts are not written
        both = pairs.join(texts.select(F.col("item_id").alias("x"), F.col("f").alias("fx")).hint("merge"), "x").join(texts.select(F.col("item_id").alias("y"), F.col("f").alias("fy")).hint("merge"), "y")
        return checkpoint(both.withColumn("ratio", tx.ratio_of_at_least(least)("fx", "fy")).where("ratio is not null").select(F.col("x").alias("a"), F.col("y").alias("b")))

    first = early.where(F.col("j") < MARKS).groupBy("key").agg(F.min(F.struct("x", "nx")).alias("e")).select("key", "e.x", "e.nx")
    found = verified(late.where(F.col("j") < MARKS).join(first.hint("merge"), "key").where(fits).select("x", "y").distinct())
    early, late = early.drop("j"), late.drop("j")
    if not found.isEmpty():
        labels = checkpoint(min_label_components(found, checkpoint))
        early = early.join(labels.select(F.col("id").alias("x"), F.col("component").alias("cx")).hint("merge"), "x", "left")
        late = late.join(labels.select(F.col("id").alias("y"), F.col("component").alias("cy")).hint("merge"), "y", "left")
        fits = fits & (F.coalesce("cx", "x") != F.coalesce("cy", "y"))
    met = late.join(early.hint("merge"), "key").where(fits).groupBy("x", "y").agg(F.count(F.lit(1)).alias("c"), F.first("agree").alias("agree"))
    return found.unionByName(verified(checkpoint(met.where("c >= agree").select("x", "y"))))


def min_label_components(links: DataFrame, checkpoint) -> DataFrame:
    """id, component of links (a, b): labels spread to neighbours and jump to their label's label until none changes.

    ``checkpoint`` writes and rereads a DataFrame, so lineage stays short.
    """
    both = links.select(F.col("a").alias("x"), F.col("b").alias("y")).unionByName(links.select(F.col("b").alias("x"), F.col("a").alias("y"))).where("x <> y").distinct()
    both = checkpoint(both)
    labels = checkpoint(both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("l")).select(F.col("x").alias("id"), "l"))
    while True:
        near = both.join(labels.withColumnRenamed("id", "y").hint("merge"), "y").groupBy("x").agg(F.min("l").alias("m")).select(F.col("x").alias("id"), "m")
        jump = labels.select(F.col("id").alias("l"), F.col("l").alias("ll"))
        new = labels.join(near.hint("merge"), "id").join(jump.hint("merge"), "l").select("id", F.least("l", "m", "ll").alias("n"), F.col("l").alias("old"))
        new = checkpoint(new)
        labels = new.select("id", F.col("n").alias("l"))
        if not new.where("n <> old").limit(1).count():
            return labels.withColumnRenamed("l", "component")


def shared_token_links(items: DataFrame) -> DataFrame:
    """Links from each item to the smallest item that shares a token with it: a star a token, not its pairs."""
    first = items.groupBy("token").agg(F.min("item_id").alias("a"))
    return items.join(first, "token").where("a <> item_id").select("a", F.col("item_id").alias("b")).distinct()


def split_runs(sizes: list[tuple[int, int]], splits: list[str], seed: int) -> list[tuple[int, int, list[str]]]:
    """(size, first place, splits in turn) for components of ``sizes`` (size, how many), largest first, each to the split that has least.

    Splits that are within a component's size of the least one take turns; how often they do so before the next
    split is reached is a division. Ties between splits go by a hash of the seed, the split and the size.
    """
    import hashlib

    level, out = dict.fromkeys(splits, 0), []
    for size, n in sorted(sizes, reverse=True):
        place = 0
        while place < n:
            order = sorted(splits, key=lambda s: (level[s], hashlib.md5(f"{seed}:{s}:{size}".encode()).hexdigest()))
            turn = [s for s in order if level[s] < level[order[0]] + size]
            rest = min((level[s] for s in order if s not in turn), default=None)
            rounds = n if rest is None else (rest - 1 - max(level[s] for s in turn)) // size + 1
            took = min(n - place, rounds * len(turn))
            out.append((size, place, turn))
            for i, s in enumerate(turn):
                level[s] += size * (took // len(turn) + (i < took % len(turn)))
            place += took
    return out


def allocate_splits(components: DataFrame, splits: list[str], seed: int) -> DataFrame:
    """``components`` (item_id, component) with ``split``: largest component first to the split that has least so far.

    The driver sees how many components there are of each size, which are few different ones, and gives back runs of
    places among those of a size (see ``split_runs``); components of a size stand in the order of a hash.
    """
    sized = components.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    placed = order.placed(sized, ["n"], [F.md5(F.concat_ws(":", F.lit(seed), "component")), F.col("component")])
    sizes = [tuple(r) for r in placed.groupBy("n").agg(F.count(F.lit(1))).collect()]  # a row a size
    runs = components.sparkSession.createDataFrame(split_runs(sizes, splits, seed), "n long, first long, turn array<string>")
    runs = runs.groupBy("n").agg(F.sort_array(F.collect_list(F.struct("first", "turn"))).alias("runs"))  # at most a run a split
    found = placed.join(runs, "n").withColumn("run", F.element_at(F.filter("runs", lambda r: r["first"] <= F.col("place")), -1))
    split = F.element_at(F.col("run.turn"), ((F.col("place") - F.col("run.first")) % F.size("run.turn") + 1).cast("int"))
    return components.join(found.select("component", split.alias("split")), "component")


def stratified(items: DataFrame, strata: list[str], n: int, key: Column) -> DataFrame:
    """Round robin over the strata in the order of a hash key: first of each, then second of each, ... until ``n``."""
    r = items.withColumn("__k", key).withColumn("round", F.row_number().over(Window.partitionBy(*strata).orderBy("__k")))
    return r.where(F.col("round") <= n).orderBy("round", *strata).limit(n).drop("__k")


def admit(rows: DataFrame, quota: str = "kind", quotas: dict[str, int] | None = None) -> DataFrame:
    """First rows of each kind in input order up to its quota."""
    most = F.lit(0)
    for name, size in (quotas or {}).items():
        most = F.when(F.col(quota) == name, size).otherwise(most)
    return order.placed(rows, [quota], [F.col("ord")], "__p").withColumn("accepted", F.col("__p") < most).drop("__p")


def admit_with_caps(rows: DataFrame, quotas: dict[str, int], per_document: int, block: int = admission.BLOCK) -> DataFrame:
    """The same where each document may also give at most ``per_document``; a row that its document's cap rejects uses no quota.

    See ``admission``: the driver holds a block of rows and what was accepted, at most the quotas' sum.
    """
    keyed = rows.withColumn("places", F.array(F.struct(F.col("document_id").cast("string").alias("document_id"), F.lit(0).alias("page"))))
    filled = admission.admission(keyed.select("ord", "kind", "places"), quotas, per_document, None, block)
    return admission.rejected(keyed, filled, quotas, rows.sparkSession).withColumn("accepted", F.col("rule").isNull()).drop("rule", "places")


def one_substitution(original: Column, changed: Column) -> Column:
    """struct(place, old, new) if two texts differ in one token only; else null."""
    a, b = F.split(original, r"\s+"), F.split(changed, r"\s+")
    differ = F.filter(F.transform(F.arrays_zip(a.alias("a"), b.alias("b")), lambda z, i: F.struct(i.alias("place"), z["a"].alias("old"), z["b"].alias("new"))), lambda z: ~z["old"].eqNullSafe(z["new"]))
    return F.when((F.size(a) == F.size(b)) & (F.size(differ) == 1), differ[0])


def first_seen(rows: DataFrame, key: str, order: str) -> DataFrame:
    """First row of each key and whether its rows disagree."""
    w = Window.partitionBy(key)
    body = F.struct(*[c for c in rows.columns if c not in (key, order)])
    return rows.withColumn("__r", F.row_number().over(w.orderBy(order))).withColumn("conflict", F.min(F.to_json(body)).over(w) != F.max(F.to_json(body)).over(w)).where("__r = 1").drop("__r")


def quota_deficits(accepted: DataFrame, quotas: DataFrame) -> DataFrame:
    """kind, deficit where positive."""
    have = accepted.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    return quotas.join(have, "kind", "left").select("kind", (F.col("target") - F.coalesce("n", F.lit(0))).alias("deficit")).where("deficit > 0")


def completion_level(n: Column, target: int, floor: int, emergency: int) -> Column:
    return F.when(n >= target, "TARGET").when(n >= floor, "NORMAL_FLOOR").when(n >= emergency, "EMERGENCY").otherwise("INSUFFICIENT")


def plan_jobs(windows: DataFrame, quotas: dict[str, int], per_document: int, per_page: int) -> DataFrame:
    """Jobs (ordinal, kind, window_id): kinds in turn take the next window, documents in turn, within both caps.

    Raises if the windows do not reach. Sequential, so on the driver, but over those windows only that it may come to:
    of the first documents, one a job, the first windows of each page and of these the first ones, up to the caps.
    """
    jobs_wanted = sum(quotas.values())
    rows = windows.select("window_id", "document_id", "page").where(F.lit(jobs_wanted > 0))
    place = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy("page", "window_id"))
    rows = rows.join(windows.select("document_id").distinct().orderBy("document_id").limit(jobs_wanted), "document_id", "left_semi")
    rows = rows.withColumn("__p", place("document_id", "page")).where(F.col("__p") <= per_page)
    rows = rows.withColumn("__p", place("document_id")).where(F.col("__p") <= per_document).drop("__p")
    rows = rows.orderBy("document_id", "page", "window_id").collect()  # at most jobs times the cap
    queues: dict[str, list] = {}
    for r in rows:
        queues.setdefault(r.document_id, []).append(r)
    used_document: dict[str, int] = {}
    used_page: dict[tuple, int] = {}
    turn, jobs = sorted(queues), []
    at = 0
    for kind in [k for k, n in sorted(quotas.items()) for _ in range(n)]:
        for _ in range(len(turn)):
            document = turn[at % len(turn)]
            at += 1
            if used_document.get(document, 0) >= per_document:
                continue
            free = next((r for r in queues[document] if used_page.get((document, r.page), 0) < per_page), None)
            if free is not None:
                queues[document].remove(free)
                used_document[document] = used_document.get(document, 0) + 1
                used_page[document, free.page] = used_page.get((document, free.page), 0) + 1
                jobs.append((len(jobs), kind, free.window_id))
                break
        else:
            raise ValueError(f"no window is left for {kind}")
    return windows.sparkSession.createDataFrame(jobs, "ordinal int, kind string, window_id string")


def plan_replacements(accepted: DataFrame, windows: DataFrame, quotas: dict[str, int], per_document: int, per_page: int) -> DataFrame:
    """Jobs for what is missing only, from windows that are not used yet."""
    have = {r["kind"]: r["n"] for r in accepted.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()}
    missing = {k: n - have.get(k, 0) for k, n in quotas.items() if n > have.get(k, 0)}
    return plan_jobs(windows.join(accepted.select("window_id"), "window_id", "left_anti"), missing, per_document, per_page)
