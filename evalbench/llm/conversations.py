"""Operator 13: repair of conversations by a Viterbi pass over a role grammar.

A conversation is sound if the initials of its roles read ``(s?(ua)+)?``. Its rows, in the order of their turns, are
kept (K, 0), given the role user or assistant (R, 3) or deleted (D, 4; blank rows and repeats must be), and empty turns
of user or assistant may be inserted anywhere (I, 3); a truncated row that stays adds 3. ``repair`` returns the edits
of least cost, of equal ones those whose letters are least in ASCII.

Four states hold what the repaired conversation ends with so far: nothing, s, u or a. Each carries the least (cost,
letters) that lead to it; a row moves states, and each row's layer is closed by at most two inserts, as a third would
come back to a state at a higher cost. Of equal costs, no letters are the beginning of others (equal letters cost the
same), so the least letters stay least whatever follows. Letters that all live states share are decided: their rows go
out at once, so memory holds the undecided stretch, not the conversation. A state that another can stand in for at
less cost is dropped: s for a that costs no more; nothing for a that costs less by over a deletion.

Rows are dealt by conversation and sorted there; repeats are found by a window over (conversation, role, text) in the
same partitioning, which spills like the sort. One conversation is one stream, as its edits and the hash of its text
are of the whole in order: a giant one takes long, but no more memory.

Defined results: null role and text read as one space, whose initial is none of the grammar's; a null turn stands
first; rows of one turn are ordered by role, then text; a null conversation id is a conversation; rows repeated in full
are repeats; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import os
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evalbench.llm._spark import table

SPACE = " \t\n\x0b\x0c\r"
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
NOTHING, S, U, A = range(4)
#: fault of a row
SOUND, BLANK, REPEAT, CUT = range(4)
ENTERS = {"s": (S, (NOTHING,)), "u": (U, (NOTHING, S, A)), "a": (A, (U,))}
ROWS, BYTES = 4_096, 4 << 20  # of a batch that goes out
DECIDE = 32  # letters after which what is decided goes out

EDITS = "conv_id long, place long, turn long, edit string, role string, text string, role_before string, fault int"


def damage(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, gone``: rows dropped, emptied, without stops, repeated or given another role by a hash of their id.

    A dropped row stays as one without text that says only that its conversation exists (``gone``).
    """
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    d, text = F.crc32(name.cast("binary")) % 20, F.coalesce("text", F.lit(" "))
    hurt = rows.select(
        "conv_id", "turn", F.when(d == 4, "user").otherwise(F.coalesce("role", F.lit(" "))).alias("role"),
        F.when(d <= 1, "").when(d == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"), (d == 0).alias("gone"), F.when(d == 3, 2).otherwise(1).alias("__times"),
    )
    return hurt.withColumn("__copy", F.explode(F.sequence(F.lit(1), "__times"))).drop("__copy", "__times")


class Chain:
    """The pass over one conversation; ``put`` takes what is decided, an edit at a time."""

    def __init__(self, put):
        self.put, self.pending, self.at = put, deque(), NOTHING
        self.live = {NOTHING: (0, "")}
        self.close()

    def close(self) -> None:
        live = self.live
        for state, before in ((U, (NOTHING, S, A)), (A, (U,))):
            found = [(live[b][0] + INSERT, live[b][1] + "I") for b in before if b in live]
            live[state] = min(found + [live[state]] if state in live else found)
        if S in live and live[A] <= live[S]:
            del live[S]
        if NOTHING in live and live[A][0] + DELETE < live[NOTHING][0]:
            del live[NOTHING]

    def add(self, turn, role: str, text: str, fault: int) -> None:
        self.pending.append((turn, role, text, fault))
        new = {state: (cost + DELETE, letters + "D") for state, (cost, letters) in self.live.items()}
        if fault not in (BLANK, REPEAT):
            more = TRUNCATED if fault == CUT else 0
            moves = [("R", REROLE + more, *ENTERS["u"]), ("R", REROLE + more, *ENTERS["a"])]
            if role[:1] in ENTERS:
                moves.append(("K", more, *ENTERS[role[:1]]))
            for letter, cost, state, before in moves:
                for b in before:
                    if b in self.live:
                        option = (self.live[b][0] + cost, self.live[b][1] + letter)
                        if state not in new or option < new[state]:
                            new[state] = option
        self.live = new
        self.close()
        if len(self.pending) >= DECIDE and len(self.pending) % DECIDE == 0:
            shared = len(os.path.commonprefix([letters for _, letters in self.live.values()]))
            self.decide(self.live[A][1][:shared])
            self.live = {state: (cost, letters[shared:]) for state, (cost, letters) in self.live.items()}

    def end(self) -> None:
        self.decide(min(self.live[s] for s in (NOTHING, A) if s in self.live)[1])

    def decide(self, letters: str) -> None:
        for letter in letters:
            turn, role, text, fault = (None, None, "", SOUND) if letter == "I" else self.pending.popleft()
            before = role
            if letter in "RI":
                role = "assistant" if self.at == U else "user"
            if letter != "D":
                self.at = ENTERS[role[:1]][0]
            self.put(turn, letter, role, text, before, fault)


class Batches:
    """Rows gathered into batches of bounded size."""

    def __init__(self, schema: pa.Schema):
        self.schema, self.full = schema, []
        self.clear()

    def clear(self) -> None:
        self.columns, self.bytes = [[] for _ in self.schema], 0

    def add(self, row: tuple, size: int = 0) -> None:
        for column, value in zip(self.columns, row, strict=True):
            column.append(value)
        self.bytes += size
        if len(self.columns[0]) >= ROWS or self.bytes >= BYTES:
            self.flush()

    def flush(self) -> None:
        if self.columns[0]:
            self.full.append(pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(self.columns, self.schema, strict=True)], schema=self.schema))
            self.clear()

    def taken(self) -> Iterator[pa.RecordBatch]:
        while self.full:
            yield self.full.pop(0)


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}
    return pa.schema([pa.field(name, kinds[kind]) for name, kind in (x.split() for x in ddl.split(", "))])


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out, chain, now, place = Batches(_arrow(EDITS)), None, (), 0

    def put(turn, letter, role, text, before, fault):
        nonlocal place
        out.add((now, place, turn, letter, role, text, before, fault), len(text))
        place += 1

    for batch in batches:
        for conv, turn, role, text, gone, fault in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "gone", "fault")), strict=True):
            if chain is None or conv != now:
                if chain is not None:
                    chain.end()
                now, chain, place = conv, Chain(put), 0
            if gone:
                out.add((now, None, None, None, None, None, None, None))
            else:
                chain.add(turn, role, text, fault)
        yield from out.taken()
    if chain is not None:
        chain.end()
    out.flush()
    yield from out.taken()


def repair(rows: DataFrame) -> DataFrame:
    """Each conversation's edits in order: ``conv_id, place, turn, edit, role, text, role_before, fault``.

    The repaired conversation is the rows whose edit is not D, by ``place``; ``role_before`` is null where a turn was
    inserted. Rows that are ``gone`` come back without place and edit. A partition holds whole conversations in order.
    """
    gone = F.col("gone") if "gone" in rows.columns else F.lit(False)
    read = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), gone.alias("gone"))
    seen = F.row_number().over(Window.partitionBy("conv_id", "role", "text", "gone").orderBy(F.asc_nulls_first("turn"))) > 1
    bare = F.rtrim("text", F.lit(SPACE))
    fault = F.when(bare == "", BLANK).when(seen, REPEAT).when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), CUT).otherwise(SOUND)
    ordered = read.repartition("conv_id").withColumn("fault", fault).sortWithinPartitions(F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "role", "text")
    return ordered.mapInArrow(_edits, EDITS)


DIGESTS = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out, now, letters = Batches(_arrow(DIGESTS)), (), None
    prices = {"K": 0, "R": REROLE, "D": DELETE, "I": INSERT}

    def close():
        gaps = min(last - least + 1 - turns, (1 << 63) - 1) if turns else 0
        out.add((now, gaps, faults[BLANK], faults[REPEAT], faults[CUT], illegal, cost, "".join(letters), text_hash.hexdigest()), len(letters))

    for batch in batches:
        for conv, turn, edit, role, text, before, fault in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "edit", "role", "text", "role_before", "fault")), strict=True):
            if letters is None or conv != now:
                if letters is not None:
                    close()
                now, letters, text_hash, faults, illegal, cost = conv, [], hashlib.sha256(), [0, 0, 0, 0], 0, 0
                least = last = previous = None
                turns, lines = 0, False
            if edit is None:
                continue
            letters.append(edit)
            cost += prices[edit] + (TRUNCATED if fault == CUT and edit != "D" else 0)
            if before is not None:
                faults[fault] += 1
                illegal += previous is not None and previous + before[:1] not in ("su", "ua", "au")
                previous = before[:1]
                if turn is not None and turn != last:
                    least, last, turns = turn if least is None else least, turn, turns + 1
            if edit != "D":
                text_hash.update(f"{'\n' if lines else ''}{role}:{text}".encode())
                lines = True
        yield from out.taken()
    if letters is not None:
        close()
    out.flush()
    yield from out.taken()


def digest(edits: DataFrame) -> DataFrame:
    """A row for each conversation of ``repair``, read in the order in which its partitions hold it: faults, cost, letters and the repaired text's hash."""
    return edits.mapInArrow(_digests, DIGESTS)


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return digest(repair(damage(rows)))


SQL = r"""
with recursive named as (select *, coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ') as name from conversations),
    hashed as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, cast(xor(list_reduce(list_prepend(4294967295::ubigint, list_transform(string_split(name, ''), lambda ch: ascii(ch)::ubigint)),
            lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, (x & 1) * 3988292384))), 4294967295::ubigint) % 20 as integer) as d from named),
    hurt as (select conv_id, turn, case d when 4 then 'user' else role end as role, case d when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text
        from hashed, range(2) t(copy) where d <> 0 and (copy = 0 or d = 3)),
    placed as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as i from hurt),
    found as (select *, substr(role, 1, 1) as initial, row_number() over (partition by conv_id, role, text order by i) > 1 as again,
        not regexp_matches(text, '[^\x20\x09-\x0D]') as blank, not regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') as cut, lag(substr(role, 1, 1)) over (partition by conv_id order by i) as before from placed),
    faulty as (select *, case when blank then 1 when again then 2 when cut then 3 else 0 end as fault from found),
    enters(t, f, initial, named) as (values (1, 0, 's', 'system'), (2, 0, 'u', 'user'), (2, 1, 'u', 'user'), (2, 3, 'u', 'user'), (3, 2, 'a', 'assistant')),
    closes(f, t, cost, letters, lines) as (values (0, 0, 0, '', ''), (1, 1, 0, '', ''), (2, 2, 0, '', ''), (3, 3, 0, '', ''), (0, 2, 3, 'I', E'\nuser:'), (1, 2, 3, 'I', E'\nuser:'), (3, 2, 3, 'I', E'\nuser:'),
        (2, 3, 3, 'I', E'\nassistant:'), (0, 3, 6, 'II', E'\nuser:\nassistant:'), (1, 3, 6, 'II', E'\nuser:\nassistant:')),
    moves as (select f, t, 'K' as letter, initial, null as named, 0 as cost from enters
        union all select f, t, 'R', null, named, 3 from enters where t > 1 union all select s, s, 'D', null, null, 4 from range(4) r(s)),
    dp(conv_id, i, st, m) as (
        select distinct conv_id, 0::bigint, c.t, {'cost': c.cost, 'audit': c.letters, 'out': c.lines} from placed, closes c where c.f = 0
        union all
        select dp.conv_id, r.i, c.t, min({'cost': dp.m.cost + v.cost + c.cost + case when r.fault = 3 and v.letter <> 'D' then 3 else 0 end, 'audit': dp.m.audit || v.letter || c.letters,
            'out': dp.m.out || case v.letter when 'D' then '' else E'\n' || coalesce(v.named, r.role) || ':' || r.text end || c.lines})
        from dp join faulty r on r.conv_id is not distinct from dp.conv_id and r.i = dp.i + 1 join moves v on v.f = dp.st and (v.letter = 'D' or r.fault in (0, 3)) and (v.initial is null or v.initial = r.initial) join closes c on c.f = v.t
        group by dp.conv_id, r.i, c.t),
    facts as (select conv_id, count(*) as n, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 1) as blank, count(*) filter (fault = 2) as duplicate,
        count(*) filter (fault = 3) as truncated, count(*) filter (before is not null and before || initial not in ('su', 'ua', 'au')) as illegal from faulty group by conv_id),
    best as (select dp.conv_id, min(dp.m) as m from dp join facts f on f.conv_id is not distinct from dp.conv_id and f.n = dp.i where dp.st in (0, 3) group by dp.conv_id)
select o.conv_id, coalesce(f.gaps, 0) as gaps, coalesce(f.blank, 0) as blank, coalesce(f.duplicate, 0) as duplicate, coalesce(f.truncated, 0) as truncated, coalesce(f.illegal, 0) as illegal,
    cast(coalesce(b.m.cost, 0) as bigint) as cost, coalesce(b.m.audit, '') as audit, sha256(coalesce(substr(b.m.out, 2), '')) as repaired_sha256
from (select distinct conv_id from conversations) o left join facts f on f.conv_id is not distinct from o.conv_id left join best b on b.conv_id is not distinct from o.conv_id
"""
