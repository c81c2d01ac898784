"""Repair against an enumeration of all edits, on random and odd conversations, and with what is decided going out early."""

import collections
import hashlib
import itertools
import random
import zlib

from pyspark.sql import functions as F

from evalbench.llm import conversations as cv

SCHEMA = "conv_id long, turn long, role string, text string"


def sound(roles):
    s = "".join(r[:1] for r in roles)
    s = s[1:] if s.startswith("s") else s
    return all(r for r in roles) and s == "ua" * (len(s) // 2) and (s or not roles)


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        bare = text.strip(cv.SPACE)
        out.append(cv.BLANK if not bare else cv.REPEAT if (role, text) in seen else cv.CUT if bare[-1] not in ".!?" else cv.SOUND)
        seen.add((role, text))
    return out


def by_enumeration(rows, most=4):
    """The least (cost, letters, lines) over all edits with up to ``most`` inserts."""
    best, fault = None, faults(rows)
    for letters in itertools.product("KRD", repeat=len(rows)):
        if any(f in (cv.BLANK, cv.REPEAT) and x != "D" for f, x in zip(fault, letters)):
            continue
        for inserts in range(most + 1):
            for places in itertools.combinations(range(len(rows) + inserts), inserts):
                edits, left = [], iter(letters)
                for i in range(len(rows) + inserts):
                    edits.append("I" if i in places else next(left))
                free = sum(x in "RI" for x in edits)
                cost = sum({"K": 0, "R": 3, "D": 4, "I": 3}[x] for x in edits) + sum(3 for f, x in zip(fault, letters) if f == cv.CUT and x != "D")
                if best and (cost, "".join(edits)) >= best[:2]:
                    continue
                for named in itertools.product(("user", "assistant"), repeat=free):
                    roles, lines, own, name = [], [], iter(rows), iter(named)
                    for x in edits:
                        _, role, text = (None, None, "") if x == "I" else next(own)
                        role = next(name) if x in "RI" else role
                        if x != "D":
                            roles.append(role)
                            lines.append(f"{role}:{text}")
                    if sound(roles):
                        best = (cost, "".join(edits), lines)
                        break
    return best


def test_equals_an_enumeration(spark):
    r = random.Random(1)
    talks = {}
    for c in range(160):
        n = r.randrange(1, 5)
        talks[c] = [(t, r.choice(["system", "user", "user", "assistant", "assistant", "tool", ""]), r.choice(["Yes.", "No!", "cut", " ", "", "Yes.", f"t{r.random()}?"])) for t in range(n)]
    df = spark.createDataFrame([(c, *row) for c, rows in talks.items() for row in rows], SCHEMA)
    edits = collections.defaultdict(list)
    for x in cv.repair(df).collect():
        edits[x.conv_id].append(x)
    digests = {x.conv_id: x for x in cv.digest(cv.repair(df)).collect()}
    for c, rows in talks.items():
        cost, letters, lines = by_enumeration(rows)
        own = sorted(edits[c], key=lambda x: x.place)
        assert "".join(x.edit for x in own) == letters and [f"{x.role}:{x.text}" for x in own if x.edit != "D"] == lines, rows
        d, fault = digests[c], faults(rows)
        assert (d.cost, d.audit, d.repaired_sha256) == (cost, letters, hashlib.sha256("\n".join(lines).encode()).hexdigest())
        assert (d.blank, d.duplicate, d.truncated) == tuple(fault.count(k) for k in (cv.BLANK, cv.REPEAT, cv.CUT)) and d.gaps == 0
        assert d.illegal == sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))


def closed(live):
    for s, before in ((2, (0, 1, 3)), (3, (2,))):
        live[s] = min([(live[b][0] + 3, live[b][1] + "I") for b in before if b in live] + [live[x] for x in (s,) if x in live])
    return live


def whole(rows):
    """The same pass with nothing decided before the end, and no state dropped."""
    live = closed({0: (0, "")})
    for (_, role, _), f in zip(rows, faults(rows)):
        options = [(s, c + 4, a + "D") for s, (c, a) in live.items()]
        if f not in (cv.BLANK, cv.REPEAT):
            more = 3 if f == cv.CUT else 0
            for b, (c, a) in live.items():
                options += [(2, c + 3 + more, a + "R")] * (b in (0, 1, 3)) + [(3, c + 3 + more, a + "R")] * (b == 2)
                to, places = {"s": (1, (0,)), "u": (2, (0, 1, 3)), "a": (3, (2,))}.get(role[:1], (0, ()))
                options += [(to, c + more, a + "K")] * (b in places)
        live = closed({s: min((c, a) for t, c, a in options if t == s) for s in {t for t, _, _ in options}})
    return min(live[s] for s in (0, 3) if s in live)


def test_long_conversations_go_out_as_they_are_decided(spark):
    r = random.Random(2)
    rows = [(1, t, r.choice(["user", "assistant", "tool"]) if r.random() < 0.2 else "ua"[t % 2].replace("u", "user").replace("a", "assistant"), f"text {t}" + r.choice([".", "!", ""])) for t in range(5000)]
    rows += [(2, t, "user", " ") for t in range(3000)] + [(3, t, "system", f"{t}.") for t in range(2000)] + [(4, 0, "user", "long " * 400_000 + ".")]
    out = {x.conv_id: x for x in cv.digest(cv.repair(spark.createDataFrame(rows, SCHEMA))).collect()}
    for c in (1, 2, 3, 4):
        own = [row[1:] for row in rows if row[0] == c]
        assert (out[c].cost, out[c].audit) == whole(own)
    held, chain = [], cv.Chain(lambda *a: None)
    for row, f in zip([x[1:] for x in rows if x[0] == 1], faults([x[1:] for x in rows if x[0] == 1])):
        chain.add(*row, f)
        held.append(len(chain.pending))
    assert max(held) < 10 * cv.DECIDE


def test_odd_rows_and_damage(spark):
    rows = [(None, None, None, None), (None, 3, "user", "a."), (None, 3, "user", "a."), (5, 9, "user", "x."), (5, None, "system", "s."), (5, 2**62, "assistant", "y."), (6, 1, "user", "b."), (6, 1, "assistant", "a.")]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("old") for c in ("edit", "fault", "place", "name", "d")})
    out = {x.conv_id: x for x in cv.digest(cv.repair(df)).collect()}
    assert set(out) == {None, 5, 6} and out[5].gaps == 2**62 - 9 - 1 and out[None].gaps == 0
    assert (out[None].blank, out[None].duplicate, out[5].audit, out[6].audit) == (1, 1, "KKK", "IKKI")
    assert out[6].cost == 6 and out[6].repaired_sha256 == hashlib.sha256(b"user:\nassistant:a.\nuser:b.\nassistant:").hexdigest()
    assert cv.repair(df.where("conv_id = 0")).count() == cv.digest(cv.repair(df.where("conv_id = 0"))).count() == 0
    many = [(c, t, ["user", "assistant"][t % 2], f"Word {t}. End.") for c in range(60) for t in range(4)] + [(None, None, None, None), (7, None, "user", "q")]
    hurt = collections.defaultdict(list)
    for x in cv.damage(spark.createDataFrame(many, SCHEMA)).collect():
        hurt[x.conv_id, x.turn].append((x.role, x.text, x.gone))
    for c, t, role, text in many:
        role, text = role or " ", text or " "
        d = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        text = "" if d <= 1 else text.replace(".", "") if d == 2 else text
        assert hurt[c, t] == [("user" if d == 4 else role, text, d == 0)] * (2 if d == 3 else 1)
    lost = spark.createDataFrame([(i, 0, "user", "Hello.") for i in range(400) if zlib.crc32(f"{i}:0".encode()) % 20 == 0], SCHEMA)
    for x in cv.digest(cv.repair(cv.damage(lost))).collect():
        assert (x.gaps, x.cost, x.audit, x.repaired_sha256) == (0, 0, "", hashlib.sha256(b"").hexdigest())
    assert lost.count() == cv.digest(cv.repair(cv.damage(lost))).count() > 5


def test_one_shuffle(spark):
    df = spark.createDataFrame([(1, 1, "user", "a.")], SCHEMA)
    plan = cv.digest(cv.repair(df))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1
