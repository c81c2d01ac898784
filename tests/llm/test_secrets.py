"""Secret scan against SQL, a plain loop, and candidates whose secret part is anywhere."""

import hashlib
import random
import re
import string
import uuid

import duckdb
from pyspark.sql import functions as F

from evalbench.llm import secrets

DOCS = "/root/testdata/sf0.01/documents.parquet"


def test_base_columns_equal_sql(spark):
    """The counts by base kind, by the patterns in SQL; letters outside ASCII do not match in either."""
    sql = f"""
    with d as (select doc_id, coalesce(text, '') as t from read_parquet('{DOCS}'))
    select doc_id, len(list_filter(regexp_extract_all(t, '(?i)(?:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 1), lambda v: length(v) >= 6)),
    len(list_filter(regexp_extract_all(t, 'AKIA[A-Z0-9]+'), lambda v: length(v) >= 20)), len(list_filter(regexp_extract_all(t, '[0-9a-f]+'), lambda v: length(v) >= 24)) from d"""
    want = sorted(duckdb.sql(sql).fetchall())
    got = sorted((r.doc_id, r.n_assign, r.n_access, r.n_hex) for r in secrets.find(spark.read.parquet(DOCS)).collect())
    assert got == want and sum(sum(r[1:]) for r in want) > 10


def test_digest_equals_a_plain_loop(spark):
    r = random.Random(4)
    bits = ["password", "Api_Key", "token", "=", ":", " ", '"', "'", "AKIA", "ABCDEFGH0123456789", "0123456789abcdef", "é", "日本", "x.y", "secret", "zz", "A" * 7, "\n"]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(0, 40))) for _ in range(300)] + [None, ""]
    got = {x.doc_id: x for x in secrets.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, text in enumerate(texts):
        text, spans = text or "", []
        for order, (kind, pattern, least) in enumerate((("assign", r"""(?ai)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6), ("access", "(AKIA[A-Z0-9]+)", 20), ("hex", "([0-9a-f]+)", 24))):
            spans += [(m.start(), order, kind, m.end()) for m in re.finditer(pattern, text) if len(m[1]) >= least]
        line = ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in sorted(spans))
        assert got[i].base_sha256 == hashlib.sha256(line.encode()).hexdigest()
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == tuple(sum(s[2] == k for s in spans) for k in ("assign", "access", "hex"))
        kept = [s for s in got[i].spans.split(",") if s and not s.startswith("learned")]
        assert ",".join(kept) == line and 0 <= got[i].n_confirmed <= len(kept)


def test_the_middle_of_a_long_candidate_decides():
    net, r = secrets.trained(), random.Random(3)
    word = lambda: "".join(r.choice(string.ascii_lowercase) for _ in range(r.randint(3, 8)))
    key = lambda: "".join(r.choice(string.ascii_letters + string.digits) for _ in range(36))
    path = lambda n: "".join(word() + "/" for _ in range(n))
    with_key = [f"see {path(6)}ghp_{key()}/{path(6)}page7.html or" for _ in range(60)]
    without = [f"see {path(9)}{path(6)}page7.html or" for _ in range(60)]
    found = lambda texts: sum(any(k == "learned" for *_, k in spans) for spans, _ in secrets.scan(texts, net))
    assert found(with_key) >= 57 and found(without) <= 6
    assert [b - a for a, b in secrets.pieces(5, 205)][:1] == [secrets.INNER] and {x for a, b in secrets.pieces(5, 205) for x in range(a, b)} == set(range(5, 205))


def test_what_looks_like_a_key_and_is_none():
    """Precision on UUIDs, account and book numbers and real class names, and recall on keys, in plain prose."""
    net, r = secrets.trained(), random.Random(11)
    some = lambda of, n: "".join(r.choice(of) for _ in range(n))
    names = ["AbstractSingletonProxyFactoryBean", "ThreadPoolExecutorService2", "HttpServletRequestWrapper", "getElementsByClassName", "XMLHttpRequestEventTarget", "MultivariateNormalDistribution", "OrganizationalUnitController"]
    plain = [lambda: str(uuid.UUID(int=r.getrandbits(128))), lambda: "DE" + some(string.digits, 20), lambda: "GB" + some(string.digits, 2) + some(string.ascii_uppercase, 4) + some(string.digits, 14), lambda: f"978-{r.randint(0, 9)}-{some(string.digits, 4)}-{some(string.digits, 4)}-{r.randint(0, 9)}", lambda: r.choice(names), lambda: "src/main/java/org/example/StringUtils2.java"]
    keys = [lambda: some(string.ascii_letters + string.digits, 30), lambda: some(string.ascii_letters + string.digits + "+/", 40), lambda: "ghp_" + some(string.ascii_letters + string.digits, 36)]
    learned = lambda make: sum(any(k == "learned" for *_, k in spans) for spans, _ in secrets.scan([f"and the {make()} is here" for _ in range(150)], net)) / 150
    false, true = [learned(make) for make in plain], [learned(make) for make in keys]
    assert max(false) <= 0.05 and min(true) >= 0.95, (false, true)
    assert sum(true) / (sum(true) + sum(false)) >= 0.97


def test_short_values_are_read():
    net, r = secrets.trained(), random.Random(5)
    some = lambda: "".join(r.choice(string.ascii_letters + string.digits) for _ in range(r.randint(9, 14)))
    good = [f"the password = {some()} is" for _ in range(80)]
    plain = [f"the token: {x} is" for x in ("string", "required", "please", "values", "enabled", "default") * 10]
    share = lambda texts: sum(n for _, n in secrets.scan(texts, net)) / len(texts)
    assert share(good) > 0.9 and share(plain) < 0.5


def test_odd_rows(spark):
    rows = [(1, "x" * 200_000 + " api_key=abcdef " + "y1" * 50_000), (1, "x"), (None, "token: 123456"), (2, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("z") for c in ("spans", "n_hex", "base_sha256")})
    got = secrets.find(df).collect()
    assert sorted((r.doc_id or 0, r.n_assign) for r in got) == [(0, 1), (1, 0), (1, 1), (2, 0)]
    out = secrets.redact(df)
    assert out.columns == df.columns and out.where("doc_id is null").first().text == "[SECRET]" and {r.spans for r in out.collect()} == {"z"}
