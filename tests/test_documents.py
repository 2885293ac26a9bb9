import random
import re
from decimal import Decimal
from fractions import Fraction

import duckdb
import pytest
from pyspark.sql import functions as F

from fathomark.functions import text as tx
from fathomark.operators import documents as docs
from fathomark.plans import load_all
from fathomark.plans.registry import ORACLES, QUERIES
from oracle import compare

load_all()

TEXT = "score 0.316 and -2e3, 24be64 5kg 12.5kg v1\nvalue $3\\times 10^{-2}$ 1,084 runs % 99\n5th 7--9 x_4 \\cite{ab2001, cd} 1.55e5 100\\% 8"


def test_number_tokens_follow_the_pattern(spark):
    df = spark.createDataFrame([(1, TEXT), (2, "no digits")], "d int, t string")
    got = {}
    for r in docs.number_tokens(df, "t", ["d"]).orderBy("line", "pos").collect():
        got.setdefault(r.line, []).append(r.token)
    assert got[1] == re.findall(tx.NUMBER, TEXT.split("\n")[0].replace(",", ""))
    assert got[2] == ["3e-2", "1084"]
    assert got[3] == ["5", "7", "9", "1.55e5", "100", "8"]


def test_trace_by_brute_force(spark):
    tokens = ["0.316", "0.3156", "0.32", "12", "12.0", "1.5e3", "1.55e3", "-0.5", "0.45", "99.9999", "5", "0.1250", "7.1e-3"]
    values = ["0.31560", "12.04", "1549", "-0.4501", "0.125", "100", "0.00705", "0.3155"]

    def traced(tok):
        v = Decimal(tok)
        if v in {Decimal(x) for x in values}:
            return True
        m, *e = tok.split("e")
        if "." not in m:
            return False
        tol = Decimal("0.5") * Decimal(10) ** ((int(e[0]) if e else 0) - len(m.split(".")[1]))
        return any(abs(v - Decimal(x)) < tol for x in values)

    t = spark.createDataFrame([(x,) for x in tokens], "token string")
    v = spark.createDataFrame([(x,) for x in values], "value string")
    got = {r.token: r.traced for r in docs.trace_numbers(t, v).collect()}
    assert got == {x: traced(x) for x in tokens}
    assert any(got.values()) and not all(got.values())


def test_trace_exact_at_any_size(spark):
    """Random numbers of up to 60 digits, ties, zeros and wide exponents against exact fractions."""
    rng = random.Random(5)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    tokens, values = {"0.0", "0.000", "-0.00", "0.0e3", "0.000e-9", "9.5", "10.0", "1.0", "-1.0", "0", "1.5e-700", "99.99", "1.0e2", "7"}, {"0.04", "-0.5", "9.96", "9.95", "99.995", "99.9951", "1.5e-700", "1.4E+20", "nan", "inf", "", "x", "5.", ".5"}
    for _ in range(120):
        base = f"{rng.choice(['', '-'])}{rng.choice(['0', digits(3), digits(25)])}.{digits(rng.randint(1, 40))}"
        power = rng.choice(["", "", "e7", "e-31", "e400"])
        tokens.add(base + power)
        values.add(base + rng.choice(["", "49", "5", "51", "5" + "0" * 30 + "1", "0", "999"]) + power)
        values.add(base[:-1] + rng.choice(["4", "5", "9", ""]) + "5" + rng.choice(["", "1"]) + power)
    exact = [Fraction(Decimal(v)) for v in values if re.fullmatch(r"[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?", v)]

    def traced(tok):
        v, (m, *e) = Fraction(Decimal(tok)), tok.split("e")
        half = Fraction(10) ** ((int(e[0]) if e else 0) - len(m.split(".")[1])) / 2 if "." in m else 0
        return any(v == x or abs(v - x) < half for x in exact)

    t = spark.createDataFrame([(x,) for x in [*tokens, None, "x", "1.5e" + "9" * 30]], "token string")
    v = spark.createDataFrame([(x,) for x in [*values, None]], "value string")
    got = {r.token: r.traced for r in docs.trace_numbers(t, v).collect()}
    assert got.pop(None) is False and got.pop("x") is False and got.pop("1.5e" + "9" * 30) is False
    want = {x: traced(x) for x in tokens}
    assert got == want
    assert 30 < sum(want.values()) < len(want) - 30
    empty = docs.trace_numbers(t, v.limit(0)).where("traced")
    assert empty.count() == 0 and docs.trace_numbers(t.limit(0), v).count() == 0


def test_decimal_numbers_are_those_of_a_sql_cast(spark):
    """Rounded to 16 decimals, 20 digits before them, exponents of 16 bits; the operator stays exact without it."""
    tokens = "7e-2 0.0 00 0e54 0e32767 0e32768 00e-99999 41e-607 1e-40000 5e-17 -5e-17 14.5e-17 4.9e-17 1.5e+3 12e0002 12e00000000000000000002 1e20 99999999999999999999.99999999999999994 99999999999999999999.99999999999999996 x".split()
    con = duckdb.connect()
    want = dict(con.execute("SELECT t, try_cast(t AS DECIMAL(36,16)) FROM (SELECT unnest($1::VARCHAR[]) AS t)", [tokens]).fetchall())
    t = spark.createDataFrame([(x,) for x in tokens], "token string")
    got = {r.token: r.v and Decimal(f"{'-' * (r.v.sign < 0)}0.{r.v.digits or 0}e{r.v.exp}") for r in t.select("token", docs.decimal_number(F.col("token")).alias("v")).collect()}
    assert got == want and want["0e32768"] is None and want["41e-607"] == 0
    v = spark.createDataFrame([("0.0",), ("0.06999999999999999",)], "value string")
    held = {r.token for r in docs.trace_numbers(t, v, number=docs.decimal_number).where("traced").collect()}
    assert held == {"7e-2", "0.0", "00", "0e54", "0e32767", "41e-607", "4.9e-17"}
    assert {r.token for r in docs.trace_numbers(t, v).where("traced").collect()} == {"0.0", "00", "0e54", "0e32767", "0e32768", "00e-99999"}


def test_traced_documents_equal_their_sql_where_a_result_is_zero(spark, tmp_path):
    text = "0e54 0e32768 0e99999 41e-607 7e-2 0.0 12 3 1.5"
    write = lambda name, rows, schema: spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    write("documents", [(1, text, 0), (2, text + "\n2 0e40000", 12)], "doc_id long, text string, n_chars long")
    write("part", [(900.0,)], "p_retailprice double")
    write("supplier", [(0.0,), (0.21,)], "s_acctbal double")
    con = duckdb.connect()
    for name in ("documents", "part", "supplier"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    for name in ("trace_numbers", "trace_report"):
        assert compare(QUERIES[name](spark, str(tmp_path)), con, ORACLES[name]) == ""


def test_results_are_rounded_to_places_of_tokens_only(spark):
    number = lambda name: docs.exact_number(F.col("x")).alias(name)
    vals = spark.createDataFrame([("0." + "1234567890" * 6 + str(i),) for i in range(1, 10)], "x string").select(number("_c"))
    seen = spark.createDataFrame([("0.1", 1), ("0.2", 40), ("3", None)], "x string, p int").select(number("_v"), F.col("p").cast("long").alias("_p"))
    got = docs.rounded_results(vals, seen)
    assert {r["_p"] for r in got.collect()} == {1, 40} and got.count() == 18
    # With more different places than the bound all between them are worked out: the same rows and more.
    every = docs.rounded_results(vals, seen, max_places=1)
    assert every.count() == 9 * 40 and got.exceptAll(every).count() == 0
    assert docs.rounded_results(vals, seen.where("_p IS NULL")) is None


def test_titles_fold(spark):
    df = spark.createDataFrame([("Wav2Vec2: Éléments—of  Spéech", "wav2vec2 elements of speech"), ("ﾆA² Ｂ", "")], "a string, b string")
    got = df.select(tx.norm_title(F.col("a")).alias("n"), tx.title_sim(F.col("a"), F.col("b")).alias("s")).collect()
    assert got[0]["n"] == "wav2vec2 elements of speech" and got[0]["s"] == 1.0
    assert got[1]["n"] == "a2 b"


def test_surnames(spark):
    df = spark.createDataFrame([("B. Schuller, B. Vlasenko, and A. Wendemuth", "Schuller, Bernd and A. Wendemuth AND Lee, K.")], "a string, b string")
    r = df.select(tx.surnames(F.col("a")), tx.bib_surnames(F.col("b"))).first()
    assert r[0] == ["schuller", "vlasenko", "wendemuth"] and r[1] == ["schuller", "wendemuth", "lee"]


def test_pages(spark):
    df = spark.createDataFrame([("12--19", "12-19", True), ("12", "12-19", True), ("30", "12-19", False)], "a string, b string, w boolean")
    assert all(r[0] == r[1] for r in df.select(tx.pages_agree(F.col("a"), F.col("b")), "w").collect())


def test_citations(spark):
    df = spark.createDataFrame([(1, r"see \citep[p.~3]{a1, b2} and \cite{c3}")], "d int, t string")
    cited = docs.extract_all(df, "t", tx.CITE, ["d"])
    assert {r.key for r in cited.collect()} == {"a1", "b2", "c3"}
    refs = spark.createDataFrame([("a1",), ("z9",)], "key string")
    assert [r.key for r in docs.uncited(refs, cited).collect()] == ["z9"]


@pytest.fixture(scope="module")
def audit(spark):
    ref = "key string, title string, venue string, volume string, issue string, pages string, year int, surnames array<string>"
    refs = spark.createDataFrame([
        ("ok", "deep emotion transfer", "V", "1", "1", "10-20", 2020, ["kim"]),
        ("fake", "Deep Emotion Transfer", "V", "2", "1", "30", 2020, ["nobody"]),
        ("lost", "an unindexed workshop note", "W", "3", None, None, 2019, ["lee"]),
        ("wrong", "speech features revisited", "X", "9", "4", "5", 2018, ["ray"]),
    ], ref)
    rec = "key string, doi string, title string, surnames array<string>, volume string, pages string, year int"
    recs = spark.createDataFrame([
        ("ok", "d1", "Deep emotion transfer", ["kim"], "1", "10-20", 2020), ("ok", "d0", "other", ["x"], "7", "1", 1999),
        ("fake", "d1", "Deep emotion transfer", ["kim"], "1", "10-20", 2020),
        ("lost", "d5", "completely different thing", ["lee"], "3", "1", 2019),
        ("wrong", "d6", "speech features revisited", ["ray"], "8", "5", 2018),
    ], rec)
    cited = spark.createDataFrame([("ok",), ("fake",), ("lost",)], "key string")
    return {r.key: r for r in docs.audit_entries(refs, recs, cited).collect()}


def test_audit_flags_and_tiers(audit):
    assert audit["ok"]["flags"] == ["DUPLICATED-BY-OTHER"] and audit["ok"]["tier"].startswith("A")
    assert audit["fake"]["flags"] == ["AUTHOR-MISMATCH", "VOLUME-MISMATCH", "DUPLICATE-TITLE"] and audit["fake"]["tier"].startswith("C")
    assert audit["lost"]["flags"] == ["NOT-IN-CROSSREF"] and audit["lost"]["tier"].startswith("B")
    assert audit["wrong"]["flags"] == ["VOLUME-MISMATCH", "UNCITED"] and audit["wrong"]["tier"].startswith("B")


def test_slots_without_issue_meet_in_normalised_form(spark):
    rows = [("a", "J. Foo", "10", None, "1-9"), ("b", "j foo", "10", "", "1--9"), ("c", "J Foo", "10", "2", "1-9"), ("d", None, "10", None, "1-9"), ("e", "J Foo", "", None, "1-9")]
    df = spark.createDataFrame(rows, "key string, venue string, volume string, issue string, pages string")
    (got,) = docs.dup_slots(df, "key").collect()
    assert (got.venue, got.volume, got.issue, got.pages, got.n, got["first"]) == ("j foo", "10", "", "19", 2, "a")
