"""Number extraction, contexts, runs, words and URL functions."""

import pytest
from hypothesis import given
from hypothesis import settings as hypothesis_settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarryline.functions import patterns as C
from quarryline.functions import text as T
from quarryline.functions import urls

CASES = [
    ("1'234'567", ["1'234'567"]), ("1.234.567", ["1.234.567"]), ("1;234;567", []), ("1234567", ["1234567"]), ("US1.234.567", ["US1.234.567"]), ("US 1234567", ["US 1234567"]),
    ("us1234567", []), ("D234'567", ["D234'567"]), ("USD234567", ["USD234567"]), ("RE44,701", ["RE44,701"]), ("US RE44701", ["US RE44701"]), ("RE44701E1", ["RE44701E1"]),
    ("U.S. Patent Nos. 1234567B8", ["U.S. Patent Nos. 1234567B8"]), ("U.S. Patent # 1234567B8", ["U.S. Patent # 1234567B8"]), ("JP2009278698A", ["JP2009278698A"]),
    ("JPS60041878", ["JPS60041878"]), ("JP106792C2", []), ("999999999", []), ("2.009.278.698", []), ("11'234'567", []), ("US11234567", []), ("D1234567", []),
    ("1.234.567.B1", ["1.234.567.B1"]), ("1.234.567 A", ["1.234.567 A"]), ("#1.234.567", ["#1.234.567"]), ("$1'234'567'123", []), ("1'234'567. 123", ["1'234'567"]),
    ("patent numbers 1'234'567, 2'222'333 and 3'444'555.", ["patent numbers 1'234'567", "2'222'333", "3'444'555"]), ("8028357;295166;8321970", []),
    ("<p>\n\tU.S. 7,658,040</p>", ["U.S. 7,658,040"]), ("9,004,524,&nbsp;9,050,987", ["9,004,524", "9,050,987"]),
    ("U.S. Patent Numbers:6,839,403; 7,505,557; 8,213,570", ["6,839,403", "7,505,557", "8,213,570"]), ("US Patent No: US 7,650,942,B2", ["US 7,650,942,B2"]),
    ("US Patent Numbers: 8,299,944; 8,396,905; 9,251,198;9,501,548;9,495,435. Other patents pending.", ["8,299,944", "8,396,905"]),
]


def test_numbers(spark):
    rows = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "i int, t string")
    got = {r.i: r.n for r in rows.select("i", T.numbers(T.clean_spaces(T.html_to_text(F.col("t")))).alias("n")).collect()}
    assert [got[i] for i in range(len(CASES))] == [c[1] for c in CASES]


def test_matches_have_their_context(spark):
    texts = ["1234567", "ab 1234567 cd", "zero 1234567; 7654321, and so on and on", "x" * 30 + " 1234567 " + "y" * 30]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.matches(F.col("t"), T.NUMBER, 10).alias("m")).collect()
    for r in rows:
        at = 0
        for m in r.m:
            at = r.t.index(m.text, at)
            assert m.context == r.t[max(0, at - 10) : at + len(m.text) + 10]
            at += 1
    assert [len(r.m) for r in rows] == [1, 1, 2, 1]


def test_runs(spark):
    P = T.MARKER
    cases = [(["a", P, P, "b", P], [(1, 2), (4, 4)], 2), (["x", "y"], [], 0), (["", P], [(1, 1)], 1), ([], [], 0)]
    rows = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, t array<string>").select("i", T.runs(F.col("t")).alias("r"), T.longest_run(F.col("t")).alias("n"))
    for r in rows.collect():
        assert ([(x.start, x.end) for x in r.r], r.n) == cases[r.i][1:]
        assert all(x.length == x.end - x.start + 1 for x in r.r)


def test_words(spark):
    rows = spark.createDataFrame([("Ab, cd ab",), (" x",), ("",), (" ",), ("12",)], "t string").select(T.words(F.col("t")).alias("w")).collect()
    assert [r.w for r in rows] == [["ab", "cd", "ab"], ["", "x"], [""], [], []]


def test_urls(spark):
    given_urls = ["HTTP://U@a.B.com:80/x/YzAb?q=1#f", "http://h", "no url", None, "http://h/a b|c"]
    u = F.col("u")
    rows = spark.createDataFrame([(x,) for x in given_urls], "u string").select(urls.host(u).alias("h"), urls.normalized(u).alias("n"), urls.path(u).alias("p"), urls.path_words(u).alias("w"), urls.discarded(u, (r"(.+\.)?B\.com",)).alias("d")).collect()
    assert [r.h for r in rows] == ["a.B.com", "h", None, None, "h"]
    assert [r.n for r in rows][:2] == ["http://U@a.B.com:80/x/YzAb?q=1", "http://h"]
    assert rows[0].p == "/x/YzAb?q=1#f" and rows[0].w == ["x", "yz", "ab", "q", "f"]
    assert [r.d for r in rows] == [True, False, False, False, False]


def test_top_private_domain(spark):
    hosts = ["www.a.example.co.uk", "foo.blogspot.com", "localhost", "127.0.0.1", "co.uk", None, "x.y.example.com", "a.b.ck", "b.ck", "x.www.ck", "ck", "", "Example.ORG.", "com.example"]
    rows = urls.with_top_private_domain(spark.createDataFrame([(h,) for h in hosts], "h string"), F.col("h")).collect()
    assert [r.domain for r in rows] == ["example.co.uk", "foo.blogspot.com", "", "", "", "", "example.com", "a.b.ck", "", "www.ck", "", "", "example.org", ""]


@hypothesis_settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet='ab§\\/"?&.', max_size=12), min_size=1, max_size=30))
def test_filenames_give_urls_back(spark, names):
    rows = spark.createDataFrame([(n,) for n in names], "u string").withColumn("f", urls.filename(F.col("u"), F.length("u") % 2 == 0))
    for r in rows.withColumn("again", urls.url_of_filename(F.col("f"))).collect():
        assert r.again == r.u and "/" not in r.f


def test_filename_without_extension(spark):
    assert spark.range(1).select(urls.url_of_filename(F.lit("a.txt"))).first()[0] is None


@pytest.mark.parametrize(("text", "expected"), [("U.S. Patent Nos. 8,363,572", "US8363572"), ("D435,561", "D435561"), ("pat. no. 5,123,123", "5123123")])
def test_bare_number(spark, text, expected):
    assert spark.range(1).select(T.bare_number(F.lit(text))).first()[0] == expected


def test_hosts_are_discarded_as_by_the_regexes(spark, monkeypatch):
    """Every default pattern and others, on hosts around them; 100,000 patterns in one pass."""
    monkeypatch.setattr(urls, "FEW", 0)
    odd = (r"blog\..+", r"a(b|c)\.de", r".+\.gov(\...)?", r"x-y\.z_\.org", r"(.+\.)?two\...")
    patterns = (*C.DISCARDED_HOSTS, *odd)
    names = [p.replace("(.+\\.)?", "").replace(".+\\.", "").replace("(\\...)?", "").replace("\\...", ".uk").replace("\\.", ".") for p in patterns]
    ends = [n + e for n in names for e in ("", ".uk", ".c", ".com", ".", ".é1")]
    hosts = sorted({pre + n for n in ends for pre in ("", "www.", "a.b.", ".", "a..", "not", "1.2.")} | {"", "com", "blog.x", "blog.", "ab.de", "ad.de", "x.ab.de"})
    rows = spark.createDataFrame([(f"http://{h}/p",) for h in hosts] + [(None,), ("no url",)], "u string")
    host, regex = urls.host(F.col("u")), "^(?:" + "|".join(f"(?:{p})" for p in patterns) + ")$"
    both = rows.select("u", urls.discarded(F.col("u"), patterns).alias("got"), F.coalesce(F.regexp_like(host, F.lit(regex)), F.lit(False)).alias("want")).collect()
    assert [r.u for r in both if r.got != r.want] == [] and 100 < sum(r.got for r in both) < len(both)
    listed, rest = urls.host_names(patterns)
    assert rest == [r"blog\..+", r"a(b|c)\.de"] and ("google.com.??", "s") in listed
    many = tuple(rf"(.+\.)?site{i}\.com" for i in range(100_000))
    some = rows.limit(3).select(F.explode(F.array(*(F.lit(f"http://{h}/") for h in ("site7.com", "a.site99999.com", "site100000.com", "xsite7.com")))).alias("u"))
    assert [r[0] for r in some.limit(4).select(urls.discarded(F.col("u"), many)).collect()] == [True, True, False, False]


def test_domain_gives_way_and_needs_no_join(spark):
    rows = spark.createDataFrame([("a.b.co.uk", "old", 1), ("y.ck", None, 2), ("www.ck", "", 3), (None, "z", 4)], "h string, domain string, _labels int")
    out = urls.with_top_private_domain(rows, F.col("h"))
    assert [(r.domain, r._labels) for r in out.collect()] == [("b.co.uk", 1), ("", 2), ("www.ck", 3), ("", 4)]
    assert "Join" not in out._jdf.queryExecution().toString()


def test_contexts_are_cut_down(spark):
    """At the start and the end of a text one side is shorter, and what stands beside a match may look like it."""
    text = "1234567 1234567 and EP7654321 at the end 7654321"
    rows = spark.createDataFrame([(text,)], "t string").select(F.explode(T.matches(F.col("t"), r"\d{7}", 10)).alias("m")).select("m.text", "m.context")
    got = [r[0] for r in rows.select(T.cut_context(F.col("context"), F.col("text"), 10, 3)).collect()]
    assert got == ["1234567 12", "67 1234567 an", " EP7654321 at", "nd 7654321"]
