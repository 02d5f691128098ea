"""Relational arithmetic, curation, classifier, archives, mining and the registered queries."""

import datetime as dt
import gzip

import duckdb
import pytest
from pyspark.sql import functions as F

from quarryline.operators import classifier, curation, mining, pages, relational
from quarryline.plans import registry
from quarryline.sources import files, warc

SF = "/root/testdata/sf0.001"


def test_domain_stats(spark):
    rows = [("a", f"n{i}", c) for i, c in enumerate((2, 1, 1, 1, 1))] + [("b", f"n{i}", 1) for i in range(4)] + [("c", "n", 7)]
    got = {r.domain: r for r in relational.domain_stats(spark.createDataFrame(rows, "domain string, han_name string, n long")).collect()}
    assert [round(got["a"][f"share_top{k}"], 3) for k in range(1, 6)] == [0.333, 0.5, 0.667, 0.833, 1.0]
    assert round(got["a"].han_names_herfindahl_index, 4) == 0.2222
    assert [got["b"][f"share_top{k}"] for k in range(1, 6)] == [0.25, 0.5, 0.75, 1, 1] and got["b"].han_names_herfindahl_index == 0.25
    assert got["c"].share_top1 == got["c"].share_top5 == got["c"].han_names_herfindahl_index == 1


def test_every_nth(spark):
    rows = spark.range(0, 100, 1, 5).select((99 - F.col("id")).alias("id"))
    assert sorted(r.id for r in pages.every_nth(rows, 7, "id").collect()) == list(range(0, 100, 7))


def test_labels(spark):
    lines = ["x\tsvpm\t1\t\t0\ty\thttp://u\tz", "x\tother\t0\t1\t1\ty\thttp://v", "x\tbad\t1\t1\t1\ty\thttp://w", "x\tsvpm\t1\t1\t1\ty\t", "short"]
    good, bad = curation.parse_labels(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert sorted((r.url, r.page_type, r.true_patent_numbers) for r in good.collect()) == [("http://u", "svpm", None), ("http://v", "other", True)]
    assert bad.count() == 3


def test_balanced(spark):
    rows = spark.createDataFrame([(i, i % 3 == 0) for i in range(10)], "i int, l boolean")
    assert sorted(r.i for r in curation.balanced(rows, "l", "i").collect()) == [0, 1, 2, 3, 4, 5, 6, 9]


def test_features():
    found = classifier.features()
    assert len(found) == 124 and found[20].name == "page_word_patent" and found[72].name == "url_word_patent"
    assert found[72].condition(True, 0.5).endswith("= false")
    with pytest.raises(ValueError, match="word"):
        found[72].condition(True, 1.5)


def test_tree_sql_is_the_tree(spark):
    found = classifier.features()
    rows = registry.QUERIES["predict_tree"](spark, SF).where("prediction = 1.0")
    said = registry.QUERIES["tree_rules_as_sql"](spark, SF)
    assert sorted(r.url for r in rows.collect()) == sorted(r.url for r in said.collect())
    assert len(found) == 124


def test_archive(spark, tmp_path):
    chunked = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nTransfer-Encoding: chunked\r\n\r\n3\r\nabc\r\n2\r\nde\r\n0\r\n\r\n"
    plain = b"HTTP/1.1 404 Not Found\r\nContent-Type: TEXT/HTML; charset=x\r\n\r\ngone"
    day = dt.datetime(2020, 1, 2, tzinfo=dt.UTC)
    blocks = [warc.framed("http://a/x.html", day, chunked), warc.framed("http://b/y", day, plain)]
    (tmp_path / "one.warc.gz").write_bytes(b"".join(blocks) + blocks[0][:20])  # the last member is torn
    (tmp_path / "two.warc").write_bytes(gzip.decompress(blocks[1]))
    warc.register(spark)
    rows = sorted(spark.read.format("warc").load(str(tmp_path)).collect(), key=lambda r: (r.file, r.offset))
    assert [(r.warc_type, r.offset, r.content) for r in rows if r.warc_type == "torn"] == [("torn", len(blocks[0] + blocks[1]), None)]
    rows = [r for r in rows if r.warc_type != "torn"]
    assert [(r.url, r.http_status, r.mime, bytes(r.content), r.offset) for r in rows] == [
        ("http://a/x.html", 200, "text/html", b"abcde", 0), ("http://b/y", 404, "text/html", b"gone", len(blocks[0])), ("http://b/y", 404, "text/html", b"gone", 0)]
    assert {(r.url, r.offset) for r in warc.records(spark, str(tmp_path)).where("url IS NOT NULL").collect()} == {(r.url, r.offset) for r in rows}
    index = warc.index_of(spark.read.format("warc").load(str(tmp_path)))
    assert [r.url for r in warc.first_by_url(index, "https://www.a/x.html").collect()] == ["http://a/x.html"]
    assert warc.by_prefix(index, "http://b").count() == 0


def test_members_with_several_records(spark, tmp_path):
    day = dt.datetime(2020, 1, 2, tzinfo=dt.UTC)
    blocks = [warc.framed(f"http://h/{i}", day, f"HTTP/1.1 200 OK\r\n\r\nbody {i}".encode()) for i in range(5)]
    joined = [gzip.compress(gzip.decompress(blocks[0]) + gzip.decompress(blocks[1])), blocks[2], gzip.compress(gzip.decompress(blocks[3]) + gzip.decompress(blocks[4]))]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(joined))
    (tmp_path / "b.warc").write_bytes(b"".join(map(gzip.decompress, blocks)))
    warc.register(spark)
    archive = spark.read.format("warc").load(str(tmp_path))
    rows = archive.collect()
    first = len(gzip.decompress(blocks[0]))
    assert [(r.url, r.offset, r.within) for r in sorted(rows, key=lambda r: r.url) if r.file.endswith("gz")] == [
        ("http://h/0", 0, 0), ("http://h/1", 0, first), ("http://h/2", len(joined[0]), 0), ("http://h/3", len(joined[0] + joined[1]), 0), ("http://h/4", len(joined[0] + joined[1]), first)]
    assert len({(r.file, r.offset, r.within) for r in rows}) == 10 and all(r.within == 0 for r in rows if r.file.endswith("b.warc"))
    read = warc.content_of(warc.index_of(archive)).collect()
    assert sorted((r.file[-2:], r.url, bytes(r.content)) for r in read) == sorted((e, f"http://h/{i}", f"body {i}".encode()) for i in range(5) for e in ("gz", "rc"))
    assert warc.load_page(warc.index_of(archive), "http://h/3") == "body 3" and warc.load_page(warc.index_of(archive), "http://h/9") is None


def test_cdx_lines(spark, tmp_path):
    (tmp_path / "i.cdx").write_text(" CDX N b a m s k r M S V g\na/x 2020 http://a/x text/html 200 D - - 10 123 f.warc.gz\nb/y 2021 http://b/y text/html - D - - 10 5 f.warc.gz\n")
    assert [(r.url_key, r.http_status, r.offset, r.file) for r in warc.cdx(spark, str(tmp_path)).orderBy("url_key").collect()] == [("a/x", 200, 123, "f.warc.gz"), ("b/y", None, 5, "f.warc.gz")]


def test_files(spark, tmp_path):
    made = []
    make = lambda: (made.append(1), spark.range(3))[1]
    assert files.cached(spark, str(tmp_path / "c"), make).count() == files.cached(spark, str(tmp_path / "c"), make).count() == 3 and len(made) == 1
    (tmp_path / "h.txt").write_text(" a\\.com \n\nb\n")
    assert files.host_patterns(spark, str(tmp_path / "h.txt")) == ("a\\.com", "b")
    (tmp_path / "t.csv").write_text(" a , b \n")
    assert tuple(files.trimmed_csv(spark, str(tmp_path / "t.csv"), "x string, y string").first()) == ("a", "b")


def tree(html):
    return mining.parse(html).kids[0]


ALIGNED = [
    ("<p><a></a><b></b><e></e></p>", "<p><b></b><c></c><d></d><e></e></p>", "abcde", "bcde"),
    ("<p><a></a><b></b><e></e></p>", "<p><e></e><f></f><g></g></p>", "abefg", "efg"),
    ("<p><a></a><b></b><e></e></p>", "<p><f></f><g></g><a></a></p>", "fgabe", "afg"),
    ("<p><a></a><b></b><e></e></p>", "<p><a></a><g></g><e></e></p>", "abe", "ae"),
    ("<p><x></x><b></b><d></d></p>", "<p><b></b><c></c><d></d><h></h><k></k></p>", "xbcdhk", "bcdhk"),
]


@pytest.mark.parametrize(("one", "two", "columns", "filled"), ALIGNED)
def test_alignment(one, two, columns, filled):
    template = [mining.Column.of(tree(one), 0)]
    mining.place(template, [tree(two)], 1, True)
    assert "".join(c.tag for c in template[0].kids) == columns
    assert sorted(c.tag for c in template[0].kids if 1 in c.cells) == sorted(filled)


def test_mining_of_a_table(spark):
    html = "<html><body><table>" + "".join(f"<tr><td>name {i}</td><td>{i}00</td></tr>" for i in range(3)) + "</table></body></html>"
    rows = mining.mine_pages(spark.createDataFrame([(1, html), (2, "<p>no"), (3, None)], "page_id long, html string")).collect()
    got = [r for r in rows if r.page_id == 1][0]
    assert got.root.endswith("/table") and got.n_records == 3 and got.error is None
    assert sorted(sorted(r.values()) for r in got.records) == [["000", "name 0"], ["100", "name 1"], ["200", "name 2"]] or [len(r) for r in got.records] == [2, 2, 2]
    nested = mining.nested({"/tr/td[1]/text": "a", "/tr/td[2]/text": "b"})
    assert nested == {"tr": {"td": {"001": {"text": "a"}, "002": {"text": "b"}}}} and mining.compact(nested) == {"001": "a", "002": "b"}


def test_mining_of_wide_roots(spark):
    """Each row of a long table is in a record; rows that alternate between two shapes make records of two rows."""
    cells = ["<td>{0}</td><td>{0}00</td>", "<td>{0}</td><td><b>{0}00</b></td>"]
    tables = [(k, "<html><body><table>" + "".join(f"<tr>{cells[i % k].format(i)}</tr>" for i in range(450)) + "</table></body></html>") for k in (1, 2)]
    mined = mining.mine_pages(spark.createDataFrame(tables, "page_id long, html string"))
    for r in mined.where("root LIKE '%/table'").collect():
        assert (r.n_records, r.error) == (450 // r.page_id, None)
        assert sorted(v for x in r.records for v in x.values()) == sorted(v for i in range(450) for v in (f"{i}", f"{i}00"))
    assert mining.structure(mined).where("root LIKE '%/table' AND size(paths) >= 2").count() == 2


def test_mining_of_deep_pages(spark):
    table = "<table>" + "".join(f"<tr><td>n{i}</td><td>{i}</td></tr>" for i in range(3)) + "</table>"
    inside = "<ul>" + "".join("<li>" + "<div>" * 1500 + f"d{i}" + "</div>" * 1500 + "</li>" for i in range(3)) + "</ul>"
    deep = [(1, "<div>" * 1500 + table + "</div>" * 1500), (2, inside)]
    rows = mining.mine_pages(spark.createDataFrame(deep, "page_id long, html string")).where("rank = 0").orderBy("page_id").collect()
    assert [(r.n_records, r.error) for r in rows] == [(3, None), (3, None)]


def test_mining_by_a_seed_and_as_paths():
    html = "<ul>" + "".join(f"<li><b>k{i}</b></li><li>v{i}</li>" for i in range(3)) + "</ul>"
    top = mining.parse(html)
    root = mining.by_path(top, "/ul")
    seed = root.kids[2:4]
    template, n = mining.template_of(root, seed)
    assert n == 3 and [t.cells[1] for t in template] == seed
    assert mining.mapping(template, top)[0] == {0: "/ul/li[1]", 1: "/ul/li[3]", 2: "/ul/li[5]"}
    other = mining.parse("<ul><li><b>a</b></li><li>b</li></ul>").kids[0].kids
    assert mining.mine(root, other) == [{"/li[1]/b/text": f"k{i}", "/li[2]/text": f"v{i}"} for i in range(3)]
    assert mining.division_by_seed(root, seed) == [[0, 1], [2, 3], [4, 5]]


def test_strict_trees():
    top = mining.parse_strict("<a class='x'><b> t  u </b><c/></a>")
    assert mining.printed(top.kids[0]) == "a\n  b\n    t u\n  c" and top.kids[0].marks == {"class": "x"}
    with pytest.raises(ValueError, match="mismatched"):
        mining.parse_strict("<a><b></a>")


def test_matches_and_clusters():
    one, two = tree("<p><a><b></b></a><c></c></p>"), tree("<p><a></a><c></c><d></d></p>")
    assert mining.simple_match(one, two) == 3 and mining.simple_match(one, one) == 4 and mining.normalized_match(one, one) == 0.25
    assert mining.clustered_match(one, one) == 1.0 and round(mining.clustered_match(one, two), 4) == round((0 + 1 / 3), 4)
    sims, kinds = mining.similarities([one, two, tree("<p><a><b></b></a><c></c></p>"), tree("<q></q>")])
    assert kinds == [0, 1, 0, 2] and mining.clusters(sims, kinds, 0.0)[0] == mining.clusters(sims, kinds, 0.0)[2]
    assert len(set(mining.clusters(sims, kinds, 100.0))) == 1


def test_interesting(spark):
    rows = spark.createDataFrame([(1, [{"a": "no 12"}]), (2, [{"a": "none"}])], "page_id long, records array<map<string,string>>")
    assert [r.page_id for r in mining.interesting(rows, r"\d").collect()] == [1]


def _learnable(spark):
    """A dataset whose labels follow several features."""
    rows = []
    for i in range(400):
        words, pages, share = (["patent"] if i % 3 == 0 else []) + ["page"], i % 17, (i % 7) / 7
        label = 1.0 if ("patent" in words and pages > 5) or (share > 0.5 and pages > 11) else 0.0
        rows.append((f"http://h/{i}", words, ["legal"] if i % 5 == 0 else [], pages, share, label))
    names = [f.name for f in classifier.features() if f.kind != "word"]
    base = spark.createDataFrame(rows, "url string, page_words array<string>, url_words array<string>, num_pages long, share_top1 double, label double")
    return base.select("*", *(F.lit(0).cast("double").alias(n) for n in names if n not in ("num_pages", "share_top1")))


def _in_duckdb(rows, sql):
    con = duckdb.connect()
    pdf = rows.toPandas()
    con.register("ClassifierDataset", pdf)
    return con.sql(sql).fetchall()


def test_models_as_sql_in_another_engine(spark):
    """The emitted SQL gives what the models predict; the tree has several levels."""
    found, rows = classifier.features(), _learnable(spark)
    training = classifier.assembled(rows, found).select("features", "label")
    model = classifier.tree(training)
    assert model.depth >= 3
    said = sorted(u for (u,) in _in_duckdb(rows, classifier.tree_sql(model, found)))
    assert said == sorted(r.url for r in classifier.predicted(model, rows, found).where("prediction = 1").collect())
    assert said == sorted(r.url for r in rows.where("label = 1").collect())
    line = classifier.regression(training)
    want = {r.url: r.prediction for r in classifier.predicted(line, rows, found).collect()}
    scored = {u: s for s, u in _in_duckdb(rows, classifier.regression_sql(line, found))}
    assert scored.keys() == want.keys() and all(abs(scored[u] - want[u]) < 1e-9 for u in want)


def test_small_functions(spark):
    from quarryline.functions import text as T

    rows = spark.createDataFrame([("0123456789", "US 1,234,567", bytearray(b"%PDF-1")), ("ab", "D1", bytearray(b"<p>"))], "c string, n string, x binary")
    got = rows.select(T.shorter_context(F.col("c"), 3, 1), T.without_office(F.col("n")), files.is_pdf("x")).collect()
    assert tuple(got[0]) == ("234567", "1234567", True) and got[1][2] is False
    words = spark.createDataFrame([("Cat",), ("zzz",)], "word string")
    known = spark.createDataFrame([("cat",)], "w string")
    assert {r.word: r.in_dictionary for r in classifier.dictionary_words(words, known).collect()} == {"Cat": True, "zzz": False}
    assert classifier.with_timeout(lambda: spark.range(5).count(), 60, spark) == 5
    with pytest.raises(Exception, match=r"(?i)cancel|interrupt"):
        classifier.with_timeout(lambda: spark.range(10**13).selectExpr("sum(id % 7)").collect(), 2, spark)
    assert files.s3_settings("a", "b") == {"spark.hadoop.fs.s3a.access.key": "a", "spark.hadoop.fs.s3a.secret.key": "b"}


def test_mining_helpers():
    assert mining.split_before([0, 1, 2, 1, 2], lambda x: x == 1) == [[0], [1, 2], [1, 2]]
    assert mining.runs_of([2, 1, 2, 4], lambda x: x % 2 == 0) == [[2], [2, 4]]
    assert mining.common_prefix([list("abcdef"), list("abc"), list("abac")]) == ["a", "b"]
    assert mining.simplified("/html/body[1]/div[12]/p") == "/html/body/div/p"


def test_candidates_natively_and_in_a_tree_agree(spark):
    pages_ = spark.read.parquet(f"{SF}/pages.parquet").limit(5)
    native = {(r.page_id, r.root): r.votes for r in mining.candidates(mining.text_nodes(pages_)).collect()}
    for r in pages_.collect():
        for root in mining.candidate_roots(mining.parse(r.html)):
            assert (r.page_id, root.path()) in native


SAME = [n for n in registry.ORACLES if n not in ("training_corpus", "prediction_candidates", "page_regexs_pivot")]


@pytest.fixture(scope="module")
def tables():
    import os

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", SAME)
def test_query_is_its_sql(spark, tables, name):
    def rows(columns, values):
        order = sorted(range(len(columns)), key=lambda i: columns[i])
        return [columns[i] for i in order], sorted(repr([round(v[i], 8) if isinstance(v[i], float) else v[i] for i in order]) for v in values)

    got = registry.QUERIES[name](spark, SF)
    want = tables.sql(registry.ORACLES[name])
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(want.columns, want.fetchall())


def test_flags_reach_the_scan(spark, tmp_path):
    rows = spark.createDataFrame([(1, "patent 1234567"), (2, "patent"), (3, "1234567"), (4, None)], "page_id int, text string")
    found = files.cached(spark, str(tmp_path / "flagged"), lambda: pages.flagged(rows))
    assert sorted((r.page_id, r.has_keyword, r.has_number) for r in found.collect()) == [(1, True, True), (2, True, False), (3, False, True), (4, False, False)]
    assert "EqualTo(has_keyword,true)" in found.where("has_keyword")._jdf.queryExecution().executedPlan().toString()
