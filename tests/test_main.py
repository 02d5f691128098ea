"""The jobs of the command line on a small archive."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from quarryline.__main__ import main
from quarryline.functions import text as T
from quarryline.operators import classifier
from quarryline.sources import files, warc

HEADER = "HTTP/1.1 200 OK\r\nContent-Type: text/html"
PAGES = {
    "http://a.com/one.html": "<p>Protected by patent No. 5,123,456 and 6,123,456</p>",
    "http://b.com/two": "<p>no number of a patent here</p>",
    "http://www.google.com/x": "<p>patent 5,123,456</p>",
    "http://c.org/pdf": "%PDF patent 7,654,321",
}


@pytest.fixture
def archive(spark, tmp_path):
    path = str(tmp_path / "archive")
    rows = [(u, HEADER, bytearray(h.encode())) for u, h in PAGES.items()]
    warc.register(spark).createDataFrame(rows, "url string, http_header string, content binary").coalesce(1).write.format("warc").mode("append").save(path)
    return path


def test_extract_and_filter(spark, tmp_path, archive):
    main(["extract", "--in", archive, "--out", str(tmp_path / "lines")])
    lines = sorted(r.value for r in spark.read.text(str(tmp_path / "lines")).collect())
    assert [x.split("\t")[0] for x in lines] == sorted(u for u in PAGES if u != "http://b.com/two") and lines[0].split("\t")[1:] == ["patent No. 5,123,456", "6,123,456"]
    main(["filter", "--in", archive, "--out", str(tmp_path / "kept")])
    kept = spark.read.format("warc").load(str(tmp_path / "kept"))
    assert sorted((r.url, r.content.decode()) for r in kept.collect()) == sorted((u, PAGES[u]) for u in ("http://a.com/one.html", "http://c.org/pdf"))
    (tmp_path / "hosts").write_text("a\\.com\n")
    main(["filter", "--in", archive, "--out", str(tmp_path / "kept"), "--discarded", str(tmp_path / "hosts")])
    assert sorted(r.url for r in spark.read.format("warc").load(str(tmp_path / "kept")).collect()) == ["http://c.org/pdf", "http://www.google.com/x"]


def test_pages(spark, tmp_path, archive):
    main(["pages", "--in", archive, "--out", str(tmp_path / "t"), "--text-regex", "(?i)no\\."])
    table = {n: spark.read.parquet(str(tmp_path / "t" / n)) for n in ("pages", "page_patents", "page_regexs")}
    assert sorted((r.domain, r.num_patents) for r in table["pages"].collect()) == [("a.com", 2), ("c.org", 1)]
    assert table["page_patents"].join(table["pages"], "page_id").count() == 3
    assert [r.num_matches for r in table["page_regexs"].where("regex = '(?i)no\\\\.' AND domain = 'a.com'").collect()] == [1]
    with pytest.raises(SystemExit):
        main(["extract", "--in", archive])


def test_export(spark, tmp_path, archive):
    out = tmp_path / "files"
    main(["export", "--in", archive, "--out", str(out)])
    assert {os.path.basename(f): open(f).read() for f in glob.glob(f"{out}/*")} == {u.replace("/", "\\") + (".pdf" if "pdf" in u else ".html"): h for u, h in PAGES.items()}
    main(["export", "--in", archive, "--out", str(tmp_path / "some"), "--every", "3"])
    assert len(os.listdir(tmp_path / "some")) == 2
    rows = spark.createDataFrame([("http://x/" + "y" * 300, bytearray(b"1")), ("http://x/z", None), (None, bytearray(b"2"))], "url string, content binary")
    got = {len(r.url): r.error for r in files.write_pages(rows, str(tmp_path / "long")).collect()}
    assert got[10] is None and "too long" in got[309] and os.listdir(tmp_path / "long") == ["http:\\\\x\\z.html"]


def test_words_of_padded_texts(spark):
    rows = spark.createDataFrame([(["a", "patent"], "http://x/Patents"), ([], "http://x/a")], "w array<string>, url string")
    padded = rows.select("url", T.padded(F.col("w")).alias("distinct_words_text"))
    assert [r.w for r in padded.select(T.split_words(F.col("distinct_words_text")).alias("w")).collect()] == [["a", "patent"], []]
    found = {f.name: f for f in classifier.features(("patent",), located=True)}
    both = padded.select(*(F.expr(found[f"{where}_word_patent"].condition(False, 0.5)) for where in ("page", "url")))
    assert [tuple(r) for r in both.collect()] == [(True, True), (False, False)]
