"""Archives read in ranges and from any file system, the sorted index, ordered files, databases."""

import gzip
import os
import random
import zlib

import pytest
from pyspark.sql import functions as F

from quarryline.sources import files, warc


def member(url, body, level=6):
    head = f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: {url}\r\nWARC-Date: 2024-01-02T03:04:05Z\r\nContent-Length: {len(body)}\r\n\r\n".encode()
    gz = zlib.compressobj(level, zlib.DEFLATED, 31)
    return gz.compress(head + body + b"\r\n\r\n") + gz.flush()


@pytest.fixture
def archive(tmp_path):
    """Members of all sizes; some hold, stored as it is, what looks like another archive's member."""
    r = random.Random(1)
    trap = member("http://trap/", b"x")
    bodies = [b"HTTP/1.1 200 OK\r\n\r\n" + (r.randbytes(r.randint(0, 3000)) + trap + r.randbytes(50) if i % 5 == 0 else b"text " * r.randint(0, 400)) for i in range(60)]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(member(f"http://h/{i}", b, 0 if i % 5 == 0 else 6) for i, b in enumerate(bodies)))
    return str(tmp_path / "a.warc.gz"), [(f"http://h/{i}", b.partition(b"\r\n\r\n")[2]) for i, b in enumerate(bodies)]


def rows(df):
    return sorted((r.url, bytes(r.content)) for r in df.collect())


def test_one_archive_in_ranges(spark, archive):
    """Each record once, wherever the ranges begin."""
    path, want = archive
    warc.register(spark)
    whole = spark.read.format("warc").load(path)
    assert rows(whole) == sorted(want) and whole.rdd.getNumPartitions() == 1
    places = sorted((r.url, r.offset) for r in whole.collect())
    for split in (257, 1000, 30_000):
        found = spark.read.format("warc").option("split", str(split)).load(path)
        assert rows(found) == sorted(want) and sorted((r.url, r.offset) for r in found.collect()) == places
    assert spark.read.format("warc").option("split", "1000").load(path).rdd.getNumPartitions() == -(-os.path.getsize(path) // 1000)


def test_torn_archives_in_ranges(spark, archive, tmp_path):
    path, want = archive
    with open(path, "rb") as f:
        data = f.read()
    cut = str(tmp_path / "cut.warc.gz")
    with open(cut, "wb") as f:
        f.write(data[: len(data) - 40])
    warc.register(spark)
    for split in (700, 1 << 20):
        found = spark.read.format("warc").option("split", str(split)).load(cut)
        assert found.where("warc_type = 'torn'").count() == 1 and found.where("warc_type = 'response'").count() == len(want) - 1


def test_paths_of_file_systems(spark, archive):
    """Paths with a scheme, folders and globs; what is being written isn't read."""
    path, want = archive
    folder = os.path.dirname(path)
    with open(f"{folder}/_tmp_x.warc.gz", "wb") as f:
        f.write(member("http://unfinished/", b""))
    with open(f"{folder}/b.warc", "wb") as f:
        f.write(gzip.decompress(member("http://plain/", b"HTTP/1.1 200 OK\r\n\r\np")))
    warc.register(spark)
    both = sorted([*want, ("http://plain/", b"p")])
    assert rows(spark.read.format("warc").load(f"file://{folder}")) == both == rows(spark.read.format("warc").load(folder))
    assert rows(spark.read.format("warc").load(f"{folder}/b*")) == [("http://plain/", b"p")]
    assert rows(warc.records(spark, f"file://{folder}/b.warc")) == [("http://plain/", b"p")]


def test_content_that_is_not_there(spark, archive):
    path, want = archive
    warc.register(spark)
    one = next(r for r in spark.read.format("warc").load(path).collect() if r.url == "http://h/7")
    index = spark.createDataFrame([("a", path, one.offset, 0), ("b", path + ".gone", 0, 0), ("c", path, None, 0), ("d", None, 1, 0), ("e", path, 10**9, 0), ("f", path, 3, 0)], "url_key string, file string, offset long, within long")
    found = {r.url_key: r.content for r in warc.content_of(index).collect()}
    assert bytes(found.pop("a")) == dict(want)["http://h/7"] and set(found.values()) == {None}
    joined = {r.url_key: r.content for r in warc.content_of(index, spark.read.format("warc").load(path)).collect()}
    assert bytes(joined.pop("a")) == dict(want)["http://h/7"] and set(joined.values()) == {None}


def test_attempts_leave_one_copy(tmp_path):
    """Of two attempts of a task only the one that counts stays; other jobs' attempts aren't touched."""
    writer, other = warc.Writer(f"file://{tmp_path}/out", False), warc.Writer(f"file://{tmp_path}/out", False)
    row = {"url": "http://u", "http_header": None, "content": b"c"}
    lost, counts, running = writer.write(iter([row])), writer.write(iter([row])), other.write(iter([row]))
    writer.commit([counts, writer.write(iter([])), None])
    assert sorted(os.listdir(tmp_path / "out")) == sorted([f"files_{counts.name}.warc.gz", f"_tmp_{other.job}_{running.name}.warc.gz"]) and lost.name
    other.abort([running])
    again = warc.Writer(str(tmp_path / "out"), True)
    again.commit([again.write(iter([row]))])
    assert len(os.listdir(tmp_path / "out")) == 1


def test_lookups_read_what_may_match(spark, tmp_path):
    """A lookup in a sorted index pushes its filter and leaves out what can't have the key, whatever the size of the index."""
    read = []
    for n in (2_000, 20_000):
        path = str(tmp_path / f"index{n}")
        rows_ = spark.range(n).select(F.format_string("h%06d.com/p", "id").alias("url_key"), F.lit("20240101").alias("timestamp"), F.lit("u").alias("url"), F.lit(200).alias("http_status"), F.lit("f").alias("file"), F.col("id").alias("offset"))
        warc.write_index(rows_.orderBy(F.rand(1)).repartition(4), path)
        assert warc.by_url(warc.read_index(spark, path), "http://h001234.com/p").count() == 1
        found = warc.by_prefix(warc.read_index(spark, path), "http://h00123")
        assert found.count() == 10
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "StringStartsWith(url_key,h00123)" in plan
        touched = found.select(F.col("_metadata.file_name")).distinct().count()
        read.append(touched)
    assert read == [1, 1]


def test_order_is_that_of_the_files(spark, tmp_path):
    rows_ = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("a"), (F.col("id") % 3).alias("b"), F.lit("x").alias("part"))
    files.write_ordered(rows_.repartition(5), str(tmp_path / "o"), F.desc("b"), F.col("a"))
    found = files.read_ordered(spark, str(tmp_path / "o")).orderBy("position").collect()
    assert [r.position for r in found] == list(range(1, 1001))
    assert [(r.b, r.a) for r in found] == sorted(((r.b, r.a) for r in found), key=lambda t: (-t[0], t[1]))


def test_tables_of_a_database(spark, tmp_path):
    """Written by tasks, read again in parts; a new table takes the old one's place only when it is whole."""
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    driver = {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    rows_ = spark.range(500).select(F.col("id").alias("N"), F.concat(F.lit("v"), "id").alias("V"))
    files.to_database(rows_.repartition(3), url, "PAGES", create=True, **driver)
    files.to_database(rows_.where("N < 10"), url, "PAGES", **driver)
    read = lambda **options: files.table_from_database(spark, url, "PAGES", **driver, **options)
    parts = read(partitionColumn="N", lowerBound="0", upperBound="500", numPartitions="4")
    assert parts.rdd.getNumPartitions() == 4 and parts.count() == 510
    assert sorted(map(tuple, parts.distinct().collect())) == sorted(map(tuple, rows_.collect()))
    files.to_database(rows_.where("N >= 490"), url, "PAGES", create=True, **driver)
    assert read().count() == 10
    broken = rows_.withColumn("V", F.when(F.col("N") == 7, F.raise_error(F.lit("broken"))).otherwise(F.col("V")))
    with pytest.raises(Exception, match="broken"):
        files.to_database(broken, url, "PAGES", create=True, **driver)
    assert read().count() == 10


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"
        _jsc = spark.sparkContext._jsc

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda name, default=None: default)

    assert files.shared_folder(spark) != files.shared_folder(spark)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        with pytest.raises(ValueError, match="checkpoint"):
            files.shared_folder(Session())


def test_long_work_is_dealt_out_by_size(spark, tmp_path, monkeypatch):
    """One row group is one task, however large; what takes long for its bytes is dealt out in parts of a bounded size."""
    spark.range(4000).select("id", F.sha2(F.col("id").cast("string"), 512).alias("html")).coalesce(1).write.parquet(str(tmp_path / "p"))
    rows = spark.read.parquet(str(tmp_path / "p"))
    monkeypatch.setattr(files, "SPREAD_BYTES", 20_000)
    parts = files.spread_out(rows).rdd.glom().map(len).collect()
    assert len(parts) > 8 and sum(parts) == 4000 and max(parts) < 1000
    assert files.spread_out(spark.createDataFrame([(1,)], "a long")).rdd.getNumPartitions() <= 8  # of unknown size


def test_records_are_handed_on_in_slices(archive, tmp_path):
    """A task holds some records only, however many its range has."""
    path = str(tmp_path / "many.warc.gz")
    with open(path, "wb") as f:
        f.write(b"".join(member(f"http://h/{i}", b"HTTP/1.1 200 OK\r\n\r\n" + bytes([i]) * 1_000_000) for i in range(20)))
    reader = warc.Reader(path, 64 << 20)
    batches = [b for part in reader.partitions() for b in reader.read(part)]
    assert max(b.num_rows for b in batches) <= 5 and [u for b in batches for u in b.column("url").to_pylist()] == [f"http://h/{i}" for i in range(20)]
    small, want = archive
    reader = warc.Reader(small, 64 << 20)
    assert [(r["url"], r["content"]) for b in reader.read(reader.partitions()[0]) for r in b.to_pylist()] == want
