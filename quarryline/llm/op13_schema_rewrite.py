"""Drifted schema rewrite over an external merge sort.

Sorting: every task spills a sorted run of its rows with their keys. The keys at the exact ranks where one file ends and the next begins
are found by counting keys by ever longer prefixes, only where a cut lies. Each run is cut at these keys, which gives a manifest: for
every file the slices of runs that make it up. A task for each file merges its slices through a heap of blocks and writes the file as
it goes. Rewriting: a second manifest lists the files as they are, and a task for each of them matches columns by field id, not by
name or place, and writes a file of the evolved schema beside it. Files are written under a name of the attempt and moved when
complete, old ones go when all are done, so a task may be lost or run twice at any time.

No task, and neither the driver nor a broadcast, holds more than blocks of rows or a bounded number of keys and counts.
"""

from __future__ import annotations

import hashlib
import heapq
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow.fs import FileSystem
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scan import read_table, record, shared_dir, stored

#: Files of a table, and what a file's version is drawn with.
FILES, SALT, DRAWN, VERSIONS = 250, "19:", 24, 16
#: Columns of the evolved schema; a field's id is its place from 1.
EVOLVED = (
    ("client_id", "bigint"), ("master_id", "bigint"), ("source", "string"), ("updated_at", "timestamp_ntz"), ("name", "string"),
    ("email", "string"), ("city", "string"), ("nation_id", "bigint"), ("segment", "string"), ("balance", "double"),
)
#: Bits of a version: names of two columns swapped, columns reversed, columns missing, narrower types.
SWAPPED, REVERSED, MISSING, NARROW = 1, 2, 4, 8
#: Values of columns that a file lacks, by field id.
DEFAULTS = {8: -1, 9: "none"}
#: Most runs, which is what a merge reads from at once; rows of a block; bytes of a row group in runs.
RUNS, BLOCK_ROWS, RUN_GROUP = 256, 8192, 8 << 20
RESULT = "file_no long, version long, n_rows long, n_nulls long, ids_sha256 string, rows_sha256 string, start_columns string, columns string, path string, rewritten boolean"


def hex_of(number: Column) -> Column:
    return F.lpad(F.hex(number), 16, "0")


def sort_key(rows: DataFrame) -> Column:
    """A string of 56 hexadecimal digits that sorts like (crc32 of the decimal client_id, client_id, a hash of the row, a number that no
    other row has). A null client_id counts as an empty string and sorts before all numbers."""
    crc = F.crc32(F.coalesce(F.col("client_id").cast("string"), F.lit("")))
    number = F.coalesce(F.col("client_id"), F.lit(-(1 << 63))).bitwiseXOR(F.lit(-(1 << 63)))
    return F.concat(F.lpad(F.hex(crc), 8, "0"), hex_of(number), hex_of(F.xxhash64(*rows.columns)), hex_of(F.monotonically_increasing_id()))


def spill_runs(rows: DataFrame, folder: str) -> DataFrame:
    """Writes the rows as sorted runs; rows (run: a file's name, key) of them."""
    keyed = rows.withColumn("key", sort_key(rows))
    keyed.coalesce(RUNS).sortWithinPartitions("key").write.option("parquet.block.size", RUN_GROUP).parquet(folder)
    return rows.sparkSession.read.schema("key string").parquet(folder).select(F.col("_metadata.file_name").alias("run"), "key")


def rank_cuts(runs: DataFrame, ranks: list[int]) -> list[str]:
    """The keys at some ranks (ascending, from 0). To the driver: 256 counts for each rank and step at most."""
    cuts: list[str | None] = [None] * len(ranks)
    open_ = [("", i, r) for i, r in enumerate(ranks)]  # what the key begins with, and the rank among keys that do
    digits = 0
    while open_:
        prefixes = sorted({p for p, _, _ in open_})
        among = runs.where(F.substring("key", 1, digits).isin(prefixes)) if digits else runs
        digits += 2
        found: dict[str, list] = {}
        for r in among.groupBy(F.substring("key", 1, digits).alias("head")).agg(F.count("*").alias("n"), F.min("key").alias("key")).collect():
            found.setdefault(r["head"][:-2], []).append((r["head"], r["n"], r["key"]))
        following = []
        for prefix, i, rank in open_:
            for head, n, key in sorted(found[prefix]):
                if rank < n:
                    break
                rank -= n
            if rank == 0:  # the smallest key that begins so
                cuts[i] = key
            else:
                following.append((head, i, rank))
        open_ = following
    return cuts


def slice_manifest(runs: DataFrame, cuts: list[str]) -> DataFrame:
    """Rows (file_no, slices: run, start, rows), from runs and the first keys of all files but the first."""
    edges = np.array(cuts, "S56")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            file_no = np.searchsorted(edges, batch.column(1).to_numpy(zero_copy_only=False).astype("S56"), "right")
            for run in batch.column(0).unique():
                own = file_no[pc.equal(batch.column(0), run).to_numpy(zero_copy_only=False)]
                files, rows = np.unique(own, return_counts=True)
                yield record(run=pa.array([run.as_py()] * len(files), pa.string()), file_no=files.astype(np.int64), rows=rows.astype(np.int64))

    parts = runs.mapInArrow(count, "run string, file_no long, rows long").groupBy("run", "file_no").agg(F.sum("rows").alias("rows"))
    before = Window.partitionBy("run").orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("start", F.coalesce(F.sum("rows").over(before), F.lit(0)))
    return parts.groupBy("file_no").agg(F.array_sort(F.collect_list(F.struct("run", "start", "rows"))).alias("slices"))


def version_of(file_no: Column, salt: str = SALT) -> Column:
    drawn = F.crc32(F.concat(F.lit(salt), file_no.cast("string"))) % DRAWN
    return F.when(drawn < VERSIONS, drawn).otherwise(0)


ARROW = {"bigint": pa.int64(), "string": pa.string(), "timestamp_ntz": pa.timestamp("us"), "double": pa.float64()}


def fields(version: int) -> list[tuple[int, str, pa.DataType]]:
    """Field id, name and type of the columns of a file of some version, in its order."""
    found = [(i, name, ARROW[kind]) for i, (name, kind) in enumerate(EVOLVED, 1)]
    if version & MISSING:
        found = [f for f in found if f[0] not in DEFAULTS]
    if version & NARROW:
        narrow = {8: pa.int32(), 10: pa.float32()}
        found = [(i, name, narrow.get(i, kind)) for i, name, kind in found]
    if version & SWAPPED:
        other = {"name": "email", "email": "name"}
        found = [(i, other.get(name, name), kind) for i, name, kind in found]
    return found[:1] + found[:0:-1] if version & REVERSED else found


def schema_of(version: int) -> pa.Schema:
    return pa.schema([pa.field(name, kind, True, {b"PARQUET:field_id": str(i).encode()}) for i, name, kind in fields(version)])


def shaped(by_id: dict[int, pa.Array], version: int, n: int) -> pa.RecordBatch:
    """Columns by field id in the schema of a version: missing ones with their default, types cast (doubles may lose digits)."""
    columns = [by_id[i].cast(kind, safe=kind != pa.float32()) if i in by_id else pa.repeat(pa.scalar(DEFAULTS[i], kind), n) for i, _, kind in fields(version)]
    return pa.RecordBatch.from_arrays(columns, schema=schema_of(version))


def write_file(path: str, aside: str, version: int, batches: Iterator[pa.RecordBatch]) -> None:
    """Writes a whole file under a name of its own in another folder and moves it to its place."""
    system, place = FileSystem.from_uri(path)
    attempt = f"{FileSystem.from_uri(aside)[1]}/{uuid.uuid4().hex}"
    system.create_dir(attempt.rpartition("/")[0])
    system.create_dir(place.rpartition("/")[0])
    with system.open_output_stream(attempt) as out, pq.ParquetWriter(out, schema_of(version), compression="snappy") as writer:
        for batch in batches:
            writer.write_batch(batch)
    system.move(attempt, place)


class Slice:
    """A slice of a run, block by block: ``keys`` and ``rows`` of the block at hand."""

    def __init__(self, path: str, start: int, rows: int):
        system, place = FileSystem.from_uri(path)
        self.file = pq.ParquetFile(system.open_input_file(place), pre_buffer=False, buffer_size=1 << 16)
        sizes = [self.file.metadata.row_group(g).num_rows for g in range(self.file.metadata.num_row_groups)]
        ends = np.cumsum(sizes)
        first, last = np.searchsorted(ends, [start, start + rows - 1], "right")
        self.skip, self.left = start - int(ends[first] - sizes[first]), rows
        self.blocks = self.file.iter_batches(BLOCK_ROWS, row_groups=list(range(first, last + 1)))

    def advance(self) -> bool:
        while self.left:
            block = next(self.blocks)
            over = min(self.skip, block.num_rows)
            self.skip -= over
            self.rows = block.slice(over, self.left)
            self.left -= self.rows.num_rows
            if self.rows.num_rows:
                self.keys = self.rows.column(self.rows.schema.get_field_index("key")).to_numpy(zero_copy_only=False).astype("S56")
                return True
        self.file.close()
        return False


def merged(slices: list[Slice]) -> Iterator[pa.RecordBatch]:
    """The rows of some slices in the order of their keys. A heap has the last key of every slice's block: all rows up to the smallest
    of these are at hand."""
    slices = [s for s in slices if s.advance()]
    heap = [(s.keys[-1], k) for k, s in enumerate(slices)]
    heapq.heapify(heap)
    alive = dict(enumerate(slices))
    while heap:
        bound, k = heapq.heappop(heap)
        rows, keys = [], []
        for s in alive.values():
            n = int(np.searchsorted(s.keys, bound, "right"))
            if n:
                rows.append(s.rows.slice(0, n))
                keys.append(s.keys[:n])
                s.rows, s.keys = s.rows.slice(n), s.keys[n:]
        table = pa.Table.from_batches(rows).take(pa.array(np.argsort(np.concatenate(keys), kind="stable")))
        yield table.combine_chunks().to_batches()[0]
        if alive[k].advance():
            heapq.heappush(heap, (alive[k].keys[-1], k))
        else:
            del alive[k]


def write_start_files(manifest: DataFrame, runs: str, table: str, aside: str, files: int) -> DataFrame:
    """Rows (file_no, version, path) of the files that are merged from the slices of the manifest (file_no, version, slices)."""
    names = [name for name, _ in EVOLVED]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file_no, version, slices in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                path = f"{table}/file-{file_no:05d}-0.parquet"
                blocks = merged([Slice(f"{runs}/{s['run']}", s["start"], s["rows"]) for s in slices])
                write_file(path, aside, version, (shaped({i: b.column(b.schema.get_field_index(n)) for i, n in enumerate(names, 1)}, version, b.num_rows) for b in blocks))
                yield record(file_no=[file_no], version=[version], path=[path])

    return manifest.select("file_no", "version", "slices").repartitionById(files, F.col("file_no").cast("int")).mapInArrow(run, "file_no long, version long, path string")


def as_texts(batch: pa.RecordBatch) -> pa.Array:
    """Each row as a text: fields joined by |, nulls as ?, times in microseconds, balances as floor(2^20 x)."""
    out = []
    for (_, kind), column in zip(EVOLVED, batch.columns, strict=True):
        if kind == "double":
            scaled = pc.floor(pc.multiply(column, float(1 << 20)))
            if pc.all(pc.less(pc.abs(scaled), float(1 << 62))).as_py() is False:
                column = pa.array([None if x is None else str(int(x)) if np.isfinite(x) else str(x) for x in scaled.to_pylist()], pa.string())
            else:
                column = scaled.cast(pa.int64())
        elif kind == "timestamp_ntz":
            column = column.cast(pa.int64())
        out.append(column.cast(pa.string()))
    return pc.binary_join_element_wise(*out, "|", null_handling="replace", null_replacement="?")


class Digest:
    """Sums up the batches of a file."""

    def __init__(self):
        self.rows = self.nulls = 0
        self.ids, self.lines = hashlib.sha256(), hashlib.sha256()

    def add(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = pc.fill_null(batch.column(0).cast(pa.string()), "?")
        for digest, texts, mark in ((self.ids, ids, ","), (self.lines, as_texts(batch), "\n")):
            whole = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), texts), mark)
            digest.update((mark if self.rows else "").encode())
            digest.update(whole[0].as_buffer())
        self.rows += batch.num_rows
        self.nulls += sum(c.null_count for c in batch.columns)
        return batch


def rewrite_files(manifest: DataFrame, aside: str, files: int) -> DataFrame:
    """Brings the files of a manifest (file_no, version, path) to the evolved schema; a row of RESULT for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file_no, version, path in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                system, place = FileSystem.from_uri(path)
                with system.open_input_file(place) as source:
                    file = pq.ParquetFile(source, pre_buffer=False, buffer_size=1 << 16)
                    ids = [int(f.metadata[b"PARQUET:field_id"]) for f in file.schema_arrow]
                    digest = Digest()
                    blocks = (digest.add(shaped(dict(zip(ids, b.columns, strict=True)), 0, b.num_rows)) for b in file.iter_batches(BLOCK_ROWS))
                    evolved = file.schema_arrow.equals(schema_of(0), check_metadata=True)
                    if evolved:
                        for _ in blocks:
                            pass
                    else:
                        path = path.replace("-0.parquet", "-1.parquet")
                        write_file(path, aside, 0, blocks)
                    start = ",".join(file.schema_arrow.names)
                yield record(
                    file_no=[file_no], version=[version], n_rows=[digest.rows], n_nulls=[digest.nulls], ids_sha256=[digest.ids.hexdigest()], rows_sha256=[digest.lines.hexdigest()],
                    start_columns=[start], columns=[",".join(schema_of(0).names)], path=[path], rewritten=[not evolved],
                )

    return manifest.select("file_no", "version", "path").repartitionById(files, F.col("file_no").cast("int")).mapInArrow(run, RESULT)


def starting_files(clients: DataFrame, folder: str, files: int = FILES, salt: str = SALT) -> DataFrame:
    """Sorts ``clients`` and writes them to ``folder``/table as about ``files`` files of equal size and drifting schemas. Rows (file_no,
    version, path), none for an empty table."""
    spark = clients.sparkSession
    rows = clients.select(*(F.col(name).cast(kind).alias(name) for name, kind in EVOLVED))
    runs = spill_runs(rows, f"{folder}/runs")
    n = runs.count()
    if not n:
        return spark.createDataFrame([], "file_no long, version long, path string")
    size = 1 + n // files
    cuts = rank_cuts(runs, list(range(size, n, size)))
    manifest = stored(slice_manifest(runs, cuts).withColumn("version", version_of(F.col("file_no"), salt)), "slices")
    return stored(write_start_files(manifest, f"{folder}/runs", f"{folder}/table", f"{folder}/aside", len(cuts) + 1), "start")


def rewritten(start: DataFrame, folder: str, files: int = FILES) -> DataFrame:
    """Brings the starting files to the evolved schema in ``folder``/table, which has the final files and nothing else then. A row of
    RESULT for each. ``files``: their number, about; paths of so many files go to the driver."""
    spark = start.sparkSession
    result = stored(rewrite_files(start, f"{folder}/aside", files), "result")
    # All results are written: files of the old schema go, and what lost attempts may have left.
    keep = {r["path"].rpartition("/")[2] for r in result.select("path").collect()}
    of = spark._jvm.org.apache.hadoop.fs.Path
    system = of(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    if keep:
        for status in system.listStatus(of(f"{folder}/table")):
            if status.getPath().getName() not in keep:
                system.delete(status.getPath(), True)
    for spent in ("runs", "aside"):
        system.delete(of(f"{folder}/{spent}"), True)
    return result


def drifted_rewrite(clients: DataFrame, files: int = FILES, salt: str = SALT) -> DataFrame:
    """Both steps in a new folder under spark.checkpoint.dir, which stays.

    Rows that repeat a client_id are in the order of a hash of all values; a null client_id sorts by the crc32 of an empty text. Nulls
    stay null; balances that are no finite numbers are written as they are and called ``nan``, ``inf`` or ``-inf`` in ``rows_sha256``.
    More columns of ``clients`` are left out. An empty table gives no files and an empty result.
    """
    folder = shared_dir(clients.sparkSession)
    return rewritten(starting_files(clients, folder, files, salt), folder, files)


def op13_schema_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drifted_rewrite(read_table(spark, sf_dir, "clients"))
