"""Source divergence audit with deduplicated count columns.

For each language, how far the term shares of a source are from those of every other source, and which terms a source has more of than
its language. A term's column is the sparse vector of its counts by source. Very many terms share a column (rare ones above all), so
terms are grouped by column, every pair of sources is evaluated once for each distinct column, times the number of its terms. Ranked
terms are the original ones.

Sources of a language are numbered within tiles of a bounded size, so that a column is cut into parts of bounded length and no task
holds more than the columns of two tiles. A source without a term has the share of count 0 there; what that adds to a pair's sum is
known in one step for all terms, so only parts that aren't empty travel.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scan import Scratch, Texts, read_table, record, slices

#: Documents of the language that a term must be in, and terms in a group's ranking.
LEAST_DOCS, TERMS = 30, 50
#: Sources of a tile, about, and distinct columns of a block.
TILE, BLOCK = 256, 2048
#: Counts that a task gathers before it hands them on.
GATHER = 1 << 19
#: A share is a part of so many, after this number is added to each count.
SCALE, ADDED = 1_000_000_000, 5


def folded(data: np.ndarray) -> np.ndarray:
    """Bytes of terms, A-Z lower-cased; all others are spaces."""
    table = np.arange(256, dtype=np.uint8)
    table[0x41:0x5B] += 32
    table[:0x41] = table[0x5B:0x61] = table[0x7B:0x80] = 32
    return table[data]


def terms_of(texts: Texts) -> tuple[pa.Array, np.ndarray]:
    """The terms of all rows, one after the other, and the number of them before each row."""
    texts = Texts(folded(texts.data), texts.offsets)
    starts, ends, ptr = texts.words()
    ink = texts.data[texts.data != 32]
    offsets = np.concatenate(([0], np.cumsum(ends - starts)))
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(ink)), ptr


def counted(docs: DataFrame) -> DataFrame:
    """Rows (lang, source, term, n, docs): occurrences and documents, summed over some documents; a row without term for each group."""
    columns = ["lang", "source", "term"]

    def count(part: pa.RecordBatch, texts: Texts) -> pa.Table:
        terms, ptr = terms_of(texts)
        coded = terms.dictionary_encode()
        codes, values = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
        lang, source = (part.column(i).dictionary_encode() for i in (1, 2))
        wide = len(source.dictionary)
        group = lang.indices.to_numpy(zero_copy_only=False).astype(np.int64) * wide + source.indices.to_numpy(zero_copy_only=False)
        size = max(1, len(values))
        pairs, n = np.unique(np.repeat(np.arange(texts.n), np.diff(ptr)) * size + codes, return_counts=True)
        key, at = np.unique(group[pairs // size] * size + pairs % size, return_inverse=True)
        sums = np.bincount(at, n, len(key)).astype(np.int64), np.bincount(at, minlength=len(key))
        groups = np.unique(group)
        none = np.zeros(len(groups), np.int64)
        names = np.concatenate((key // size, groups))
        term = pa.concat_arrays([values.take(pa.array(key % size)), pa.nulls(len(groups), pa.large_string())])
        lang, source = lang.dictionary.take(pa.array(names // wide)), source.dictionary.take(pa.array(names % wide))
        return pa.table([lang.cast(pa.large_string()), source.cast(pa.large_string()), term, np.concatenate((sums[0], none)), np.concatenate((sums[1], none))], [*columns, "n", "docs"])

    def merged(tables: list[pa.Table]) -> pa.Table:
        return pa.concat_tables(tables).group_by(columns).aggregate([("n", "sum"), ("docs", "sum")]).select([*columns, "n_sum", "docs_sum"]).rename_columns([*columns, "n", "docs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for part, texts in slices(batch):
                held.append(count(part, texts))
                size += held[-1].num_rows
                if size > GATHER:
                    held = [merged(held)]
                    size = held[0].num_rows
                    if size > GATHER // 2:
                        yield from held.pop().to_batches(max_chunksize=1 << 16)
                        size = 0
        if held:
            yield from merged(held).to_batches(max_chunksize=1 << 16)

    return docs.mapInArrow(run, "lang string, source string, term string, n long, docs long")


def share(n: np.ndarray, total: np.ndarray | int) -> np.ndarray:
    """1 + floor(SCALE * (n + ADDED) / total), exactly."""
    if n.max(initial=0) >= (1 << 62) // SCALE:
        n = n.astype(object)
    return (1 + SCALE * (n + ADDED) // total).astype(np.int64)


def sums_of_pairs(blocks: DataFrame) -> DataFrame:
    """Partial sums (lang, one, other, value) from rows (lang, i, j, columns, names and sizes of both tiles, kinds)."""

    def dense(column: pa.ListArray, base: np.ndarray, sizes: np.ndarray, kinds: int) -> np.ndarray:
        out = np.repeat(base[None, :], len(column), 0)
        offsets = column.offsets.to_numpy()
        cells = column.values.slice(offsets[0], offsets[-1] - offsets[0])
        # A null list has no cells.
        row, spot, n = np.repeat(np.arange(len(column)), np.diff(offsets)), cells.field(0).to_numpy(), cells.field(1).to_numpy()
        out[row, spot] = share(n, sizes[spot] + ADDED * kinds)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            get = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            for r in range(batch.num_rows):
                kinds, same = get["kinds"][r].as_py(), get["i"][r].as_py() == get["j"][r].as_py()
                names, sizes = ([get[f"{c}_{s}"][r].values for s in "ij"] for c in ("names", "sizes"))
                sizes = [s.to_numpy() for s in sizes]
                if not kinds:
                    total = np.zeros((len(sizes[0]), len(sizes[1])), np.int64)
                else:
                    base = [share(np.zeros(len(s), np.int64), s + ADDED * kinds) for s in sizes]
                    apart = np.abs(base[0][:, None] - base[1][None, :])
                    columns = get["columns"][r].values
                    if columns is None or not len(columns):  # what count 0 adds for all terms
                        total = kinds * apart
                    else:
                        left, right = (dense(columns.field(k), base[k], sizes[k], kinds) for k in (0, 1))
                        right = left if same else right
                        times = columns.field(2).to_numpy()
                        total = np.stack([times @ np.abs(left[:, a : a + 1] - right) for a in range(left.shape[1])]) - times.sum() * apart
                one, other = np.triu_indices(len(sizes[0]), 1) if same else np.indices(total.shape).reshape(2, -1)
                yield record(lang=pa.array([get["lang"][r].as_py()] * len(one), pa.string()), one=names[0].take(pa.array(one)), other=names[1].take(pa.array(other)), value=total[one, other])

    return blocks.mapInArrow(run, "lang string, one string, other string, value long")


def divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, terms: int = TERMS, tile: int = TILE, block: int = BLOCK) -> DataFrame:
    """Rows (lang, source, part, item, value, rank) from ``docs`` (text, lang, source).

    Part ``pair``: item is another source of the language, value the sum of differences of their shares over all kept terms. Part
    ``term``: item is a term that the source has, with a larger share than the language, value the difference; the first ``terms``
    only. Kept are terms in ``least_docs`` documents of the language at least. A share is 1 + floor(10^9 (count + 5) / (N + 5 V)) of
    the group's N kept occurrences and the language's V kept terms. Larger values rank first, equal ones by item.

    Null text, lang and source count as ''. Groups without terms take part; a language without kept terms has value 0 for its pairs,
    one with a single source no pairs. Repeated rows count as often as they occur. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    texts = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")))
    counts = scratch.store(counted(texts).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "counts")
    kept = counts.where("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("all_n")).where(F.col("docs") >= least_docs).drop("docs")
    kept = scratch.store(counts.drop("docs").join(kept, ["lang", "term"]), "kept")
    langs = kept.groupBy("lang", "term").agg(F.max("all_n").alias("n")).groupBy("lang").agg(F.count("*").alias("kinds"), F.sum("n").alias("lang_n"))
    groups = counts.where("term IS NULL").select("lang", "source")
    tiles = groups.groupBy("lang").agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles"))
    groups = groups.join(kept.groupBy("lang", "source").agg(F.sum("n").alias("size")), ["lang", "source"], "left").join(tiles, "lang").join(langs, "lang", "left")
    groups = groups.na.fill(0, ["size", "kinds", "lang_n"]).withColumn("tile", F.pmod(F.xxhash64("source"), F.col("tiles")).cast("int"))
    groups = scratch.store(groups.withColumn("spot", F.row_number().over(Window.partitionBy("lang", "tile").orderBy("source")) - 1), "groups")

    counts = kept.join(groups, ["lang", "source"])
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    of = lambda n, size: F.expr(f"1 + (CAST({n} + {ADDED} AS DECIMAL(20, 0)) * {SCALE}) div CAST({size} + {ADDED} * kinds AS DECIMAL(20, 0))")
    over = counts.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (of("n", "size") - of("all_n", "lang_n")).alias("value")).where("value > 0")
    over = over.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= terms)

    # A term's column in each tile, then in each pair of tiles of which one has it at least.
    column = F.array_sort(F.collect_list(F.struct("spot", "n"))).alias("cells")
    parts = counts.groupBy("lang", "term", "tile").agg(column, F.max("tiles").alias("tiles")).withColumn("with", F.explode(F.expr("sequence(0, tiles - 1)")))
    parts = parts.select("lang", "term", F.least("tile", "with").alias("i"), F.greatest("tile", "with").alias("j"), "tile", "cells")
    sides = [F.max(F.when(F.col("tile") == F.col(c), F.col("cells"))).alias(s) for c, s in (("i", "left"), ("j", "right"))]
    columns = parts.groupBy("lang", "term", "i", "j").agg(*sides)
    columns = scratch.store(columns.groupBy("lang", "i", "j", "left", "right").agg(F.count("*").alias("times")), "columns")
    blocks = columns.groupBy("lang", "i", "j").agg(F.ceil(F.count("*") / block).alias("blocks"))
    blocks = columns.join(blocks, ["lang", "i", "j"]).withColumn("block", F.pmod(F.xxhash64("left", "right"), F.col("blocks")))
    blocks = blocks.repartition("lang", "i", "j", "block").groupBy("lang", "i", "j", "block").agg(F.collect_list(F.struct("left", "right", "times")).alias("columns")).drop("block")
    tiled = F.transform(F.array_sort(F.collect_list(F.struct("spot", "source", "size"))), lambda x: x.dropFields("spot"))
    tiled = groups.groupBy("lang", "tile").agg(tiled.alias("t"), F.max("kinds").alias("kinds"), F.max("tiles").alias("tiles")).select("lang", "tile", F.col("t.source").alias("names"), F.col("t.size").alias("sizes"), "kinds", "tiles")
    tiled = scratch.store(tiled, "tiled")
    # Each pair of tiles once for what count 0 adds, and once for each block of columns.
    every = tiled.select("lang", F.col("tile").alias("i"), F.explode(F.expr("sequence(tile, tiles - 1)")).alias("j"), F.lit(None).cast(blocks.schema["columns"].dataType).alias("columns"))
    blocks = blocks.select("lang", "i", "j", "columns").union(every)
    for side in "ij":
        own = tiled.select("lang", F.col("tile").alias(side), *(F.col(c).alias(f"{c}_{side}") for c in ("names", "sizes")), *(["kinds"] if side == "i" else []))
        blocks = blocks.join(own, ["lang", side])
    sums = sums_of_pairs(blocks).groupBy("lang", "one", "other").agg(F.sum("value").alias("value"))
    ways = F.explode(F.array(F.struct(F.col("one").alias("source"), F.col("other").alias("item")), F.struct(F.col("other").alias("source"), F.col("one").alias("item")))).alias("way")
    pairs = sums.select("lang", ways, "value").select("lang", "way.source", F.lit("pair").alias("part"), "way.item", "value").withColumn("rank", F.row_number().over(ranked))
    scratch.clear("kept", "groups", "columns", "tiled")
    return pairs.union(over.select(*pairs.columns))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(read_table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
t AS (SELECT r, lang, source, unnest(terms) AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS docs FROM t GROUP BY ALL),
k AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL HAVING sum(docs) >= 30),
v AS (SELECT lang, count(*) AS v, sum(n) AS n FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
s AS (SELECT g.lang, g.source, coalesce(sum(c.n) FILTER (WHERE k.term IS NOT NULL), 0) AS n FROM g LEFT JOIN c ON c.lang = g.lang AND c.source = g.source LEFT JOIN k ON k.lang = c.lang AND k.term = c.term GROUP BY ALL),
p AS (
  SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000 * (coalesce(c.n, 0) + 5)) // (s.n + 5 * v.v) AS p, 1 + (1000000000 * (k.n + 5)) // (v.n + 5 * v.v) AS q
  FROM s JOIN k ON k.lang = s.lang JOIN v ON v.lang = s.lang LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term),
u AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.f, 0) AS value FROM g a JOIN g b ON b.lang = a.lang AND b.source <> a.source
  LEFT JOIN (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS f FROM p a JOIN p b ON b.lang = a.lang AND b.term = a.term GROUP BY ALL) x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q),
o AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM u)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM o WHERE part = 'pair' OR rank <= 50
"""
