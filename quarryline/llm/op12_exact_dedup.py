"""Exact dedup by an extendible-hash index on shared files, in DataFrame operations only.

A text's key is a 64-bit hash of what is left without white space. The index's directory has a pointer for each value of the key's
leading bits. It is doubled, so that those bits grow by one and overfull buckets split in two, until every bucket fits or the bits are
used up; a bucket that is still overfull then (one key that very many rows have) gets a chain of overflow pages. Buckets, in the order
of their keys, are dealt out to owner tasks of about equal weight. An owner sorts its range of keys, chains texts that share a key and
compares them byte by byte. What it finds is written to the shared folder, and every row looks its group up there.

Only keys and sizes of all rows are counted first: texts travel where their key occurs more than once, the others are settled by it.
"""

from __future__ import annotations

from collections.abc import Callable
from math import ceil, log2

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scan import Scratch, read_table

#: Characters that don't count.
SPACES = " \t\n\v\f\r"
#: Buckets that an owner task should have, and the most bits of the directory (2^20 pointers at most).
BUCKETS, MOST_BITS = 4, 20
#: Bytes of a row in the index besides its text.
ROW_BYTES = 100
#: Most keys that are broadcast to tell which texts are needed; beyond it all texts travel.
BROADCAST_KEYS = 1 << 20
#: A text of more than one row in so many is looked up by broadcast (there are no more such texts than this number).
HOT = 1024


def normalised(text: Column) -> Column:
    for space in SPACES:
        text = F.replace(text, F.lit(space), F.lit(""))
    return text


def cell_of(key: Column, bits: int) -> Column:
    """The leading bits of a key."""
    return F.shiftrightunsigned(key, 64 - bits).cast("int") if bits else F.lit(0)


def directory(keys: DataFrame, bits: int, capacity: int) -> DataFrame:
    """A row (cell, depth, start, pages) for each pointer, 2^bits at most, from rows (key, weight).

    ``depth``: bits of the bucket; ``start``: weight of all buckets before it; ``pages``: 1, or more where the bucket is heavier than
    ``capacity`` at the last depth. Buckets without keys have no pointers.
    """
    cells = keys.groupBy(cell_of(F.col("key"), bits).alias("cell")).agg(F.sum("weight").alias("weight"))
    # Depth d of the doubling directory has the prefixes of d bits; each is the sum of its two halves at depth d + 1.
    depths = cells.select(F.explode(F.sequence(F.lit(0), F.lit(bits))).alias("depth"), "cell", "weight")
    depths = depths.groupBy("depth", F.expr(f"shiftright(cell, {bits} - depth)").alias("prefix")).agg(F.sum("weight").alias("weight"))
    split = (F.col("weight") > capacity) & (F.col("depth") < bits)
    above = depths.where(split).select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("above"))
    buckets = depths.where(~split).withColumn("above", F.expr("shiftright(prefix, 1)"))
    buckets = buckets.where("depth = 0").drop("above").union(buckets.where("depth > 0").join(above, ["depth", "above"], "left_semi").select(*depths.columns))
    first = F.expr(f"shiftleft(prefix, {bits} - depth)")
    before = Window.orderBy("first").rowsBetween(Window.unboundedPreceding, -1)  # 2^bits rows at most
    buckets = buckets.withColumn("first", first).withColumn("start", F.coalesce(F.sum("weight").over(before), F.lit(0)))
    pages = F.when(F.col("depth") == bits, F.ceil(F.col("weight") / capacity)).otherwise(1).cast("long")
    pointers = F.explode(F.sequence(F.col("first"), F.expr(f"first + shiftleft(1, {bits} - depth) - 1"))).alias("cell")
    return buckets.select(pointers, "depth", "start", pages.alias("pages"))


def exact_groups(docs: DataFrame, key: Callable[[Column], Column] = F.xxhash64, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are so without white space; of a group the row with the most code points stays, of those that with the
    smallest doc_id (one without doc_id only if there is no other). Null counts as empty; texts without anything but white space are
    equal. ``group_size`` counts rows. Rows that repeat both doc_id and number of code points can't be told apart: of those that stay
    all have ``kept``. An empty table gives an empty result. ``key`` is the hash of the index; results don't depend on it.
    """
    spark = docs.sparkSession
    owners = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bits = min(MOST_BITS, max(1, ceil(log2(BUCKETS * owners)) + 3))
    scratch = Scratch(spark)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.length(text).alias("n"), normalised(text).alias("norm"))
    rows = rows.withColumn("key", key(F.col("norm")).cast("long"))

    entries = scratch.store(rows.select("doc_id", "n", "key", F.octet_length("norm").alias("bytes")), "entries")
    counts = scratch.store(entries.groupBy("key").agg(F.count("*").alias("rows"), F.sum("bytes").alias("bytes")), "keys")
    repeated = counts.where("rows > 1")
    weight = F.col("rows") * ROW_BYTES + F.when(F.col("rows") > 1, F.col("bytes")).otherwise(0)
    n_rows, total = counts.agg(F.sum("rows"), F.sum(weight)).first()
    capacity = max(1, (total or 0) // (BUCKETS * owners))
    pointers = scratch.store(directory(counts.select("key", weight.alias("weight")), bits, capacity), "directory")

    # Rows are dealt out to the owners, with their texts where these have to be compared.
    facts = rows.withColumn("sha", F.sha2("norm", 256))
    if repeated.count() <= broadcast_keys:
        known = repeated.select(F.col("key").alias("again"))
        facts = facts.join(F.broadcast(known), F.col("key") == F.col("again"), "left").withColumn("norm", F.when(F.col("again").isNotNull(), F.col("norm"))).drop("again")
    facts = facts.withColumn("cell", cell_of(F.col("key"), bits)).join(F.broadcast(pointers), "cell")
    page = F.pmod(F.xxhash64("doc_id", "n", "sha"), F.col("pages"))
    owner = F.least(F.lit(owners - 1), F.floor((F.col("start") + page * capacity) / max(1, total or 0) * owners)).cast("int")
    dealt = facts.select(owner.alias("owner"), "key", "norm", F.struct(F.col("n"), F.bitwise_not("doc_id").alias("id")).alias("place"), "sha", (F.col("pages") > 1).alias("paged")).repartitionById(owners, F.col("owner"))
    found = dealt.groupBy("owner", "key", "norm").agg(F.count("*").alias("size"), F.max("place").alias("best"), F.max("sha").alias("sha"), F.max("paged").alias("paged"))
    found = found.withColumn("chain", F.count("*").over(Window.partitionBy("owner", "key")))
    found = found.withColumn("norm", F.when(F.col("paged") | (F.col("chain") > 1), F.col("norm")))
    index = scratch.store(found, "index")

    # Overflow pages of a bucket meet once more: of each text a page has one row.
    columns = ["key", "norm", "size", "best", "sha"]
    paged = index.where("paged").groupBy("key", "norm").agg(F.sum("size").alias("size"), F.max("best").alias("best"), F.max("sha").alias("sha"))
    paged = paged.withColumn("chain", F.count("*").over(Window.partitionBy("key")))
    groups = scratch.store(index.where("NOT paged").select(*columns, "chain").union(paged.select(*columns, "chain")), "groups")

    alone = groups.where("chain = 1").drop("norm", "chain")
    many = F.col("size") * HOT > (n_rows or 0)
    hot = F.broadcast(alone.where(many))
    result = entries.join(hot, "key").union(entries.join(hot.select("key"), "key", "left_anti").join(alone.where(~many), "key"))
    result = result.drop("key", "bytes")
    chained = groups.where("chain > 1").select(F.col("key").alias("other"), F.col("norm").alias("same"), "size", "best", "sha")
    if not chained.isEmpty():
        result = result.union(rows.join(chained, (F.col("key") == F.col("other")) & (F.col("norm") == F.col("same"))).select(*result.columns))
    scratch.clear("entries", "groups")
    keep = F.bitwise_not("best.id")
    return result.select("doc_id", keep.alias("keep_id"), F.col("size").alias("group_size"), (F.col("doc_id").eqNullSafe(keep) & (F.col("n") == F.col("best.n"))).alias("kept"), F.col("sha").alias("text_sha256"))


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(read_table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
g AS (SELECT norm, count(*) AS size, sha256(norm) AS sha, arg_min(doc_id, (-n, doc_id)) AS keep_id FROM d GROUP BY norm)
SELECT d.doc_id, g.keep_id, g.size AS group_size, d.doc_id = g.keep_id AS kept, g.sha AS text_sha256 FROM d JOIN g ON g.norm = d.norm
"""
