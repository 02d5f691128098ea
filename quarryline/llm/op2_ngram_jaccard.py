"""N-gram Jaccard join by vertical partitioning.

The distinct n-grams of all documents have one global order: those of a bounded list of the most frequent ones last, by the number of
documents that have them, all others before them by their hash. The order is cut into fragments, and a document's set into segments,
one for each fragment. Overlaps are counted for each fragment on its own and summed for each pair of documents.

Steps: (1) documents with equal sets form a class, and one of them stands for it; document frequencies are counted over the whole table.
(2) Two sets that are similar enough share an n-gram among the first ones of either, and at the first one that they share, their places
in the global order bound what they can differ in: all that stands before is in one of them only. Classes that meet at an n-gram within
these bounds are candidates. (3) Partial overlaps are counted for candidates.

The result is the components of the links, so a group of classes that meet at one n-gram isn't expanded into pairs. Each class is first
compared with the group's hubs: the class with the smallest place there, which differs least from what the group has in common, over
all and among those of a similar size. Only where that leaves more than one component in a group, pairs of different components within
the bounds are compared as well. So no link is lost, and a group of near copies costs as many comparisons as it has members. What two
sets can share at most is first bounded by small histograms of their n-grams; only pairs within reach have their sets compared.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .graph import components
from .scan import Scratch, Texts, U, blobs, documents, grams, map_slices, mix, parts_of, read_table, record, slices, spread, starts_within

#: Words of an n-gram.
N = 5
#: Fragments of the global order; the last one holds the frequent n-grams.
FRAGMENTS = 4
#: Most n-grams in the list of frequent ones, and how many documents must share one at least. The order is all that depends on it.
FREQUENT, SHARED = 1 << 18, 3
#: Bits of the filter of n-grams that occur in several documents. Beyond about FILTER_BITS / 4 of those it lets most n-grams through,
#: which costs time and a larger exchange; results don't change.
FILTER_BITS = 1 << 27
#: Sets that have an n-gram beyond which its entries are dealt out over several tasks.
SALTED = 1 << 16
#: N-grams that a task gathers before it deals out their counts.
GATHER = 1 << 21
#: Most candidates that are broadcast to select their texts; beyond it they are joined.
BROADCAST_IDS = 200_000


def gram_sets(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-gram hashes of each row, flat, and the number of them before each row."""
    t = t.lowered()
    ptr = t.words()[2]
    words = t.word_hashes()
    at, counts = starts_within(ptr, N)
    values = grams(words, N)[at] if len(at) else np.zeros(0, U)
    size = np.diff(ptr)
    lists = np.split(values, np.cumsum(counts)[:-1]) if t.n else []
    for k in range(1, N):  # a shorter text is one n-gram as a whole
        rows = np.flatnonzero(size == k)
        if len(rows):
            whole = mix(grams(words, k)[ptr[rows]] ^ U(0xABCD0000 + k))
            for r, h in zip(rows.tolist(), whole, strict=True):
                lists[r] = np.array([h], U)
    out = []
    for x in lists:
        x.sort()
        if len(x) > 1:
            new = np.empty(len(x), bool)
            new[0] = True
            np.not_equal(x[1:], x[:-1], out=new[1:])
            x = x[new]
        out.append(x)
    sizes = np.array([len(x) for x in out], np.int64)
    return (np.concatenate(out) if out else np.zeros(0, U)), np.concatenate(([0], np.cumsum(sizes)))


def digests(values: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    """A 64-bit digest of each row's set."""
    sums = np.concatenate((np.zeros(1, U), np.cumsum(mix(values ^ U(0x5DEECE66D)), dtype=U)))
    return mix((sums[ptr[1:]] - sums[ptr[:-1]]) ^ (np.diff(ptr).astype(U) << U(40))).view(np.int64)


def cells(values: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """What n-grams are counted by: a part, and 32 bits within it. N-grams of one cell count as equally frequent."""
    return ((values & U(0xFFFFFFFF)) % U(parts)).astype(np.int64), (values >> U(32)).astype(np.uint32)


def filter_places(cell: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    a = mix(cell.astype(U) ^ U(0x9E3779B9))
    return ((a & U(0xFFFFFFFF)) % U(bits)).astype(np.int64), ((a >> U(32)) % U(bits)).astype(np.int64)


class Order:
    """The global order of n-grams: ``listed`` (sorted cells) are the frequent ones, ``rank`` their places and ``counts`` their sets;
    ``masks`` is the filter of cells that occur in several documents, a row of bytes for each part.

    Tasks get the four arrays by broadcast, and make the order of them: what is broadcast is found by name, and the package need not be
    where tasks run."""

    def __init__(self, listed: np.ndarray, rank: np.ndarray, counts: np.ndarray, masks: np.ndarray):
        self.parts, self.listed, self.rank, self.counts, self.masks = len(masks), listed, rank, counts, masks

    def repeated(self, values: np.ndarray) -> np.ndarray:
        """False for n-grams that only one document has."""
        part, cell = cells(values, self.parts)
        one, two = filter_places(cell, self.masks.shape[1] * 8)
        return ((self.masks[part, one >> 3] >> (one & 7)) & (self.masks[part, two >> 3] >> (two & 7)) & 1).astype(bool)

    def sets_with(self, values: np.ndarray) -> np.ndarray:
        """How many sets have each n-gram, 0 for those that aren't listed."""
        if not len(self.listed):
            return np.zeros(len(values), np.int64)
        part, cell = cells(values, self.parts)
        name = part.astype(U) << U(32) | cell
        at = np.minimum(np.searchsorted(self.listed, name), len(self.listed) - 1)
        return np.where(self.listed[at] == name, self.counts[at], 0)

    def sort(self, values: np.ndarray, ptr: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The n-grams of each row (sorted by hash) in the global order, and how many of each row aren't frequent."""
        if not len(self.listed) or not len(values):
            return values, np.diff(ptr)
        part, cell = cells(values, self.parts)
        name = part.astype(U) << U(32) | cell
        at = np.minimum(np.searchsorted(self.listed, name), len(self.listed) - 1)
        late = self.listed[at] == name
        move = np.flatnonzero(late)
        row = np.searchsorted(ptr, move, "right") - 1
        many = np.bincount(row, minlength=len(ptr) - 1)
        out = np.empty(len(values), U)
        before = np.cumsum(many) - many
        stay = np.flatnonzero(~late)
        out[stay - (np.cumsum(late) - np.repeat(before, np.diff(ptr)))[stay]] = values[stay]
        order = np.lexsort((self.rank[at[move]], row))
        out[ptr[1:][row] - many[row] + spread(many)] = values[move[order]]
        return out, np.diff(ptr) - many


def described(docs: DataFrame, parts: int) -> DataFrame:
    """A row (doc_id, key = digest of the set, n, part) for each document, and rows (part, counted) with the cells of n-grams: sorted,
    differences, their bytes by significance; once for each of some documents with different sets that has them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, seen, rows = [], 0, set(), 0

        def flush() -> pa.RecordBatch:
            part, cell = cells(np.concatenate(held), parts)
            name = np.sort(part.astype(U) << U(32) | cell)
            cut = np.searchsorted(name, np.arange(parts + 1, dtype=U) << U(32))
            full = np.flatnonzero(np.diff(cut))
            raw = [np.diff((name[cut[p] : cut[p + 1]] & U(0xFFFFFFFF)).astype("<u4"), prepend=np.uint32(0)).view(np.uint8).reshape(-1, 4).T.tobytes() for p in full]
            none = pa.nulls(len(full), pa.int64())
            held.clear()
            seen.clear()
            return record(doc_id=none, key=none, n=none, part=pa.array(full, pa.int32()), counted=blobs(raw))

        for batch in batches:
            for part, texts in slices(batch):
                values, ptr = gram_sets(texts)
                keys = digests(values, ptr)
                yield record(doc_id=part.column(0), key=keys, n=np.diff(ptr), part=((np.arange(rows, rows + len(keys))) % parts).astype(np.int32), counted=pa.nulls(len(keys), pa.binary()))
                rows += len(keys)
                for key, a, b in zip(keys.tolist(), ptr[:-1].tolist(), ptr[1:].tolist(), strict=True):
                    if a < b and key not in seen:
                        seen.add(key)
                        held.append(values[a:b])
                        size += b - a
                if size > GATHER:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    return docs.mapInArrow(run, "doc_id long, key long, n long, part int, counted binary")


def sets_and_counts(known: DataFrame, parts: int) -> DataFrame:
    """Of the rows of ``described``, dealt out once: those of documents (doc_id, key, n) as they are, and for each part a row (part,
    bits, listed, counts) with its share of the filter and its most frequent cells."""
    most, bits = -(-FREQUENT // parts), FILTER_BITS // parts // 8 * 8

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, part = [], None
        for batch in batches:
            rows = batch.filter(batch.column(4).is_null())
            none = pa.nulls(rows.num_rows, pa.binary())
            yield record(doc_id=rows.column(0), key=rows.column(1), n=rows.column(2), part=rows.column(3), bits=none, listed=none, counts=none)
            for raw in batch.column(4).drop_null().to_pylist():
                steps = np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").ravel()
                found.append(np.cumsum(steps, dtype=np.uint32))
                part = batch.column(3)[0].as_py()
        if part is None:
            return
        cell = np.concatenate(found)
        found.clear()
        cell.sort()
        head = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
        count = np.diff(np.append(head, len(cell)))
        cell, count = cell[head[count > 1]], count[count > 1]
        mask = np.zeros(bits, bool)
        for place in filter_places(cell, bits):
            mask[place] = True
        cell, count = cell[count >= SHARED], count[count >= SHARED]
        top = np.lexsort((cell, -count))[:most]
        none = pa.nulls(1, pa.int64())
        yield record(doc_id=none, key=none, n=none, part=pa.array([part], pa.int32()), bits=blobs([np.packbits(mask, bitorder="little").tobytes()]), listed=blobs([(cell[top].astype(U) | U(part << 32)).tobytes()]), counts=blobs([count[top].astype(np.int64).tobytes()]))

    return known.repartitionById(parts, F.col("part")).mapInArrow(judge, "doc_id long, key long, n long, part int, bits binary, listed binary, counts binary")


def global_order(counted: DataFrame, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What ``Order`` is made of, from the parts' rows of ``sets_and_counts``. To the driver: FILTER_BITS bits, and FREQUENT cells (or
    one for each part) with their counts."""
    masks, listed, counts = np.zeros((parts, FILTER_BITS // parts // 8), np.uint8), [np.zeros(0, U)], [np.zeros(0, np.int64)]
    for r in counted.where("bits IS NOT NULL").select("part", "bits", "listed", "counts").collect():
        masks[r["part"]] = np.frombuffer(r["bits"], np.uint8)
        listed.append(np.frombuffer(r["listed"], U))
        counts.append(np.frombuffer(r["counts"], np.int64))
    listed, counts = np.concatenate(listed), np.concatenate(counts)
    rank = np.empty(len(listed), np.int64)
    rank[np.lexsort((listed, counts))] = np.arange(len(listed))
    order = np.argsort(listed)
    return listed[order], rank[order], counts[order], masks


def prefix_entries(docs: DataFrame, order, salted: int = SALTED) -> DataFrame:
    """Rows (gram, salt, key, n, place): the first n-grams of each set that others may have, and their places in it. A pair that is
    similar enough shares at least 0.8 of the larger set, so it meets among them. Rows may repeat. The salt is -1, but where more than
    ``salted`` sets have an n-gram, its entries are dealt out to about so many each by salts from 0 on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Order(*order.value)
        seen: set[int] = set()
        for batch in batches:
            for _, texts in slices(batch):
                values, ptr = gram_sets(texts)
                keys = digests(values, ptr)
                values, _ = known.sort(values, ptr)
                n = np.diff(ptr)
                first = np.zeros(len(n), bool)
                for i, key in enumerate(keys.tolist()):
                    if key not in seen:
                        seen.add(key)
                        first[i] = True
                if len(seen) > GATHER // 4:
                    seen.clear()
                many = np.where(first & (n > 0), n - (4 * n + 4) // 5 + 1, 0)
                row, place = np.repeat(np.arange(len(n)), many), spread(many)
                gram = values[ptr[row] + place]
                hit = known.repeated(gram)
                row, gram = row[hit], gram[hit]
                sets = known.sets_with(gram)
                salt = np.where(sets > salted, (mix(keys[row].view(U)) % (U(1) + sets.astype(U) // U(salted))).astype(np.int32), np.int32(-1))
                yield record(gram=gram.view(np.int64), salt=salt, key=keys[row], n=n[row].astype(np.int32), place=place[hit].astype(np.int32))

    return docs.mapInArrow(run, "gram long, salt int, key long, n int, place int")


def meetings(entries: DataFrame) -> DataFrame:
    """The distinct entries of n-grams that several classes have, with the hubs of their n-gram and salt: ``top``, the entry of the
    smallest place over all, and ``own``, that among the classes of a similar size; null where that is the same. Entries are dealt out
    once, and copies of a class are one entry from there on."""
    entry = F.struct("place", "n", "key")
    rows = entries.repartition("gram", "salt").groupBy("gram", "salt", "key", "n", "place").agg(F.count("*").alias("copies"))
    rows = rows.withColumn("size", F.floor(F.log("n") / F.log(F.lit(1.25))).cast("int"))
    rows = rows.withColumn("own", F.min(entry).over(Window.partitionBy("gram", "salt", "size")))
    group = Window.partitionBy("gram", "salt")
    rows = rows.withColumns({"top": F.min("own").over(group), "many": F.count("*").over(group)})
    rows = rows.where("many > 1 OR salt >= 0")
    return rows.select("gram", "salt", "key", "n", "place", F.when(F.col("own") != F.col("top"), F.col("own")).alias("own"), "top")


def needed(na: str, nb: str) -> Column:
    """N-grams that two sets must share."""
    return F.expr(f"(4 * ({na} + {nb}) + 8) div 9")


def may_link(one: str, two: str) -> Column:
    """Whether the sets of two entries of an n-gram may be similar enough if it is the first one that they share."""
    na, nb, i, j = f"{one}.n", f"{two}.n", f"{one}.place", f"{two}.place"
    need = needed(na, nb)
    sizes = F.expr(f"5 * {na} >= 4 * {nb} AND 5 * {nb} >= 4 * {na}")
    return sizes & (F.expr(f"{i} + {j} - {na} - {nb}") <= -2 * need) & (F.expr(f"{i} - {na}") <= -need) & (F.expr(f"{j} - {nb}") <= -need)


def hub_pairs(met: DataFrame) -> DataFrame:
    """Pairs (a, b) of keys: each entry with the hubs of its n-gram and salt, and these with the first hub of all salts."""
    both = met.select(F.struct("place", "n", "key").alias("x"), F.explode(F.array_compact(F.array("own", "top"))).alias("y"))
    hubs = met.where("salt >= 0").select("gram", "top").distinct()
    both = both.union(hubs.join(hubs.groupBy("gram").agg(F.min("top").alias("y")), "gram").select(F.col("top").alias("x"), "y"))
    both = both.where((F.col("x.key") != F.col("y.key")) & may_link("x", "y"))
    return both.select(F.least("x.key", "y.key").alias("a"), F.greatest("x.key", "y.key").alias("b")).distinct()


def mixed_pairs(met: DataFrame, roots: DataFrame, store: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """Pairs (a, b) of keys that meet at an n-gram within the bounds and are in different components. ``roots``: key, root.

    In each group, all classes but those of its largest component meet the others, so a group that is linked but for a few classes
    costs as many pairs as these have partners."""
    # A class whose place is too far for the smallest one of its group meets nobody (sets differ in a quarter of the smaller one at most).
    near = met.where("4 * (place + IF(salt < 0, top.place, 0)) <= n").select("gram", F.struct("place", "n", "key").alias("x"))
    members = near.join(roots, F.col("x.key") == roots["key"]).drop("key")
    sizes = members.groupBy("gram", "root").agg(F.count("*").alias("size"))
    groups = sizes.groupBy("gram").agg(F.max(F.struct("size", "root")).alias("main"), F.sum("size").alias("size"), F.count("*").alias("roots"))
    # Two classes have met as one of them is the hub.
    groups = groups.where("roots > 1 AND size > 2").select("gram", F.col("main.root").alias("main"))
    rest = store(members.join(groups, "gram"), "mixed")
    one = rest.where("root <> main")
    two = rest.select(F.col("gram").alias("gram2"), F.col("root").alias("root2"), F.col("x").alias("y"))
    both = one.join(two, (F.col("gram") == F.col("gram2")) & F.expr("root <> root2 AND (root2 = main OR root < root2)") & may_link("x", "y"))
    return both.select(F.least("x.key", "y.key").alias("a"), F.greatest("x.key", "y.key").alias("b")).distinct()


def texts_of_pairs(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The documents of some pairs (a, b)."""
    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", "left_semi")


def histogram(values: np.ndarray) -> bytes:
    """How many n-grams of a set fall on each value of some bits of their hashes, about four on each, 255 for more."""
    size = 1 << max(4, (len(values) // 4).bit_length())
    return np.minimum(np.bincount((values & U(size - 1)).astype(np.int64), minlength=size), 255).astype(np.uint8).tobytes()


def most_shared(one: bytes, other: bytes) -> float:
    """The most n-grams that two sets can share, by their histograms."""
    x, y = sorted((np.frombuffer(one, np.uint8), np.frombuffer(other, np.uint8)), key=len)
    if (x == 255).any() or (y == 255).any():
        return float("inf")
    return float(np.minimum(x, y.reshape(-1, len(x)).sum(axis=0)).sum())


def within_reach(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of some pairs (a, b: documents) that may be similar enough by the histograms of their sets, which are a small part of the
    sets: those that have a passage in common and little else go here."""

    def cut(part: pa.RecordBatch, texts: Texts) -> pa.RecordBatch:
        values, ptr = gram_sets(texts)
        return record(doc=part.column(0), n=np.diff(ptr), bins=blobs([histogram(values[a:b]) for a, b in zip(ptr[:-1].tolist(), ptr[1:].tolist(), strict=True)]))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb, x, y = (batch.column(i).to_pylist() for i in range(2, 6))
            stay = [most_shared(p, q) >= (4 * (m + n) + 8) // 9 for m, n, p, q in zip(na, nb, x, y, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(stay, pa.bool_()))

    bins = map_slices(texts_of_pairs(docs, pairs), cut, "doc long, n long, bins binary").dropDuplicates(["doc"])
    both = pairs.join(bins.select(F.col("doc").alias("a"), F.col("n").alias("na"), F.col("bins").alias("x")), "a")
    both = both.join(bins.select(F.col("doc").alias("b"), F.col("n").alias("nb"), F.col("bins").alias("y")), "b")
    return both.select("a", "b", "na", "nb", "x", "y").mapInArrow(judge, "a long, b long")


def linked(docs: DataFrame, pairs: DataFrame, classes: DataFrame, order) -> DataFrame:
    """Those of some pairs (a, b: documents) whose sets are similar enough: partial overlaps for each fragment, summed for each pair."""

    def cut(part: pa.RecordBatch, texts: Texts) -> pa.RecordBatch:
        values, ptr = gram_sets(texts)
        values, plain = Order(*order.value).sort(values, ptr)
        bounds = [U((i << 64) // (FRAGMENTS - 1)) for i in range(1, FRAGMENTS - 1)]
        doc, fragment, lists = [], [], []
        for d, a, b, rare in zip(part.column(0).to_pylist(), ptr[:-1].tolist(), ptr[1:].tolist(), plain.tolist(), strict=True):
            x = values[a:b]
            edges = [0, *np.searchsorted(x[:rare], bounds).tolist(), rare, len(x)]
            for f in range(FRAGMENTS):
                if edges[f] < edges[f + 1]:
                    doc.append(d)
                    fragment.append(f)
                    lists.append(x[edges[f] : edges[f + 1]])
        flat = np.concatenate(lists).view(np.int64) if lists else np.zeros(0, np.int64)
        offsets = np.concatenate(([0], np.cumsum([len(x) for x in lists], dtype=np.int64))).astype(np.int32)
        return record(doc=pa.array(doc, pa.int64()), fragment=pa.array(fragment, pa.int32()), segment=pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)))

    segments = map_slices(texts_of_pairs(docs, pairs), cut, "doc long, fragment int, segment array<long>")
    wide = pairs.select("a", "b", F.explode(F.sequence(F.lit(0), F.lit(FRAGMENTS - 1))).alias("fragment"))
    one = wide.join(segments.select(F.col("doc").alias("a"), "fragment", F.col("segment").alias("x")), ["a", "fragment"])
    two = one.join(segments.select(F.col("doc").alias("b"), "fragment", F.col("segment").alias("y")), ["b", "fragment"])
    partial = two.select("a", "b", "fragment", F.size(F.array_intersect("x", "y")).cast("long").alias("overlap"))
    # At most one count for each fragment; a set, as rows of a document may repeat.
    counts = F.collect_set(F.struct("fragment", "overlap"))
    total = partial.groupBy("a", "b").agg(F.aggregate(counts, F.lit(0).cast("long"), lambda acc, x: acc + x["overlap"]).alias("overlap"))
    sizes = classes.select("rep", "n")
    total = total.join(sizes.select(F.col("rep").alias("a"), F.col("n").alias("na")), "a").join(sizes.select(F.col("rep").alias("b"), F.col("n").alias("nb")), "b")
    return total.where("100 * overlap >= 80 * (na + nb - overlap)").select("a", "b")


def jaccard_components(docs: DataFrame, salted: int = SALTED) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id.

    A null or empty text, or one without words, has an empty set and is linked with nothing; one with fewer than five words has one
    n-gram, its whole sequence. Repeated rows get equal results. A row without doc_id is nobody's smallest one, and a text that only
    such rows have links nothing: documents that are linked through it alone aren't linked. An empty table gives an empty result. Sets
    are compared by 64-bit hashes. ``salted`` changes no results.
    """
    spark = docs.sparkSession
    docs = documents(docs)
    parts = parts_of(docs)
    scratch = Scratch(spark)
    store = scratch.store
    known = store(sets_and_counts(described(docs, parts), parts), "sets")
    order = spark.sparkContext.broadcast(global_order(known, parts))
    sets = known.where("bits IS NULL").select("doc_id", "key", "n")
    classes = store(sets.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n")).where("rep IS NOT NULL"), "classes")
    met = store(meetings(prefix_entries(docs, order, salted)), "met")

    def reps(pairs: DataFrame) -> DataFrame:
        """The documents that stand for the classes of some pairs."""
        for side in ("a", "b"):
            pairs = pairs.join(classes.select(F.col("key").alias(side), F.col("rep").alias(f"rep_{side}")), side)
        return pairs.select(F.least("rep_a", "rep_b").alias("a"), F.greatest("rep_a", "rep_b").alias("b")).where("a <> b")

    def rooted(stars: DataFrame) -> DataFrame:
        return classes.join(stars, classes["rep"] == stars["node"], "left").select("key", F.coalesce("root", "rep").alias("root"))

    first = store(reps(hub_pairs(met)), "first")
    links = store(linked(docs, store(within_reach(docs, first), "near"), classes, order), "links")
    stars = components(links, store)
    more = store(reps(mixed_pairs(met, store(rooted(stars), "roots"), store)).join(first, ["a", "b"], "left_anti"), "more")
    if not more.isEmpty():
        stars = components(links.union(linked(docs, store(within_reach(docs, more), "near"), classes, order)), store)
    out = sets.join(store(rooted(stars), "components").withColumnRenamed("root", "component"), "key", "left")
    scratch.clear("sets", "components")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read_table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, array_to_string(ws[i:i+4], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM d)
    UNION ALL SELECT doc_id, array_to_string(ws, ' ') AS s FROM d WHERE len(ws) BETWEEN 1 AND 4)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, e.b FROM r JOIN e ON e.a = r.y)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.component_id::BIGINT AS component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT x, min(y) AS component_id FROM r GROUP BY x) m ON m.x = d.doc_id
"""
