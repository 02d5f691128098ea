"""Exact substring dedup with a compressed FM-index per shard.

A window is 20 consecutive words. Each window has an anchor, its smallest 5-gram by hash, so equal windows have equal anchors; the
windows of a text that share one place of an anchor form a segment (at most 16 windows, 35 words). Anchors that occur once in the whole
table can't be in a repeated window. The other segments go to the shard of their anchor. There the earliest segment of each anchor is
held in an FM-index, and the later ones are streamed through it from the last word to the first: backward search over the wavelet
matrix extends the match, and where a word doesn't fit, the interval is widened to what its last words leave. That gives the matching
statistics, the longest earlier match from each word on; intervals of a window's length or more are reported, and what is new in a
segment is searched in, and added to, the next index.

Scale: every window is in one shard. Anchors are counted from one number for each anchor and task; those that repeat are told to the
second scan by a filter of a fixed number of bits (what it lets through wrongly only costs time). Equal segments of a task are
summed up before they are dealt out. An anchor with very many segments isn't dealt as one group: its windows are cut apart and each
goes to the shard of its own content.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .fm_index import FMIndex
from .scan import Texts, U, blobs, documents, grams, mix, parts_of, moved, prefix_sums, ranges, read_table, record, slices, spread, starts_within

WINDOW, GRAM = 20, 5
#: Bits of the filter of repeated anchors.
FILTER_BITS = 1 << 27
#: An anchor with more segments than this and than this share of all rows is cut into windows before it is dealt out; the most frequent
#: ones of these, as many as the list may have (others are searched as they are).
HOT, HOT_SHARE, HOT_LIST = 256, 20_000, 1 << 20
#: After so many rounds, what is left of segments is cut into windows.
ROUNDS = 12
#: Text that a task gathers before it deals out its segments, and words of an index.
GATHER_BYTES = 12 << 20
INDEX_WORDS = 1 << 19
SEGMENT = np.dtype([("doc", "<i8"), ("start", "<u4"), ("words", "<u4"), ("route", "<u4")])


def segments(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of the texts, then anchor, first word (in the slice), number of windows and row of each segment."""
    ptr, words = t.words()[2], t.word_hashes()
    at, counts = starts_within(ptr, WINDOW)
    if not len(at):
        none = np.zeros(0, np.int64)
        return words, np.zeros(0, U), none, none, none
    g = grams(words, GRAM)
    span = WINDOW - GRAM + 1
    least, have = g, 1
    while have < span:
        step = min(have, span - have)
        least = np.minimum(least[: len(least) - step], least[step:])
        have += step
    anchor = least[at]
    row = np.repeat(np.arange(t.n), counts)
    new = np.ones(len(at), bool)
    # Also a new one when the anchor's first place leaves the window: what stays is another place with the same 5-gram.
    new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1]) | (g[at[:-1]] == anchor[:-1])
    head = np.flatnonzero(new)
    return words, anchor[head], at[head], np.diff(np.append(head, len(at))), row[head]


def anchor_place(anchor: np.ndarray, parts: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Part of the filter, and two bits in it."""
    a = mix(anchor ^ U(0x243F6A88))
    return (a % U(parts)).astype(np.int64), ((a >> U(20)) % U(bits)).astype(np.int64), ((mix(a) >> U(20)) % U(bits)).astype(np.int64)


def repeated_anchors(docs: DataFrame, parts: int, hot: int) -> tuple[np.ndarray, np.ndarray]:
    """The filter (a row of bytes for each part) and the sorted list of anchors with at least ``hot`` segments."""
    bits = FILTER_BITS // parts // 8 * 8

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            # A number for each anchor: its upper 56 bits, then how often it occurs here (up to 255).
            a, n = np.unique(np.concatenate(held) | U(255), return_counts=True)
            entry = (a ^ U(255)) | np.minimum(n, 255).astype(U)
            part = anchor_place(a, parts, bits)[0]
            order = np.argsort(part, kind="stable")
            cut = np.searchsorted(part[order], np.arange(parts + 1))
            full = np.flatnonzero(np.diff(cut))
            return record(part=pa.array(full, pa.int32()), entries=blobs([entry[order[cut[p] : cut[p + 1]]].tobytes() for p in full]))

        for batch in batches:
            for _, texts in slices(batch):
                held.append(segments(texts)[1])
                size += len(texts.data)
                if size >= GATHER_BYTES:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, part = [], None
        for batch in batches:
            raw += batch.column(1).to_pylist()
            part = batch.column(0)[0].as_py()
        if part is None:
            return
        e = np.sort(np.frombuffer(b"".join(raw), U))
        a, n = e | U(255), (e & U(255)).astype(np.int64)
        head = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1]))) if len(a) else np.zeros(0, np.int64)
        total, a = np.add.reduceat(n, head) if len(head) else n, a[head]
        again = a[total > 1]
        mask = np.zeros(bits, bool)
        for place in anchor_place(again, parts, bits)[1:]:
            mask[place] = True
        many = np.flatnonzero(total >= hot)
        many = many[np.argsort(-total[many], kind="stable")[: max(1, HOT_LIST // parts)]]
        yield record(part=pa.array([part], pa.int32()), bits=blobs([np.packbits(mask, bitorder="little").tobytes()]), hot=blobs([a[many].tobytes()]))

    dealt = docs.mapInArrow(count, "part int, entries binary").repartitionById(parts, F.col("part"))
    out = np.zeros((parts, bits // 8), np.uint8)
    often = [np.zeros(0, U)]
    # FILTER_BITS in all, and about HOT_LIST anchors.
    for r in dealt.mapInArrow(judge, "part int, bits binary, hot binary").collect():
        out[r["part"]] = np.frombuffer(r["bits"], np.uint8)
        often.append(np.frombuffer(r["hot"], U))
    return out, np.sort(np.concatenate(often))


def digests(words: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Hash of the ``count`` words from place ``first`` on, in their order and wherever they stand."""
    upto = prefix_sums(mix(words))
    return mix(moved(upto[first + count] - upto[first], first) ^ count.astype(U) << U(56))


def copies(keys: np.ndarray, doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which entries come first of their key by (doc, start), and which are copies of them at another place.

    Entries at the first one's own place, from rows that repeat a document, are neither.
    """
    order = np.lexsort((start, doc))
    _, which, number = np.unique(keys[order], return_index=True, return_inverse=True)
    lead = np.empty(len(order), np.int64)
    lead[order] = order[which][number]
    first = np.zeros(len(keys), bool)
    first[order[which]] = True
    return first, (doc != doc[lead]) | (start != start[lead])


def spans(doc: np.ndarray, start: np.ndarray, windows: np.ndarray) -> tuple[list, list[bytes]]:
    """Spans of removed windows by document: ids, and bytes of (first word, number of windows) pairs."""
    if not len(doc):
        return [], []
    order = np.lexsort((start, doc))
    doc, pair = doc[order], np.stack((start[order], windows[order]), axis=1).astype("<u4")
    head = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
    ends = np.append(head[1:], len(doc))
    return doc[head].tolist(), [pair[a:b].tobytes() for a, b in zip(head.tolist(), ends.tolist(), strict=True)]


def runs(place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First place and length of each run of consecutive places (ascending)."""
    head = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1] + 1))) if len(place) else np.zeros(0, np.int64)
    return place[head], np.diff(np.append(head, len(place)))


def streamed(words: np.ndarray, index_at: tuple[np.ndarray, np.ndarray], text_at: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Matching statistics of some texts (first place and length in ``words``) in an index of others, one after the other."""
    (first, size), (begin, count) = index_at, text_at
    names, ids = np.unique(words[ranges(first, size)], return_inverse=True)
    ends = np.cumsum(size + 1)
    held = np.ones(ends[-1], np.int64)  # each text's words, numbered from 2, then a separator
    held[ranges(ends - size - 1, size)] = ids + 2
    index = FMIndex(held, len(names) + 2, int(max(size.max(), count.max())) + 1)
    other = words[ranges(begin, count)]
    at = np.minimum(np.searchsorted(names, other), len(names) - 1)
    return index.statistics(np.where(names[at] == other, at + 2, 0), np.cumsum(count) - count, count)


def searched(seg: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans (document, first word, windows) of the windows of some segments that also start earlier in one of them.

    Segments of one anchor have one route. In each round the earliest of every route that has several goes into an index, and the
    others are streamed through it: what matches WINDOW words or more is an earlier occurrence, as windows that are equal have one
    anchor. What is left of them waits for the next round, and what is left of many is cut into windows, each a route by its content.
    """
    begin = np.concatenate(([0], np.cumsum(seg["words"], dtype=np.int64)))
    keep, later = copies(digests(words, begin[:-1], np.diff(begin)), seg["doc"], seg["start"])
    out = [(seg["doc"][later], seg["start"][later].astype(np.int64), seg["words"][later].astype(np.int64) - WINDOW + 1)]
    order = np.lexsort((seg["start"][keep], seg["doc"][keep]))
    seg, at = seg[keep][order], begin[:-1][keep][order]
    # What is left: document, first word in it, first word here, number of words, route; by document and first word.
    doc, start, size, route = seg["doc"].astype(np.int64), seg["start"].astype(np.int64), seg["words"].astype(np.int64), seg["route"].astype(np.uint64)
    for rounds in itertools.count(1):
        _, head, which, often = np.unique(route, return_index=True, return_inverse=True, return_counts=True)
        several = often[which] > 1
        if not several.any():
            break
        first = np.zeros(len(doc), bool)
        first[head] = True
        one, rest = np.flatnonzero(first & several), np.flatnonzero(~first)
        doc, start, place, size, route, at = doc[rest], start[rest], at[rest], size[rest], route[rest], (at[one], size[one])
        length = streamed(words, at, (place, size))
        # Windows, by their first words.
        row = np.repeat(np.arange(len(doc)), size - WINDOW + 1)
        shift = spread(size - WINDOW + 1)
        known = length[(np.cumsum(size) - size)[row] + shift] >= WINDOW
        line = np.cumsum(size + 1)[row] + shift  # places with a gap after each text
        for hit in (True, False):
            part = np.flatnonzero(known == hit)
            begun, many = runs(line[part])
            part = part[np.searchsorted(line[part], begun)]
            if hit:
                out.append((doc[row[part]], start[row[part]] + shift[part], many))
        owner = row[part]
        doc, start, at, size, route = doc[owner], start[owner] + shift[part], place[owner] + shift[part], many + WINDOW - 1, route[owner]
        if rounds == ROUNDS:
            many = size - WINDOW + 1
            inner = spread(many)
            doc, start, at = np.repeat(doc, many), np.repeat(start, many) + inner, np.repeat(at, many) + inner
            size, route = np.full(len(doc), WINDOW), grams(words, WINDOW)[at]
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, spans) of all windows that also start earlier; a document may have several rows."""
    spark = docs.sparkSession
    parts = parts_of(docs)
    docs = docs.where("doc_id IS NOT NULL")
    bits = FILTER_BITS // parts // 8 * 8
    told = spark.sparkContext.broadcast(repeated_anchors(docs, parts, max(HOT, docs.count() // HOT_SHARE)))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks, hot = told.value
        held, size = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            doc, start, count, route, digest = (np.concatenate([h[i] for h in held]) for i in range(5))
            words = np.concatenate([h[5] for h in held])
            begin = np.cumsum(count) - count
            keep, later = copies(digest, doc, start)
            ids, raw = spans(doc[later], start[later], count[later] - WINDOW + 1)
            if ids:
                yield record(part=pa.array([i % parts for i in ids], pa.int32()), doc_id=pa.array(ids, pa.int64()), spans=blobs(raw), low=pa.nulls(len(ids), pa.binary()), high=pa.nulls(len(ids), pa.binary()))
            at = np.flatnonzero(keep)
            part = (route[at] % U(parts)).astype(np.int64)
            at = at[np.argsort(part, kind="stable")]
            cuts = np.searchsorted(np.sort(part), np.arange(parts + 1))
            seg = np.empty(len(at), SEGMENT)
            seg["doc"], seg["start"], seg["words"], seg["route"] = doc[at], start[at], count[at], (route[at] >> U(32)).astype(np.uint32)
            w = words[ranges(begin[at], count[at])]
            ends = np.concatenate(([0], np.cumsum(count[at])))[cuts]
            full = np.flatnonzero(np.diff(cuts))
            # 40 bits of each word's hash: windows differ unless 20 of them agree.
            yield record(
                part=pa.array(full, pa.int32()), doc_id=pa.nulls(len(full), pa.int64()), spans=blobs([seg[cuts[p] : cuts[p + 1]].tobytes() for p in full]),
                low=blobs([w[ends[p] : ends[p + 1]].astype("<u4").tobytes() for p in full]), high=blobs([(w[ends[p] : ends[p + 1]] >> U(32)).astype(np.uint8).tobytes() for p in full]),
            )

        for batch in batches:
            for part, texts in slices(batch):
                words, anchor, first, windows, row = segments(texts)
                p, one, two = anchor_place(anchor | U(255), parts, bits)
                hit = ((masks[p, one >> 3] >> (one & 7)) & (masks[p, two >> 3] >> (two & 7)) & 1).astype(bool)
                anchor, first, windows, row = anchor[hit] | U(255), first[hit], windows[hit], row[hit]
                route = mix(anchor)
                if len(hot) and len(anchor):
                    many = hot[np.minimum(np.searchsorted(hot, anchor), len(hot) - 1)] == anchor
                    each = np.where(many, windows, 1)  # segments of a hot anchor are cut into windows
                    inner = spread(each)
                    route, many, row = np.repeat(route, each), np.repeat(many, each), np.repeat(row, each)
                    first = np.repeat(first, each) + inner
                    windows = np.where(many, 1, np.repeat(windows, each))
                    route[many] = grams(words, WINDOW)[first[many]]
                count = windows + WINDOW - 1
                digest = digests(words, first, count) ^ route
                ptr = texts.words()[2]
                doc = part.column(0).to_numpy()[row]
                held.append((doc, first - ptr[row], count, route, digest, words[ranges(first, count)]))
                size += len(texts.data)
                if size >= GATHER_BYTES:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seg, low, high = [], [], []
        for batch in batches:
            ready = batch.filter(batch.column(1).is_valid())
            if ready.num_rows:
                yield record(doc_id=ready.column(1), spans=ready.column(2))
            rest = batch.filter(batch.column(1).is_null())
            for kept, i in ((seg, 2), (low, 3), (high, 4)):
                kept += rest.column(i).to_pylist()
        if not seg:
            return
        seg = np.frombuffer(b"".join(seg), SEGMENT)
        low, high = np.frombuffer(b"".join(low), "<u4"), np.frombuffer(b"".join(high), np.uint8)
        count = seg["words"].astype(np.int64)
        begin = np.cumsum(count) - count
        # As many indexes as the shard's size asks for; equal routes stay together.
        indexes = -(-len(low) // INDEX_WORDS)
        own = seg["route"] % indexes
        for k in range(indexes):
            at = np.flatnonzero(own == k)
            if len(at):
                of = ranges(begin[at], count[at])
                ids, raw = spans(*searched(seg[at], (high[of].astype(U) << U(32)) | low[of]))
                if ids:
                    yield record(doc_id=pa.array(ids, pa.int64()), spans=blobs(raw))

    dealt = docs.mapInArrow(cut, "part int, doc_id long, spans binary, low binary, high binary").repartitionById(parts, F.col("part"))
    return dealt.mapInArrow(search, "doc_id long, spans binary")


def kept_words(text: bytes, removed: bytes | None) -> tuple[int, int, list[bytes]]:
    """Number of words, of removed words, and the words that stay."""
    words = text.split()
    if not removed:
        return len(words), 0, words
    # A row that repeats a doc_id with a shorter text may lack some places.
    pairs = np.frombuffer(removed, "<u4").reshape(-1, 2).astype(np.int64)
    step = np.zeros(len(words) + 1, np.int64)
    np.add.at(step, np.minimum(pairs[:, 0], len(words)), 1)
    np.add.at(step, np.minimum(pairs[:, 0] + pairs[:, 1] + WINDOW - 1, len(words)), -1)
    stay = np.cumsum(step[:-1]) <= 0
    return len(words), int(len(words) - stay.sum()), list(compress(words, stay.tolist()))


def with_spans(docs: DataFrame, *columns: str) -> DataFrame:
    """doc_id, the columns given, and ``spans``: all spans of the document, null without any."""
    found = repeated_spans(documents(docs)).groupBy("doc_id").agg(F.collect_list("spans").alias("spans"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *columns)
    return rows.join(found, "doc_id", "left")


def substring_dedup(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, n_words, n_removed, kept_sha256.

    A null or empty text has no words and the digest of an empty text; one with fewer than 20 words loses nothing. doc_id names a
    document: rows that repeat one with the same text get the same result and don't count as earlier occurrences of each other; of rows
    that repeat one with different texts, each loses the words at the places that are found in any of them. A
    row without doc_id keeps all words and removes none elsewhere. An empty table gives an empty result. Words are compared by 40 bits
    of a hash, windows so by 20 times 40, and whole segments that are copies by 64 bits that tell the order of their words.
    """

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, removed, digest = [], [], []
            for text, parts in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                a, b, words = kept_words((text or "").encode(), b"".join(parts) if parts else None)
                n.append(a)
                removed.append(b)
                digest.append(hashlib.sha256(b" ".join(words)).hexdigest())
            yield record(doc_id=batch.column(0), n_words=pa.array(n, pa.int64()), n_removed=pa.array(removed, pa.int64()), kept_sha256=pa.array(digest, pa.string()))

    rows = with_spans(docs, F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(finish, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(read_table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM d),
w AS (SELECT doc_id, i, array_to_string(ws[i:i+19], ' ') AS g FROM p),
r AS (SELECT doc_id, i FROM w QUALIFY row_number() OVER (PARTITION BY g ORDER BY doc_id, i) > 1),
c AS (SELECT DISTINCT doc_id, i + k AS i FROM r, (SELECT unnest(range(0, 20)) AS k)),
x AS (SELECT doc_id, list(i) AS gone FROM c GROUP BY doc_id),
k AS (SELECT d.doc_id, ws, coalesce(gone, []) AS gone FROM d LEFT JOIN x ON x.doc_id = d.doc_id),
u AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM d),
s AS (SELECT u.doc_id, string_agg(word, ' ' ORDER BY u.i) AS kept FROM u LEFT JOIN c ON c.doc_id = u.doc_id AND c.i = u.i WHERE c.i IS NULL GROUP BY u.doc_id)
SELECT k.doc_id, len(ws)::BIGINT AS n_words, len(gone)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM k LEFT JOIN s ON s.doc_id = k.doc_id
"""
