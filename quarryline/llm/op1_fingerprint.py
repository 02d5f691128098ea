"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A text is cut into paragraphs: its lines, and long lines once more after words whose hash says so (about every fourth), so an edit
changes only the paragraphs that it touches. The digest of a paragraph holds 48 bits of its hash (with the number of equal paragraphs
before it, so repeats count) and 16 bits of its length. Each digest is added to three cells of a sketch: count, sum of digests, sum of
check hashes. Subtracting the sketches of two versions cancels what they share; peeling the rest recovers the digests that differ.
When peeling fails, both sketches are made again, four times as large; where that can't help, the digests themselves are compared.

The likeness of two texts is the shared weight over the weight of either (weighted Jaccard; the weight of a paragraph is its length).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scan import Texts, U, documents, mix, read_table, record, spread

#: Cells of the fingerprint that is returned, a multiple of three; larger sketches are made where they are needed.
CELLS = 24
#: Most bytes of a paragraph.
LONGEST = (1 << 16) - 1
#: A word ends a paragraph if its hash is 0 modulo this.
CUT = 4
#: Sketches of more cells than this for each digest aren't tried.
MOST_CELLS = 16
#: Bytes of text gathered before a batch is worked through.
GATHER = 1 << 20


def paragraphs(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Digest of each paragraph, and the number of paragraphs before each row (one more entry than rows)."""
    starts, ends, ptr = t.words()
    if not len(starts):
        return np.zeros(0, U), np.zeros(t.n + 1, np.int64)
    hashes = t.hashes(starts, ends)
    lines = np.concatenate(([0], np.cumsum(t.data == 10)))[starts]
    last = (hashes % U(CUT) == 0) | (np.append(lines[1:] != lines[:-1], True))
    last[ptr[1:][ptr[1:] > 0] - 1] = True
    close = np.flatnonzero(last)
    first = np.concatenate(([0], close[:-1] + 1))
    a, b = starts[first], ends[close]
    row = np.searchsorted(ptr, first, "right") - 1
    if (b - a > LONGEST).any():  # longer ones are cut, so that 16 bits tell a length
        parts = -(-(b - a) // LONGEST)
        row, a, b = np.repeat(row, parts), np.repeat(a, parts) + spread(parts) * LONGEST, np.repeat(b, parts)
        b = np.minimum(a + LONGEST, b)
    first = np.arange(len(a))
    h = t.hashes(a, b)
    # How many equal paragraphs of the same row come before.
    order = np.lexsort((first, h, row))
    same = np.zeros(len(h), bool)
    same[1:] = (h[order][1:] == h[order][:-1]) & (row[order][1:] == row[order][:-1])
    head = np.flatnonzero(~same)
    nth = np.empty(len(h), np.int64)
    nth[order] = spread(np.diff(np.append(head, len(h))))
    digest = (mix(h + nth.astype(U) * U(0x9E3779B97F4A7C15)) & U(0xFFFFFFFFFFFF0000)) | (b - a).astype(U)
    return digest, np.searchsorted(row, np.arange(t.n + 1))


def weights(digests: np.ndarray) -> np.ndarray:
    return (digests & U(0xFFFF)).astype(np.int64)


def cells_of(digests: np.ndarray, cells: int) -> list[np.ndarray]:
    """One cell in each third of a sketch."""
    third = U(cells // 3)
    return [(mix(digests ^ U(seed)) % third).astype(np.int64) + k * (cells // 3) for k, seed in enumerate((0x1F83D9AB, 0x5BE0CD19, 0x3C6EF372))]


def check(digests: np.ndarray) -> np.ndarray:
    return mix(digests ^ U(0xA54FF53A)) & U(0xFFFFFFFF)


def sketches(digests: np.ndarray, row: np.ndarray, n: int, cells: int, sign: np.ndarray | int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts, digest sums and check sums of n sketches, flat; each digest is added (or with sign -1 taken away)."""
    count, total, proof = np.zeros(n * cells, np.int64), np.zeros(n * cells, U), np.zeros(n * cells, U)
    sign = np.broadcast_to(np.asarray(sign, np.int64), digests.shape)
    d, c = digests * sign.astype(U), check(digests) * sign.astype(U)
    for cell in cells_of(digests, cells):
        at = row * cells + cell
        np.add.at(count, at, sign)
        np.add.at(total, at, d)
        np.add.at(proof, at, c)
    return count, total, proof


def peel(count: np.ndarray, total: np.ndarray, proof: np.ndarray, n: int, cells: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, digest and sign of what the subtracted sketches hold, and which sketches came out empty (all of theirs recovered)."""
    rows, digests, signs = [], [], []
    look = np.flatnonzero(count != 0)
    while len(look):
        s = count[look]
        d = np.where(s == 1, total[look], U(0) - total[look])
        pure = (np.abs(s) == 1) & (np.where(s == 1, proof[look], U(0) - proof[look]) == check(d))
        look, s, d = look[pure], s[pure], d[pure]
        if not len(look):
            break
        row = look // cells
        _, once = np.unique(mix(d) ^ mix(row + 1), return_index=True)  # a digest may be alone in two of its cells
        s, d, row = s[once], d[once], row[once]
        rows.append(row)
        digests.append(d)
        signs.append(s)
        touched = []
        for cell in cells_of(d, cells):
            at = row * cells + cell
            np.add.at(count, at, -s)
            np.add.at(total, at, U(0) - d * s.astype(U))
            np.add.at(proof, at, U(0) - check(d) * s.astype(U))
            touched.append(at)
        look = np.unique(np.concatenate(touched))
        look = look[count[look] != 0]
    left = np.zeros(n, bool)
    left[np.flatnonzero((count != 0) | (total != 0)) // cells] = True
    join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
    return join(rows, np.int64), join(digests, U), join(signs, np.int64), ~left


def likeness(da: np.ndarray, pa_: np.ndarray, db: np.ndarray, pb: np.ndarray) -> np.ndarray:
    """Weighted Jaccard likeness of text i of the first digests and text i of the second, through subtraction and peeling."""
    n = len(pa_) - 1
    na, nb = np.diff(pa_), np.diff(pb)
    ra, rb = np.repeat(np.arange(n), na), np.repeat(np.arange(n), nb)
    wa, wb = (np.bincount(r, w, n) for r, w in ((ra, weights(da)), (rb, weights(db))))
    out = np.zeros(n)
    todo, cells = np.arange(n), CELLS
    while len(todo):
        if cells > MOST_CELLS * max(int((na + nb)[todo].max()), CELLS):
            # Larger sketches don't help where digests of one text are equal by chance: those are compared themselves.
            for i in todo.tolist():
                one, two = da[pa_[i] : pa_[i + 1]], db[pb[i] : pb[i + 1]]
                found, which = np.unique(np.concatenate((one, two)), return_inverse=True)
                left = np.bincount(which, np.concatenate((np.ones(len(one)), -np.ones(len(two)))), len(found)) * weights(found)
                both = (wa[i] + wb[i] - np.abs(left).sum()) / 2
                out[i] = both / max(wa[i] + wb[i] - both, 1)
            break
        place = np.full(n, -1)
        place[todo] = np.arange(len(todo))
        ka, kb = place[ra] >= 0, place[rb] >= 0
        d = np.concatenate((da[ka], db[kb]))
        sign = np.concatenate((np.ones(ka.sum(), np.int64), np.full(kb.sum(), -1, np.int64)))
        row, found, s, ok = peel(*sketches(d, place[np.concatenate((ra[ka], rb[kb]))], len(todo), cells, sign), len(todo), cells)
        only_a, only_b = (np.bincount(row[s == k], weights(found[s == k]), len(todo)) for k in (1, -1))
        a, b = wa[todo], wb[todo]
        both = (a - only_a + b - only_b) / 2
        either = a + b - both
        out[todo[ok]] = np.where(either[ok] > 0, both[ok] / np.maximum(either[ok], 1), 1.0)
        todo = todo[~ok]
        cells *= 4
    return np.clip(out, 0, 1)


def written(t: Texts, digests: np.ndarray, ptr: np.ndarray) -> list[str]:
    """The fingerprint as text: paragraphs, total weight, then count (4 bytes), digest sum (8) and check sum (4) of each cell, in hex."""
    row = np.repeat(np.arange(t.n), np.diff(ptr))
    count, total, proof = (x.reshape(t.n, CELLS) for x in sketches(digests, row, t.n, CELLS))
    weight = np.bincount(row, weights(digests), t.n).astype(np.int64)
    raw = np.concatenate([count.astype(np.int32).view(np.uint8).reshape(t.n, -1), total.view(np.uint8).reshape(t.n, -1), proof.astype(np.uint32).view(np.uint8).reshape(t.n, -1)], axis=1)
    return [f"{n}.{w}.{raw[i].tobytes().hex()}" for i, (n, w) in enumerate(zip(np.diff(ptr), weight, strict=True))]


def edited(text: str, following: str) -> str:
    """The last floor(n/2) code points replaced by the first as many (or all) of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compared(ids: list, texts: list[str], following: list[str]) -> pa.RecordBatch:
    changed = [edited(a, b) for a, b in zip(texts, following, strict=True)]
    raw = [x.encode() for x in changed]
    kinds = []
    for t in (Texts.of([x.encode() for x in texts]), Texts.of(raw), Texts.of([x.encode() for x in following])):
        digests, ptr = paragraphs(t)
        kinds.append((t, digests, ptr))
    (t, d, p), (te, de, pe), (_, df, pf) = kinds
    return record(
        doc_id=pa.array(ids, pa.int64()), n_chars=pa.array([len(x) for x in texts], pa.int64()), edited_sha256=[hashlib.sha256(x).hexdigest() for x in raw],
        fingerprint=written(t, d, p), edited_fingerprint=written(te, de, pe), near_edited=likeness(d, p, de, pe), near_next=likeness(d, p, df, pf),
    )


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text), compared with its edited version and with the next row by doc_id.

    The last row's next one is the first. Rows without doc_id come before all others; rows with equal doc_id are ordered by text. A
    null text counts as empty; two texts without words are alike (1), one with and one without aren't (0). The only row of a table
    is its own next one. An empty table gives an empty result. Equal texts have equal fingerprints.

    The table is cut into ranges of doc_id at some of its ids; the rows at a cut also go to the range before it, as the next ones of
    its last row, so one exchange is enough and each task reads one range in order.
    """
    spark = docs.sparkSession
    docs = documents(docs).select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("k"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    ranges = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # The ranges' first ids: as many numbers as there are partitions, whatever the input.
    cuts = docs.agg(F.min("k"), F.percentile_approx("k", [i / ranges for i in range(1, ranges)] or [0.5], 10_000)).first()
    bounds = sorted({cuts[0], *(cuts[1] or [])} - {None})
    if not bounds:
        return spark.createDataFrame([], SCHEMA)
    at = np.array(bounds, np.int64)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k = b.column(0).to_numpy(zero_copy_only=False)
            own = np.searchsorted(at, k, "right") - 1
            first = np.flatnonzero(at[own] == k)  # also the next rows of the range before
            rows = np.concatenate((np.arange(len(k)), first))
            part = np.concatenate((own, (own[first] - 1) % len(at)))
            late = np.concatenate((np.zeros(len(k), bool), np.ones(len(first), bool)))
            taken = b.take(pa.array(rows))
            yield record(part=pa.array(part, pa.int32()), late=late, k=taken.column(0), doc_id=taken.column(1), text=taken.column(2))

    dealt = docs.mapInArrow(deal, "part int, late boolean, k long, doc_id long, text string")
    dealt = dealt.repartitionById(len(at), F.col("part")).sortWithinPartitions("part", "late", "k", "text")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # a row whose next one hasn't come yet
        ids, texts, following, size = [], [], [], 0
        for b in batches:
            for part, late, doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True):
                if held is not None and held[0] == part:
                    ids.append(held[1])
                    texts.append(held[2])
                    following.append(text)
                    size += len(held[2])
                    if size >= GATHER:
                        yield compared(ids, texts, following)
                        ids, texts, following, size = [], [], [], 0
                held = None if late else (part, doc_id, text)
        if ids:
            yield compared(ids, texts, following)

    return dealt.mapInArrow(compare, SCHEMA)


def op1_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(read_table(spark, sf_dir, "documents"))
