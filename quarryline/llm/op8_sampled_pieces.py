"""SentencePiece segmentations sampled by forward filtering and backward sampling, and lossless decoding.

The lattice of a text has its byte positions as nodes and the pieces that match there as edges (characters without a piece of their
own fall back to byte pieces). A piece's log-probability falls with its rank in the vocabulary (Zipf), sharpened by ``alpha``. Forward
filtering sums the weights of all segmentations that end at a node; backward sampling then draws the last piece, the one before it,
and so on. The random number at a node is a hash of the row's key, the seed and the node's place in the text, so a row gets the same
segmentation wherever and whenever it is encoded.

No piece reaches over the start of a run of spaces or over a line end, so the lattice falls apart into words there: each distinct word
of a slice is filtered once (or was before: a worker keeps the lattices of words that come again), and all of its occurrences are
sampled from that, in steps for all words at the same time; very long ones are taken alone. Probabilities are multiples of 2**-32.
"""

from __future__ import annotations

import itertools
import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .scan import Texts, U, cache, documents, mix, powers, ranges, read_table, record, slices

#: Sharpness of the sampling distribution: 0 is uniform over segmentations, larger values come closer to the best one.
ALPHA = 1.0
SEED = 17
SPACE = 32
#: Bytes of text whose distinct words are filtered together.
SLICE = 3 << 16
#: Size of the lookup tables, as a power of two.
BITS = 21
#: Units of more bytes are filtered and sampled each on its own, node by node, in blocks of so many nodes.
LONG, BLOCK = 1 << 10, 1 << 15


@dataclass
class Vocabulary:
    keys: np.ndarray  # hashes of the normal pieces' bytes and of all that they start with
    ids: np.ndarray  # their ids, -1 for a mere prefix
    slots: np.ndarray  # two hash tables from some bits of a hash to its place in keys
    longest: int  # bytes of the longest piece
    byte_ids: np.ndarray  # id of each byte piece
    log_p: np.ndarray  # by id
    bytes_of: np.ndarray  # all pieces' bytes, flat
    begin: np.ndarray  # of each id in it
    newline: bool  # whether a line end is in no normal piece
    space: bool  # whether spaces are at the start of pieces only


def slot(hashes: np.ndarray, k: int) -> np.ndarray:
    return (hashes >> U((64 - BITS) * (1 - k))) & U((1 << BITS) - 1)


def vocabulary(tokenizer: str) -> Vocabulary:
    kept = cache()
    if ("pieces", tokenizer) in kept:
        return kept["pieces", tokenizer]
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=tokenizer)
    raw, normal, byte_ids = [], [], np.zeros(256, np.int64)
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            raw.append(bytes([int(piece[3:5], 16)]))
            byte_ids[int(piece[3:5], 16)] = i
        elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            raw.append(b"")
        else:
            raw.append(piece.replace("▁", " ").encode())
            normal.append(i)
    own = [raw[i] for i in normal]
    known = {x: -1 for piece in own for x in (piece[:k] for k in range(1, len(piece)))} | dict(zip(own, normal, strict=True))
    t = Texts.of(list(known))
    keys = t.hashes(t.offsets[:-1], t.offsets[1:])
    slots = np.zeros((2, 1 << BITS), np.int32)
    left = np.arange(len(keys))
    for k in range(2):  # the few keys that another one displaces from the first table find a place in the second
        slots[k, slot(keys[left], k)] = left
        left = left[slots[k, slot(keys[left], k)] != left]
    assert not len(left), "the tables are too small for this vocabulary"
    log_p = np.full(len(raw), -30.0)
    log_p[normal] = -np.log(np.arange(len(normal)) + 2.7)  # ids are in the order of ranks
    log_p[byte_ids] = -np.log(len(raw)) - 2.0
    kept["pieces", tokenizer] = Vocabulary(
        keys, np.array(list(known.values())), slots, max(map(len, own)), byte_ids, log_p,
        np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(x) for x in raw]))),
        not any(b"\n" in x for x in own), not any(b" " in x.lstrip(b" ") for x in own),
    )
    return kept["pieces", tokenizer]


def lookup(v: Vocabulary, hashes: np.ndarray) -> np.ndarray:
    """Place of each hash among the keys, or -1."""
    at = v.slots[0, slot(hashes, 0)]
    wrong = np.flatnonzero(v.keys[at] != hashes)
    other = v.slots[1, slot(hashes[wrong], 1)]
    at[wrong] = np.where(v.keys[other] == hashes[wrong], other, -1)
    return at


def prefixed(t: Texts) -> Texts:
    """A space before each text that isn't empty."""
    size = np.diff(t.offsets)
    more = (size > 0).astype(np.int64)
    offsets = np.concatenate(([0], np.cumsum(size + more)))
    data = np.full(offsets[-1], SPACE, np.uint8)
    data[ranges(offsets[:-1] + more, size)] = t.data
    return Texts(data, offsets)


def units(t: Texts, v: Vocabulary) -> np.ndarray:
    """Places at which the lattice falls apart: starts of runs of spaces, line ends and what follows them, starts of texts."""
    d = t.data
    cut = np.zeros(len(d), bool)
    if v.space:
        cut |= d == SPACE
        cut[1:] &= d[:-1] != SPACE
    if v.newline:
        line = d == 10
        cut |= line
        cut[1:] |= line[:-1]
    cut[t.offsets[:-1][np.diff(t.offsets) > 0]] = True
    return np.flatnonzero(cut)


def edges(t: Texts, v: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and piece of each edge of the lattices of some units (the rows of t)."""
    n = len(t.data)
    stop = np.repeat(t.offsets[1:], np.diff(t.offsets))
    head = (t.data & 0xC0) != 0x80
    begin = np.flatnonzero(head)
    width = np.diff(np.append(begin, n))
    after = np.zeros(n, np.int64)  # where the character that starts here ends
    after[begin] = begin + width
    starts, ends, pieces = [], [], []
    alone = np.zeros(n, bool)  # characters that are pieces themselves
    at, code, room, bytes_, up = begin, np.zeros(len(begin), U), (stop - np.arange(n))[begin], t.data.astype(U) + U(1), powers()[0]
    for size in range(1, v.longest + 1):  # only places where some piece may still go on
        inside = room >= size
        if not inside.all():
            at, code, room = at[inside], code[inside], room[inside]
        if not len(at):
            break
        code = code + bytes_[at + size - 1] * up[size - 1]  # the hash of a byte range, one byte longer each time
        found = lookup(v, mix(code ^ (U(size) << U(48))))
        go = np.flatnonzero(found >= 0)
        at, code, room, found = at[go], code[go], room[go], v.ids[found[go]]
        ok = found >= 0
        starts.append(at[ok])
        ends.append(at[ok] + size)
        pieces.append(found[ok])
        one = at[ok]
        alone[one[one + size == after[one]]] = True
    rest = ~np.repeat(alone[begin], width) if n else np.zeros(0, bool)
    at = np.flatnonzero(rest)
    starts.append(at)
    ends.append(at + 1)
    pieces.append(v.byte_ids[t.data[at]])
    return np.concatenate(starts), np.concatenate(ends), np.concatenate(pieces)


def filtered(t: Texts, v: Vocabulary, alpha: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Forward filtering. For the edges in the order of their ends: end, last random number (of 2**32) that draws the edge given its end,
    start, and piece. Every edge has one random number at least. Weights are summed as whole numbers, so an edge's numbers don't hang on
    what else is in the slice."""
    starts, ends, pieces = edges(t, v)
    size = np.diff(t.offsets)
    base = np.repeat(t.offsets[:-1], size)
    depth = np.where(np.repeat(size > LONG, size)[ends - 1], 0, ends - base[ends - 1])
    order = np.argsort((depth << 38) | (ends << 6) | (ends - starts))
    s, e, p = starts[order], ends[order], pieces[order]
    layer = np.searchsorted(depth[order], np.arange(1, (depth.max() if len(depth) else 0) + 2))
    first = s == base[s]
    score = np.full(len(t.data) + 1, 0.0)
    last = np.empty(len(s), np.uint32)
    w = alpha * v.log_p[p]
    if layer[0]:
        far = slice(0, layer[0])
        last[far] = along(e[far], s[far], w[far], first[far], v.longest)
    for a, b in zip(layer[:-1].tolist(), layer[1:].tolist(), strict=True):
        if a == b:
            continue
        value = w[a:b] + np.where(first[a:b], 0.0, score[s[a:b]])
        node = e[a:b]
        heads = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1])))
        tails = np.append(heads[1:], b - a) - 1
        sizes = tails - heads + 1
        top = np.maximum.reduceat(value, heads)
        run = np.cumsum((np.exp(value - np.repeat(top, sizes)) * 2.0**52).astype(np.int64))  # differences are right even if it wraps
        before = np.concatenate(([0], run[tails[:-1]]))
        total = (run[tails] - before).astype(np.float64)
        share = (run - np.repeat(before, sizes)) / np.repeat(total, sizes)
        last[a:b] = (share * np.repeat(2.0**32 - sizes, sizes)).astype(np.int64) + (np.arange(b - a) - np.repeat(heads, sizes))
        score[node[heads]] = top + np.log(total * 2.0**-52)
    # From the order of layers to the order of ends: the edges of a node stay together.
    heads = np.flatnonzero(np.diff(e, prepend=-1))
    sizes = np.diff(np.append(heads, len(e)))
    by_end = ranges(heads[rank := np.argsort(e[heads])], sizes[rank])
    return e[by_end], last[by_end], s[by_end], p[by_end]


def along(e: np.ndarray, s: np.ndarray, w: np.ndarray, first: np.ndarray, longest: int) -> np.ndarray:
    """``last`` of ``filtered`` for edges in the order of their ends, node by node: few edges end at a node, so steps over arrays don't pay.
    Only the scores that an edge may still start from are held."""
    last = np.empty(len(e), np.uint32)
    ring = [0.0] * (longest + 1)
    bounds = np.append(np.flatnonzero(np.diff(e, prepend=-1)), len(e))
    for h in range(0, len(bounds) - 1, BLOCK):
        cut = bounds[h : h + BLOCK + 1]
        span = slice(cut[0], cut[-1])
        weight, begin, top_edge, node = w[span].tolist(), (s[span] % len(ring)).tolist(), first[span].tolist(), (e[cut[:-1]] % len(ring)).tolist()
        found = []
        for at, (a, b) in zip(node, itertools.pairwise((cut - cut[0]).tolist()), strict=True):
            value = [weight[i] if top_edge[i] else weight[i] + ring[begin[i]] for i in range(a, b)]
            top = max(value)
            run = list(itertools.accumulate(int(math.exp(x - top) * 2.0**52) for x in value))
            total, room = run[-1], 2.0**32 - len(value)
            found += [int(x / total * room) + i for i, x in enumerate(run)]
            ring[at] = top + math.log(total * 2.0**-52)
        last[span] = found
    return last


class Lattices:
    """Filtered lattices of units, kept by the units' hashes for the worker's life, up to a number of edges. When there is no more room,
    those go that weren't asked for again since the last time. What is kept changes no result."""

    MOST = 4 << 20

    def __init__(self, v: Vocabulary, alpha: float):
        self.v, self.alpha = v, alpha
        self.hashes, self.begin, self.count, self.used = np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
        self.n = 0
        # By edge: end and start in the unit, last random number, piece.
        self.edges = tuple(np.zeros(self.MOST, kind) for kind in (np.uint16, np.uint32, np.uint16, np.uint32))

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of sorted hashes among those that are kept, and which of them are there."""
        at = np.searchsorted(self.hashes, hashes)
        known = np.zeros(len(hashes), bool)
        inside = at < len(self.hashes)
        known[inside] = self.hashes[at[inside]] == hashes[inside]
        return at, known

    def sweep(self) -> None:
        """Keeps what was used again since the last time, or nothing if that is more than half of the room."""
        stay = self.used if self.count[self.used].sum() <= self.MOST // 2 else np.zeros(len(self.used), bool)
        order = np.flatnonzero(stay)
        order = order[np.argsort(self.begin[order])]
        at = ranges(self.begin[order], self.count[order])
        for column in self.edges:
            column[: len(at)] = column[at]
        self.begin[order] = np.cumsum(self.count[order]) - self.count[order]
        self.n = len(at)
        self.hashes, self.begin, self.count = self.hashes[stay], self.begin[stay], self.count[stay]
        self.used = np.zeros(len(self.hashes), bool)

    def add(self, t: Texts, hashes: np.ndarray, starts: np.ndarray, size: np.ndarray) -> bool:
        """Filters the units that aren't kept yet; False if there is no room for all."""
        at, known = self.find(hashes)
        self.used[at[known]] = True
        if known.all():
            return True
        new = np.flatnonzero(~known)
        if size.max() >= 1 << 16 or size[new].sum() > 4 * SLICE:
            return False
        own = Texts(t.data[ranges(starts[new], size[new])], np.concatenate(([0], np.cumsum(size[new]))))
        end, last, start, piece = filtered(own, self.v, self.alpha)
        if self.n + len(end) > self.MOST:
            self.sweep()
            at, known = self.find(hashes)
            if self.n + len(end) > self.MOST or len(new) + known.sum() < len(hashes):
                return False
        count = np.diff(np.searchsorted(end, own.offsets, "right"))
        base = np.repeat(own.offsets[:-1], count)
        for column, values in zip(self.edges, (end - base, last, start - base, piece), strict=True):
            column[self.n : self.n + len(values)] = values
        at = at[new]
        self.begin = np.insert(self.begin, at, self.n + np.cumsum(count) - count)
        self.hashes, self.count, self.used = np.insert(self.hashes, at, hashes[new]), np.insert(self.count, at, count), np.insert(self.used, at, False)
        self.n += len(end)
        return True

    def of(self, t: Texts, hashes: np.ndarray, starts: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Edges of units with these (sorted, distinct) hashes: end and last random number as one sorted key, start, piece. The units'
        nodes are numbered through."""
        offsets = np.cumsum(size) - size
        if self.add(t, hashes, starts, size):
            at, _ = self.find(hashes)
            count = self.count[at]
            at = ranges(self.begin[at], count)
            end, last, start, piece = (column[at] for column in self.edges)
            base = np.repeat(offsets, count)
            end, start = end + base, start + base
        else:
            end, last, start, piece = filtered(Texts(t.data[ranges(starts, size)], np.append(offsets, size.sum())), self.v, self.alpha)
        return (end.astype(U) << U(32)) | last, start, piece


def drawn(salt: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Random numbers below 2**32 of places in texts."""
    return mix(salt ^ (place.astype(U) * U(0x9E3779B97F4A7C15))) >> U(32)


def sample(texts: Texts, keys: np.ndarray, v: Vocabulary, alpha: float, seed: int, known: Lattices | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Flat piece ids, and the number of pieces before each row."""
    t = prefixed(texts)
    if not len(t.data):
        return np.zeros(0, np.uint32), np.zeros(t.n + 1, np.int64)
    starts = units(t, v)
    ends = np.append(starts[1:], len(t.data))
    hashes, first, which = np.unique(t.hashes(starts, ends), return_index=True, return_inverse=True)
    size = (ends - starts)[first]
    upto, back, piece = (known or Lattices(v, alpha)).of(t, hashes, starts[first], size)
    order = np.argsort(which)  # neighbours read the same part of the tables
    starts, which = starts[order], which[order]
    row = np.searchsorted(t.offsets, starts, "right") - 1
    salt = mix(mix(keys.astype(np.int64).view(U)) ^ U(seed))[row]
    origin = (np.cumsum(size) - size)[which]
    node = origin + size[which]
    shift = starts - origin  # from the unit's node to the place in the slice
    inside = starts - t.offsets[row] - origin  # and to the place in the text
    out = np.full(len(t.data), -1, np.int64)
    far = node - origin > LONG
    for i in np.flatnonzero(far).tolist():  # edges are drawn for all nodes of a block, then followed
        here, low = int(node[i]), int(origin[i])
        while here > low:
            a = max(low, here - BLOCK)
            nodes = np.arange(a + 1, here + 1)
            e = np.searchsorted(upto, (nodes.astype(U) << U(32)) | drawn(salt[i], nodes + inside[i]))
            before, way = back[e].tolist(), []
            while here > a:
                way.append(here - a - 1)
                here = before[way[-1]]
            out[back[e[way]] + shift[i]] = piece[e[way]]
    near = ~far
    node, origin, shift, inside, salt = node[near], origin[near], shift[near], inside[near], salt[near]
    while len(node):
        e = np.searchsorted(upto, (node.astype(U) << U(32)) | drawn(salt, node + inside))
        node = back[e]
        out[node + shift] = piece[e]
        go = node > origin
        node, origin, shift, inside, salt = node[go], origin[go], shift[go], inside[go], salt[go]
    return out[out >= 0].astype(np.uint32), np.concatenate(([0], np.cumsum(out >= 0)))[t.offsets]


def lattices(tokenizer: str, alpha: float) -> Lattices:
    kept = cache()
    if ("lattices", tokenizer, alpha) not in kept:
        kept["lattices", tokenizer, alpha] = Lattices(vocabulary(tokenizer), alpha)
    return kept["lattices", tokenizer, alpha]


def joined(ids: np.ndarray, upto: np.ndarray, v: Vocabulary) -> Texts:
    """The texts of some rows of ids: the pieces' bytes without the first space."""
    counts = v.begin[ids + 1] - v.begin[ids]
    data = v.bytes_of[ranges(v.begin[ids], counts)]
    offsets = np.concatenate(([0], np.cumsum(counts)))[upto]
    full = np.diff(offsets) > 0
    keep = np.ones(len(data), bool)
    keep[offsets[:-1][full]] = False
    return Texts(data[keep], offsets - np.concatenate(([0], np.cumsum(full))))


def encode(docs: DataFrame, tokenizer: str, alpha: float = ALPHA, seed: int = SEED) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, ids (unsigned 32-bit, little-endian), n_pieces, ids_crc32, lossless
    (whether decoding the ids gives the text again).

    A null or empty text has no pieces. The segmentation depends on doc_id, text and seed only, so repeated rows get equal ones and
    equal texts of different doc_id need not; a null doc_id counts as 0. An empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, known = vocabulary(tokenizer), lattices(tokenizer, alpha)
        for batch in batches:
            for part, texts in slices(batch, size=SLICE):
                keys = part.column(0).fill_null(0).to_numpy()
                ids, upto = sample(texts, keys, v, alpha, seed, known)
                again = joined(ids, upto, v)
                same = np.diff(again.offsets) == np.diff(texts.offsets)
                if len(again.data) == len(texts.data):
                    wrong = np.concatenate(([0], np.cumsum(again.data != texts.data)))[texts.offsets]
                    same &= np.diff(wrong) == 0
                raw = [ids[a:b].astype("<u4").tobytes() for a, b in zip(upto[:-1], upto[1:], strict=True)]
                yield record(doc_id=part.column(0), ids=pa.array(raw, pa.binary()), n_pieces=np.diff(upto), ids_crc32=pa.array([zlib.crc32(x) for x in raw], pa.int64()), lossless=same)

    return documents(docs).mapInArrow(run, "doc_id long, ids binary, n_pieces long, ids_crc32 long, lossless boolean")


def decode(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """Text of each row of (doc_id, ids); null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(tokenizer)
        for batch in batches:
            lists = [np.frombuffer(x or b"", "<u4") for x in batch.column(1).to_pylist()]
            t = joined(np.concatenate(lists) if lists else np.zeros(0, np.uint32), np.concatenate(([0], np.cumsum([len(x) for x in lists], dtype=np.int64))), v)
            yield record(doc_id=batch.column(0), text=pa.array([t.data[a:b].tobytes().decode(errors="replace") for a, b in zip(t.offsets[:-1], t.offsets[1:], strict=True)], pa.string()))

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def op8_sampled_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(read_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
