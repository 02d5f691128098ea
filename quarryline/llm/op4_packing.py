"""Best-fit packing of token pieces into sequences of a fixed length.

Texts are tokenised, each followed by the end id; longer ones are cut. The packer is online and bounded: it keeps a fixed number of
open bins, found by a bitset keyed by free space. A piece goes to the open bin with the least free space that holds it; without one, a
new bin is opened, and when too many are open the fullest closes first.

Each task packs what it reads (within a slice of rows, the largest pieces come first). The bins that are still open at a task's end are
packed once more, as items, in groups of tasks, so what is left over doesn't grow with the number of tasks.
"""

from __future__ import annotations

import itertools
import os
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scan import Texts, cache, documents, ranges, read_table, record, slices, stored

LENGTH = 2048
END_ID = 0
OPEN_BINS = 512
#: Tasks whose open bins are packed together once more.
GROUP = 64


class Packer:
    """Bounded-space online best-fit. ``put`` gives the bin and the place in it."""

    def __init__(self, length: int, open_bins: int):
        self.length, self.open_bins = length, open_bins
        self.free = 0  # bit f is set if an open bin has f free places
        self.bins: list[list[int]] = [[] for _ in range(length + 1)]
        self.n_open = 0
        self.made = 0

    def put(self, size: int) -> tuple[int, int]:
        fit = self.free >> size
        if fit:
            space = size + (fit & -fit).bit_length() - 1
            name = self.take(space)
        else:
            if self.n_open >= self.open_bins:
                self.take((self.free & -self.free).bit_length() - 1)  # the fullest closes
            space, name = self.length, self.made
            self.made += 1
        if space > size:
            self.bins[space - size].append(name)
            self.free |= 1 << (space - size)
            self.n_open += 1
        return name, self.length - space

    def take(self, space: int) -> int:
        name = self.bins[space].pop()
        if not self.bins[space]:
            self.free &= ~(1 << space)
        self.n_open -= 1
        return name

    def left(self) -> dict[int, int]:
        """Free space of each open bin."""
        return {name: space for space, names in enumerate(self.bins) for name in names}


def encoder(tokenizer: str):
    kept = cache()
    if ("ids", tokenizer) not in kept:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(tokenizer)
        model.no_truncation()
        model.no_padding()
        kept["ids", tokenizer] = lambda texts: [x.ids for x in model.encode_batch_fast(texts, add_special_tokens=False)]
    return kept["ids", tokenizer]


class WordEncoder:
    """Token ids of texts, for tokenizers that drop white space and never join over it: the ids of a text are those of its words, one
    after the other. Each distinct word is encoded once and kept, up to a number of bytes."""

    MOST = 40 << 20

    def __init__(self, tokenizer: str):
        self.encode = encoder(tokenizer)
        self.forget()

    def forget(self) -> None:
        self.hashes, self.starts, self.counts, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.uint32), np.zeros(0, np.uint16)

    def __call__(self, t: Texts) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids, and the number of ids before each row."""
        starts, ends, ptr = t.words()
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(t.n + 1, np.int64)
        values, first, inverse = np.unique(t.word_hashes(), return_index=True, return_inverse=True)
        at = np.searchsorted(self.hashes, values)
        known = np.zeros(len(values), bool)
        inside = at < len(self.hashes)
        known[inside] = self.hashes[at[inside]] == values[inside]
        new = np.flatnonzero(~known)
        if len(new):
            raw = t.data.tobytes()
            got = self.encode([raw[a:b].decode(errors="replace") for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)])
            counts = np.array([len(x) for x in got], np.uint32)
            flat = np.fromiter(itertools.chain.from_iterable(got), np.uint32, int(counts.sum()))
            if len(self.hashes) * 16 + self.ids.nbytes > self.MOST and len(self.hashes):
                self.forget()
                return self(t)
            begin = (len(self.ids) + np.cumsum(counts) - counts).astype(np.uint32)
            order = np.argsort(np.concatenate((self.hashes, values[new])), kind="stable")
            self.hashes = np.concatenate((self.hashes, values[new]))[order]
            self.starts = np.concatenate((self.starts, begin))[order]
            self.counts = np.concatenate((self.counts, counts))[order]
            self.ids = np.concatenate((self.ids, flat.astype(self.ids.dtype) if flat.max(initial=0) <= np.iinfo(self.ids.dtype).max else flat))
            at = np.searchsorted(self.hashes, values)
        counts = self.counts[at][inverse].astype(np.int64)
        upto = np.concatenate(([0], np.cumsum(counts)))
        return self.ids[ranges(self.starts[at][inverse].astype(np.int64), counts)].astype(np.uint32), upto[ptr]


SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, task int, free int"


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, end_id: int = END_ID, open_bins: int = OPEN_BINS, words: bool = False) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is one piece of the end id alone. Repeated rows are packed as often as they occur; a null doc_id passes
    through; an empty table gives an empty result. ``words`` says that the tokenizer treats words apart (see ``WordEncoder``).
    """

    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        packer = Packer(length, open_bins)
        whole = encoder(tokenizer)

        def encode(t: Texts) -> tuple[np.ndarray, np.ndarray]:
            got = whole([t.data[a:b].tobytes().decode(errors="replace") for a, b in zip(t.offsets[:-1], t.offsets[1:], strict=True)])
            upto = np.concatenate(([0], np.cumsum([len(x) for x in got], dtype=np.int64)))
            return np.fromiter((i for x in got for i in x), np.uint32, upto[-1]), upto

        if words:
            encode = cache().setdefault(("words", tokenizer), None) or WordEncoder(tokenizer)
            cache()["words", tokenizer] = encode
        for batch in batches:
            for part, texts in slices(batch):
                ids, upto = encode(texts)
                pieces = []
                for doc, a, b in zip(part.column(0).to_pylist(), upto[:-1].tolist(), upto[1:].tolist(), strict=True):
                    own = np.append(ids[a:b], end_id).astype("<u4")
                    pieces += [(doc, k // length, k, len(own[k : k + length]), zlib.crc32(own[k : k + length].tobytes())) for k in range(0, len(own), length)]
                pieces.sort(key=lambda p: -p[3])
                columns = list(zip(*((*p, *packer.put(p[3])) for p in pieces), strict=True))
                arrays = [pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int32(), *(pa.int64(),) * 5), strict=True)]
                arrays[5] = pa.array(np.array(columns[5], np.int64) + (task << 32))
                yield pa.RecordBatch.from_arrays([*arrays, pa.nulls(len(pieces), pa.int32()), pa.nulls(len(pieces), pa.int32())], names=names)
        # At last, the bins that are still open; a row without a piece for each.
        left = packer.left()
        if left:
            none = [pa.nulls(len(left), k) for k in (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())]
            bins = pa.array(np.array(list(left), np.int64) + (task << 32))
            yield pa.RecordBatch.from_arrays([*none, bins, pa.nulls(len(left), pa.int64()), pa.array(np.full(len(left), task, np.int32)), pa.array(list(left.values()), pa.int32())], names=names)

    written = stored(documents(docs).mapInArrow(run, SCHEMA), "pieces")
    pieces = written.where("piece IS NOT NULL")
    bins = written.where("free > 0").select("sequence_id", "free", F.floor(F.col("task") / GROUP).alias("grp"))

    def again(table: pa.Table) -> pa.Table:
        """Bins as items, largest first; a group has at most GROUP * open_bins of them."""
        rows = sorted(zip(table["free"].to_pylist(), table["sequence_id"].to_pylist(), strict=True))
        packer, names, out = Packer(length, len(rows) + 1), {}, []
        for free, seq in rows:
            name, at = packer.put(length - free)
            out.append((seq, names.setdefault(name, seq), at))
        return pa.table({"sequence_id": pa.array([x[0] for x in out], pa.int64()), "joined": pa.array([x[1] for x in out], pa.int64()), "shift": pa.array([x[2] for x in out], pa.int64())})

    moved = bins.groupBy("grp").applyInArrow(again, "sequence_id long, joined long, shift long")
    out = pieces.join(moved, "sequence_id", "left")
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", F.coalesce("joined", "sequence_id").alias("sequence_id"), (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset"))


def pack_documents(docs: DataFrame) -> DataFrame:
    """The packing that the query and the pipeline use."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), words=True)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read_table(spark, sf_dir, "documents"))
