"""Language identification by nearest centroids.

A text becomes a vector of hashed byte n-grams (1 to 3 bytes of lower-cased letters, anything between words as one space), weighted by TF-IDF and scaled to length 1. Each
language has several centroids (spherical k-means), and a text gets the language of the centroid with the largest cosine. A text
whose cosine is below what labelled texts of that language show is marked as not accepted (distance-based rejection). The floors are
calibrated by cross-fitting: centroids of one half of the labelled rows, cosines of the other half and of short pieces of it. Cosines
grow with the number of distinct n-grams, so each size of a text has its own floor.

The model is fitted on a bounded sample of labelled rows: about ``PER_LANGUAGE`` for each language, chosen by a hash of doc_id. Every
language that has a row is learned, each in a task of its own; the driver gets the centroids and floors, about 65 KB for a language.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scan import Scratch, Texts, blobs, documents, map_slices, read_table, record

#: Labelled rows of each language that the model is fitted on, about.
PER_LANGUAGE = 250
CENTROIDS = 4
#: Length of the hashed vectors.
SIZE = 4096
#: A text is rejected when its cosine is below this share of a low quantile of the cosines of labelled texts of its language and size.
SLACK, QUANTILE = 0.8, 0.01
#: Sizes are powers of two of the number of distinct n-grams; a floor is taken from at least so many texts.
SIZES, LEAST = 13, 40
#: Bytes of the pieces of labelled texts that stand for short texts; one piece of each, in turn.
PIECES = (8, 16, 32, 64, 128, 256)


@dataclass
class Model:
    languages: list[str]  # of each centroid
    idf: np.ndarray
    centroids: np.ndarray  # SIZE x number of centroids
    floors: np.ndarray  # least accepted cosine: a row for each centroid, a column for each size


def letters(t: Texts) -> Texts:
    """Lower-cased (ASCII and Latin-1) texts in which each run of other ASCII characters is one space."""
    d = t.lowered().data.copy()
    after = np.zeros(len(d), bool)
    after[1:] = d[:-1] == 0xC3
    d[after & (d >= 0x80) & (d <= 0x9E) & (d != 0x97)] += 0x20
    space = (d < 128) & ((d < 97) | (d > 122))
    d[space] = 32
    keep = np.ones(len(d), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    at = t.offsets[:-1][np.diff(t.offsets) > 0]
    keep[at] = True
    return Texts(d[keep], np.concatenate(([0], np.cumsum(keep)))[t.offsets])


def vectors(t: Texts) -> np.ndarray:
    """Counts of hashed n-grams, a row for each text; n-grams don't cross rows. Long texts are counted in parts, whole."""
    t = letters(t)
    d = t.data.astype(np.uint32)
    out = np.zeros((t.n, SIZE), np.float32)
    code, shift = np.zeros(len(d), np.uint32), np.uint32(32 - SIZE.bit_length() + 1)
    for n in (1, 2, 3):
        if len(d) < n:
            break
        code = (code[: len(d) - n + 1] << np.uint32(8)) | d[n - 1 :]
        slot = ((code + np.uint32(n << 24)) * np.uint32(2654435761)) >> shift
        for row in range(t.n):
            a, b = t.offsets[row], t.offsets[row + 1] - n + 1
            if b > a:
                out[row] += np.bincount(slot[a:b], minlength=SIZE)
    return out


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Sub-linear TF times IDF, scaled to length 1 (a text without n-grams stays 0)."""
    x = np.log1p(counts) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def sizes_of(counts: np.ndarray) -> np.ndarray:
    """The power of two of the number of distinct n-grams of each row."""
    return np.minimum(np.log2(np.maximum((counts > 0).sum(axis=1), 1)).astype(int), SIZES - 1)


def centroids(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Spherical k-means of one language's rows; deterministic, as the rows come in a fixed order."""
    own = weighted(counts, idf)
    k = min(CENTROIDS, len(own))
    c = own[np.linspace(0, len(own) - 1, k).astype(int)]
    for _ in range(10):
        near = (own @ c.T).argmax(axis=1)
        c = np.stack([own[near == j].mean(axis=0) if (near == j).any() else c[j] for j in range(k)])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def floor(cos: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Least accepted cosine of each size, from those of labelled texts: of a size and, if there are too few, also of its neighbours.

    With fewer than ``LEAST`` texts in all, of all of them; without any, everything is accepted.
    """
    out = np.zeros(SIZES)
    for k in range(SIZES if len(cos) else 0):
        near = np.abs(size - k)
        reach = np.sort(near)[min(LEAST, len(near)) - 1]
        out[k] = SLACK * np.quantile(cos[near <= reach], QUANTILE)
    return out


def learned(counts: np.ndarray, pieces: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centroids of all rows of a language, and its floors, from rows and ``pieces`` (one of each row) that centroids of the other half
    of the rows weren't fitted on."""
    half, seen = np.arange(len(counts)) % 2, []
    for h in (0, 1):
        fitted, rest = half != h, half == h
        if fitted.any() and rest.any():
            centres = centroids(counts[fitted], idf)
            for c in (counts[rest], pieces[rest]):
                c = c[c.any(axis=1)]
                if len(c):
                    seen.append(((weighted(c, idf) @ centres.T).max(axis=1), sizes_of(c)))
    return centroids(counts, idf), floor(*(np.concatenate(x) for x in zip(*seen, strict=True))) if seen else np.zeros(SIZES)


def packed(counts: np.ndarray) -> bytes:
    """Slots that aren't 0 and their counts."""
    at = np.flatnonzero(counts)
    return np.stack((at.astype(np.float32), counts[at])).tobytes()


def unpacked(rows: list[bytes]) -> np.ndarray:
    out = np.zeros((len(rows), SIZE), np.float32)
    for row, raw in zip(out, rows, strict=True):
        at, n = np.frombuffer(raw, np.float32).reshape(2, -1)
        row[at.astype(np.int64)] = n
    return out


def piece(t: Texts, doc: np.ndarray) -> Texts:
    """A piece from the middle of each text, of a length that its doc_id chooses, cut at spaces where there are any."""
    out = []
    for i, d in enumerate(doc.tolist()):
        text = t.data[t.offsets[i] : t.offsets[i + 1]].tobytes()
        size = PIECES[zlib.crc32(str(d).encode()) // 3 % len(PIECES)]
        at = text.find(b" ", max(0, len(text) - size) // 2) + 1
        out.append(text[at : at + size].decode(errors="ignore").encode())
    return Texts(np.frombuffer(b"".join(out), np.uint8), np.cumsum([0, *map(len, out)]))


def fit(labelled: DataFrame, per_language: int = PER_LANGUAGE) -> Model | None:
    """Learns from rows (doc_id, text, lang); rows with a null in any of them are left out. None without rows."""
    rows = labelled.where("doc_id IS NOT NULL AND text IS NOT NULL AND lang IS NOT NULL AND text <> ''")
    shares = rows.groupBy("lang").count().select("lang", (F.least(F.lit(1.0), F.lit(float(per_language)) / F.col("count")) * 1_000_000 + 1).cast("long").alias("share"))
    # As many rows as there are languages.
    chosen = rows.join(F.broadcast(shares), "lang").where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.col("share")).select("doc_id", "text", "lang")

    def counted(part: pa.RecordBatch, texts: Texts) -> pa.RecordBatch:
        whole, short = vectors(texts), vectors(piece(texts, part.column(0).to_numpy()))
        return record(doc_id=part.column(0), lang=part.column(2), counts=blobs([packed(v) for v in whole]), piece=blobs([packed(v) for v in short]), slots=pa.array([np.flatnonzero(v) for v in whole], pa.list_(pa.int32())))

    scratch = Scratch(labelled.sparkSession)
    sample = scratch.store(map_slices(documents(chosen, "lang"), counted, "doc_id long, lang string, counts binary, piece binary, slots array<int>"), "sample")
    n = sample.count()
    frequency = np.zeros(SIZE)
    for slot, df in sample.select(F.explode("slots").alias("slot")).groupBy("slot").count().collect():
        frequency[slot] = df
    idf = (np.log((1 + n) / (1 + frequency)) + 0.1).astype(np.float32)

    def learn(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table["doc_id"].to_pylist(), table["counts"].to_pylist(), table["piece"].to_pylist(), strict=True))
        centres, floors = learned(unpacked([r[1] for r in rows]), unpacked([r[2] for r in rows]), idf)
        return pa.table({"lang": [table["lang"][0].as_py()], "centres": blobs([centres.astype(np.float32).tobytes()]), "floors": blobs([floors.tobytes()])})

    found = sorted(sample.drop("slots").groupBy("lang").applyInArrow(learn, "lang string, centres binary, floors binary").collect(), key=lambda r: r["lang"])
    scratch.clear()
    if not found:
        return None
    centres = [np.frombuffer(r["centres"], np.float32).reshape(-1, SIZE) for r in found]
    floors = [np.broadcast_to(np.frombuffer(r["floors"]), (len(c), SIZES)) for r, c in zip(found, centres, strict=True)]
    return Model([r["lang"] for r, c in zip(found, centres, strict=True) for _ in c], idf, np.concatenate(centres).T.copy(), np.concatenate(floors))


def has_letter(texts: Texts) -> np.ndarray:
    d = texts.data | 32
    plain = np.concatenate(([0], np.cumsum((d >= 97) & (d <= 122) & (texts.data < 128), dtype=np.int64)))
    found = plain[texts.offsets[1:]] > plain[texts.offsets[:-1]]
    for i in np.flatnonzero(~found):
        s = texts.data[texts.offsets[i] : texts.offsets[i + 1]].tobytes().decode(errors="replace")
        found[i] = any(map(str.isalpha, s))
    return found


def identify(docs: DataFrame, model: Model | None, *more: str | Column) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): ``lang_pred``, ``score`` (the cosine, 0 to 1) and ``accepted``.

    A null text, a text without any letter, and any text when there was nothing to learn from get ``und``, score 0 and aren't
    accepted. Ties go to the language that sorts first. Repeated rows get equal results; an empty table gives an empty result.
    """

    def predict(part: pa.RecordBatch, texts: Texts) -> pa.RecordBatch:
        lang = np.full(texts.n, "und", object)
        score, accepted = np.zeros(texts.n), np.zeros(texts.n, bool)
        if model is not None:
            for a in range(0, texts.n, 256):
                b = min(texts.n, a + 256)
                counts = vectors(Texts(texts.data[texts.offsets[a] : texts.offsets[b]], texts.offsets[a : b + 1] - texts.offsets[a]))
                cos = weighted(counts, model.idf) @ model.centroids
                best = cos.argmax(axis=1)
                top = cos[np.arange(b - a), best]
                lang[a:b] = [model.languages[j] for j in best]
                score[a:b] = np.clip(top, 0, 1)
                accepted[a:b] = top >= model.floors[best, sizes_of(counts)]
            none = ~has_letter(texts)
            lang[none], score[none], accepted[none] = "und", 0.0, False
        rest = {part.schema.names[i]: part.column(i) for i in range(2, part.num_columns)}
        return record(doc_id=part.column(0), **rest, lang_pred=pa.array(lang, pa.string()), score=score, accepted=accepted)

    read = documents(docs, *more)
    extra = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in read.schema.fields[2:])
    return map_slices(read, predict, f"doc_id long, {extra}lang_pred string, score double, accepted boolean")


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out()))
    return identify(docs, model, held_out().alias("held_out")).select("doc_id", "held_out", "lang_pred", "score", "accepted")
