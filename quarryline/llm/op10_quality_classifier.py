"""Quality classifier with hierarchical empirical Bayes over hosts and paths.

A logistic model gives the evidence of a document alone, from shares of its characters, words and lines; it is fitted on a bounded
sample of labelled rows. Grouped aggregation over all documents gives each host and each path (a section of a host) the sum of that
evidence. A host's rate is shrunk toward the global rate, a path's toward its host's; how strongly is estimated from how much the
rates of hosts (of paths) differ more than chance makes them (Beta-binomial, by moments). The score adds to the document's log-odds
those by which its path's rate differs from the global one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import op9_quality_rules as rules
from .scan import Texts, blobs, documents, map_slices, per_doc, read_table, record, slices, stored

#: Labelled rows that the document model is fitted on, about.
SAMPLE = 4000
#: Most sites whose statistics are broadcast; beyond it they are joined over salted keys.
BROADCAST_SITES = 50_000
SALT = 32
#: Bounds of the number of documents that a prior counts for.
LEAST, MOST = 20.0, 10_000.0
#: A document is kept from this score on: losing a clean one counts nine times as much as keeping a poor one.
KEEP = 0.1


def features(t: Texts) -> np.ndarray:
    """A row for each text; all are shares, so long texts and short ones compare."""
    m = rules.Measures(t)
    words = np.maximum(m[rules.n_words], 1)
    chars = np.maximum(m[rules.word_chars], 1)
    marks = per_doc(rules.table(b"!?")[t.data], t.offsets)
    digits = per_doc((t.data >= 48) & (t.data <= 57), t.offsets)
    bars = per_doc(t.data == 124, t.offsets)
    x = np.stack([
        np.minimum(m[rules.n_symbols] / words, 3), marks / chars, m[rules.upper_chars] / chars, digits / chars, bars / words, m[rules.n_bare_words] / words,
        m[rules.n_repeat_words] / words, np.minimum(chars / words, 30) / 10, np.log1p(words) / 10,
    ], axis=1)
    return np.concatenate((np.ones((t.n, 1)), x, np.sqrt(x[:, :7])), axis=1)


def learned(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of a ridge logistic regression by Newton's method."""
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], 0.3)
    ridge[0] = 1e-3
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> np.ndarray | None:
    """Weights of the document model; None without labels of both kinds. Labels with a null and documents without a label don't count,
    and of several labels of a document the largest does."""
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    n = known.count()
    if not n:
        return None
    share = int(min(1.0, sample / n) * 1_000_000) + 1
    known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share)
    # The sample is bounded, whatever the number of labels, so it may be broadcast.
    rows = documents(docs).join(F.broadcast(known), "doc_id").select("doc_id", "text", "quality")

    def measure(part: pa.RecordBatch, texts: Texts) -> pa.RecordBatch:
        return record(doc_id=part.column(0), quality=part.column(2), x=blobs([v.tobytes() for v in features(texts)]))

    got = map_slices(rows, measure, "doc_id long, quality int, x binary").collect()
    got.sort(key=lambda r: (r["doc_id"], bytes(r["x"])))
    y = np.array([float(r["quality"] > 0) for r in got])
    if not len(y) or y.min() == y.max():
        return None
    return learned(np.stack([np.frombuffer(r["x"]) for r in got]), y)


def evidence(weights: np.ndarray | None) -> Callable[[Texts], np.ndarray]:
    """Log-odds of each text: 0 without a model; a text without words gets the least."""

    def of(t: Texts) -> np.ndarray:
        z = np.clip(features(t) @ weights, -12, 12) if weights is not None else np.zeros(t.n)
        return np.where(rules.n_words(t) > 0, z, -12.0)

    return of


def concentration(stats: DataFrame, center: Column) -> Column:
    """Number of documents that a prior counts for: by moments, from the spread of the rates around ``center``."""
    n, rate = F.col("n"), F.col("s") / F.col("n")
    return stats.agg(F.sum(n * (rate - center) ** 2).alias("v"), F.sum(n).alias("n"), F.sum(n * n).alias("nn"), F.count("*").alias("k"), F.sum(n * center * (1 - center)).alias("b"))


def strength(row) -> float:
    """Beta-binomial moments: spread of the rates beyond what chance gives; no spread beyond it means the strongest prior."""
    if not row["k"] or row["k"] < 2 or not row["n"]:
        return MOST
    base = row["b"] / row["n"]
    between = (row["v"] - base * (row["k"] - 1)) / max(row["n"] - row["nn"] / row["n"], 1e-9)
    return float(np.clip(base / between - 1, LEAST, MOST)) if between > 1e-12 else MOST


def site_offsets(scored: DataFrame) -> DataFrame:
    """host, path and ``shift``, the log-odds that the path adds, from (host, path, p) of all documents."""
    paths = stored(scored.groupBy("host", "path").agg(F.count("*").cast("double").alias("n"), F.sum("p").alias("s")), "sites")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    total = hosts.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    prior = min(max((total["s"] or 0.0) / max(total["n"] or 0.0, 1.0), 1e-4), 1 - 1e-4)
    m = strength(concentration(hosts, F.lit(prior)).first())
    hosts = hosts.select("host", ((F.col("s") + m * prior) / (F.col("n") + m)).alias("host_rate"))
    both = paths.join(hosts, "host")
    m = strength(concentration(both, F.col("host_rate")).first())
    both = both.withColumn("path_rate", (F.col("s") + m * F.col("host_rate")) / (F.col("n") + m))
    rate = F.least(F.greatest("path_rate", F.lit(1e-4)), F.lit(1 - 1e-4))
    return stored(both.select("host", "path", "host_rate", "path_rate", (F.log(rate / (1 - rate)) - float(np.log(prior / (1 - prior)))).alias("shift")), "rates")


def with_sites(rows: DataFrame, sites: DataFrame) -> DataFrame:
    """Rows joined with their site: by broadcast if there are few sites, else over salted keys, as one site may hold a third of all."""
    if sites.count() <= BROADCAST_SITES:
        return rows.join(F.broadcast(sites), ["host", "path"])
    salted = sites.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALT)).cast("int")).join(salted, ["host", "path", "salt"]).drop("salt")


def site_of() -> tuple[Column, Column]:
    """Host and path of a row of documents: its source, and the language section of it (null as empty)."""
    host = F.coalesce(F.col("source").cast("string"), F.lit(""))
    return host.alias("host"), F.concat(host, F.lit("/"), F.coalesce(F.col("lang").cast("string"), F.lit(""))).alias("path")


def classify(docs: DataFrame, weights: np.ndarray | None, host: Column, path: Column, keep: float = KEEP) -> DataFrame:
    """One row for each row of ``docs``: doc_id, host, path, p_doc, host_rate, path_rate, score, kept.

    A null or empty text has the least evidence; without a model all other evidence is 0.5. Null sites count as one empty site.
    Repeated rows count as often as they occur. An empty table gives an empty result.
    """
    rows = documents(docs, host, path)
    of = evidence(weights)

    def judge(part: pa.RecordBatch, texts: Texts) -> pa.RecordBatch:
        z = of(texts)
        return record(doc_id=part.column(0), host=part.column(2), path=part.column(3), z=z, p=1 / (1 + np.exp(-z)))

    scored = stored(map_slices(rows, judge, "doc_id long, host string, path string, z double, p double"), "scored")
    out = with_sites(scored, site_offsets(scored)).withColumn("score", 1 / (1 + F.exp(-(F.col("z") + F.col("shift")))))
    return out.select("doc_id", "host", "path", F.col("p").alias("p_doc"), "host_rate", "path_rate", "score", (F.col("score") >= keep).alias("kept"))


def kept_documents(docs: DataFrame, weights: np.ndarray | None, keep: float = KEEP) -> DataFrame:
    """The rows of ``docs`` (all columns) that ``classify`` keeps; texts aren't dealt out again."""
    host, path = site_of()
    of = evidence(weights)

    def judge(part: pa.RecordBatch, texts: Texts) -> pa.RecordBatch:
        return record(host=part.column(2), path=part.column(3), p=1 / (1 + np.exp(-of(texts))))

    scored = stored(map_slices(documents(docs, host, path), judge, "host string, path string, p double"), "scored")
    # The rows are one column, so names of theirs clash with nothing.
    rows = with_sites(docs.select(F.struct("*").alias("row"), "doc_id", host, path), site_offsets(scored)).select("row", "shift")

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shift, at = batch.column(1).to_numpy(), 0
            for part, texts in slices(pa.RecordBatch.from_struct_array(batch.column(0))):
                score = 1 / (1 + np.exp(-(of(texts) + shift[at : at + texts.n])))
                at += texts.n
                yield part.filter(pa.array(score >= keep))

    return rows.mapInArrow(choose, docs.schema)


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return classify(docs, fit(docs, read_table(spark, sf_dir, "labels")), *site_of())
