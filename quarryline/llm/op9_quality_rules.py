"""Quality rules as a short-circuit cascade.

Each rule's cost (seconds a document) and selectivity (share of documents that it rejects) are measured on a sample; the rules are
then applied in the order of rejections per cost, and a rule sees only the documents that all rules before it have kept. The verdict
is the conjunction of the rules, so it doesn't depend on the measured order; only the work does.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scan import Texts, documents, grams, map_slices, mix, per_doc, read_table, record, starts_within

#: Documents in the sample on which the rules' cost and selectivity are estimated.
SAMPLE = 2000
#: The eight symbols that count as symbols.
SYMBOLS = b"#*$%&|<>"


def table(chars: bytes) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(chars)] = True
    return t


def first_seen(keys: np.ndarray) -> np.ndarray:
    """Whether each key occurs here for the first time (places in ascending order)."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    out = np.empty(len(k), bool)
    out[order] = new
    return out


def repeated(keys: np.ndarray) -> np.ndarray:
    """Whether each key occurs at least twice."""
    order = np.argsort(keys)
    k = keys[order]
    same = np.zeros(len(k) + 1, bool)
    same[1:-1] = k[1:] == k[:-1]
    out = np.empty(len(k), bool)
    out[order] = same[1:] | same[:-1]
    return out


def n_words(t: Texts) -> np.ndarray:
    return np.diff(t.words()[2])


def word_chars(t: Texts) -> np.ndarray:
    """Code points in words: bytes that start a character and aren't white space."""
    start = (t.data & 0xC0) != 0x80
    start &= ~table(b" \t\n\v\f\r")[t.data]
    return per_doc(start, t.offsets)


def n_symbols(t: Texts) -> np.ndarray:
    return per_doc(table(SYMBOLS)[t.data], t.offsets)


def lines(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each line that has a word."""
    cut = np.flatnonzero(t.data == 10)
    starts = np.unique(np.concatenate((t.offsets[:-1], cut + 1)))
    starts = starts[starts < len(t.data)]
    ends = np.minimum(np.append(cut, len(t.data))[np.searchsorted(cut, starts)], t.offsets[np.searchsorted(t.offsets, starts, "right")])
    words = t.words()[0]
    full = np.searchsorted(words, ends) > np.searchsorted(words, starts)
    starts, ends = starts[full], ends[full]
    return starts, ends, np.searchsorted(t.offsets, starts, "right") - 1


def n_lines(t: Texts) -> np.ndarray:
    return np.bincount(lines(t)[2], minlength=t.n)


def n_dup_lines(t: Texts) -> np.ndarray:
    starts, ends, row = lines(t)
    if not len(starts):
        return np.zeros(t.n, np.int64)
    again = ~first_seen(t.hashes(starts, ends) ^ mix(row + 1))
    return np.bincount(row[again], minlength=t.n)


def n_repeat_words(t: Texts, window: int = 8) -> np.ndarray:
    """Words that lie in a window of 8 words found at least twice in the same text."""
    _, _, ptr = t.words()
    at, counts = starts_within(ptr, window)
    if not len(at):
        return np.zeros(t.n, np.int64)
    row = np.repeat(np.arange(t.n), counts)
    at = at[repeated(grams(t.word_hashes(), window)[at] ^ mix(row + 1))]
    step = np.bincount(at, minlength=ptr[-1] + 1) - np.bincount(at + window, minlength=ptr[-1] + 1)
    return per_doc(np.cumsum(step[:-1]) > 0, ptr)


def upper_chars(t: Texts) -> np.ndarray:
    return per_doc((t.data >= 65) & (t.data <= 90), t.offsets)


def n_bare_words(t: Texts) -> np.ndarray:
    """Words without an ASCII letter and without a character beyond ASCII."""
    letters = table(bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256)))[t.data]
    starts, ends, ptr = t.words()
    upto = np.concatenate(([0], np.cumsum(letters, dtype=np.int64)))
    return per_doc(upto[ends] == upto[starts], ptr)


@dataclass
class Measures:
    """Measures of some texts, or of some rows of them in ascending order, each computed when a rule first asks for it; only then are texts copied."""

    whole: Texts
    known: dict = field(default_factory=dict)
    rows: np.ndarray | None = None

    def __getitem__(self, fn: Callable[[Texts], np.ndarray]) -> np.ndarray:
        if fn.__name__ not in self.known:
            self.known[fn.__name__] = fn(self.texts)
        return self.known[fn.__name__]

    @property
    def n(self) -> int:
        return self.whole.n if self.rows is None else len(self.rows)

    @property
    def texts(self) -> Texts:
        if self.rows is not None and len(self.rows) < self.whole.n:
            sizes, stay = np.diff(self.whole.offsets), np.zeros(self.whole.n, bool)
            stay[self.rows] = True
            self.whole = Texts(self.whole.data[np.repeat(stay, sizes)], np.concatenate(([0], np.cumsum(sizes[stay]))))
        self.rows = None
        return self.whole

    def only(self, keep: np.ndarray) -> Measures:
        """The measures of the kept rows; what is known stays known."""
        return Measures(self.whole, {k: v[keep] for k, v in self.known.items()}, keep if self.rows is None else self.rows[keep])

    def based(self) -> np.ndarray:
        """Whether the base rule rejects; the base measures are known then, whatever the rules ask for."""
        words, repeat = self[n_words], self[n_repeat_words]
        for f in (word_chars, n_symbols, n_dup_lines):
            self[f]
        return (words < 20) | (100 * repeat > 30 * words)


#: Rules of the cascade: name -> rejected rows. They are mild on purpose: each names a kind of text that no prose has.
RULES: dict[str, Callable[[Measures], np.ndarray]] = {
    "symbols": lambda m: 10 * m[n_symbols] > 3 * m[n_words],
    "word_length": lambda m: (m[word_chars] < 2 * m[n_words]) | (m[word_chars] > 25 * m[n_words]),
    "dup_lines": lambda m: 10 * m[n_dup_lines] > 4 * m[n_lines],
    "shouting": lambda m: 2 * m[upper_chars] > m[word_chars],
    "bare_words": lambda m: 2 * m[n_bare_words] > m[n_words],
}


def cascade(measures: Measures, order: list[str]) -> np.ndarray:
    """The rows that every rule keeps, in ascending order."""
    left = np.arange(measures.n)
    for name in order:
        if not len(left):
            break
        stay = ~RULES[name](measures)
        if not stay.all():
            left = left[stay]
            measures = measures.only(np.flatnonzero(stay))
    return left


def plan(docs: DataFrame, sample: int = SAMPLE) -> list[str]:
    """The rules in the order of rejections per second, estimated on about ``sample`` documents spread over the table by a hash."""
    docs = documents(docs)
    total = docs.count()
    if not total:
        return list(RULES)
    share = min(1.0, sample / total)
    chosen = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000) + 1)

    def measure(part: pa.RecordBatch, texts: Texts) -> pa.RecordBatch:
        names, rejected, seconds = [], [], []
        m = Measures(texts)
        rest = np.flatnonzero(~m.based())
        for name, rule in RULES.items():
            # From what the cascade has when it begins: the base measures of the documents that pass the base rule.
            start = m.only(rest)
            began = time.perf_counter()
            no = rule(start)
            names.append(name)
            rejected.append(int(no.sum()))
            seconds.append(time.perf_counter() - began)
        return record(rule=names, rejected=pa.array(rejected, pa.int64()), seconds=seconds)

    found = map_slices(chosen, measure, "rule string, rejected long, seconds double").groupBy("rule").agg(F.sum("rejected").alias("r"), F.sum("seconds").alias("s")).collect()
    gain = {x["rule"]: x["r"] / max(x["s"], 1e-9) for x in found}
    return sorted(RULES, key=lambda name: (-gain.get(name, 0.0), name))


def quality_rules(docs: DataFrame, order: list[str] | None = None) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): the base measures, ``base_failed`` and ``kept``.

    A null or empty text has no words and so fails the base rule; repeated rows are judged alike; a null doc_id passes through; an
    empty table gives an empty result. Other columns of ``docs`` aren't read.
    """
    order = plan(docs) if order is None else order

    def judge(part: pa.RecordBatch, texts: Texts) -> pa.RecordBatch:
        m = Measures(texts)
        failed = m.based()
        words, repeat, base = m[n_words], m[n_repeat_words], {f.__name__: m[f] for f in (word_chars, n_symbols, n_dup_lines)}
        rest = np.flatnonzero(~failed)
        kept = np.zeros(texts.n, bool)
        kept[rest[cascade(m.only(rest), order)]] = True
        return record(doc_id=part.column(0), n_words=words.astype(np.int64), **{k: v.astype(np.int64) for k, v in base.items()}, n_repeat_words=repeat.astype(np.int64), base_failed=failed, kept=kept)

    return map_slices(documents(docs), judge, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(read_table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
pos AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w),
win AS (SELECT doc_id, i, array_to_string(ws[i:i+7], ' ') AS g FROM pos),
dup AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM dup, (SELECT unnest(range(0, 8)) AS k) GROUP BY doc_id),
ln AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM d),
lw AS (SELECT doc_id, l FROM ln WHERE regexp_matches(l, '[^\x20\x09-\x0D]')),
lc AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup FROM lw GROUP BY doc_id),
b AS (
  SELECT w.doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, coalesce(n_dup, 0) AS n_dup_lines, coalesce(n_lines, 0) AS n_lines,
         coalesce(cov.n, 0) AS n_repeat_words, len(regexp_extract_all(text, '[A-Z]')) AS n_upper,
         len(list_filter(ws, lambda x: NOT regexp_matches(x, '[^\x00-\x40\x5B-\x60\x7B-\x7F]'))) AS n_bare
  FROM w LEFT JOIN cov ON cov.doc_id = w.doc_id LEFT JOIN lc ON lc.doc_id = w.doc_id)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
       (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words)
         AND NOT (10 * n_symbols > 3 * n_words) AND NOT (word_chars < 2 * n_words OR word_chars > 25 * n_words)
         AND NOT (10 * n_dup_lines > 4 * n_lines) AND NOT (2 * n_upper > word_chars) AND NOT (2 * n_bare > n_words) AS kept
FROM b
"""
