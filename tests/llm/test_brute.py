"""Predictions, scores and the pipeline's stages row by row against plain Python."""

import hashlib
import math
from collections import Counter

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from quarryline.llm import op5_language_id as op5
from quarryline.llm import op7_url_filter as op7
from quarryline.llm import op10_quality_classifier as op10
from quarryline.llm.scan import PART_BYTES, Texts, parts_of

from . import edge
from .test_operators import dedup_brute, jaccard_brute

SF = "/root/testdata/sf0.001"
COLUMNS = list(corpus_pipeline.COLUMNS)
WHITE = " \t\n\v\f\r"


def key(rows):
    return sorted(rows, key=repr)


def plain_vector(text):
    """Distinct slots of hashed n-grams and their counts."""
    data, last = bytearray(), None
    for c in text:
        c = c.lower() if c.isascii() else chr(ord(c) + 32) if "À" <= c <= "Þ" and c != "×" else c
        space = c.isascii() and not "a" <= c <= "z"
        if not (space and last):
            data += b" " if space else c.encode()
        last = space
    return Counter((int.from_bytes(data[i : i + n], "big") + (n << 24)) * 2654435761 % 2**32 >> 20 for n in (1, 2, 3) for i in range(len(data) - n + 1))


def plain_language(model, text):
    """Predicted language, cosine and whether it is accepted."""
    if text is None or not any(c.isalpha() for c in text):
        return "und", 0.0, False
    counts = plain_vector(text)
    weights = {s: math.log1p(n) * float(model.idf[s]) for s, n in counts.items()}
    length = math.sqrt(sum(w * w for w in weights.values())) or 1.0
    cos = [sum(w * float(model.centroids[s, j]) for s, w in weights.items()) / length for j in range(len(model.languages))]
    best = max(range(len(cos)), key=cos.__getitem__)
    size = min(int(math.log2(len(counts))), op5.SIZES - 1)
    return model.languages[best], min(max(cos[best], 0.0), 1.0), cos[best] >= model.floors[best, size]


def test_languages_are_those_of_the_nearest_centroid(spark):
    model = op5.fit(spark.read.parquet(f"{SF}/documents.parquet"))
    more = ["ÀÉÎ Ünïçödé ×÷ straße", "x", "ß", "中文 text", "a1b2-c3", "é" * 300, edge.prose(3, 3000)]
    real = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 40").collect()]
    texts = dict(enumerate([*edge.texts(), *more, *real]))
    found = op5.identify(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3), model).collect()
    assert len(found) == len(texts)
    for r in found:
        lang, score, accepted = plain_language(model, texts[r.doc_id])
        assert r.lang_pred == lang and abs(r.score - score) < 1e-4 and r.accepted == accepted, (r, lang, score)


def plain_features(text):
    words = [w for w in text.encode().translate(bytes.maketrans(WHITE.encode(), b" " * 6)).split(b" ") if w]
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    again = {i + k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(8)}
    chars = max(1, sum(len(w.decode()) for w in words))
    n = max(1, len(words))
    bare = sum(not any(chr(b).isalpha() and b < 128 or b >= 128 for b in w) for w in words)
    count = lambda some: sum(text.count(c) for c in some)
    upper, digits = (sum(c in some for c in text) for some in ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"))
    x = [min(count("#*$%&|<>") / n, 3), count("!?") / chars, upper / chars, digits / chars, text.count("|") / n, bare / n, len(again) / n, min(chars / n, 30) / 10, math.log1p(n) / 10]
    return [1.0, *x, *(math.sqrt(v) for v in x[:7])], bool(words)


def test_features_are_those_of_the_definition():
    texts = [t or "" for t in edge.texts()] + ["!? A1|2 é3 -- 中", edge.prose(1, 9) + " " + edge.prose(1, 9)]
    got = op10.features(Texts.of([t.encode() for t in texts]))
    assert np.allclose(got, [plain_features(t)[0] for t in texts])


def test_weights_solve_the_ridge_regression():
    r = np.random.default_rng(2)
    x = np.concatenate((np.ones((300, 1)), r.normal(size=(300, 4))), axis=1)
    y = (x @ [0.3, 1, -2, 0, 0.5] + r.logistic(size=300) > 0).astype(float)
    w = op10.learned(x, y)
    p = 1 / (1 + np.exp(-(x @ w)))
    assert np.abs(x.T @ (y - p) - np.array([1e-3, 0.3, 0.3, 0.3, 0.3]) * w).max() < 1e-6


def plain_scores(rows, weights):
    """Score of each (text, source, lang): evidence, and the shift of its path by two steps of shrinking."""
    z = []
    for text, _, _ in rows:
        x, some = plain_features(text or "")
        z.append(max(-12.0, min(12.0, float(np.dot(x, weights)))) if some else -12.0)
    p = [1 / (1 + math.exp(-v)) for v in z]
    hosts = [r[1] or "" for r in rows]
    paths = [(r[1] or "", f"{r[1] or ''}/{r[2] or ''}") for r in rows]
    total = lambda keys: {k: (sum(1.0 for x in keys if x == k), sum(v for x, v in zip(keys, p, strict=True) if x == k)) for k in set(keys)}

    def strength(stats, center):
        n = sum(v[0] for v in stats.values())
        if len(stats) < 2:
            return op10.MOST
        base = sum(v[0] * center(k) * (1 - center(k)) for k, v in stats.items()) / n
        spread = sum(v[0] * (v[1] / v[0] - center(k)) ** 2 for k, v in stats.items())
        between = (spread - base * (len(stats) - 1)) / max(n - sum(v[0] ** 2 for v in stats.values()) / n, 1e-9)
        return min(max(base / between - 1, op10.LEAST), op10.MOST) if between > 1e-12 else op10.MOST

    prior = min(max(sum(p) / len(p), 1e-4), 1 - 1e-4)
    by_host, by_path = total(hosts), total(paths)
    m = strength(by_host, lambda _: prior)
    rate = {h: (s + m * prior) / (n + m) for h, (n, s) in by_host.items()}
    m = strength(by_path, lambda k: rate[k[0]])
    logit = lambda q: math.log(q / (1 - q))
    shift = {k: logit(min(max((s + m * rate[k[0]]) / (n + m), 1e-4), 1 - 1e-4)) - logit(prior) for k, (n, s) in by_path.items()}
    return [1 / (1 + math.exp(-(v + shift[k]))) for v, k in zip(z, paths, strict=True)]


def weights_of(spark):
    return op10.fit(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))


def test_scores_are_those_of_plain_arithmetic(spark):
    weights = weights_of(spark)
    rows = [(d, t, lang, s) for d, t, lang, s, *_ in edge.rows()] + [(5000 + r.doc_id, r.text, r.lang, r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 60").collect()]
    out = op10.classify(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3), weights, *op10.site_of()).collect()
    want = [(r[0], round(s, 7), s >= op10.KEEP) for r, s in zip(rows, plain_scores([(r[1], r[3], r[2]) for r in rows], weights), strict=True)]
    assert key((r.doc_id, round(r.score, 7), r.kept) for r in out) == key(want)


def tables(spark):
    """Edge tables with a few documents that pass all stages."""
    real = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 50").withColumn("doc_id", F.col("doc_id") + 10_000).select(*COLUMNS)
    some = edge.table(spark).select(*COLUMNS)
    yield some.union(real)
    yield edge.no_id(spark).select(*COLUMNS).union(real.union(real))
    yield edge.empty(spark).select(*COLUMNS)
    yield edge.all_null(spark).select(*COLUMNS)


def rows_of(df):
    return [tuple(r) for r in df.select(*COLUMNS).collect()]


def test_stages_row_by_row(spark):
    """What each stage keeps of nulls, empty tables, ties, repeated rows and long texts."""
    stage = dict(corpus_pipeline.STAGES)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for docs in tables(spark):
        docs = docs.repartition(3)
        rows = rows_of(docs)

        weights = op10.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
        scores = plain_scores([(r[1], r[3], r[2]) for r in rows], weights) if rows and weights is not None else []
        want = [r for r, s in zip(rows, scores, strict=True) if s >= op10.KEEP] if weights is not None else None
        kept = rows_of(stage["quality"](spark, docs, SF))
        if want is not None:
            assert key(kept) == key(want)
        else:  # nothing to learn from: texts without words go
            assert key(kept) == key(r for r in rows if r[1] and r[1].strip(WHITE))

        model = op5.fit(docs.where(~op5.held_out()))
        want = [r for r in rows if model is not None and plain_language(model, r[1])[2]]
        assert key(rows_of(stage["language"](spark, docs, SF))) == key(want)

        named = [r for r in rows if r[0] is not None]
        found = rows_of(stage["near_duplicates"](spark, docs, SF))
        component = {d: c for d, _, c in jaccard_brute([r[:2] for r in named])}
        assert key(r[0] for r in found) == key([d for d, c in component.items() if c == d] + [None] * (len(rows) - len(named)))
        assert set(map(repr, found)) <= set(map(repr, rows))

        if len({r[0] for r in named}) == len(rows):
            digest = {d: (n, sha) for d, _, n, sha in dedup_brute([r[:2] for r in rows])}
            for r in rows_of(stage["passages"](spark, docs, SF)):
                n, sha = digest[r[0]]
                assert (hashlib.sha256((r[1] or "").encode()).hexdigest() == sha and r[4] == len(r[1])) if n else r in rows
        else:
            assert len(rows_of(stage["passages"](spark, docs, SF))) == len(rows)

        pieces = stage["packing"](spark, docs, SF).collect()
        size = Counter()
        for r in pieces:
            size[r.doc_id] += r.length
        want = Counter()
        for d, t, *_ in rows:
            want[d] += len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1
        assert size == want


def test_signs_beyond_the_alphabet_are_others(spark):
    """Letters whose codes are near those of the alphabet's numbers count as any other character."""
    urls = ["http://a/Āāĭ", "http://a/中中中", "HTTP://A/xyz", "http://a/\u0001 |"]
    rows = spark.createDataFrame([(u,) for u in urls], "u string").select("u", op7.signs(F.col("u")).alias("s")).collect()
    place = {c: i for i, c in enumerate(op7.ALPHABET, 1)}
    for r in rows:
        assert r.s == [0, 0, *(place.get(c, op7.SIZE - 1) for c in r.u.lower())]


def test_parts_grow_with_the_input(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    few = parts_of(docs)
    assert few == int(spark.conf.get("spark.sql.shuffle.partitions")) == parts_of(edge.table(spark))
    monkeypatch.setattr("quarryline.llm.scan.PART_BYTES", 10_000)
    assert parts_of(docs) > 2 * few and PART_BYTES > 10_000
