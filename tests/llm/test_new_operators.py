"""Source divergence, exact dedup and the drifted schema rewrite against brute force."""

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter
from datetime import datetime, timedelta

import numpy as np
import pyarrow.parquet as pq

from pyspark.sql import functions as F

from quarryline.llm import op11_source_divergence as op11
from quarryline.llm import op12_exact_dedup as op12
from quarryline.llm import op13_schema_rewrite as op13
from quarryline.llm.scan import shared_dir

from . import edge


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def dedup_brute(rows):
    groups = {}
    for doc, text in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", text or ""), []).append((doc, len(text or "")))
    out = []
    for norm, members in groups.items():
        n = max(m[1] for m in members)
        ids = [m[0] for m in members if m[1] == n and m[0] is not None]
        keep = min(ids) if ids else None
        out += [(doc, keep, len(members), doc == keep and size == n, hashlib.sha256(norm.encode()).hexdigest()) for doc, size in members]
    return sorted(out, key=repr)


def dedup_rows():
    rows = [r[:2] for r in edge.rows()] + [(None, "a b"), (None, " a b"), (9, "a b"), (7, " ab "), (5, "a b")]
    return rows + [(2000 + i, "hot " * (1 + i % 3)) for i in range(300)] + [(3000 + i, edge.prose(20 + i % 5, 40).replace(" ", " " * (1 + i % 2))) for i in range(60)]


def test_exact_groups(spark):
    rows = dedup_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"key": F.lit("k"), "n": F.lit(1), "size": F.lit("s"), "owner": F.lit(0)}).repartition(5)
    want = dedup_brute(rows)
    assert got(op12.exact_groups(docs)) == want
    assert got(op12.exact_groups(docs, broadcast_keys=0)) == want


def test_exact_groups_of_colliding_keys(spark):
    """Keys that many texts share, at one place of the directory or at a few: texts tell, in pages as well."""
    rows = dedup_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = dedup_brute(rows)
    assert got(op12.exact_groups(docs, key=lambda c: F.length(c).cast("long"))) == want
    assert got(op12.exact_groups(docs, key=lambda c: F.shiftleft(F.length(c).cast("long") % 3, 62), broadcast_keys=0)) == want


def test_exact_groups_of_edge_tables(spark):
    assert op12.exact_groups(edge.empty(spark)).count() == 0
    none = hashlib.sha256(b"").hexdigest()
    assert got(op12.exact_groups(edge.all_null(spark))) == [(None, None, 3, True, none)] * 3


def test_directory_doubles(spark):
    """Buckets split until they fit; one that can't gets pages; pointers and weights add up."""
    keys = spark.createDataFrame([(i << 56 if i < 128 else (i - 256) << 56, 1) for i in range(256)] + [(5, 1000)], "key long, weight long")
    found = {r.cell: r for r in op12.directory(keys, 6, 10).collect()}
    assert sorted(found) == list(range(64))
    assert found[0].depth == 6 and found[0].pages == 101 and found[0].start == 0  # 4 keys and the heavy one
    assert all(r.pages == 1 for c, r in found.items() if c)
    assert found[63].depth == 5 and found[63].start == 1000 + 256 - 8 and found[62].start == found[63].start


def divergence_brute(rows, least_docs, terms):
    counts, docs = {}, Counter()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        found = ["".join(c.lower() if c < "\x80" else c for c in t) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        counts.setdefault(lang, {}).setdefault(source, Counter()).update(found)
        docs.update((lang, t) for t in set(found))
    out = []
    for lang, sources in counts.items():
        kept = {t for s in sources.values() for t in s if docs[lang, t] >= least_docs}
        whole = Counter()
        for s in sources.values():
            whole.update({t: n for t, n in s.items() if t in kept})
        share = lambda c, t: 1 + 10**9 * (c[t] + 5) // (sum(n for x, n in c.items() if x in kept) + 5 * len(kept))  # noqa: E731, B023
        p = {s: {t: share(c, t) for t in kept} for s, c in sources.items()}
        q = {t: share(whole, t) for t in kept}
        for s, c in sources.items():
            pair = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in sources if o != s]
            term = [(q[t] - p[s][t], t.encode()) for t in kept if c[t] and p[s][t] > q[t]]
            out += [(lang, s, part, item.decode(), -value, rank) for part, found, most in (("pair", pair, None), ("term", term, terms)) for rank, (value, item) in enumerate(sorted(found)[:most], 1)]
    return sorted(out, key=repr)


def divergence_rows():
    r = random.Random(5)
    words = [f"w{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]}" for i in range(60)] + ["Été", "中文", "don't", "X1Y"]
    rows = [(" ".join(r.choices(words, [1 / (k + 1) for k in range(len(words))], k=r.randint(0, 30))), r.choice("abc"), f"s{min(int(r.expovariate(0.2)), 30)}") for _ in range(400)]
    return rows + [(None, "a", "s0"), ("only here", "z", "one"), ("", "y", "one"), ("12 34", "y", "two"), ("wak wak", None, None), ("WAK!", None, "s1"), rows[0], rows[0]]


def test_divergence(spark):
    rows = divergence_rows()
    docs = spark.createDataFrame(rows, "text string, lang string, source string").withColumns({c: F.lit(1) for c in ("doc_id", "n", "tile", "item", "value", "term")}).repartition(4)
    got_rows = got(op11.divergence(docs, 3, 5))
    want = divergence_brute(rows, 3, 5)
    assert got_rows == want and len({r[1] for r in want if r[0] == "a"}) > 15
    assert got(op11.divergence(docs, 3, 5, tile=4, block=7)) == want  # many tiles and blocks
    assert got(op11.divergence(docs, 1, 1000)) == divergence_brute(rows, 1, 1000)


def test_divergence_of_edge_tables(spark):
    assert op11.divergence(edge.empty(spark)).count() == 0
    assert op11.divergence(edge.all_null(spark)).count() == 0
    rows = [r[1:4] for r in edge.rows()]
    assert got(op11.divergence(edge.table(spark), 1, 50)) == divergence_brute(rows, 1, 50)


def test_shares_are_exact():
    big = np.array([0, 7, 10**13, 9 * 10**14], np.int64)
    assert op11.share(big, 10**15).tolist() == [1 + 10**9 * (n + 5) // 10**15 for n in big.tolist()]


CLIENTS = "client_id long, master_id long, source string, updated_at timestamp_ntz, name string, email string, city string, nation_id int, segment string, balance double"
NAMES = [c.split()[0] for c in CLIENTS.split(", ")]


def client_rows(n):
    r = random.Random(11)
    maybe = lambda x: None if r.random() < 0.1 else x
    rows = []
    for i in range(n):
        when = datetime(2024, 1, 1) + timedelta(microseconds=r.randrange(10**13))
        rows.append((i * 3 - 40, maybe(r.randrange(99)), maybe("web"), maybe(when), maybe(f"n|{i}"), maybe(f"é{i}@x\n"), maybe(""), maybe(r.randrange(25)), maybe("s"), maybe(r.uniform(-2e3, 1e4))))
    return rows


def rewrite_brute(rows, files, salt):
    """Contract by plain Python: a row of the result without path for each file, and the version of each."""
    rows = sorted(rows, key=lambda r: (zlib.crc32(str(r[0]).encode()), r[0]))
    size, out = 1 + len(rows) // files, []
    for at in range(0, len(rows), size):
        no = at // size
        version = zlib.crc32(f"{salt}{no}".encode()) % 24
        version = version if version < 16 else 0
        names = [(n, n) for n in NAMES if not (version & 4 and n in ("nation_id", "segment"))]
        names = [(n, {"name": "email", "email": "name"}.get(n, n) if version & 1 else n) for n, _ in names]
        names = names[:1] + names[:0:-1] if version & 2 else names
        final = []
        for row in rows[at : at + size]:
            row = list(row)
            if version & 4:
                row[7:9] = -1, "none"
            if version & 8 and row[9] is not None:
                row[9] = float(np.float32(row[9]))
            final.append(row)
        show = [[*r[:3], None if r[3] is None else (r[3] - datetime(1970, 1, 1)) // timedelta(microseconds=1), *r[4:9], None if r[9] is None else math.floor(1048576 * r[9])] for r in final]
        digest = lambda texts, mark: hashlib.sha256(mark.join(texts).encode()).hexdigest()
        lines = ["|".join("?" if x is None else str(x) for x in r) for r in show]
        out.append((no, version, len(final), sum(x is None for r in final for x in r), digest([str(r[0]) for r in final], ","), digest(lines, "\n"), ",".join(n for _, n in names), ",".join(NAMES), version > 0))
    return out


def test_drifted_rewrite(spark):
    rows = client_rows(1200)
    clients = spark.createDataFrame(rows, CLIENTS).withColumns({"key": F.lit("k"), "version": F.lit(1), "run": F.lit("r")}).repartition(7)
    folder = shared_dir(spark)
    start = op13.starting_files(clients, folder, 60)
    want = rewrite_brute(rows, 60, "19:")
    assert {w[1] for w in want} > {0, 1, 2, 4, 8} or len({w[1] for w in want}) > 10
    before = {r.file_no: r for r in start.collect()}
    stamp = {}
    for w in want:  # what the starting files look like
        file = pq.ParquetFile(before[w[0]].path)
        ids = {int(f.metadata[b"PARQUET:field_id"]): f for f in file.schema_arrow}
        assert ",".join(file.schema_arrow.names) == w[6] and before[w[0]].version == w[1]
        assert set(ids) == set(range(1, 11)) - ({8, 9} if w[1] & 4 else set())
        assert str(ids[10].type) == ("float" if w[1] & 8 else "double") and (8 not in ids or str(ids[8].type) == ("int32" if w[1] & 8 else "int64"))
        stamp[w[0]] = os.stat(before[w[0]].path).st_mtime_ns
    result = sorted(op13.rewritten(start, folder, 60).collect())
    assert [(*r[:8], r[9]) for r in result] == want
    assert sorted(os.listdir(f"{folder}/table")) == sorted(os.path.basename(r.path) for r in result)
    for r in result:
        file = pq.ParquetFile(r.path)
        assert file.schema_arrow.equals(op13.schema_of(0), check_metadata=True) and file.metadata.num_rows == r.n_rows
        assert r.rewritten or (r.path == before[r.file_no].path and os.stat(r.path).st_mtime_ns == stamp[r.file_no])


def test_rewrite_of_a_whole_table(spark):
    """The registered query on the table as it is, and the final folder as Spark reads it."""
    path = "/root/testdata/sf0.001/clients.parquet"
    columns = pq.read_table(path)
    rows = list(zip(*(columns.column(n).to_pylist() for n in NAMES), strict=True))
    found = sorted(op13.op13_schema_rewrite(spark, "/root/testdata/sf0.001").collect())
    assert [(*r[:8], r[9]) for r in found] == rewrite_brute(rows, 250, "19:")
    back = spark.read.parquet(os.path.dirname(found[0].path))
    assert back.count() == len(rows) and back.columns == NAMES and dict(back.dtypes)["nation_id"] == "bigint"


def test_drifted_rewrite_of_edge_tables(spark):
    empty = spark.createDataFrame([], CLIENTS)
    assert op13.drifted_rewrite(empty).count() == 0
    one = client_rows(30)[7]
    got_rows = op13.drifted_rewrite(spark.createDataFrame([one], CLIENTS)).collect()
    assert [(*r[:8], r[9]) for r in got_rows] == rewrite_brute([one], 250, "19:")
    odd = [(None,) * 10] * 3 + [one] * 40 + [(5, None, "x" * 200_000, None, None, None, None, None, None, x) for x in (float("nan"), float("inf"), 1e300, -0.0)]
    found = sorted(op13.drifted_rewrite(spark.createDataFrame(odd, CLIENTS).repartition(4), 5).collect())
    assert sum(r.n_rows for r in found) == len(odd) and all(r.n_rows == 10 for r in found[:-1])


def test_rank_cuts_are_exact(spark):
    """Keys with long common prefixes and cuts within them."""
    r = random.Random(3)
    keys = sorted(f"{r.choice(['00', 'A7', 'FF']) * 20}{i:016X}" for i in range(500))
    runs = spark.createDataFrame([("r", k) for k in keys], "run string, key string").repartition(3)
    ranks = [1, 2, 99, 250, 251, 499]
    assert op13.rank_cuts(runs, ranks) == [keys[i] for i in ranks] and op13.rank_cuts(runs, []) == []
