"""Matching, linkage and alignment of record mining against plain definitions, and on wide and deep pages."""

import itertools
import random
import time

import numpy as np
import pytest

from quarryline.operators import mining


def page(r, level=0):
    tag = r.choice(["div", "p2", "span", "b", "td"])
    kids = "".join(page(r, level + 1) for _ in range(r.choice([0, 1, 1, 2, 3]) if level < 3 else 0))
    return f"<{tag}{r.choice(['', ' class=x', ' class=y'])}>{r.choice(['', 't', 'u'])}{kids}</{tag}>"


def roots(n, seed):
    r = random.Random(seed)
    for _ in range(n):
        row = [page(r, 1) for _ in range(3)]
        kids = [x for _ in range(r.randint(1, 4)) for x in row if r.random() < 0.8] + [page(r, 1) for _ in range(r.randint(0, 3))]
        yield mining.parse("<ul>" + "".join(kids) + "</ul>").kids[0]


def chain(n, m, score):
    best = np.zeros((n + 1, m + 1))
    for i, j in itertools.product(range(n), range(m)):
        best[i + 1, j + 1] = max(best[i, j + 1], best[i + 1, j], best[i, j] + score(i, j))
    return float(best[n, m])


def plain_clustered(a, b, wide=1):
    if a.tag != b.tag:
        return 0.0
    n, m = len(a.kids), len(b.kids)
    return (chain(n, m, lambda i, j: plain_clustered(a.kids[i], b.kids[j], max(n, m))) if n or m else 1.0) / wide


def plain_simple(a, b):
    return 0 if a.tag != b.tag else 1 + int(chain(len(a.kids), len(b.kids), lambda i, j: plain_simple(a.kids[i], b.kids[j])))


def plain_linkage(points, kinds, threshold):
    groups = [[k for k, s in enumerate(kinds) if s == i] for i in range(len(points))]
    often = np.bincount(kinds, minlength=len(points))
    far = np.array([[np.sqrt(((a - b) ** 2 * often).sum()) for b in points] for a in points])
    alive = list(range(len(points)))
    while len(alive) > 1:
        d, x, y = min((max(far[i, j] for i in members[x] for j in members[y]), x, y) for members in [{a: set(np.array(kinds)[groups[a]]) for a in alive}] for x, y in itertools.combinations(alive, 2))
        if d > threshold:
            break
        groups[x] += groups[y]
        alive.remove(y)
    return {frozenset(groups[a]) for a in alive}


def test_matches_are_those_of_the_definition():
    for root in roots(60, 1):
        for a, b in itertools.combinations_with_replacement(root.kids[:6], 2):
            assert mining.clustered_match(a, b) == plain_clustered(a, b) and mining.simple_match(a, b) == plain_simple(a, b)
        sims, kinds = mining.similarities(root.kids)
        assert all(sims[kinds[i], kinds[j]] == plain_clustered(root.kids[i], root.kids[j]) for i in range(len(kinds)) for j in range(len(kinds)))


@pytest.mark.parametrize("seed", range(4))
def test_cuts_are_those_of_complete_linkage(seed):
    r = np.random.default_rng(seed)
    for n in (1, 2, 7, 14):
        points = r.random((n, n))
        points = (points + points.T) / 2
        kinds = list(range(n)) + r.integers(0, n, 5).tolist()
        for threshold in (0.0, 0.6, 1.2, 3.0):
            labels = mining.clusters(points, kinds, threshold)
            found = {frozenset(i for i, x in enumerate(labels) if x == c) for c in set(labels)}
            assert found == plain_linkage(points, kinds, threshold)


def test_distances_of_many_points():
    """More points than are compared one by one."""
    points = np.random.default_rng(1).random((600, 600))
    often = np.random.default_rng(2).integers(1, 4, 600)
    far = mining.distances(points, often)
    assert np.allclose(far[17], np.sqrt(((points - points[17]) ** 2 * often).sum(axis=1)), atol=1e-4) and far[5, 5] == 0


def test_mean_similarity_counts_all_pairs():
    r = random.Random(4)
    sims = np.array([[r.random() for _ in range(6)] for _ in range(6)])
    sims = (sims + sims.T) / 2
    records = [tuple(r.choices(range(6), k=r.randint(1, 4))) for _ in range(30)]
    want = sum(mining.record_similarity(a, b, sims) for a, b in itertools.combinations(records, 2)) / (30 * 29 // 2 + 1)
    assert abs(mining.mean_similarity(records, sims) - want) < 1e-9


def test_many_shapes():
    """A thousand rows of different shapes."""
    r, rows = random.Random(1), {}
    while len(rows) < 1000:
        rows["".join(f"<td>{r.choice(['', '<b>x</b>', '<i>y</i>', '<a><b>z</b></a>', 't'])}</td>" for _ in range(6))] = None
    began = time.time()
    table = mining.parse("<table>" + "".join(f"<tr>{x}</tr>" for x in rows) + "</table>").kids[0]
    assert len(mining.similarities(table.kids)[0]) == 1000
    mining.mine(table)
    assert time.time() - began < 30


def test_deep_items():
    depth = 3000
    began = time.time()
    items = "".join(f"<li>{'<div>' * depth}v{i}{'</div>' * depth}</li>" for i in range(3))
    records = mining.mine(mining.parse(f"<ul>{items}</ul>").kids[0])
    assert [list(x.values()) for x in records] == [["v0"], ["v1"], ["v2"]] and time.time() - began < 20


def texts(html):
    return mining.mine(mining.parse(html).kids[0])


def test_records_of_known_pages():
    """Records of small pages, written out by hand."""
    assert texts("<ul><li><b>a</b>1</li><li><b>b</b>2</li><li><b>c</b>3</li></ul>") == [{"/li/b/text": k, "/li/text": v} for k, v in (("a", "1"), ("b", "2"), ("c", "3"))]
    # Records of two children each, found by their first one.
    assert texts("<dl><dt>k</dt><dd><i>v</i></dd><dt>l</dt><dd><i>w</i></dd></dl>") == [{"/dt/text": "k", "/dd/i/text": "v"}, {"/dt/text": "l", "/dd/i/text": "w"}]
    # A column that only one record has, between two that all have.
    rows = "<tr><td>a</td><td>b</td></tr><tr><td>c</td><th>x</th><td>d</td></tr><tr><td>e</td><td>f</td></tr>"
    assert texts(f"<table>{rows}</table>") == [{"/tr/td[1]/text": "a", "/tr/td[2]/text": "b"}, {"/tr/td[1]/text": "c", "/tr/th/text": "x", "/tr/td[2]/text": "d"}, {"/tr/td[1]/text": "e", "/tr/td[2]/text": "f"}]


def test_marks_tell_columns_apart():
    """Equal tags: the class decides which column a node fills."""
    template = [mining.Column.of(mining.parse("<li><b class=n>a</b><b class=p>1</b></li>").kids[0], 0)]
    mining.place(template, mining.parse("<li><b class=p>2</b></li>").kids, 1, True)
    assert mining.texts(template, 2) == [{"/li/b[1]/text": "a", "/li/b[2]/text": "1"}, {"/li/b[2]/text": "2"}]


def test_results_are_handed_on_in_slices():
    """However many pages a batch has, a task holds the results of some of them only."""
    import pyarrow as pa

    html = "<ul>" + "".join(f"<li><b>k{i}</b>{'v' * 2000}</li>" for i in range(50)) + "</ul>"
    batch = pa.RecordBatch.from_pydict({"page_id": list(range(100)), "html": [html] * 100})
    done = []
    found = mining.in_slices(iter([batch]), lambda page, html: (done.append(page), [(page, "/ul", 0, 1, 1, [[("/b", "k")]], None)])[1], mining.FIELDS)
    first = next(found)
    assert len(done) < 20 and first.num_rows == len(done)
    rows = [*first.to_pylist(), *(r for b in found for r in b.to_pylist())]
    assert [r["page_id"] for r in rows] == list(range(100)) and rows[-1]["records"] == [[("/b", "k")]]


def test_pages_of_one_build_are_cut_once(monkeypatch):
    """Roots and records are those of each page by itself, but are worked out once for a build."""
    calls = []
    plain = mining.template_of
    monkeypatch.setattr(mining, "template_of", lambda *a: (calls.append(1), plain(*a))[1])
    r, known = random.Random(7), mining.Known()
    htmls = [f"<body><h1>n{n}</h1><ul>" + "".join(f"<li class={'xy'[i % 2]}><b>k{n}</b>{i}</li>" for i in range(6)) + "</ul></body>" for n in range(50)]
    found = [[(path, known.mine(nodes, at)) for at, path in known.roots(nodes, 3)] for nodes in (known.page(mining.parse(h)) for h in htmls)]
    assert 0 < len(calls) == len(found[0])
    htmls += [f"<ul>{''.join(page(r, 1) for _ in range(4))}</ul><text>{page(r, 2)}</text>" for _ in range(40)]
    monkeypatch.setattr(mining, "KEPT", 500)  # what is kept is forgotten several times
    for h in htmls:
        nodes = known.page(mining.parse(h))
        want = [(root.path(), [list(x.items()) for x in mining.mine(root)]) for root in mining.candidate_roots(mining.parse(h))[:3]]
        assert [(path, known.mine(nodes, at)) for at, path in known.roots(nodes, 3)] == want
        assert known.kept < 500 + 10 * len(nodes) + 1000


def test_few_and_many_are_compared_alike(monkeypatch):
    for root in roots(30, 3):
        sims, kinds = mining.similarities(root.kids)
        cut = mining.best_division(sims, kinds, mining.clusters(sims, kinds))
        monkeypatch.setattr(mining, "FEW_SHAPES", 0)
        monkeypatch.setattr(mining, "FEW_PAIRS", 0)
        same, kinds = mining.similarities(root.kids)
        assert (sims == same).all() and cut == mining.best_division(same, kinds, mining.clusters(same, kinds))
        assert all(mining.simple_match(a, b) == plain_simple(a, b) for a, b in itertools.combinations(root.kids[:4], 2))
        monkeypatch.undo()


def test_texts_are_handed_on_in_slices():
    """The function that finds texts holds those of some pages of a batch only."""
    import pyarrow as pa

    class Pages:
        def select(self, *_):
            return self

        def mapInArrow(self, run, _):  # noqa: N802
            return run

    html = "<ul>" + "".join(f"<li><b>k{i}</b>{'v' * 2000}</li>" for i in range(50)) + "</ul>"
    batch = pa.RecordBatch.from_pydict({"page_id": list(range(100)), "html": [html] * 99 + [None]})
    found = [b.to_pylist() for b in mining.text_nodes(Pages())(iter([batch]))]
    assert max(len(b) for b in found) < 2000 and sum(len(b) for b in found) == 99 * 100
    assert found[0][:2] == [{"page_id": 0, "path": "/ul/li[1]/b", "text": "k0"}, {"page_id": 0, "path": "/ul/li[1]", "text": "v" * 2000}]
