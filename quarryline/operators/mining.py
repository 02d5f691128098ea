"""Repeated-record mining in HTML pages.

A page is parsed into a light tree whose texts are ``text`` elements. Roots of repeated records are found by grouping the paths of texts;
the children of a root are compared by tree matching and clustered, and the best cluster cuts them into records. Records are aligned
into one *template*: a tree whose nodes are columns and hold, for each record, the node that fills them. Elements that fit no column get
a new one where their place is certain.

A page is handled as a whole in one Arrow batch function; finding candidate roots is also there as plain DataFrame operations.
"""

from __future__ import annotations

import functools
import itertools
import json
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.files import spread_out

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An open element of the key ends when one of the values starts.
CLOSED_BY = {"p": frozenset("p div ul ol table h1 h2 h3 h4 h5 h6 section article form".split()), "li": frozenset({"li"}), "tr": frozenset({"tr"}), "td": frozenset({"td", "th", "tr"}), "th": frozenset({"td", "th", "tr"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}), "option": frozenset({"option"})}
#: Distance at which clusters of children are cut apart.
THRESHOLD = 0.9
#: Pairs of records that are compared at once.
PAIRS = 1 << 18
#: Up to so many distinct shapes, and pairs of records, are compared one by one; arrays pay for more.
FEW_SHAPES, FEW_PAIRS = 512, 32
#: Characters of HTML whose results a task holds before it hands them on; a page stays whole.
SLICE = 1 << 20
#: Numbers, paths and places that a task keeps of pages it has seen.
KEPT = 1 << 18


@dataclass(eq=False)
class Node:
    tag: str
    marks: dict[str, str] = field(default_factory=dict)  # class and itemprop
    kids: list[Node] = field(default_factory=list)
    up: Node | None = None
    text: str = ""
    build: int = -1  # by ``Known``

    def add(self, kid: Node) -> Node:
        kid.up = self
        self.kids.append(kid)
        return kid

    def walk(self) -> Iterator[Node]:
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(reversed(node.kids))

    def size(self) -> int:
        return sum(1 for _ in self.walk())

    def path(self) -> str:
        parts, node = [], self
        while node.up is not None:
            same = [k for k in node.up.kids if k.tag == node.tag]
            parts.append(node.tag if len(same) == 1 else f"{node.tag}[{next(i for i, k in enumerate(same) if k is node) + 1}]")
            node = node.up
        return "/" + "/".join([node.tag, *reversed(parts)]) if node.tag != "#" else "/" + "/".join(reversed(parts))


class Builder(HTMLParser):
    """Lenient parser: comments and blank texts go, unclosed elements end with their parents."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.top = self.at = Node("#")

    def handle_starttag(self, tag: str, attrs: list) -> None:
        while self.at.up is not None and tag in CLOSED_BY.get(self.at.tag, ()):
            self.at = self.at.up
        node = self.at.add(Node(tag, {k: v for k, v in attrs if k in ("class", "itemprop") and v}))
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if self.at.tag == tag and tag not in VOID:
            self.at = self.at.up

    def handle_endtag(self, tag: str) -> None:
        node = self.at
        while node.up is not None and node.tag != tag:
            node = node.up
        if node.up is not None:
            self.at = node.up

    def handle_data(self, data: str) -> None:
        if data.strip() and self.at.tag not in ("script", "style"):
            self.at.add(Node("text", text=" ".join(data.split())))


def parse(html: str) -> Node:
    b = Builder()
    b.feed(html or "")
    b.close()
    return b.top


def numbered(top: Node) -> dict[str, Node]:
    """All elements by their path, in document order; each level is numbered once."""
    found: dict[str, Node] = {}
    stack = [(top, "")]
    while stack:
        node, path = stack.pop()
        if path:
            found.setdefault(path, node)
        if len(node.kids) < 2:
            stack += [(k, f"{path}/{k.tag}") for k in node.kids]
            continue
        total, seen, inner = Counter(k.tag for k in node.kids), Counter(), []
        for k in node.kids:
            seen[k.tag] += 1
            inner.append((k, f"{path}/{k.tag}" + (f"[{seen[k.tag]}]" if total[k.tag] > 1 else "")))
        stack.extend(reversed(inner))
    return found


def by_path(top: Node, path: str) -> Node | None:
    return numbered(top).get(path)


def simplified(path: str) -> str:
    return re.sub(r"\[\d+\]", "", path)


def common_prefix(items: list[list]) -> list:
    low, high = min(items), max(items)
    return [a for a, _ in itertools.takewhile(lambda p: p[0] == p[1], zip(low, high, strict=False))]


def split_before(items: list, starts: Callable) -> list[list]:
    """Cuts a list before each item that starts a part."""
    out: list[list] = []
    for item in items:
        if starts(item) or not out:
            out.append([])
        out[-1].append(item)
    return out


def runs_of(items: list, wanted: Callable) -> list[list]:
    return [list(g) for hit, g in itertools.groupby(items, wanted) if hit]


def candidate_roots(top: Node, of: Callable[[str], bool] = lambda text: True) -> list[Node]:
    """Roots with two children at least, those above most kinds of text paths first (then by path)."""
    kinds: dict[str, list[list[str]]] = {}
    places = numbered(top)
    for path, node in places.items():
        if node.tag == "text" and of(node.text):
            path = path.rpartition("/")[0]
            kinds.setdefault(simplified(path), []).append(path.split("/"))
    votes = Counter("/".join(common_prefix(paths)) for paths in kinds.values())
    found = (places.get(path) for path, _ in sorted(votes.items(), key=lambda v: (-v[1], v[0])))
    return [node for node in found if node is not None and len(node.kids) >= 2]


def best_chain(scores: list[list[float]]) -> tuple[float, list[tuple[int, int]]]:
    """Largest sum of scores over pairs (i, j) that ascend in both, and the pairs; a pair is taken only if it adds something."""
    n, m = len(scores), len(scores[0]) if scores else 0
    best = [[0.0] * (m + 1)]
    for row in scores:
        above, here = best[-1], [0.0]
        for j, score in enumerate(row):
            here.append(max(above[j + 1], here[j], above[j] + score))
        best.append(here)
    i, j, chain = n, m, []
    while i and j:
        if scores[i - 1][j - 1] and best[i][j] == best[i - 1][j - 1] + scores[i - 1][j - 1] and best[i][j] > max(best[i - 1][j], best[i][j - 1]):
            i, j = i - 1, j - 1
            chain.append((i, j))
        elif best[i][j - 1] > best[i - 1][j]:
            j -= 1
        else:
            i -= 1
    return float(best[n][m]), chain[::-1]


def best_total(one: tuple[int, ...], other: tuple[int, ...], score: Callable[[int, int], float]) -> float:
    """The best chain's total of two lists."""
    above = [0.0] * (len(other) + 1)
    for i in one:
        here, last = [0.0], 0.0
        for j, k in enumerate(other):
            last = max(above[j + 1], last, above[j] + score(i, k))
            here.append(last)
        above = here
    return above[-1]


def best_totals(one: tuple[int, ...], others: np.ndarray, score: Callable[[int, np.ndarray], np.ndarray]) -> np.ndarray:
    """The best chain's total of a list with each of many others of one length (a row each). ``score`` gives that of one item with each
    of some others."""
    above = [np.zeros(len(others))] * (others.shape[1] + 1)
    for item in one:
        here = [above[0]]
        for j in range(others.shape[1]):
            here.append(np.maximum(np.maximum(above[j + 1], here[j]), above[j] + score(item, others[:, j])))
        above = here
    return above[-1]


class Shapes:
    """The distinct shapes (tags, without texts and marks) of some nodes and of all that is below them, each known by a number; a
    shape's children have smaller ones than itself. ``of`` gives the number of each node."""

    def __init__(self, nodes: list[Node]):
        known: dict[tuple, int] = {}
        below: dict[int, int] = {}  # by identity
        for top in nodes:
            for node in reversed(list(top.walk())):  # children come before their parents
                below[id(node)] = known.setdefault((node.tag, *(below[id(k)] for k in node.kids)), len(known))
        self.kids = [key[1:] for key in known]
        tags: dict[str, int] = {}
        self.tag = np.array([tags.setdefault(key[0], len(tags)) for key in known], np.int64)
        self.of = [below[id(n)] for n in nodes]

    def matches(self, simple: bool = False) -> Callable[[int, int], float]:
        """Matches of any two shapes, from a table over pairs of one tag that is filled from the leaves up, each pair once.

        Clustered: a level counts by its width, a leaf 1 / width, an inner node what its children add up to / width. Simple: the number
        of nodes in the largest common top-down tree that keeps order."""
        if len(self.kids) <= FEW_SHAPES:
            return self.matches_one_by_one(simple)
        place = np.zeros(len(self.kids), np.int64)
        groups: dict[tuple[int, int], list[int]] = {}  # shapes of a tag with as many children, ascending
        for s, kids in enumerate(self.kids):
            groups.setdefault((int(self.tag[s]), len(kids)), []).append(s)
        sizes = np.bincount(self.tag) if len(self.tag) else self.tag
        table = [np.zeros((n, n)) for n in sizes]
        at = [0] * len(sizes)
        for s in range(len(place)):
            place[s] = at[self.tag[s]]
            at[self.tag[s]] += 1
        by_tag: dict[int, list] = {}
        for (tag, m), members in groups.items():
            by_tag.setdefault(tag, []).append((m, np.array(members), np.array([self.kids[s] for s in members], np.int64).reshape(len(members), m)))

        def score(one: int, others: np.ndarray) -> np.ndarray:
            same = self.tag[others] == self.tag[one]
            return np.where(same, table[self.tag[one]][place[one], np.where(same, place[others], 0)], 0.0)

        for s, kids in enumerate(self.kids):
            own = table[self.tag[s]]
            for m, members, rows in by_tag[int(self.tag[s])]:
                n = int(np.searchsorted(members, s, "right"))
                if not n:
                    continue
                wide = max(len(kids), m)
                if simple:
                    values = 1 + np.floor(best_totals(kids, rows[:n], score))
                else:
                    values = best_totals(kids, rows[:n], lambda one, others, w=wide: score(one, others) / w) if wide else np.ones(n)
                own[place[s], place[members[:n]]] = own[place[members[:n]], place[s]] = values
        return lambda a, b: float(table[self.tag[a]][place[a], place[b]]) if self.tag[a] == self.tag[b] else 0.0


    def matches_one_by_one(self, simple: bool) -> Callable[[int, int], float]:
        """The same; a pair is worked out, after those below it, when it is asked for."""
        kids, tag = self.kids, self.tag.tolist()
        known: dict[tuple[int, int], float] = {}

        def match(a: int, b: int) -> float:
            stack = [(a, b)]
            while stack:
                x, y = pair = stack[-1]
                if pair in known:
                    stack.pop()
                    continue
                if tag[x] != tag[y]:
                    known[pair] = 0.0
                    continue
                missing = [(i, j) for i in kids[x] for j in kids[y] if (i, j) not in known]
                if missing:
                    stack.extend(dict.fromkeys(missing))
                    continue
                wide = max(len(kids[x]), len(kids[y]))
                if simple:
                    value = 1.0 + int(best_total(kids[x], kids[y], lambda i, j: known[i, j]))
                else:
                    value = best_total(kids[x], kids[y], lambda i, j: known[i, j] / wide) if wide else 1.0  # noqa: B023
                known[pair] = known[y, x] = value
            return known[a, b]

        return match


def simple_match(a: Node, b: Node) -> int:
    """Number of nodes in the largest common top-down tree that keeps order."""
    found = Shapes([a, b])
    return int(found.matches(simple=True)(*found.of))


def normalized_match(a: Node, b: Node) -> float:
    return simple_match(a, b) / (2.0 * (a.size() + b.size()))


def clustered_match(a: Node, b: Node) -> float:
    """Match of two trees where a level counts by its width."""
    found = Shapes([a, b])
    return found.matches()(*found.of)


def similarities(nodes: list[Node]) -> tuple[np.ndarray, list[int]]:
    """Matches between the distinct shapes of the nodes, numbered by first occurrence, and the shape of each node: equal shapes match
    everything equally."""
    found = Shapes(nodes)
    number: dict[int, int] = {}
    kinds = [number.setdefault(s, len(number)) for s in found.of]
    match = found.matches()
    return np.array([[match(a, b) for b in number] for a in number]).reshape(len(number), len(number)), kinds


def distances(sims: np.ndarray, often: np.ndarray) -> np.ndarray:
    """Between rows of matches as points, where a column counts as often as its shape occurs."""
    points = sims * np.sqrt(often)
    if len(points) <= 512:
        return np.stack([np.sqrt(((points - p) ** 2).sum(axis=1)) for p in points]) if len(points) else points
    squares = (points**2).sum(axis=1)
    return np.sqrt(np.maximum(0, (squares[:, None] + squares[None, :] - 2 * (points @ points.T)).round(9)))


def clusters(sims: np.ndarray, kinds: list[int], threshold: float = THRESHOLD) -> list[int]:
    """Complete linkage over the nodes' rows of matches as points, cut at a distance; numbered by first member.

    Nodes of one shape are one point and are joined at distance 0, before all others, so linkage starts from the shapes.
    """
    n = len(sims)
    groups = [[i] for i in range(n)]
    far = distances(sims, np.bincount(kinds, minlength=n))
    np.fill_diagonal(far, np.inf)
    alive = np.ones(n, bool)
    # Each row's nearest other; distances only grow, so it is looked for again only where it was one of the two that join.
    near = far.argmin(axis=1) if n else np.zeros(0, np.int64)
    least = far[np.arange(n), near] if n else np.zeros(0)
    for _ in range(n - 1):
        x = int(least.argmin())
        y = int(near[x])
        if not least[x] <= threshold:
            break
        groups[x] += groups[y]
        far[x] = far[:, x] = np.maximum(far[x], far[y])
        far[x, x] = far[y] = far[:, y] = np.inf
        alive[y], least[y] = False, np.inf
        again = np.flatnonzero(alive & ((near == y) | ((near == x) & (far[:, x] > least))))
        again = np.union1d(again, [x])
        near[again] = far[again].argmin(axis=1)
        least[again] = far[again, near[again]]
    of = {i: g for g in np.flatnonzero(alive).tolist() for i in groups[g]}
    number: dict[int, int] = {}
    return [number.setdefault(of[k], len(number)) for k in kinds]


def record_similarity(a: tuple[int, ...], b: tuple[int, ...], sims: np.ndarray) -> float:
    """Of two records, given as the shapes of their children."""
    return best_chain([[sims[i, j] for j in b] for i in a])[0] / (max(len(a), len(b)) + 1)


def mean_similarity(records: list[tuple[int, ...]], sims: np.ndarray) -> float:
    """Similarities of all pairs of records, summed, by the number of pairs and one. Equal records are compared once, and records of two
    lengths with each other at once."""
    often = Counter(records)
    by_size: dict[int, list[tuple[int, ...]]] = {}
    for r in often:
        by_size.setdefault(len(r), []).append(r)
    lists = [(size, np.array(rows, np.int64).reshape(len(rows), size), np.array([often[r] for r in rows], float)) for size, rows in sorted(by_size.items())]
    total = -sum(n * record_similarity(r, r, sims) for r, n in often.items())  # a record isn't paired with itself
    near = sims.tolist()
    for k, (size, rows, times) in enumerate(lists):
        for size2, rows2, times2 in lists[k:]:
            if len(rows) * len(rows2) <= FEW_PAIRS:
                pairs = itertools.product(zip(rows.tolist(), times.tolist(), strict=True), zip(rows2.tolist(), times2.tolist(), strict=True))
                value = sum(n * n2 * best_total(r, r2, lambda i, j: near[i][j]) for (r, n), (r2, n2) in pairs) / (max(size, size2) + 1)
                total += value if size == size2 else 2 * value
                continue
            step = max(1, PAIRS // len(rows2))
            for at in range(0, len(rows), step):
                part = rows[at : at + step]
                above = [np.zeros((len(part), len(rows2)))] * (size2 + 1)
                for i in range(size):
                    here = [above[0]]
                    for j in range(size2):
                        here.append(np.maximum(np.maximum(above[j + 1], here[j]), above[j] + sims[part[:, i][:, None], rows2[:, j]]))
                    above = here
                value = float(times[at : at + step] @ above[-1] @ times2) / (max(size, size2) + 1)
                total += value if size == size2 else 2 * value
    return total / 2 / (len(records) * (len(records) - 1) // 2 + 1)


def best_division(sims: np.ndarray, kinds: list[int], labels: list[int]) -> list[list[int]]:
    """Records (lists of places) for the cluster whose members cut the children into the most similar ones; none if all differ."""
    if len(set(labels)) == len(labels):
        return []
    best, chosen = -1.0, []
    for c in sorted(set(labels)):
        records = [r for r in split_before(list(range(len(labels))), lambda i, c=c: labels[i] == c) if len(r) < len(labels)]
        if records:
            score = round(mean_similarity([tuple(kinds[i] for i in r) for r in records], sims), 12)
            if score > best:
                best, chosen = score, records
    return chosen


def division_by_seed(root: Node, seed: list[Node]) -> list[list[int]]:
    """Records cut where a child is most like the first element of a known record."""
    found = Shapes([*root.kids, *seed])
    match, n = found.matches(), len(root.kids)
    near = [max(range(len(seed)), key=lambda j, k=k: (match(k, found.of[n + j]), -j)) for k in found.of[:n]]
    if len(set(near)) == len(near):
        return []
    return [r for r in split_before(list(range(len(near))), lambda i: near[i] == 0) if len(r) < len(near)]


@dataclass(eq=False)
class Column:
    """A node of the template with the nodes that fill it, by record."""

    tag: str
    marks: dict[str, str]
    cells: dict[int, Node] = field(default_factory=dict)
    kids: list[Column] = field(default_factory=list)

    @staticmethod
    def of(node: Node, record: int) -> Column:
        top = Column(node.tag, node.marks, {record: node})
        stack = [(top, node)]
        while stack:
            column, n = stack.pop()
            column.kids = [Column(k.tag, k.marks, {record: k}) for k in n.kids]
            stack.extend(zip(column.kids, n.kids, strict=True))
        return top

    def walk(self) -> Iterator[Column]:
        stack = [self]
        while stack:
            column = stack.pop()
            yield column
            stack.extend(reversed(column.kids))


class Fits:
    """How well nodes fit columns: common nodes, and one more for each equal class and item property. Each pair is worked out once, from
    below; it holds as long as no columns were added below the pair."""

    def __init__(self):
        self.known: dict[tuple[int, int], int] = {}

    def fill(self, columns: list[Column], nodes: list[Node]) -> None:
        stack = [(c, n, False) for c in columns for n in nodes]
        while stack:
            c, n, ready = stack.pop()
            if (id(c), id(n)) in self.known:
                continue
            if c.tag != n.tag:
                self.known[id(c), id(n)] = 0
            elif ready:
                inner = best_chain(self.scores(c.kids, n.kids))[0]
                self.known[id(c), id(n)] = 1 + int(inner) + sum(1 for k in ("class", "itemprop") if c.marks.get(k) and c.marks.get(k) == n.marks.get(k))
            else:
                stack.append((c, n, True))
                stack.extend((x, y, False) for x in c.kids for y in n.kids)

    def scores(self, columns: list[Column], nodes: list[Node]) -> list[list[int]]:
        return [[self.known[id(c), id(n)] for n in nodes] for c in columns]


def place(columns: list[Column], nodes: list[Node], record: int, grow: bool) -> tuple[bool, bool]:
    """Fills the columns with the nodes that fit; (columns were added, something found no place).

    Nodes that fit nothing get columns of their own if their place is certain: before all, after all, or between two neighbours.
    ``grow`` is false below the level down to which columns may be added.
    """
    fits = Fits()
    fits.fill(columns, nodes)
    stack, grown, missed = [(columns, nodes)], False, False
    while stack:
        # Columns are added on the way down, so what is below this level is as it was when the table was filled.
        columns, nodes = stack.pop()
        own = {j: columns[i] for i, j in best_chain(fits.scores(columns, nodes))[1]}
        for j, column in own.items():
            column.cells[record] = nodes[j]
        for run in runs_of(list(range(len(nodes))), lambda j, own=own: j not in own):
            missed = True
            before, after = own.get(run[0] - 1), own.get(run[-1] + 1)
            first, last = run[0] == 0, run[-1] == len(nodes) - 1
            at = None
            if first and after is not None:
                at = 0
            elif last and before is not None:
                at = columns.index(before) + 1
            elif before is not None and after is not None and columns.index(after) - columns.index(before) == 1:
                at = columns.index(after)
            if at is not None and grow:
                columns[at:at] = [Column.of(nodes[j], record) for j in run]
                grown = True
        stack.extend((column.kids, nodes[j].kids) for j, column in own.items())
    return grown, missed


def aligned(records: list[list[Node]], seed: int | None = None) -> list[Column]:
    """The template of all records: that of ``seed`` first, by default the largest one; records that didn't fit whole are tried again
    once it has grown."""
    if seed is None:
        seed = max(range(len(records)), key=lambda r: (sum(n.size() for n in records[r]), -r))
    template = [Column.of(n, seed) for n in records[seed]]
    queue, waiting = [r for r in range(len(records)) if r != seed], []
    while queue:
        r = queue.pop(0)
        for c in (c for top in template for c in top.walk()):
            c.cells.pop(r, None)
        grown, missed = place(template, records[r], r, True)
        if grown:
            queue, waiting = queue + waiting, []
        elif missed:
            waiting.append(r)
    return template


def filled(template: list[Column], n: int) -> list[dict[str, Node]]:
    """For each record its text nodes by the path of the column (numbered among columns of the same tag)."""
    out: list[dict[str, Node]] = [{} for _ in range(n)]

    stack = [(template, "")]
    while stack:
        columns, prefix = stack.pop()
        total, seen = Counter(c.tag for c in columns), Counter()
        for c in columns:
            seen[c.tag] += 1
            path = f"{prefix}/{c.tag}" + (f"[{seen[c.tag]}]" if total[c.tag] > 1 else "")
            if c.tag == "text":
                for r, node in c.cells.items():
                    if node.text:
                        out[r][path] = node
            stack.append((c.kids, path))
    return out


def texts(template: list[Column], n: int) -> list[dict[str, str]]:
    """For each record the texts of its cells by the path of the column."""
    return [{path: node.text for path, node in record.items()} for record in filled(template, n)]


def mapping(template: list[Column], top: Node) -> list[dict[str, str]]:
    """For each column the path of the element that fills it, by the number of the record."""
    places = {id(node): path for path, node in numbered(top).items()}
    return [{r: places[id(node)] for r, node in sorted(c.cells.items())} for column in template for c in column.walk()]


def template_of(root: Node, seed: list[Node] | None = None) -> tuple[list[Column], int]:
    """The template of the records below a root and their number. ``seed`` is a known record, of this root or of another page: records
    are cut where they are like its first element, and aligned to it first."""
    if seed is None:
        sims, kinds = similarities(root.kids)
        cut = best_division(sims, kinds, clusters(sims, kinds))
    else:
        cut = division_by_seed(root, seed)
    records = [[root.kids[i] for i in r] for r in cut]
    if not records:
        return [], 0
    if seed is None:
        return aligned(records), len(records)
    at = next((i for i, r in enumerate(records) if r == seed), None)
    if at is not None:
        return aligned(records, at), len(records)
    template = aligned([*records, seed], len(records))  # a record of elsewhere: its columns stay, its cells go
    for c in (c for top in template for c in top.walk()):
        c.cells.pop(len(records), None)
    return template, len(records)


def mine(root: Node, seed: list[Node] | None = None) -> list[dict[str, str]]:
    """The records below a root, each a map from path to text."""
    return texts(*template_of(root, seed))


class Known:
    """What is known of pages seen before. Trees of one *build* (tags, marks and where texts are, but not what these say) have the same
    roots and are cut and aligned in the same way, so that is worked out once for each build. Beyond KEPT entries all of it is forgotten
    before the next page."""

    def __init__(self, seed: list[Node] | None = None):
        self.seed = seed
        self.forget()

    def forget(self) -> None:
        self.builds: dict[tuple, int] = {}
        self.found: dict[int, list[tuple[int, str]]] = {}
        self.cut: dict[tuple[int, ...], list[list[tuple[str, int]]]] = {}
        self.kept = 0

    def page(self, top: Node) -> list[Node]:
        """The nodes of a page in document order; each gets the number of its build."""
        if self.kept > KEPT:
            self.forget()
        nodes = list(top.walk())
        for node in reversed(nodes):  # children come before their parents
            marks = node.marks
            key = (node.tag, marks.get("class"), marks.get("itemprop"), bool(node.text), *[k.build for k in node.kids])
            new = len(self.builds)
            node.build = self.builds.setdefault(key, new)
            if node.build == new:
                self.kept += len(key)
        return nodes

    def roots(self, nodes: list[Node], most: int) -> list[tuple[int, str]]:
        """Places and paths of the best roots of a page, whatever its texts say."""
        found = self.found.get(nodes[0].build)
        if found is None:
            place = {id(node): i for i, node in enumerate(nodes)}
            found = self.found[nodes[0].build] = [(place[id(root)], root.path()) for root in candidate_roots(nodes[0])[:most]]
            self.kept += 1 + 2 * len(found)
        return found

    def mine(self, nodes: list[Node], at: int) -> list[list[tuple[str, str]]]:
        """The records below the root at a place of the page, as ``mine`` has them."""
        root = nodes[at]
        key = tuple([k.build for k in root.kids])
        records = self.cut.get(key)
        if records is None:
            place = {id(node): i for i, node in enumerate(root.walk())}
            records = self.cut[key] = [[(path, place[id(node)]) for path, node in r.items()] for r in filled(*template_of(root, self.seed))]
            self.kept += len(key) + sum(1 + 2 * len(r) for r in records)
        return [[(path, nodes[at + i].text) for path, i in r] for r in records]


def parse_strict(xml: str) -> Node:
    """A tree from XML that must be well-formed (ValueError if it isn't); marks and texts as in ``parse``."""
    from xml.parsers import expat

    top = at = Node("#")
    parser = expat.ParserCreate()
    parser.buffer_text = True

    def start(tag: str, attrs: dict) -> None:
        nonlocal at
        at = at.add(Node(tag, {k: v for k, v in attrs.items() if k in ("class", "itemprop") and v}))

    def end(_: str) -> None:
        nonlocal at
        at = at.up

    def data(text: str) -> None:
        if text.strip():
            at.add(Node("text", text=" ".join(text.split())))

    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, data
    try:
        parser.Parse(xml, True)
    except expat.ExpatError as e:
        raise ValueError(str(e)) from e
    return top


def printed(node: Node) -> str:
    """The tree as lines, indented by depth."""
    out, stack = [], [(node, 0)]
    while stack:
        n, level = stack.pop()
        out.append("  " * level + (n.text if n.tag == "text" else n.tag))
        stack.extend((k, level + 1) for k in reversed(n.kids))
    return "\n".join(out)


@functools.lru_cache(1 << 12)
def steps(path: str) -> tuple[str, ...]:
    """The levels of a path; a number is one of its own."""
    parts: list[str] = []
    for step in path.strip("/").split("/"):
        name, number = re.fullmatch(r"(.*?)(?:\[(\d+)\])?", step).groups()
        parts += [name, f"{int(number):03d}"] if number else [name]
    return tuple(parts)


def nested(flat: dict[str, str]) -> dict:
    """Paths as nested maps; a number becomes a level of its own, padded so that it sorts."""
    out: dict = {}
    for path, text in flat.items():
        parts, at = steps(path), out
        for p in parts[:-1]:
            at = at.setdefault(p, {})
        at[parts[-1]] = text
    return out


def compact(tree):
    """Nested maps without levels that have one child only."""
    if not isinstance(tree, dict):
        return tree
    if len(tree) == 1:
        return compact(next(iter(tree.values())))
    return {k: compact(v) for k, v in tree.items()}


SCHEMA = "page_id long, root string, rank int, n_records int, n_hits int, records array<map<string,string>>, error string"
FIELDS = pa.schema([("page_id", pa.int64()), ("root", pa.string()), ("rank", pa.int32()), ("n_records", pa.int32()), ("n_hits", pa.int32()), ("records", pa.list_(pa.map_(pa.string(), pa.string()))), ("error", pa.string())])

TEXTS = pa.schema([("page_id", pa.int64()), ("path", pa.string()), ("text", pa.string())])


def in_slices(batches: Iterator[pa.RecordBatch], rows_of: Callable[[int, str], list[tuple]], fields: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The rows of each page of batches (page_id, html). They are handed on whenever enough pages are through, so what a task holds
    depends neither on the number of pages in a batch nor on that of all pages."""

    def handed_on(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), fields, strict=True)], schema=fields)

    for batch in batches:
        rows, held = [], 0
        for page, html in zip(batch.column("page_id"), batch.column("html"), strict=True):
            html = html.as_py()
            rows += rows_of(page.as_py(), html)
            held += len(html or "")
            if held >= SLICE and rows:
                yield handed_on(rows)
                rows, held = [], 0
        if rows:
            yield handed_on(rows)


def mine_pages(pages: DataFrame, wanted: str | None = None, roots: int = 3, seed: str | None = None) -> DataFrame:
    """One row for each of the best roots of each page (page_id, html): its records, how many have a text that fits ``wanted``, or what
    went wrong. With ``seed``, the HTML of one record of any page, records are cut where a child is like the seed's first element. Roots of any width and depth are mined; matching is quadratic in the distinct shapes of their children."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hit = re.compile(wanted) if wanted else None
        known = Known(parse(seed).kids if seed is not None else None)

        def rows_of(page: int, html: str) -> list[tuple]:
            try:
                nodes = known.page(parse(html))
                if hit is None:
                    found = known.roots(nodes, roots)
                else:
                    place = {id(node): i for i, node in enumerate(nodes)}
                    found = [(place[id(root)], root.path()) for root in candidate_roots(nodes[0], lambda t: bool(hit.search(t)))[:roots]]
            except Exception as e:  # one page must not end the job; the row says what happened
                return [(page, None, 0, 0, 0, [], repr(e))]
            rows = []
            for rank, (at, path) in enumerate(found):
                try:
                    records = known.mine(nodes, at)
                    n = sum(1 for r in records if hit is None or any(hit.search(t) for _, t in r))
                    rows.append((page, path, rank, len(records), n, records, None))
                except Exception as e:
                    rows.append((page, path, rank, 0, 0, [], repr(e)))
            return rows

        return in_slices(batches, rows_of, FIELDS)

    return spread_out(pages.select("page_id", "html")).mapInArrow(run, SCHEMA)


def text_nodes(pages: DataFrame) -> DataFrame:
    """One row for each text of each page: the path of its parent, and the text."""

    def rows_of(page: int, html: str) -> list[tuple]:
        return [(page, path.rpartition("/")[0], n.text) for path, n in numbered(parse(html)).items() if n.tag == "text"]

    return pages.select("page_id", "html").mapInArrow(lambda batches: in_slices(batches, rows_of, TEXTS), "page_id long, path string, text string")


def candidates(nodes: DataFrame) -> DataFrame:
    """Candidate roots of each page with their votes, from text nodes, in DataFrame operations.

    The common prefix of many paths is that of the least and the greatest of them, so two aggregates are enough.
    """
    steps = F.split("path", "/")
    kinds = nodes.groupBy("page_id", F.regexp_replace("path", r"\[\d+\]", "").alias("kind")).agg(F.min(steps).alias("lo"), F.max(steps).alias("hi"))
    same = F.zip_with("lo", "hi", lambda a, b: F.when(a == b, a))
    shared = F.slice("lo", 1, F.when(F.array_position(F.transform(same, lambda x: x.isNull()), True) > 0, F.array_position(F.transform(same, lambda x: x.isNull()), True) - 1).otherwise(F.size("lo")).cast("int"))
    return kinds.groupBy("page_id", F.array_join(shared, "/").alias("root")).agg(F.count("*").alias("votes"))


def structure(mined: DataFrame) -> DataFrame:
    """The distinct paths of each root's records."""
    return mined.select("page_id", "root", F.array_sort(F.array_distinct(F.flatten(F.transform("records", F.map_keys)))).alias("paths"))


def nested_records(mined: DataFrame) -> DataFrame:
    """One row for each record: page_id, root, record, and its nested and compact form as JSON with sorted keys."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        text = lambda tree: json.dumps(tree, ensure_ascii=False, sort_keys=True)
        for whole in batches:
            for at in range(0, len(whole), 1000):
                batch = whole.iloc[at : at + 1000]
                flat = [nested(json.loads(r)) for r in batch["r"]]
                yield batch[["page_id", "root", "record"]].assign(nested=[text(t) for t in flat], compact=[text(compact(t)) for t in flat])

    rows = mined.select("page_id", "root", F.posexplode("records").alias("record", "r")).withColumn("r", F.to_json("r"))
    return rows.mapInPandas(run, "page_id long, root string, record int, nested string, compact string")


def interesting(mined: DataFrame, wanted: str) -> DataFrame:
    """Roots with a record that has a text that fits."""
    return mined.where(F.exists("records", lambda r: F.exists(F.map_values(r), lambda t: F.regexp_like(t, F.lit(wanted)))))
