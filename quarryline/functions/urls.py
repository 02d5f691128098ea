"""URL functions, Column to Column."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEME = r"(?i)^(https?|ftp|file)://"


def _if_url(url: Column, value: Column) -> Column:
    return F.when(F.regexp_like(url, F.lit(SCHEME)), value)


def host(url: Column) -> Column:
    """Host without user and port, or null for what isn't a URL."""
    return _if_url(url, F.regexp_replace(F.regexp_replace(F.regexp_extract(url, r"(?i)^\w+://([^/?#]*)", 1), r"^.*@", ""), r":\d*$", ""))


def normalized(url: Column) -> Column:
    """The URL with a lower-case scheme and without the fragment, or null."""
    return _if_url(url, F.concat(F.lower(F.regexp_extract(url, r"^(\w+)", 1)), F.regexp_extract(url, r"^\w+(://[^#]*)", 1)))


def path(url: Column) -> Column:
    """Path, query and fragment, or null."""
    return _if_url(url, F.regexp_extract(url, r"(?i)^\w+://[^/?#]*(.*)$", 1))


def path_words(url: Column) -> Column:
    """Lower-case words of the path: letters only, camel case split."""
    letters = F.regexp_replace(F.regexp_replace(path(url), "[^a-zA-Z]", " "), "(?<=[a-z])(?=[A-Z])", " ")
    return F.split(F.lower(F.trim(F.regexp_replace(letters, " +", " "))), " ")


class Names:
    """Many names with marks (a letter each) as one constant of a projection: a name is looked up in the slot of its crc32."""

    def __init__(self, entries: Iterable[tuple[str, str]]):
        entries = set(entries)
        self.slots = 1 << max(4, len(entries).bit_length())
        held: list[list[str]] = [[] for _ in range(self.slots)]
        for name, mark in sorted(entries):
            held[zlib.crc32(name.encode()) % self.slots].append(f"{name}\x02{mark}\x01")
        self.table = F.split(F.lit("\x03".join("\x01" + "".join(x) for x in held)), "\x03")

    def has(self, name: Column, mark: str) -> Column:
        slot = (F.crc32(name) % self.slots).cast("int")
        return F.coalesce(F.contains(F.get(self.table, slot), F.concat(F.lit("\x01"), name, F.lit(f"\x02{mark}\x01"))), F.lit(False))


def tail(labels: Column, k: Column) -> Column:
    """The last k labels as a name."""
    return F.array_join(F.slice(labels, -k, k), ".")


def bound(value: Column, fn: Callable[[Column], Column]) -> Column:
    """A function of a value that is worked out once."""
    return F.transform(F.array(value), fn)[0]


#: Host patterns up to which one regex is faster than the lookup (by half for two dozen).
FEW = 64
#: A host pattern that the table of names can hold: subdomains, literal labels, a last label of any two characters, or without it.
PLAIN = re.compile(r"(?P<sub>\(\.\+\\\.\)\?|\.\+\\\.)?(?P<name>[\w-]+(?:\\\.[\w-]+)*)(?P<two>\\\.\.\.|\(\\\.\.\.\)\?)?")


def host_names(patterns: Iterable[str]) -> tuple[list[tuple[str, str]], list[str]]:
    """Names of host patterns, marked e (the host itself) or s (subdomains of it), ?? for a label of two characters; and the patterns
    that are no plain names."""
    names, rest = [], []
    for pattern in patterns:
        found = PLAIN.fullmatch(pattern)
        if not found or not pattern.isascii():
            rest.append(pattern)
            continue
        name, two = found["name"].replace("\\.", "."), found["two"]
        marks = {None: "e", "(": "es", ".": "s"}[found["sub"] and found["sub"][0]]
        ends = [""] if not two else [".??"] if two[0] == "\\" else ["", ".??"]
        names += [(name + end, mark) for mark in marks for end in ends]
    return names, rest


def discarded(url: Column, patterns: tuple[str, ...]) -> Column:
    """Whether the whole host fits any pattern; what has no host isn't discarded.

    Many patterns that are plain names with or without subdomains are looked up label by label, whatever their number; the others, hosts
    with empty labels, and lists of up to ``FEW`` patterns are held against one regex.
    """
    if not patterns:
        return F.lit(False)
    either = lambda some: F.regexp_like(at, F.lit("^(?:" + "|".join(f"(?:{p})" for p in some) + ")$"))
    at = host(url)
    if len(patterns) <= FEW:
        return F.coalesce(either(patterns), F.lit(False))
    listed, rest = host_names(patterns)
    names = Names(listed)

    def fits(labels: Column) -> Column:
        n = F.size(labels)
        # Of an ending, or of one whose last label has two characters, what comes before it decides.
        masked = F.when(F.length(F.get(labels, n - 1)) == 2, F.concat(F.slice(labels, 1, n - 1), F.array(F.lit("??"))))

        def ends(some: Column) -> Column:
            below = F.exists(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda k: (k < n) & names.has(tail(some, k), "s"))
            return below | names.has(F.array_join(some, "."), "e")

        return ends(labels) | F.coalesce(ends(masked), F.lit(False))

    plain = F.when(F.regexp_like(at, F.lit(r"^\.|\.\.|\.$|[\x00-\x1f\u0085\u2028\u2029]")), either(patterns)).when(F.length(at) > 0, bound(F.split(at, r"\."), fits))
    return F.coalesce(plain | either(rest) if rest else plain, F.lit(False))


def url_key(url: Column) -> Column:
    """Canonical key of a URL: lower case, without scheme, ``www`` with digits, session ids, fragment and a last slash."""
    key = F.regexp_replace(F.lower(url), r"^\w+://(?:www\d*\.)?", "")
    key = F.regexp_replace(F.regexp_replace(key, "#.*$", ""), r"(?:;jsessionid=[0-9a-z]*|(?<=[?&])(?:jsessionid|phpsessid|sid)=[0-9a-z]*&?)", "")
    return F.regexp_replace(key, r"[/?&]+$", "")


def filename(url: Column, is_pdf: Column) -> Column:
    """A file name that gives the URL back."""
    name = F.replace(F.replace(F.replace(url, F.lit("§"), F.lit("§§")), F.lit("\\"), F.lit("§\\")), F.lit("/"), F.lit("\\"))
    return F.concat(name, F.when(is_pdf, ".pdf").otherwise(".html"))


def url_of_filename(name: Column) -> Column:
    """The URL of a file name, or null if it doesn't end in .pdf or .html."""
    # One pass over the escapes: mark each, so that none is read twice.
    marked = F.regexp_replace(F.regexp_replace(name, r"\.(pdf|html)$", ""), r"§(§|\\)", "\u0001$1\u0002")
    plain = F.replace(marked, F.lit("\u0001§\u0002"), F.lit("\u0003"))
    plain = F.replace(plain, F.lit("\u0001\\\u0002"), F.lit("\u0004"))
    plain = F.replace(F.replace(F.replace(plain, F.lit("\\"), F.lit("/")), F.lit("\u0003"), F.lit("§")), F.lit("\u0004"), F.lit("\\"))
    return F.when(F.regexp_like(name, F.lit(r"\.(pdf|html)$")), plain)


#: Marks of suffix rules: e a suffix, u any label below it is one, x a domain in spite of that.
RULE_MARKS = {"EXACT": "e", "UNDER": "u", "EXCLUDED": "x"}
_rules: list[tuple[Names, int]] = []


def suffix_rules(spark: SparkSession) -> tuple[Names, int]:
    """The public suffixes that ship with Spark's libraries, about 10,000, and the most labels of one. They are read once."""
    if not _rules:
        jvm = spark.sparkContext._jvm
        lists = {mark: jvm.com.google.common.base.Joiner.on(" ").join(getattr(jvm.com.google.thirdparty.publicsuffix.PublicSuffixPatterns, k).keySet()).split() for k, mark in RULE_MARKS.items()}
        entries = [(name, mark) for mark, names in lists.items() for name in names]
        _rules.append((Names(entries), max(name.count(".") + 1 for name, _ in entries)))
    return _rules[0]


def top_private_domain(spark: SparkSession, host_column: Column) -> Column:
    """The public suffix of a host and one label more; empty for addresses, bare suffixes, unlisted top domains and null.

    The ends of a host are looked up in one table of suffixes within the projection, without a join.
    """
    names, most = suffix_rules(spark)

    def domain(labels: Column) -> Column:
        n = F.size(labels)

        # The longest end that a rule fits: a wildcard fits one label more than it has, what is excluded is a domain itself.
        def longer(size: Column, k: Column) -> Column:
            end, below = tail(labels, k), tail(labels, k - 1)
            return F.when(names.has(end, "x"), k).when(names.has(end, "e") | ((k > 1) & names.has(below, "u")), k + 1).otherwise(size)

        size = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(n, F.lit(most + 1)), F.lit(1))), F.lit(0), longer)
        return bound(size, lambda k: F.when((k > 0) & (k <= n), tail(labels, k)).otherwise(F.lit("")))

    labels = F.split(F.regexp_replace(F.lower(host_column), r"^\.+|\.+$", ""), r"\.")
    return F.coalesce(bound(labels, domain), F.lit(""))


def with_top_private_domain(rows: DataFrame, host_column: Column, name: str = "domain") -> DataFrame:
    """Rows with the top private domain of a host; a column that has that name already gives way to it."""
    return rows.withColumn(name, top_private_domain(rows.sparkSession, host_column))
