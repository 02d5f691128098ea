"""Text functions, Column to Column: HTML to text, words, number extraction with contexts and runs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .patterns import BARE_STEPS, LABEL_WORDS, MARKER, NUMBER, WHITE_SPACE

BLOCK_TAGS = "address article aside blockquote br dd div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 head header hr html body li main nav ol p pre section table tbody td th thead title tr ul"
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"))
#: What is removed or replaced in turn; written so that engines without backreferences and lookarounds take it as well.
HTML_STEPS = (
    (r"(?is)<!--.*?-->", ""),
    *((rf"(?is)<{tag}\b.*?</{tag}\s*>", " ") for tag in ("script", "style", "noscript")),
    (rf"(?is)</?(?:{'|'.join(BLOCK_TAGS.split())})\b[^>]*>", " "),
    (r"(?s)<[^>]+>", ""),
)


def clean_spaces(text: Column) -> Column:
    return F.regexp_replace(text, WHITE_SPACE, " ")


def html_to_text(html: Column) -> Column:
    """Visible text of a page: no comments, scripts and styles; blocks apart; the common entities."""
    for pattern, by in HTML_STEPS:
        html = F.regexp_replace(html, pattern, by)
    for entity, by in ENTITIES:
        html = F.replace(html, F.lit(entity), F.lit(by))
    return F.trim(clean_spaces(html))


def words(text: Column) -> Column:
    """Lower-case words of letters. A text that begins with something else has an empty first word, an empty text one empty word."""
    w = F.regexp_replace(F.lower(text), r"[^\p{IsAlphabetic}]+", " ")
    return F.when(w == " ", F.array().cast("array<string>")).otherwise(F.split(F.rtrim(w), " "))


def numbers(text: Column, number: str = NUMBER) -> Column:
    return F.regexp_extract_all(text, F.lit(number), F.lit(0))


def bare_number(number: Column) -> Column:
    """A number without separators and labels, as registers write it; an office prefix stays."""
    for pattern in BARE_STEPS:
        number = F.regexp_replace(number, pattern, "")
    return number


def without_office(number: Column) -> Column:
    """Only the digits and a leading letter pair of special kinds: for registers of one office."""
    return F.regexp_replace(bare_number(number), "^(?:US|EP|GB|JP)", "")


def matches(text: Column, regex: str, context: int = 10) -> Column:
    """All matches with up to ``context`` characters on either side: array<struct<text, context>>. ``regex`` must not capture."""
    around = f"(?:(?<=((?s:.{{{context}}})))|(?<=\\A((?s:.{{0,{max(context - 1, 0)}}}))))(?:{regex})(?=((?s:.{{0,{context}}})))"
    found = [F.regexp_extract_all(text, F.lit(around), F.lit(i)) for i in (0, 1, 2, 3)]
    zipped = F.arrays_zip(*(f.alias(n) for f, n in zip(found, ("hit", "far", "near", "after"), strict=True)))
    return F.transform(zipped, lambda m: F.struct(m["hit"].alias("text"), F.concat(F.when(m["far"] == "", m["near"]).otherwise(m["far"]), m["hit"], m["after"]).alias("context")))


def shorter_context(context: Column, old: int, new: int) -> Column:
    """A context cut down from ``old`` to ``new`` characters on either side."""
    cut = old - new
    return F.substring(context, F.lit(cut + 1), F.greatest(F.length(context) - 2 * cut, F.lit(0)))


def cut_context(context: Column, hit: Column, old: int, new: int) -> Column:
    """A context of a match cut down from ``old`` to ``new`` characters on either side. One side may be shorter, where the text begins or
    ends: the match stands after ``old`` characters, or else before as many. If both are shorter, it is the first place that has it."""
    n, size = F.length(context), F.length(hit)
    after, before = F.lit(old + 1), F.greatest(n - old - size + 1, F.lit(1))
    is_at = lambda k: F.substring(context, k, size) == hit
    at = F.when(is_at(after) & (n <= 2 * old + size), after).when(is_at(before), before).otherwise(F.instr(context, hit))
    start = F.greatest(at - new, F.lit(1))
    return F.substring(context, start, at - start + size + new)


def marked_tokens(text: Column, number: str = NUMBER) -> Column:
    """Tokens of a text in which each number is one marker; the words of the label don't count."""
    t = F.regexp_replace(text, number, f" {MARKER} ")
    t = F.regexp_replace(t, LABEL_WORDS, " ")
    t = F.regexp_replace(F.regexp_replace(t, r"[^\p{IsAlphabetic}0-9]", " "), " +", " ")
    return F.when(t == " ", F.array().cast("array<string>")).otherwise(F.split(F.rtrim(t), " "))


def _flags(tokens: Column) -> Column:
    return F.array_join(F.transform(tokens, lambda x: F.when(x == MARKER, "1").otherwise("0")), "")


def longest_run(tokens: Column) -> Column:
    """Length of the longest run of markers, 0 without any."""
    return F.coalesce(F.array_max(F.transform(F.regexp_extract_all(_flags(tokens), F.lit("1+"), F.lit(0)), F.length)), F.lit(0))


def runs(tokens: Column) -> Column:
    """Runs of markers: array<struct<start, end, length>>, from 0 and inclusive."""
    # Cut at every change between 0 and 1; the places follow from the lengths.
    pieces = F.regexp_extract_all(_flags(tokens), F.lit("1+|0+"), F.lit(0))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,length:int>>").alias("found"))

    def step(acc: Column, piece: Column) -> Column:
        n = F.length(piece)
        run = F.struct(acc["at"].alias("start"), (acc["at"] + n - 1).alias("end"), n.alias("length"))
        return F.struct((acc["at"] + n).alias("at"), F.when(F.startswith(piece, F.lit("1")), F.array_append(acc["found"], run)).otherwise(acc["found"]).alias("found"))

    return F.aggregate(pieces, start, step, lambda acc: acc["found"])


def padded(items: Column) -> Column:
    """Items joined by spaces, with one on either end, so that `` word `` finds whole words."""
    return F.concat(F.lit(" "), F.array_join(items, " "), F.lit(" "))


def split_words(text: Column) -> Column:
    """The words of a text of ``padded``; none of an empty one."""
    trimmed = F.trim(text)
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, " "))


def tokens(text: Column) -> Column:
    """Words and punctuation marks of a text, without a language model."""
    return F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}]+(?:['’-][\p{L}\p{N}]+)*|\p{P}"), F.lit(0))


def is_punctuation(token: Column) -> Column:
    return F.regexp_like(token, F.lit(r"^\p{P}+$"))
