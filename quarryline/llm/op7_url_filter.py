"""URL filter by the ratio of two character language models, in DataFrame operations only.

Longest-match rules on host and path give a first verdict. URLs that a rule allows or blocks are the training texts of two smoothed
variable-order Markov models (orders 0 to 2, Witten-Bell interpolation, unseen contexts back off to shorter ones). The score of a URL
is the difference of its log-likelihoods under them divided by its length; the threshold lies between the two classes' mean scores,
weighted by their spreads.

Characters are folded to an alphabet of 48 signs, so the table of log-ratios has 48**3 numbers at most, whatever the input; it enters
the scoring expression as a scalar subquery's array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scan import read_table, stored

#: Rules (verdict, host, path): the longest of those that fit wins.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: Signs 1 to 46; 0 stands before the first character and 47 for any other one.
ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789-._~/:?#=&"
SIZE = len(ALPHABET) + 2


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path (both empty for null or without ``://``). A-Z of the host are lower-cased, nothing else is."""
    rest = F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def longest_rule(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...]) -> tuple[Column, Column]:
    """Text (host and path) and verdict of the longest rule that fits; null if none does. Of equally long ones the first wins."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        text, verdict = F.when(fits, h + p).otherwise(text), F.when(fits, kind).otherwise(verdict)
    return text, verdict


def signs(url: Column) -> Column:
    """The URL as an array of numbers 1 to SIZE - 1, after two zeros."""
    # The place in the alphabet, 0 for what isn't in it.
    numbers = F.transform(F.split(F.lower(url), ""), lambda c: F.coalesce(F.nullif(F.instr(F.lit(ALPHABET), c), F.lit(0)), F.lit(SIZE - 1)))
    return F.concat(F.array(F.lit(0), F.lit(0)), F.when(F.length(url) > 0, numbers).otherwise(F.array().cast("array<int>")))


def codes(url: Column) -> Column:
    """Code (context of two and sign) of each character."""
    s = signs(url)
    two = F.zip_with(F.slice(s, 1, F.greatest(F.size(s) - 2, F.lit(0))), F.slice(s, 2, F.greatest(F.size(s) - 2, F.lit(0))), lambda a, b: a * SIZE + b)
    return F.zip_with(two, F.slice(s, 3, F.greatest(F.size(s) - 2, F.lit(0))), lambda h, c: h * SIZE + c)


def log_ratios(labelled: DataFrame) -> DataFrame:
    """One row with ``ratios``: for each code log P(sign | context, allow) - log P(sign | context, block), 0 without training texts."""
    counts = labelled.select("verdict", F.explode("codes").alias("code")).groupBy("code").agg(*(F.sum(F.when(F.col("verdict") == v, 1).otherwise(0)).alias(v) for v in ("allow", "block")))
    counts = stored(counts)  # bounded by the alphabet; what follows reads only this
    grid = counts.sparkSession.range(0, SIZE**3, 1, 8).select(F.col("id").cast("int").alias("code"))
    t = grid.join(counts, "code", "left").select("code", *(F.coalesce(v, F.lit(0)).alias(v) for v in ("allow", "block")))
    sign, one, two = (F.col("code") % SIZE).alias("sign"), (F.col("code") % SIZE**2).alias("one"), F.floor(F.col("code") / SIZE).alias("two")
    t = t.select("code", sign, one, two, "allow", "block")
    for v in ("allow", "block"):
        t = t.withColumnRenamed(v, f"{v}2")
    # Sums over shorter contexts; all of these tables are as bounded as the grid.
    uni = t.groupBy("sign").agg(*(F.sum(f"{v}2").alias(f"{v}0") for v in ("allow", "block")))
    bi = t.groupBy("one").agg(*(F.sum(f"{v}2").alias(f"{v}1") for v in ("allow", "block")))
    bi_context = bi.groupBy(F.floor(F.col("one") / SIZE).alias("context")).agg(*(e for v in ("allow", "block") for e in (F.sum(f"{v}1").alias(f"{v}_n1"), F.sum((F.col(f"{v}1") > 0).cast("int")).alias(f"{v}_t1"))))
    tri_context = t.groupBy("two").agg(*(e for v in ("allow", "block") for e in (F.sum(f"{v}2").alias(f"{v}_n2"), F.sum((F.col(f"{v}2") > 0).cast("int")).alias(f"{v}_t2"))))
    total = uni.agg(*(F.sum(f"{v}0").alias(f"{v}_n0") for v in ("allow", "block")))
    rows = t.join(F.broadcast(tri_context), "two").join(F.broadcast(bi), "one").withColumn("context", F.floor(F.col("one") / SIZE))
    rows = rows.join(F.broadcast(bi_context), "context").join(F.broadcast(uni), "sign")
    n0 = {v: total.select(f"{v}_n0").scalar() for v in ("allow", "block")}
    log = {}
    for v in ("allow", "block"):
        p0 = (F.col(f"{v}0") + 0.5) / (n0[v] + 0.5 * SIZE)
        p = p0
        for k in (1, 2):  # an unseen context has n = t = 0 and leaves p as it is
            n, kinds = F.col(f"{v}_n{k}"), F.col(f"{v}_t{k}")
            p = F.when(n > 0, (F.col(f"{v}{k}") + kinds * p) / F.greatest(n + kinds, F.lit(1))).otherwise(p)
        log[v] = F.when(n0[v] > 0, F.log(p)).otherwise(F.lit(0.0))
    both = (n0["allow"] > 0) & (n0["block"] > 0)
    rows = rows.select("code", F.when(both, log["allow"] - log["block"]).otherwise(F.lit(0.0)).alias("ratio"))
    # As many numbers as the alphabet allows: 48 groups of 48**2, then one row of 48 groups.
    groups = rows.groupBy(F.floor(F.col("code") / SIZE**2).alias("g")).agg(F.transform(F.array_sort(F.collect_list(F.struct("code", "ratio"))), lambda x: x["ratio"]).alias("part"))
    return stored(groups.agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("g", "part"))), lambda x: x["part"])).alias("ratios")))


def held_back(url: Column) -> Column:
    """A fifth of the urls with a rule: the models don't learn from these, the threshold is set on them."""
    return F.pmod(F.xxhash64(F.coalesce(url, F.lit(""))), F.lit(5)) == 0


def url_filter(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    """One row for each row of ``pages`` (page_id, url): host, path, rule, verdict, and the length-normalised ``score``.

    The verdict is that of the longest rule; without a rule it is ``block`` when the score is below the threshold, else ``allow``.
    A null or empty url, and any url when one of the classes has no training text, scores 0 and without a rule is allowed. Repeated
    rows are judged alike and count as often as they occur. An empty table gives an empty result.
    """
    u = pages.select(F.col("page_id"), F.col("url").cast("string").alias("url"))
    host, path = parts(F.coalesce("url", F.lit("")))
    u = u.select("page_id", "url", host.alias("host"), path.alias("path"))
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    u = u.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"), held_back(F.col("url")).alias("held"), codes(F.coalesce("url", F.lit(""))).alias("codes"))
    # Referred to once, so the projections collapse and the array stays one constant instead of a column of each row.
    scored = u.withColumn("ratios", log_ratios(u.where("verdict IS NOT NULL AND NOT held")).scalar())
    total = F.aggregate("codes", F.lit(0.0), lambda acc, c: acc + F.get("ratios", c))
    scored = scored.withColumn("total", total).drop("ratios")
    scored = scored.withColumn("score", F.when(F.size("codes") > 0, F.col("total") / F.size("codes")).otherwise(F.lit(0.0)))
    by = {v: F.col("verdict") == v for v in ("allow", "block")}
    # Of the urls that are held back; of all if there are none of a class.
    of = lambda fn, is_v: F.coalesce(fn(F.when(is_v & F.col("held"), F.col("score"))), fn(F.when(is_v, F.col("score"))))
    stats = scored.where("verdict IS NOT NULL").agg(*(e for v, is_v in by.items() for e in (of(F.avg, is_v).alias(f"{v}_m"), of(F.stddev_pop, is_v).alias(f"{v}_s"))))
    spread = F.col("allow_s") + F.col("block_s")
    threshold = stats.select(F.coalesce(F.when(spread > 0, (F.col("allow_m") * F.col("block_s") + F.col("block_m") * F.col("allow_s")) / spread).otherwise((F.col("allow_m") + F.col("block_m")) / 2), F.lit(float("-inf")))).scalar()
    own = F.when(F.col("score") < threshold, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("verdict", own).alias("verdict"), "score")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(read_table(spark, sf_dir, "pages"))
