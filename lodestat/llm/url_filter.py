"""URL filters: host-suffix and path-prefix expressions, joined on short hash prefixes, confirmed by full digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower

#: Hex digits of a digest that the join compares; the rest is confirmed after it.
PREFIX_DIGITS = 8
#: A rule table of at most this many rows (about 100 bytes each) is broadcast; a larger one is joined by shuffle.
BROADCAST_RULES = 100_000
#: Copies of one row are given back by so many at once.
COPIES = 4096


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty if the url is null or has no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _digest(host: Column, path: Column) -> Column:
    """A host has no slash and a path starts with one, so that the two together are unambiguous."""
    return F.sha2(F.concat(host, path), 256)


def filter_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """Judge every url by the longest rule that fits it.

    rules: (action, host, path). A rule fits its host and all subdomains if the url's path starts with the rule's;
    the longest wins, of equally long ones that with the longer host, then ``block``. Returns id, host, path, rule
    (host and path together, or null), verdict (the rule's action, else default), one row for each input row: rows
    equal in id, host and path are counted before the shuffle, judged once and given back as often, null ids included;
    null urls have empty host and path, urls of any length are read whole, other columns of pages are not looked at, no
    pages give no rows, an empty rule table gives the default. Only expressions that some rule could equal are made:
    suffixes of at most as many labels as rules have, and prefixes of lengths that occur among rules. Nothing depends
    on the order of rows, so a task that runs again gives the same.
    """
    made = rules.select(
        F.col("action").alias("__action"), F.col("host").alias("__rule_host"), F.concat("host", "path").alias("__rule"),
        _digest(F.col("host"), F.col("path")).alias("__full"), F.length("path").alias("__rule_path"),
    ).where("__full is not null").withColumn("__short", F.substring("__full", 1, PREFIX_DIGITS))
    about = made.agg(F.count("*").alias("n"), F.max(F.size(F.split("__rule_host", r"\."))).alias("labels"), F.sort_array(F.collect_set("__rule_path")).alias("lengths")).first()
    host, path = split_url(F.col("__url"))
    split = pages.select(F.col(id_col).alias("__id"), F.col(url_col).alias("__url")).select("__id", host.alias("__host"), path.alias("__path"))
    if not about["n"]:
        return split.select(F.col("__id").alias(id_col), F.col("__host").alias("host"), F.col("__path").alias("path"), F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    judged = split.groupBy("__id", "__host", "__path").agg(F.count("*").alias("__n"))
    labels = F.split("__host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.least(F.size(labels), F.lit(about["labels"]))), lambda j: F.array_join(F.slice(labels, F.size(labels) - j + 1, j), "."))
    lengths = F.filter(F.array(*[F.lit(n) for n in about["lengths"]]), lambda n: n <= F.length("__path"))
    prefixes = F.transform(lengths, lambda n: F.substring("__path", F.lit(1), n))
    pairs = F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: _digest(h, p))))
    asked = judged.select("__id", "__host", "__path", "__n", F.explode_outer(pairs).alias("__digest")).withColumn("__head", F.substring("__digest", 1, PREFIX_DIGITS))
    table = F.broadcast(made) if about["n"] <= BROADCAST_RULES else made
    met = asked.join(table, F.col("__head") == F.col("__short"), "left")
    fits = F.when(F.col("__digest") == F.col("__full"), F.struct(F.length("__rule").alias("a"), F.length("__rule_host").alias("b"), F.col("__action").alias("action"), F.col("__rule").alias("rule")))
    best = met.groupBy("__id", "__host", "__path").agg(F.max(fits).alias("__best"), F.first("__n").alias("__n"))  # on the same keys: no second shuffle
    runs = best.withColumn("__run", F.explode(F.sequence(F.lit(0), F.floor((F.col("__n") - 1) / COPIES))))
    again = runs.withColumn("__copy", F.explode(F.array_repeat(F.lit(0), F.least(F.lit(COPIES), F.col("__n") - F.col("__run") * COPIES).cast("int"))))
    return again.select(F.col("__id").alias(id_col), F.col("__host").alias("host"), F.col("__path").alias("path"), F.col("__best.rule").alias("rule"), F.coalesce("__best.action", F.lit(default)).alias("verdict"))
