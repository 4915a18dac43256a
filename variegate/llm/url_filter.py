"""URL filter: a blocked Bloom filter in front of an exact join, below host and path rules.

Everything is column expressions. The filter is a table of blocks of 256 bits. A listed URL sets
four bits, all in one block, so a page asks for one row. Pages that the filter passes are
joined to the list exactly, which removes its false positives; the others never meet the list.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from variegate.llm.common import checked_broadcast, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS = 4  # of 64 bits in a block
URLS_PER_BLOCK = 16  # 16 bits for each listed URL
SALTS = 16  # parts of a hot URL in the exact join

Rule = tuple[str, str, str]


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case.

    Empty for null and for a url without ``://``.
    """
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Host without ``www.``, path without closing slashes, query without tracking fields.

    Null for null and for a url without a host.
    """
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    fields = F.filter(F.split(query, "&"), lambda x: (x != "") & ~x.rlike("^(utm_[a-z]+|ref)="))
    host = F.regexp_replace(host_of(url), r"^www\.", "")
    asked = F.when(F.size(fields) > 0, F.concat(F.lit("?"), F.array_join(F.sort_array(fields), "&")))
    plain = F.concat(host, F.regexp_replace(path_of(url), "/+$", ""),
                     F.coalesce(asked, F.lit("")))
    return F.when(host != "", plain)


def rule_for(host: Column, path: Column, rules: list[Rule], field: int) -> Column:
    """Of the longest rule that fits: its text (``field`` 1) or its verdict (2); else null.

    A rule ``(host, path, verdict)`` fits its host and all subdomains, where the url's path
    starts with the rule's.
    """
    chain = None
    for rule_host, rule_path, verdict in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r)):
        fits = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(rule_path)
        value = F.lit(rule_host + rule_path if field == 1 else verdict)
        chain = F.when(fits, value) if chain is None else chain.when(fits, value)
    return F.lit(None).cast("string") if chain is None else chain


def _bit_places(name: str, n_blocks: int) -> tuple[Column, list[Column]]:
    """The block of a canonical URL, and the place of its bit in each word of the block."""
    first, second = F.xxhash64(F.col(name)), F.xxhash64(F.col(name), F.lit(1))
    places = [F.pmod(F.shiftright(second, 8 * i), F.lit(64)).cast("int") for i in range(WORDS)]
    return F.pmod(first, F.lit(n_blocks)), places


def _one_bit(place: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), place)


def bloom_blocks(listed: DataFrame, name: str, n_blocks: int) -> DataFrame:
    """The filter as rows ``block, w0 .. w3``; blocks without a bit are left out."""
    block, places = _bit_places(name, n_blocks)
    bits = [_one_bit(p).alias(f"w{i}") for i, p in enumerate(places)]
    return listed.select(block.alias("block"), *bits).groupBy("block") \
        .agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)])


def judge_urls(pages: DataFrame, listed: DataFrame, rules: list[Rule],
               keep: tuple[str, ...] = ("page_id",), url: str = "url") -> DataFrame:
    """Return ``keep``, host, path, rule, verdict and canonical of every row.

    listed: column ``canonical``, URLs as :func:`canonical` writes them, in any number, nulls
    and repeats included. A rule decides first; without one, a listed URL is blocked and
    every other one allowed. Null and hostless urls have no canonical form and are allowed.
    No row is lost or repeated; an empty list allows all. The list is written once; the filter
    is broadcast if its blocks are counted to be few, else it is joined by block.
    """
    names = written(listed.select("canonical").where(F.col("canonical").isNotNull()).distinct())
    n_blocks = max(1, -(-names.count() // URLS_PER_BLOCK))
    blocks = written(bloom_blocks(names, "canonical", n_blocks))
    host, path = host_of(F.col(url)), path_of(F.col(url))
    kept = [F.col(c).alias(f"__keep{i}") for i, c in enumerate(keep)]
    rows = pages.select(*kept, host.alias("__host"), path.alias("__path"),
                        rule_for(host, path, rules, 1).alias("__rule"),
                        rule_for(host, path, rules, 2).alias("__ruled"),
                        canonical(F.col(url)).alias("__name"))
    block, places = _bit_places("__name", n_blocks)
    asked = rows.withColumn("__block", F.when(F.col("__name").isNotNull(), block))
    joined = asked.join(checked_broadcast(blocks), F.col("__block") == F.col("block"), "left")
    held = reduce(Column.__and__, [
        F.col(f"w{i}").bitwiseAND(_one_bit(p)) != 0 for i, p in enumerate(places)])
    probed = joined.withColumn("__maybe", F.coalesce(held & F.col("__name").isNotNull(),
                                                     F.lit(False)))
    salt = F.pmod(F.xxhash64(*[f"__keep{i}" for i in range(len(keep))]), F.lit(SALTS))
    hits = probed.where("__maybe").withColumn("__salt", salt)
    salts = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))
    sought = names.select(F.col("canonical").alias("__listed"), salts.alias("__of"))
    exact = hits.join(sought, (F.col("__name") == F.col("__listed"))
                      & (F.col("__salt") == F.col("__of")), "left")
    rest = probed.where(~F.col("__maybe")).withColumn("__listed", F.lit(None).cast("string"))
    both = exact.select(rest.columns).unionByName(rest)
    verdict = F.when(F.col("__listed").isNotNull(), "block").otherwise("allow")
    return both.select(
        *[F.col(f"__keep{i}").alias(c) for i, c in enumerate(keep)],
        F.col("__host").alias("host"), F.col("__path").alias("path"),
        F.col("__rule").alias("rule"),
        F.coalesce("__ruled", verdict).alias("verdict"), F.col("__name").alias("canonical"))
