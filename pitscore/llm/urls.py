"""URL filters: host and path rules, then a blocked Bloom filter of listed URLs before an exact join.

The filter's blocks are rows of four 64-bit words, built and probed with bit expressions. Only URLs that
pass it, hits and a few false positives, are shuffled to the exact join with the list.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitscore.sources.io import materialize

BITS_PER_KEY, BITS_SET = 12, 8
#: Largest filter that is broadcast; a larger one is joined on its block number.
BROADCAST_BYTES = 64 << 20
#: Query parameters that do not change what a URL shows.
TRACKING = r"^(utm_.*|ref|fbclid|gclid)(=.*)?$"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?`` or ``#``, A-Z lower-cased; else empty."""
    return F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def canonical(url: Column) -> Column:
    """One form for the variants of a URL: no scheme, ``www.``, ``m.``, default port, fragment, tracking
    parameters, index or ``.html`` ending or last slash; parameters in order. Empty for no URL."""
    query = F.regexp_extract(_rest(url), r"^[^?#]*\?([^#]*)", 1)
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.rlike(p, F.lit(TRACKING)))
    short_host = F.regexp_replace(F.regexp_replace(host(url), r"^(www|m)\.", ""), r":(80|443)$", "")
    short_path = F.regexp_replace(path(url), r"(/index)?(\.html?)?/*$", "")
    return F.concat(short_host, short_path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(F.array_sort(kept), "&"))).otherwise(F.lit("")))


def matching_rule(host_: Column, path_: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """The longest rule ``(verdict, host, path)`` that fits, as a struct, or null. A rule fits its host and
    the hosts below it where the path starts with its own. Of equally long rules the later one wins."""
    found = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = (host_ == rule_host) | F.endswith(host_, F.lit("." + rule_host))
        fits = fits & F.startswith(path_, F.lit(rule_path))
        found = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule_host + rule_path).alias("rule"))).otherwise(found)
    return found


def _masks(key: Column) -> list[Column]:
    """The four words in which a key sets ``BITS_SET`` of its block's 256 bits."""
    h = F.xxhash64(key, F.lit("bits"))
    bits = [F.shiftrightunsigned(h, 8 * j).bitwiseAND(F.lit(255)) for j in range(BITS_SET)]
    out = []
    for w in range(4):
        terms = [
            F.when(F.shiftright(b, 6) == w, F.expr("1L")).otherwise(F.expr("0L")) * F.call_function("shiftleft", F.expr("1L"), b.bitwiseAND(F.lit(63)).cast("int"))
            for b in bits
        ]
        out.append(reduce(lambda a, b: a.bitwiseOR(b), terms))
    return out


def bloom_filter(listed: DataFrame, key: str = "canonical") -> tuple[DataFrame, int]:
    """The filter of a list of distinct keys: rows ``block, w0..w3``, and its number of blocks."""
    n = listed.count()
    blocks = max(1, -(-n * BITS_PER_KEY // 256))
    words = listed.select(_block(F.col(key), blocks).alias("block"), *[m.alias(f"w{k}") for k, m in enumerate(_masks(F.col(key)))])
    return words.groupBy("block").agg(*[F.bit_or(f"w{k}").alias(f"w{k}") for k in range(4)]), blocks


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def judge(
    pages: DataFrame, listed: DataFrame, rules: Sequence[tuple[str, str, str]], page_id: str = "page_id",
    url: str = "url", listed_url: str = "url", broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Per row of ``pages``: ``page_id, host, path, canonical, rule, verdict, possible, listed``.

    The longest fitting rule decides; without one a URL is blocked if its canonical form is that of a URL
    of ``listed``. ``possible`` tells whether it passed the filter, ``listed`` whether the exact join found
    it. A null URL, or one without ``://``, has empty host and path, fits no rule and is allowed. Listed
    nulls are ignored and repeated URLs count once. Repeated pages get a row each; empty tables are valid.
    Other columns are not read.
    """
    keys = listed.select(canonical(F.col(listed_url)).alias("canonical")).where("canonical <> ''").distinct()
    keys = materialize(keys)
    words, blocks = bloom_filter(keys)
    if blocks * 40 <= broadcast_bytes:
        words = F.broadcast(words)
    u = F.col("_url")
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("_url"))
    rows = rows.select("page_id", host(u).alias("host"), path(u).alias("path"), canonical(u).alias("canonical"))
    rows = rows.withColumn("_rule", matching_rule(F.col("host"), F.col("path"), rules))
    rows = rows.withColumn("block", _block(F.col("canonical"), blocks)).join(words, "block", "left")
    tests = [F.col(f"w{k}").bitwiseAND(m) == m for k, m in enumerate(_masks(F.col("canonical")))]
    possible = F.coalesce(reduce(lambda a, b: a & b, tests), F.lit(False)) & (F.col("canonical") != "")
    rows = materialize(rows.select("page_id", "host", "path", "canonical", "_rule", possible.alias("possible")))
    hits = rows.where("possible").join(keys.withColumn("listed", F.lit(True)), "canonical", "left")
    misses = rows.where("NOT possible").withColumn("listed", F.lit(False))
    every = hits.withColumn("listed", F.coalesce("listed", F.lit(False))).select(*misses.columns).union(misses)
    method = F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow"))
    return every.select(
        "page_id", "host", "path", "canonical", F.col("_rule.rule").alias("rule"),
        F.coalesce("_rule.verdict", method).alias("verdict"), "possible", "listed",
    )
