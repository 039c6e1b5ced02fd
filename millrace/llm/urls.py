"""URL filters: rules on host and path, then a blocked Bloom filter and an exact join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.session import stage

BLOCK_BITS = 64
KEYS_PER_BLOCK = 5
PROBES = 4


def _rest(url: Column) -> Column:
    at = F.locate("://", F.coalesce(url, F.lit("")))
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def host(url: Column) -> Column:
    """What stands between the first :// and the next /, ? or #, A-Z lowered; empty without ://."""
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    """What stands between the host and the next ? or #."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def canonical(host: Column, path: Column) -> Column:
    """A page without scheme, leading www., query, fragment and slashes at the end."""
    return F.concat(F.regexp_replace(host, r"^www\.", ""), F.regexp_replace(path, r"/+$", ""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, both null if none fits. ``rules`` are (verdict, host/path)."""
    named, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        at, _, tail = rule.partition("/")
        fits = ((host == at) | host.endswith("." + at)) & path.startswith("/" + tail)
        named, verdict = F.when(fits, rule).otherwise(named), F.when(fits, kind).otherwise(verdict)
    return named, verdict


def _mask(key: Column) -> Column:
    """The bits of a key inside its block, from a hash that does not choose the block."""
    hashed = F.xxhash64(F.lit("bits"), key)
    bits = [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(hashed, 6 * i).bitwiseAND(F.lit(BLOCK_BITS - 1)).cast("int")) for i in range(PROBES)]
    out = bits[0]
    for b in bits[1:]:
        out = out.bitwiseOR(b)
    return out


def _block(key: Column, blocks: Column | int) -> Column:
    return F.pmod(F.xxhash64(F.lit("block"), key), F.lit(blocks).cast("long") if isinstance(blocks, int) else blocks)


def bloom(keys: DataFrame, key: str, blocks: int) -> DataFrame:
    """A blocked Bloom filter as a table: (block, 64 bits). Its size follows the listed keys (about 13 bits each)."""
    return keys.where(F.col(key).isNotNull()).groupBy(_block(F.col(key), blocks).alias("block")).agg(F.bit_or(_mask(F.col(key))).alias("bits"))


def listed(pages: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """Adds ``listed``: whether a page's key is among ``keys`` (its first column; null is never listed).

    The filter is joined by block and rejects nearly all keys that are not listed. Only what it passes goes on to the
    join by key, which removes the false positives. List and filter are stored tables, hence adaptive execution
    sees their size before it picks a join, broadcasts only what is small, and splits hot hosts and keys.
    Repeated and null entries of the list change nothing; an empty list marks nothing.
    """
    once = stage(keys.select(F.col(keys.columns[0]).alias("_listed")).where("_listed is not null").distinct(), "url-list")
    blocks = once.count() // KEYS_PER_BLOCK + 1
    table = stage(bloom(once, "_listed", blocks), "url-bloom")
    names = pages.columns
    own = {c: f"c{i}" for i, c in enumerate(names)}  # no column of the pages can clash with those added here
    page = F.col(own[key])
    probed = pages.toDF(*own.values()).withColumn("_block", _block(page, blocks)).withColumn("_mask", _mask(page))
    probed = probed.join(table, F.col("_block") == F.col("block"), "left")
    hit = F.coalesce(F.col("bits").bitwiseAND(F.col("_mask")) == F.col("_mask"), F.lit(False)) & page.isNotNull()
    shown = [F.col(x).alias(c) for c, x in own.items()]
    passed = probed.where(hit).join(once, page == F.col("_listed"), "left").select(*shown, F.col("_listed").isNotNull().alias("listed"))
    return passed.unionByName(probed.where(~hit).select(*shown, F.lit(False).alias("listed")))


def filter_urls(pages: DataFrame, keys: DataFrame, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """page_id, host, path, rule and verdict of every page.

    A page takes the verdict of the longest rule that fits; where none does, it is blocked if its
    canonical URL is listed and allowed if not. A null url, or one without ://, has an empty host and
    path; its canonical URL is empty and never listed. Rows come out as often as they came in.
    """
    parts = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    judged = parts.select("*", rule.alias("rule"), verdict.alias("_verdict"), F.nullif(canonical(F.col("host"), F.col("path")), F.lit("")).alias("_page"))
    marked = listed(judged, "_page", keys.select(F.nullif(F.col(keys.columns[0]), F.lit("")).alias("_page")))
    return marked.select("page_id", "host", "path", "rule", F.coalesce("_verdict", F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"))
