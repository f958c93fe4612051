"""URL filter (operator 1), DataFrame functions only.

A blocked Bloom filter holds the listed canonical URLs, sized from their number. Every page is
tested against it in the scan; pages that hit nothing pass straight through, and only possible
hits reach the exact hash join with the list that removes false positives. The few rules are
literals and are judged in the same scan.

Edge cases: a null url, or one without ``://``, has an empty host and path and
fits no rule; repeated rows each get their own result; an empty pages table
gives an empty result; an empty list allows everything; further columns of
``pages`` are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadflow.llm.common import stored

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: Longs in one filter block; a key sets one bit in each. Filter bits for each listed URL.
LANES, BITS_PER_URL = 4, 16
#: A filter of up to so many blocks (about 80 bytes each in memory) is broadcast, a longer one joined by block.
MAX_BROADCAST_BLOCKS = 1 << 18
#: URLs found on the list are broadcast back to the possible hits up to this number.
MAX_BROADCAST_FOUND = 100_000


@dataclass(frozen=True)
class Rule:
    """``verdict`` for ``host`` and its subdomains where the path starts with ``path``."""

    verdict: str
    host: str
    path: str


def canonical(url: Column) -> tuple[Column, Column]:
    """(host, path) of a URL: A-Z of the host lower-cased, query and fragment left out."""
    u = F.coalesce(url, F.lit(""))
    return (F.translate(F.regexp_extract(u, _URL, 1), _UPPER, _LOWER),
            F.regexp_extract(u, _URL, 2))


def _slots(key: Column, n_blocks: int) -> tuple[Column, list[Column]]:
    h = F.xxhash64(key, F.lit(1))
    return (F.pmod(F.xxhash64(key), F.lit(n_blocks)),
            [F.shiftright(h, 6 * i).bitwiseAND(F.lit(63)).cast("int") for i in range(LANES)])


def bloom_filter(keys: DataFrame, key: str, n_blocks: int) -> DataFrame:
    """Rows (block, w0..w3) of the non-empty filter blocks: at most ``n_blocks`` rows."""
    block, bits = _slots(F.col(key), n_blocks)
    one = F.lit(1).cast("long")
    return (keys.select(block.alias("block"), *[F.call_function("shiftleft", one, b).alias(f"w{i}") for i, b in enumerate(bits)])
            .groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(LANES)]))


def mark_listed(probes: DataFrame, key: Column, bloom: DataFrame, n_blocks: int, broadcast: bool) -> DataFrame:
    """``_maybe``: whether all bits of ``key`` are set. Without ``broadcast`` the probes go to the
    filter's blocks instead."""
    block, bits = _slots(key, n_blocks)
    tested = probes.withColumn("block", block).join(F.broadcast(bloom) if broadcast else bloom, "block", "left")
    hit = F.lit(True)
    for i, b in enumerate(bits):
        hit = hit & (F.call_function("getbit", F.col(f"w{i}"), b) == 1)
    return tested.select(*probes.columns, F.coalesce(hit, F.lit(False)).alias("_maybe"))


def best_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """(rule, verdict) of the longest rule that fits; null where none does."""
    best = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: len(r.host + r.path)):
        fits = ((host == r.host) | host.endswith(f".{r.host}")) & path.startswith(r.path)
        best = F.when(fits, F.struct(F.lit(f"{r.host}{r.path}").alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(best)
    return best


def _url_key(host: str, path: str) -> Column:
    """One text for a URL's two parts; a host holds no space that a URL's host can end with."""
    return F.concat(F.length(host).cast("string"), F.lit(" "), host, path)


def url_filter(pages: DataFrame, rules: Sequence[Rule], listed: DataFrame, n_blocks: int | None = None,
               max_blocks: int = MAX_BROADCAST_BLOCKS) -> DataFrame:
    """Judge every page: (page_id, host, path, rule, verdict, listed).

    ``listed``: canonical URLs to block, columns (host, path). A fitting rule
    (the longest wins) decides; else a listed URL is blocked, any other allowed.
    ``n_blocks``: blocks of the filter, by default enough for the list.
    """
    host, path = canonical(F.col("url"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("_best", best_rule(F.col("host"), F.col("path"), rules))
    exact = stored(listed.select("host", "path").distinct().withColumn("_key", _url_key("host", "path")), "url-list")
    if n_blocks is None:
        n_blocks = max(1, -(-exact.count() * BITS_PER_URL // (64 * LANES)))
    bloom = stored(bloom_filter(exact, "_key", n_blocks), "url-bloom")
    marked = mark_listed(urls, _url_key("host", "path"), bloom, n_blocks, bloom.count() <= max_blocks)

    possible = marked.filter("_maybe")
    # The possible hits' URLs, each once, meet the list; what is found goes back to its pages.
    found = stored(possible.select("host", "path").distinct().join(exact, ["host", "path"], "left_semi").withColumn("listed", F.lit(True)), "url-found")
    small = found.limit(MAX_BROADCAST_FOUND + 1).count() <= MAX_BROADCAST_FOUND
    hits = possible.join(F.broadcast(found) if small else found, ["host", "path"], "left").withColumn("listed", F.coalesce("listed", F.lit(False)))
    judged = hits.unionByName(marked.filter(~F.col("_maybe")).withColumn("listed", F.lit(False)))
    return judged.select("page_id", "host", "path", F.col("_best.rule").alias("rule"),
                         F.coalesce(F.col("_best.verdict"), F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"), "listed")
