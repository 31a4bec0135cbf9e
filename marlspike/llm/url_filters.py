"""URL filters: a few written rules first, then a listing of hosts kept in a Bloom filter cascade.

Filter 1 encodes the listed hosts; filter 2 encodes those unlisted hosts of the
corpus that filter 1 lets through by mistake; filter 3 those listed hosts that
filter 2 lets through, and so on until a filter makes no mistake. Over all hosts
of the corpus, which the filters are built for, membership is exact. A host is
judged by a few bit tests; nothing is joined. All of it is DataFrame operations:
filters are arrays of longs in one-row tables, read as scalar subqueries.

A filter takes ``BITS`` bits for each host it encodes, in whole longs. That array is
all that reaches the driver or is sent to tasks: 1.5 MB for a million hosts
listed; later filters are some hundredths of that. Where it would take more than
``LONGS`` longs (8 MB, some 5.6 million hosts listed), hosts are dealt by hash over
shards with a cascade each, and pages are judged shard by shard.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlspike.llm.common import Scratch

#: Bits for each key of a filter, and bits set for it.
BITS, HASHES = 12, 8
#: Longs in the array of a filter.
LONGS = 1 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str


class Filter(NamedTuple):
    level: int
    longs: int
    bits: DataFrame


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty where it is null or has no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"\A([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def longest_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The rule that fits and is longest (host and path together; the longer host if equal), as struct(rule, verdict), or null.

    A rule fits its host and all subdomains, for paths that start with its path.
    """
    out = None
    for r in sorted(rules, key=lambda r: (-len(r.host) - len(r.path), -len(r.host))):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        value = F.struct(F.lit(r.host + r.path).alias("rule"), F.lit(r.verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return F.lit(None).cast("struct<rule:string,verdict:string>") if out is None else out


def _places(key: Column, level: int, longs: int) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(level), F.lit(j), key), F.lit(64 * longs)) for j in range(HASHES)]


def _filter(scratch: Scratch, keys: DataFrame, n: int, level: int) -> Filter:
    """The filter of ``keys(host)``, n of them: bits are or-ed by long before they meet."""
    longs = -(-n * BITS // 64)
    places = keys.select(F.explode(F.array(*_places(F.col("host"), level, longs))).alias("at"))
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("at") % 64).cast("int"))
    words = places.select(F.floor(F.col("at") / 64).alias("word"), bit.alias("bit"))
    words = words.unionByName(scratch.spark.range(longs).select(F.col("id").alias("word"), F.lit(0).cast("bigint").alias("bit")))
    words = words.groupBy("word").agg(F.bit_or("bit").alias("bits"))
    whole = words.agg(F.array_sort(F.collect_list(F.struct("word", "bits"))).alias("w")).select(F.col("w.bits").alias("bits"))
    return Filter(level, longs, scratch.save(whole))


def _passes(key: Column, f: Filter) -> Column:
    bits, out = f.bits.scalar(), F.lit(True)
    for at in _places(key, f.level, f.longs):
        out = out & (F.getbit(F.get(bits, F.floor(at / 64).cast("int")), (at % 64).cast("int")) == 1)
    return out


def cascade(scratch: Scratch, universe: DataFrame) -> list[Filter]:
    """Filters for ``universe(host, listed)``, each host once: exact over those hosts."""
    inside, outside = universe.filter("listed").select("host"), universe.filter("not listed").select("host")
    filters: list[Filter] = []
    while n := inside.count():
        filters.append(_filter(scratch, inside, n, len(filters)))
        inside, outside = scratch.save(outside.filter(_passes(F.col("host"), filters[-1]))), inside
    return filters


def is_listed(host: Column, filters: list[Filter]) -> Column:
    """Whether a host of the universe is listed: the number of filters it passes in turn is odd."""
    out = F.lit(len(filters) % 2 == 1)
    for i, f in reversed(list(enumerate(filters))):
        out = F.when(_passes(host, f), out).otherwise(F.lit(i % 2 == 1))
    return out


def judge_urls(pages: DataFrame, rules: list[Rule], listed: DataFrame) -> DataFrame:
    """``page_id, host, path, rule, verdict`` for each row of ``pages(page_id, url)``.

    The longest rule that fits decides, and of equal ones the first in the list; else hosts of ``listed(host)`` are
    blocked and others allowed. Rows may repeat and ids may be null; a null url,
    or one without ``://``, has an empty host and is allowed unless a rule fits.
    Listed hosts that the corpus lacks, nulls and repeats in the listing are
    ignored; an empty listing blocks nothing; an empty table gives an empty
    result. Other columns are ignored.
    """
    scratch = Scratch(pages.sparkSession, "urls")
    host, path = split_url(F.col("url").cast("string"))
    seen = pages.select(host.alias("host"), F.lit(True).alias("here"), F.lit(False).alias("listed"))
    named = listed.select(F.translate(F.col("host"), UPPER, LOWER).alias("host"), F.lit(False).alias("here"), F.lit(True).alias("listed"))
    universe = seen.unionByName(named).groupBy("host").agg(F.bool_or("here").alias("here"), F.bool_or("listed").alias("listed"))
    universe = universe.filter("here and host <> ''").select("host", "listed")
    out = pages.select("page_id", host.alias("host"), path.alias("path"))
    universe = scratch.save(universe)
    shards = -(-universe.filter("listed").count() * BITS // (64 * LONGS)) or 1
    if shards == 1:
        return _judged(out, rules, cascade(scratch, universe))
    shard = F.pmod(F.xxhash64(F.lit(-1), "host"), F.lit(shards)).alias("shard")
    universe, out = (scratch.save(t.select("*", shard), by="shard") for t in (universe, out))
    done = None
    for i in range(shards):
        part = _judged(out.filter(F.col("shard") == i), rules, cascade(scratch, universe.filter(F.col("shard") == i).drop("shard")))
        done = part if done is None else done.unionByName(part)
    return done


def _judged(out: DataFrame, rules: list[Rule], filters: list[Filter]) -> DataFrame:
    out = out.withColumn("found", longest_rule(F.col("host"), F.col("path"), rules))
    block = (F.col("host") != "") & is_listed(F.col("host"), filters)
    verdict = F.coalesce("found.verdict", F.when(block, F.lit("block")).otherwise(F.lit("allow")))
    return out.select("page_id", "host", "path", F.col("found.rule").alias("rule"), verdict.alias("verdict"))


def tracking_hosts(pages: DataFrame, hundredths: int = 25) -> DataFrame:
    """Hosts of which at least so many hundredths of the pages carry a ``utm_`` parameter."""
    host, _ = split_url(F.col("url").cast("string"))
    by = pages.filter("url is not null").groupBy(host.alias("host")).agg(F.count("*").alias("n"), F.count_if(F.contains("url", F.lit("utm_"))).alias("k"))
    return by.filter(F.col("k") * 100 >= F.col("n") * hundredths).select("host")
