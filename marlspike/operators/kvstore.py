"""A versioned key-value context store over tables: queries, search, upserts, expiry, import."""

from __future__ import annotations

import base64

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marlspike.functions.fuzzy import jaro_winkler_udf
from marlspike.functions.globs import like_pattern


def can_access(agent: str) -> Column:
    """Private entries are their owner's alone."""
    return (F.col("visibility") != "private") | (F.col("agent") == agent)


def query(entries: DataFrame, now: Column, key=None, types=None, agent=None, visibility=None, tags=None, reader=None, order="key", limit=20, offset=0) -> DataFrame:
    """A page of entries with ``has_more``. All filters, tags and access included, come before the page is cut."""
    d = entries.filter(F.col("expires_at").isNull() | (F.col("expires_at") > now))
    if key:
        d = d.filter(F.col("key").like(like_pattern(key)))
    for column, wanted in (("type", types), ("visibility", visibility)):
        if wanted:
            d = d.filter(F.col(column).isin(wanted))
    if agent:
        d = d.filter(F.col("agent") == agent)
    if tags:
        d = d.filter(F.arrays_overlap("tags", F.array(*map(F.lit, tags))))
    if reader:
        d = d.filter(can_access(reader))
    limit = max(1, min(100, limit))
    page = d.orderBy(order, "key").offset(offset).limit(limit + 1)
    numbered = page.withColumn("k", F.row_number().over(Window.orderBy(order, "key"))).withColumn("n", F.count("*").over(Window.partitionBy()))
    return numbered.filter(F.col("k") <= limit).withColumn("has_more", F.col("n") > limit).drop("k", "n")


def newest_first(entries: DataFrame, now: Column, reader: str | None = None, limit: int = 20) -> DataFrame:
    """Decisions that a reader may see, the newest first."""
    d = entries.filter((F.col("type") == "decision") & (F.col("expires_at").isNull() | (F.col("expires_at") > now)))
    d = d.filter(can_access(reader)) if reader else d
    return d.orderBy(F.desc("ts"), "key").limit(limit)


def snippets(entries: DataFrame, now: Column, language: str | None = None, reader: str | None = None, limit: int = 20) -> DataFrame:
    return query(entries, now, types=["snippet"], tags=[language] if language else None, reader=reader, limit=limit)


def dependencies(entries: DataFrame, now: Column, reader: str | None = None, limit: int = 20) -> DataFrame:
    return query(entries, now, types=["dependency"], reader=reader, limit=limit)


def api_keys(keys: DataFrame, now: Column, workspace=None, agent=None, active_only: bool = True) -> DataFrame:
    """``keys(workspace, agent, active, expires_at, ...)`` by workspace and agent; unless asked otherwise only those that are active and not expired."""
    for column, wanted in (("workspace", workspace), ("agent", agent)):
        keys = keys if wanted is None else keys.filter(F.col(column) == wanted)
    return keys.filter(F.col("active") & ~expired_at(F.col("expires_at"), now)) if active_only else keys


def expired_at(until: Column, now: Column) -> Column:
    """Whether a time has passed; without one, never."""
    return F.coalesce(until < now, F.lit(False))


def outlived(since: Column, ttl: Column, now: Column) -> Column:
    """Whether more than ``ttl`` milliseconds have gone since a time; a life of null or 0 never ends."""
    return F.coalesce((ttl != 0) & (F.unix_micros(now) - F.unix_micros(since) > ttl * 1000), F.lit(False))


def encode_cursor(offset: int) -> str:
    """An offset as an opaque string."""
    return base64.urlsafe_b64encode(str(offset).encode()).decode().rstrip("=")


def decode_cursor(cursor: str | None) -> int:
    """The offset of a cursor; 0 for none, or one that is none of ours."""
    try:
        return max(0, int(base64.urlsafe_b64decode((cursor or "") + "=" * (-len(cursor or "") % 4)).decode()))
    except (ValueError, UnicodeDecodeError):
        return 0


def page(rows: DataFrame, order: list[str], cursor: str | None = None, limit: int = 20) -> DataFrame:
    """Rows behind a cursor with ``has_more`` and ``cursor``, which leads to the next page; limits are from 1 to 100. A full page counts as having more."""
    offset, limit = decode_cursor(cursor), max(1, min(100, limit))
    cut = rows.orderBy(*order).offset(offset).limit(limit)
    more = F.count("*").over(Window.partitionBy()) == limit  # a page
    return cut.withColumn("has_more", more).withColumn("cursor", F.when(F.col("has_more"), encode_cursor(offset + limit)))


def search(entries: DataFrame, text: str, how: str = "substring", least: float = 0.8) -> DataFrame:
    """Entries whose value holds a text (case aside), fits a regular expression, or is like the text by Jaro-Winkler."""
    if how == "substring":
        return entries.filter(F.contains(F.lower("value"), F.lit(text.lower())))
    if how == "regex":
        return entries.filter(F.rlike("value", F.lit(f"(?i){text}")))
    near = entries.select("value").distinct().withColumn("similarity", jaro_winkler_udf(F.lower("value"), F.lit(text.lower())))
    return entries.join(near.filter(F.col("similarity") >= least), "value")


def expires_at(created: Column, ttl: Column) -> Column:
    return F.when(ttl.isNotNull(), F.timestamp_seconds(F.unix_micros(created) / 1e6 + ttl))


def upsert(entries: DataFrame, writes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entries after ``writes(key, value, expected_etag, ts)``, and the writes refused for their etag.

    Of several writes to a key the latest counts. An etag is a hash of the value.
    """
    last = writes.groupBy("key").agg(F.max_by(F.struct("value", "expected_etag"), F.struct("ts", "value")).alias("w"), F.max("ts").alias("ts"))
    last = last.select("key", "w.*", "ts")
    met = last.join(entries.select("key", "etag", "version"), "key", "left")
    bad = F.col("expected_etag").isNotNull() & ~F.col("expected_etag").eqNullSafe(F.col("etag"))
    new = met.filter(~bad).select("key", "value", F.substring(F.sha2("value", 256), 1, 16).alias("etag"), (F.coalesce("version", F.lit(0)) + 1).alias("version"), "ts")
    kept = entries.join(new.select("key"), "key", "left_anti")
    return kept.unionByName(new, allowMissingColumns=True), met.filter(bad).select("key", "expected_etag", "etag")


def prune(versions: DataFrame, keep: int = 50) -> DataFrame:
    """The latest versions of each key."""
    w = Window.partitionBy("key").orderBy(F.desc("version"))
    return versions.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= keep).drop("_k")


def history(versions: DataFrame, key: str, limit: int = 20) -> DataFrame:
    return versions.filter(F.col("key") == key).orderBy(F.desc("version")).limit(limit)


def rollback(versions: DataFrame, back: int = 1) -> DataFrame:
    """For each key its version so many before the last, as the new last."""
    w = Window.partitionBy("key").orderBy(F.desc("version"))
    d = versions.withColumn("_k", F.row_number().over(w)).withColumn("_top", F.max("version").over(Window.partitionBy("key")))
    return d.filter(F.col("_k") == back + 1).withColumn("version", F.col("_top") + 1).drop("_k", "_top")


def sweep(entries: DataFrame, now: Column, soon: int = 60) -> DataFrame:
    """``key, status``: expired entries, and those that expire within so many seconds."""
    left = (F.unix_micros("expires_at") - F.unix_micros(now)) / 1e6
    status = F.when(left <= 0, "expired").when(left <= soon, "expiring")
    return entries.select("key", status.alias("status")).filter("status is not null")


def import_entries(entries: DataFrame, incoming: DataFrame, strategy: str = "merge") -> DataFrame:
    """merge: the later of both sides for each key; skip-existing: only new keys come in; replace: incoming alone."""
    if strategy == "replace":
        return incoming
    if strategy == "skip-existing":
        return entries.unionByName(incoming.join(entries.select("key"), "key", "left_anti"))
    both = entries.withColumn("_in", F.lit(0)).unionByName(incoming.withColumn("_in", F.lit(1)))
    w = Window.partitionBy("key").orderBy(F.desc("ts"), F.desc("_in"))
    return both.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k", "_in")
