"""Key-value store and sync queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marlspike.operators import kvstore, sync
from marlspike.plans.registry import query
from marlspike.sources.tables import table

_V = """v as (select event_type || ':' || (user_id % 25) as key, event_id, ts, props || ' ' || event_type as value, event_type as type, 'agent' || (user_id % 4) as agent,
  ['private', 'workspace', 'shared', 'global'][(user_id % 4 + 1)::int] as visibility, ['t' || (event_id % 3), 't' || (event_id % 5)] as tags,
  case when event_id % 2 = 0 then (value * 3600)::bigint end as ttl, row_number() over (partition by event_type || ':' || (user_id % 25) order by event_id) as version from events),
e as (select *, case when ttl is not null then ts + to_seconds(ttl) end as expires_at from v qualify row_number() over (partition by key order by version desc) = 1)"""
NOW = "2024-01-30 20:00:00"
_LIVE = f"(expires_at is null or expires_at > timestamp '{NOW}')"


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as versions of entries: a key for each type and group of users."""
    d = table(spark, sf_dir, "events")
    key = F.concat_ws(":", "event_type", (F.col("user_id") % 25).cast("string"))
    i = (F.col("user_id") % 4).cast("int")
    d = d.select(
        key.alias("key"), "event_id", "ts", F.concat_ws(" ", "props", "event_type").alias("value"), F.col("event_type").alias("type"),
        F.concat(F.lit("agent"), i.cast("string")).alias("agent"), F.get(F.array(*map(F.lit, ["private", "workspace", "shared", "global"])), i).alias("visibility"),
        F.array(*(F.concat(F.lit("t"), (F.col("event_id") % m).cast("string")) for m in (3, 5))).alias("tags"),
        F.when(F.col("event_id") % 2 == 0, F.round(F.col("value") * 3600).cast("bigint")).alias("ttl"),
    )
    d = d.withColumn("version", F.row_number().over(Window.partitionBy("key").orderBy("event_id")).cast("bigint"))
    return d.withColumn("expires_at", kvstore.expires_at(F.col("ts").cast("timestamp"), F.col("ttl")))


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kvstore.prune(versions(spark, sf_dir), 1)


def now():
    return F.lit(NOW).cast("timestamp")


@query(f"""with {_V}, f as (select key, value, version from e where {_LIVE} and key like 'c%:1%' and type in ('click', 'view') and (visibility <> 'private' or agent = 'agent1')
  and list_has_any(tags, ['t0', 't1', 't2']) order by key limit 6)
select key, value, version, (select count(*) from f) > 5 as has_more from f order by key limit 5""")
def context_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = kvstore.query(entries(spark, sf_dir), now(), key="c*:1*", types=["click", "view"], tags=["t0", "t1", "t2"], reader="agent1", limit=5)
    return d.select("key", "value", "version", "has_more")


@query(f"with {_V} select key, value from e where {_LIVE} and visibility in ('shared', 'global') and agent = 'agent2'")
def context_query_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = kvstore.query(entries(spark, sf_dir), now(), visibility=["shared", "global"], agent="agent2", limit=100)
    return d.select("key", "value")


@query(f"""with {_V} select key, 'substring' as how from e where contains(lower(value), '"k": 1') union all select key, 'regex' from e where regexp_matches(value, '(?i)k": [0-9] |VIEW$|3.*purchase')""")
def context_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = entries(spark, sf_dir)
    a = kvstore.search(e, '"K": 1').select("key", F.lit("substring").alias("how"))
    return a.unionByName(kvstore.search(e, '(?i)k": [0-9] |VIEW$|3.*purchase', "regex").select("key", F.lit("regex").alias("how")))


@query(f"""with {_V} select key, round(jaro_winkler_similarity(lower(value), '{{"k": 42}} purchase'), 6) as similarity from e where jaro_winkler_similarity(lower(value), '{{"k": 42}} purchase') >= 0.8""")
def context_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kvstore.search(entries(spark, sf_dir), '{"k": 42} purchase', "fuzzy").select("key", F.round("similarity", 6).alias("similarity"))


@query(f"with {_V} select key, version, value from v qualify row_number() over (partition by key order by version desc) <= 3")
def version_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kvstore.prune(versions(spark, sf_dir), 3).select("key", "version", "value")


@query(f"with {_V} select version, value from v where key = 'click:3' order by version desc limit 5")
def version_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kvstore.history(versions(spark, sf_dir), "click:3", 5).select("version", "value")


@query(f"""with {_V}, r as (select key, value, version, row_number() over (partition by key order by version desc) as k, max(version) over (partition by key) as top from v)
select key, value, top + 1 as version from r where k = 3""")
def version_rollback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kvstore.rollback(versions(spark, sf_dir), 2).select("key", "value", "version")


@query(f"""with {_V} select key, case when expires_at <= timestamp '{NOW}' then 'expired' else 'expiring' end as status from e where expires_at <= timestamp '{NOW}' + interval 3600 second""")
def ttl_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kvstore.sweep(entries(spark, sf_dir), now(), soon=3600)


_IN = """i as (select key || case when key like '%:2%' then '+' else '' end as key, 'in ' || value as value, ts + case when key like 'v%' then interval 1 day else -interval 1 day end as ts from e where key like 'v%' or key like 'e%')"""


def _incoming(e: DataFrame) -> DataFrame:
    d = e.filter(F.col("key").like("v%") | F.col("key").like("e%"))
    key = F.concat("key", F.when(F.col("key").like("%:2%"), "+").otherwise(""))
    ts = F.when(F.col("key").like("v%"), F.col("ts") + F.expr("interval 1 day")).otherwise(F.col("ts") - F.expr("interval 1 day"))
    return d.select(key.alias("key"), F.concat(F.lit("in "), "value").alias("value"), ts.alias("ts"))


@query(f"""with {_V}, {_IN}, b as (select key, value, ts, 0 as side from e union all select key, value, ts, 1 from i)
select key, value from b qualify row_number() over (partition by key order by ts desc, side desc) = 1""")
def context_import_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = entries(spark, sf_dir).select("key", "value", "ts")
    return kvstore.import_entries(e, _incoming(e), "merge").select("key", "value")


@query(f"with {_V}, {_IN} select key, value from e union all select key, value from i where key not in (select key from e)")
def context_import_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = entries(spark, sf_dir).select("key", "value", "ts")
    return kvstore.import_entries(e, _incoming(e), "skip-existing").select("key", "value")


@query(f"""with {_V}, n as (select key, value as old, substr(sha256(value), 1, 16) as etag, version from e),
w as (select key, 'new ' || old as value, case when version % 3 = 0 then etag when version % 3 = 1 then 'stale' end as expected from n where key not like 'view%')
select n.key, case when w.key is null or w.expected is distinct from n.etag and w.expected is not null then n.old else w.value end as value,
  case when w.key is null or w.expected is distinct from n.etag and w.expected is not null then n.version else n.version + 1 end as version,
  coalesce(w.expected is distinct from n.etag and w.expected is not null, false) as refused from n left join w using (key)""")
def context_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes with the right, a stale or no etag; the stale ones are refused."""
    e = entries(spark, sf_dir).select("key", "value", F.substring(F.sha2("value", 256), 1, 16).alias("etag"), "version", "ts")
    expected = F.when(F.col("version") % 3 == 0, F.col("etag")).when(F.col("version") % 3 == 1, F.lit("stale"))
    w = e.filter(~F.col("key").like("view%")).select("key", F.concat(F.lit("new "), "value").alias("value"), expected.alias("expected_etag"), "ts")
    after, refused = kvstore.upsert(e, w)
    return after.join(refused.select("key", F.lit(True).alias("refused")), "key", "left").select("key", "value", "version", F.coalesce("refused", F.lit(False)).alias("refused"))


# --- sync ---

_SIDES = """loc as (select doc_id as path, sha256(case when doc_id % 5 = 1 then text || 'l' else text end) as hash, doc_id % 17 as modified from documents where doc_id % 11 <> 0),
rem as (select doc_id as path, sha256(case when doc_id % 3 = 1 then text || 'r' else text end) as hash, doc_id % 13 as modified from documents where doc_id % 7 <> 0),
las as (select doc_id as path, sha256(text) as hash from documents where doc_id % 4 <> 0),
m as (select coalesce(l.path, r.path) as path, l.hash as lh, r.hash as rh, s.hash as sh, l.modified as lm, r.modified as rm
  from loc l full outer join rem r on l.path = r.path left join las s on s.path = coalesce(l.path, r.path))"""


def _action(clash: str) -> str:
    return f"""case when rh is null then 'upload' when lh is null then 'download' when lh = rh then 'synced'
  when lh is distinct from sh and rh is not distinct from sh then 'upload' when lh is not distinct from sh and rh is distinct from sh then 'download' else {clash} end"""


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    d = table(spark, sf_dir, "documents")
    other = lambda m, s: F.sha2(F.when(F.col("doc_id") % m == 1, F.concat("text", F.lit(s))).otherwise(F.col("text")), 256).alias("hash")
    local = d.filter("doc_id % 11 <> 0").select(F.col("doc_id").alias("path"), other(5, "l"), (F.col("doc_id") % 17).alias("modified"))
    remote = d.filter("doc_id % 7 <> 0").select(F.col("doc_id").alias("path"), other(3, "r"), (F.col("doc_id") % 13).alias("modified"))
    last = d.filter("doc_id % 4 <> 0").select(F.col("doc_id").alias("path"), F.sha2("text", 256).alias("hash"))
    return local, remote, last


@query(f"with {_SIDES} select path, {_action('case when lm >= rm then ' + chr(39) + 'upload' + chr(39) + ' else ' + chr(39) + 'download' + chr(39) + ' end')} as action from m")
def sync_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.actions(*_sides(spark, sf_dir), strategy="newest-wins")


@query(f"""with {_SIDES}, a as (select path, {_action("'conflict'")} as action from m) select path from a where action = 'conflict'""")
def sync_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.actions(*_sides(spark, sf_dir), strategy="manual").filter("action = 'conflict'").select("path")


@query("""with p as (select doc_id, string_split(text, chr(10)) as a, string_split(replace(text, ' the', ' THE') || case when doc_id % 2 = 0 then chr(10) || 'more' else '' end, chr(10)) as b from documents),
z as (select doc_id, unnest(range(1, greatest(len(a), len(b)) + 1)) as i, a, b from p),
d as (select doc_id, i, case when a[i] is not distinct from b[i] then ' ' || a[i] when a[i] is null then '+' || b[i] when b[i] is null then '-' || a[i] else '-' || a[i] || chr(10) || '+' || b[i] end as line from z)
select doc_id, md5(substr(string_agg(line, chr(10) order by i), 1, 1200)) as diff_hash from d group by doc_id""")
def positional_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of two versions compared by place; the digest of the preview."""
    d = table(spark, sf_dir, "documents")
    new = F.concat(F.replace("text", F.lit(" the"), F.lit(" THE")), F.when(F.col("doc_id") % 2 == 0, "\nmore").otherwise(""))
    return d.select("doc_id", F.md5(sync.line_diff(F.col("text"), new)).alias("diff_hash"))


@query("select coalesce(source, 'unknown') as workspace, count(*) as n_files, coalesce(sum(n_chars), 0)::bigint as total_size from documents group by 1")
def workspace_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy(F.coalesce("source", F.lit("unknown")).alias("workspace")).agg(F.count("*").alias("n_files"), F.coalesce(F.sum("n_chars"), F.lit(0)).alias("total_size"))


@query("""with v as (select item_id, case when item_id % 4 = 0 then null else 'v' || (item_id % 4) end as version, 'agent' || (item_id % 3) as agent from benchmark)
select coalesce(version, 'unknown') as version, count(*) as n, max(item_id) as latest, array_to_string(list_sort(list_distinct(list(agent))), ',') as agents from v group by 1""")
def benchmark_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark")
    version = F.when(F.col("item_id") % 4 != 0, F.concat(F.lit("v"), (F.col("item_id") % 4).cast("string")))
    d = b.select("item_id", version.alias("version"), F.concat(F.lit("agent"), (F.col("item_id") % 3).cast("string")).alias("agent"))
    return d.groupBy(F.coalesce("version", F.lit("unknown")).alias("version")).agg(F.count("*").alias("n"), F.max("item_id").alias("latest"), F.array_join(F.array_sort(F.collect_set("agent")), ",").alias("agents"))
