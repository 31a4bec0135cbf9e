"""Sources and sinks as queries: what is indexed, caches, logs, corpora, diffs, signatures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlspike.functions.globs import glob_regex, ignore_globs
from marlspike.functions.text import sql_string
from marlspike.operators import present
from marlspike.plans.present_queries import _HMAC, KEY
from marlspike.plans.registry import query
from marlspike.sources import files, logs
from marlspike.sources.tables import table

_FITS = lambda col, globs: "(" + " or ".join(f"regexp_matches({col}, {sql_string(glob_regex(g))})" for g in globs) + ")"
_PATH = """concat(case p_size % 6 when 0 then 'src/' when 1 then 'node_modules/x/' when 2 then 'src/dist/' when 3 then 'docs/deep/' when 4 then 'coverage/' else 'tmp/' end, 'f', p_partkey,
  case p_partkey % 7 when 0 then '.ts' when 1 then '.PY' when 2 then '.min.js' when 3 then '.md' when 4 then '.bin' when 5 then '.json' else '.lock' end)"""
#: An ignore file.
IGNORED = ignore_globs("# comment\n\n/docs/deep/f1*\ntmp/\n!kept.ts\n*.json\nf7.ts\n")


@query(f"with f as (select {_PATH} as path from part) select path, {_FITS('path', IGNORED)} as ignored from f where not {_FITS('path', files.EXCLUDE)} and {_FITS('path', files.INCLUDE)}")
def indexed_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for each part: those that a scan takes in, and which of them an ignore file leaves out."""
    f = table(spark, sf_dir, "part").selectExpr(f"{_PATH} as path")
    taken = f.filter(~files.fits(F.col("path"), files.EXCLUDE) & files.fits(F.col("path"), files.INCLUDE))
    return taken.select("path", files.fits(F.col("path"), IGNORED).alias("ignored"))


@query("""with c as (select doc_id, substr(sha256('m:' || text), 1, 32) as k from documents where text is not null),
cache as (select k, min(doc_id) as i from c where doc_id % 3 <> 0 group by k), live as (select k from cache where i % 5 <> 0)
select doc_id, c.k as cache_key, live.k is not null as hit from c left join live using (k)""")
def embedding_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents' embeddings a cache holds; some were never cached, some are older than thirty days."""
    docs = table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", F.col("text").alias("content"))
    key = files.cache_key("m", F.col("content"))
    made = docs.filter("doc_id % 3 <> 0").groupBy(key.alias("cache_key")).agg(F.min("doc_id").alias("i"))
    at = F.when(F.col("i") % 5 == 0, F.to_timestamp(F.lit("2024-01-01"))).otherwise(F.to_timestamp(F.lit("2024-02-20")))
    hit, miss = files.cached_embeddings(docs, made.select("cache_key", F.array(F.lit(0.0)).alias("embedding"), at.alias("created_at")), "m", F.to_timestamp(F.lit("2024-03-01")))
    return hit.select("doc_id", "cache_key", F.lit(True).alias("hit")).unionByName(miss.select("doc_id", "cache_key", F.lit(False).alias("hit")))


@query("with c as (select user_id as cache_key, max(ts) as created_at from events group by user_id) select cache_key, created_at from c order by created_at desc, cache_key limit 50")
def cache_eviction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifty users that were seen last."""
    return files.evicted(table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("cache_key")).agg(F.max("ts").alias("created_at")), 50)


@query("""with c as (select doc_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) as line from documents)
select source || '/' || doc_id as file_path, line, case when doc_id % 4 = 0 then 'fresh' else 'old' end as state from c join documents using (doc_id) where doc_id % 9 <> 5 or doc_id % 4 = 0""")
def replaced_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as chunks after every fourth file has changed and some have gone."""
    docs = table(spark, sf_dir, "documents").withColumn("file_path", F.concat_ws("/", "source", "doc_id"))
    lines = lambda d, state: d.select("file_path", F.posexplode(F.split("text", "\n", -1)).alias("i", "x")).select("file_path", (F.col("i") + 1).cast("bigint").alias("line"), F.lit(state).alias("state"))
    return files.replaced(lines(docs, "old"), lines(docs.filter("doc_id % 4 = 0"), "fresh"), docs.filter("doc_id % 9 = 5").select("file_path"))


@query("""with s as (select event_id as id, length(props) + 100 as size from events),
f as (select id, floor(coalesce(sum(size) over (order by id rows between unbounded preceding and 1 preceding), 0) / 100000)::bigint as file_no from s)
select id, file_no, file_no >= max(file_no) over () - 5 as kept from f""")
def log_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a log that starts a new file at 100,000 bytes and keeps five old ones."""
    s = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), (F.length("props") + 100).alias("size"))
    return logs.rotation(s, 100_000, 5)


_SAMPLES = """select case when doc_id % 50 = 7 then 'dup' when doc_id % 50 = 8 then '' else 's' || doc_id end as id, text as content, quality = 0 as expected_detection,
  case doc_id % 5 when 0 then 'easy' when 1 then 'medium' when 2 then 'hard' when 3 then 'odd' end as difficulty from documents left join labels using (doc_id)"""


@query(f"""with s as ({_SAMPLES}), n as (select *, count(*) over (partition by id) as n from s),
e as (select id, unnest(list_filter([case when id is null or id = '' then 'missing id' end, case when content is null or length(trim(content)) = 0 then 'missing content' end,
  case when expected_detection is null then 'missing expected_detection' end, case when difficulty is null or difficulty not in ('easy', 'medium', 'hard') then 'unknown difficulty' end,
  case when n > 1 then 'duplicate id' end], lambda x: x is not null)) as error from n)
select error, count(*) as n from e group by error union all select 'sound', count(*) from n where n = 1 and id <> '' and length(trim(content)) > 0 and expected_detection is not null and difficulty in ('easy', 'medium', 'hard')""")
def corpus_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as samples of a corpus: how many are sound, and what is wrong with the others."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    number = F.col("doc_id") % 50
    name = F.when(number == 7, "dup").when(number == 8, "").otherwise(F.concat(F.lit("s"), F.col("doc_id").cast("string")))
    level = F.get(F.array(*map(F.lit, ["easy", "medium", "hard", "odd"])), (F.col("doc_id") % 5).cast("int"))
    s = d.select(name.alias("id"), F.col("text").alias("content"), (F.col("quality") == 0).alias("expected_detection"), level.alias("difficulty"))
    good, bad = logs.validated(s)
    return bad.groupBy("error").agg(F.count("*").alias("n")).unionByName(good.agg(F.count("*").alias("n")).select(F.lit("sound").alias("error"), "n"))


_DIFF = "case event_type when 'click' then concat('M', chr(9), 'f', user_id) when 'error' then concat('D', chr(9), 'f', user_id) when 'signup' then concat('R100', chr(9), 'f', user_id, chr(9), 'g', event_id) when 'view' then concat('A', chr(9), 'f', user_id) else '' end"


@query("""select case event_type when 'click' then 'M' else 'A' end as status, 'f' || user_id as path from events where event_type in ('click', 'view')
union all select 'A', 'g' || event_id from events where event_type = 'signup'""")
def changed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as the lines of a diff: what has to be indexed, without what was deleted."""
    return files.changed_paths(table(spark, sf_dir, "events").selectExpr(f"{_DIFF} as value")).filter("status <> 'D'")


@query(f"""with r as (select doc_id, text, md5(doc_id::varchar) as n from documents where text is not null), s as (select *, {_HMAC} as good from r)
select doc_id, case when doc_id % 3 = 0 then reverse(good) else good end = good as verified from s""")
def signatures_verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signatures of documents, of which every third was turned round, against those that belong to them."""
    d = table(spark, sf_dir, "documents").filter("text is not null").withColumn("nonce", F.md5(F.col("doc_id").cast("string")))
    d = d.withColumn("good", present.signature(KEY, F.col("nonce"), F.col("text")))
    given = F.when(F.col("doc_id") % 3 == 0, F.reverse("good")).otherwise(F.col("good"))
    return d.select("doc_id", present.verified(given, KEY, F.col("nonce"), F.col("text")).alias("verified"))
