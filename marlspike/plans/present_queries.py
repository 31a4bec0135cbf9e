"""Projections and wrappers of results, suggestions, listings, preflight."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlspike.functions.text import sql_string
from marlspike.operators import chunking, context, fusion, present
from marlspike.plans import context_queries as cq
from marlspike.plans import store_queries as sq
from marlspike.plans.registry import query
from marlspike.sources.tables import table

_DOC = """r as (select doc_id, source || '/' || doc_id || case when lang = 'en' then '.md' when lang = 'de' then '.py' else '.ts' end as file_path, text, lang,
  len(string_split(text, chr(10))) as end_line, list_filter(regexp_split_to_array(split_part(text, chr(10), 1), '\\s+'), lambda x: length(x) > 5)[1:3] as symbols from documents)"""


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as search results: a path by language, long words of the first line as symbols."""
    d = table(spark, sf_dir, "documents")
    end = F.when(F.col("lang") == "en", ".md").when(F.col("lang") == "de", ".py").otherwise(".ts")
    words = F.filter(F.split(F.substring_index("text", "\n", 1), r"\s+"), lambda x: F.length(x) > 5)
    return d.select("doc_id", F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), end).alias("file_path"), "text", "lang", F.size(F.split("text", "\n", -1)).alias("end_line"), F.slice(words, 1, 3).alias("symbols"))


@query(f"""with {_DOC} select doc_id, printf('%s:%d-%d [%s] %s (%.3f)', file_path, 1, end_line, 'other',
  array_to_string(list_filter(symbols, lambda x, i: list_position(symbols, x) = i), ', '), (doc_id % 97) / 97.0) as line from r""")
def result_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One line for each result."""
    d = results(spark, sf_dir)
    d = d.withColumns({"start_line": F.lit(1), "type": F.lit("other"), "score": (F.col("doc_id") % 97) / 97.0})
    return d.select("doc_id", present.compact(d).alias("line"))


@query(f"""with {_DOC} select doc_id, md5('[other' || case when len(symbols) > 0 then ': ' || array_to_string(symbols, ', ') else '' end || ']' || chr(10) || case when length(text) > 4000 then substr(text, 1, 4000) || '...' else text end) as digest from r""")
def rerank_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results(spark, sf_dir).select("doc_id", F.md5(fusion.rerank_text(F.col("text"), F.lit("other"), F.col("symbols"))).alias("digest"))


@query(f"""with {_DOC} select doc_id, md5('// File: ' || file_path || case when len(symbols) > 0 then chr(10) || '// Defines: ' || array_to_string(symbols, ', ') else '' end || chr(10) || text) as digest,
  case when file_path like '%.md' then 'markdown' when file_path like '%.py' then 'python' else 'typescript' end as language from r""")
def embedding_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = results(spark, sf_dir)
    none = F.array().cast("array<string>")
    return d.select("doc_id", F.md5(chunking.embedding_text(F.col("text"), F.col("file_path"), F.col("symbols"), none)).alias("digest"), chunking.language(F.col("file_path")).alias("language"))


@query(f"""with {_DOC} select doc_id, md5(text || chr(10) || case when lang = 'en' then '<!-- trip-00ff -->' when lang = 'de' then '# trip-00ff' else '/* trip-00ff */' end) as marked,
  md5(replace(text, ' the ', '[REDACTED]')) as stripped from r""")
def marked_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = results(spark, sf_dir)
    mark = present.tripwire(F.col("text"), F.lit("trip-00ff"), chunking.language(F.col("file_path")))
    return d.select("doc_id", F.md5(mark).alias("marked"), F.md5(present.strip_token(F.col("text"), " the ")).alias("stripped"))


KEY = present.derived_key("session token", "salt", "result signing")
_INNER, _OUTER = (bytes(b ^ p for b in KEY.ljust(64, b"\0")).hex() for p in (0x36, 0x5C))
_HMAC = f"substr(sha256(from_hex('{_OUTER}') || from_hex(sha256(from_hex('{_INNER}') || encode(n) || '\\x00'::blob || encode(text)))), 1, 16)"


@query(f"""with {_DOC}, s as (select *, substr(md5(doc_id::varchar), 1, 8) as n from r), h as (select *, {_HMAC} as tag from s)
select doc_id, md5('--- RESULT ' || doc_id % 10 + 1 || '/10 (' || file_path || ', trust: workspace) [nonce:' || n || '|hmac:' || tag || '] ---' || chr(10) || case when doc_id % 2 = 0 then 'careful' || chr(10) else '' end
  || text || chr(10) || '--- END RESULT [nonce:' || n || '] ---') as digest, tag from h""")
def wrapped_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results between signed lines; the signature is an HMAC worked out in column expressions."""
    d = results(spark, sf_dir).withColumn("n", F.substring(F.md5(F.col("doc_id").cast("string")), 1, 8))
    warning = F.when(F.col("doc_id") % 2 == 0, "careful")
    whole = present.wrapped(F.col("text"), F.col("file_path"), F.lit("workspace"), F.col("doc_id") % 10 + 1, F.lit(10), F.col("n"), warning, KEY)
    return d.select("doc_id", F.md5(whole).alias("digest"), present.signature(KEY, F.col("n"), F.col("text")).alias("tag"))


@query("select event_id, props as value, true as ok from events")
def encrypted_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values encrypted and read again; the cipher text differs in every run."""
    key = F.lit(b"0123456789abcdef")
    d = table(spark, sf_dir, "events").select("event_id", "props", present.encrypted(F.col("props"), key).alias("c"))
    return d.select("event_id", present.decrypted(F.col("c"), key).alias("value"), (F.col("c") != F.col("props")).alias("ok"))


_TYPO = "replace(p_name, 'a', 'e')"


@query(f"""with k as (select distinct p_name as suggestion from part), u as (select distinct {_TYPO} as name from part where {_TYPO} not in (select p_name from part)),
d as (select name, suggestion, levenshtein(lower(name), lower(suggestion)) as d from u, k),
m as (select *, row_number() over (partition by name order by d, suggestion) as place from d where contains(lower(name), lower(suggestion)) or contains(lower(suggestion), lower(name)) or d <= 2)
select name, place, suggestion from m where place <= 3""")
def similar_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of parts for names that are none, being written with other letters."""
    part = table(spark, sf_dir, "part")
    known = part.select(F.col("p_name").alias("name")).distinct()
    unknown = part.select(F.expr(_TYPO).alias("name")).distinct().join(known, "name", "left_anti")
    return present.similar_names(unknown, known).withColumn("place", F.col("place").cast("bigint"))


@query(f"with {sq._V} select key from e where list_has_all(tags, ['t0', 't1'])")
def tag_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return present.tagged(sq.entries(spark, sf_dir), ["t0", "t1"]).select("key")


@query(f"""with {sq._V} select key, 'click%' as error from e where key like 'click%' and not length(value) < 15 union all select key, '%:1%' from e where key like '%:1%' and not version > 60""")
def validated_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries that the validators registered for their keys do not accept."""
    return present.invalid(sq.entries(spark, sf_dir), {"click%": F.length("value") < 15, "%:1%": F.col("version") > 60})


@query(f"""with {cq._AS}, c as (select file, count(*) filter (where confidence >= 0.8) as errors, count(*) filter (where confidence < 0.8) as warnings from met group by file)
select f.file, coalesce(errors, 0) as errors, coalesce(warnings, 0) as warnings from files f left join c using (file)""")
def preflight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conflicts of each planned file with valid assumptions."""
    planned = cq.page_files(spark, sf_dir)
    c = context.conflicts(cq.assumptions(spark), planned).groupBy(F.col("planned_file").alias("file"))
    c = c.agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))
    return planned.join(c, "file", "left").fillna(0)


@query("""with recursive d as (select doc_id as id, ceil(length(text) / 3)::bigint as tokens, doc_id // 10000 as block, row_number() over (partition by doc_id // 10000 order by doc_id) as k from documents),
r(block, k, id, batch, n, total) as (select block, k, id, block * 10000, 1, tokens from d where k = 1
  union all select d.block, d.k, d.id, case when r.n = 50 or r.total + d.tokens > 7500 then r.batch + 1 else r.batch end,
    case when r.n = 50 or r.total + d.tokens > 7500 then 1 else r.n + 1 end, case when r.n = 50 or r.total + d.tokens > 7500 then d.tokens else r.total + d.tokens end
  from r join d on d.block = r.block and d.k = r.k + 1)
select id, batch from r""")
def embedding_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of documents for an embedding service."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.ceil(F.length("text") / 3).cast("bigint").alias("tokens"))
    return present.batches(d)


@query("select count(*) as n_vectors, max(len(embedding)) as dimensions, round(sum(len(embedding)) * 4 / 1048576.0, 6)::double as megabytes from embeddings")
def vector_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    return v.agg(F.count("*").alias("n_vectors"), F.max(F.size("embedding")).cast("bigint").alias("dimensions"), F.round(F.sum(F.size("embedding")) * 4 / 1048576.0, 6).alias("megabytes"))
