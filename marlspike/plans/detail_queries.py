"""What completes other queries: responses with highlights, checked method calls, shortcuts, stored tables, dialects of globs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlspike.functions.globs import fits, glob_regex, parts, relative
from marlspike.functions.text import sql_string
from marlspike.functions.times import millis
from marlspike.operators import chunking, fusion, kvstore, present, services, sync, tasks
from marlspike.plans import chunk_queries as cq
from marlspike.plans import present_queries as pq
from marlspike.plans import search_queries as sq
from marlspike.plans import stored
from marlspike.plans import store_queries as kq
from marlspike.plans.registry import query
from marlspike.sources.commits import Table
from marlspike.sources.files import latest
from marlspike.sources.tables import table

_LIMIT = 6
_FETCHED = _LIMIT * fusion.OVER_FETCH
_TOP = f"with {sq._BM25}, {sq._LEX_RANK.replace('limit 50', f'limit {_FETCHED}')}, {sq._VEC.replace('limit 50', f'limit {_FETCHED}')}, {sq._FUSED}"


@query(f"""{_TOP}, t as (select *, row_number() over (order by round(rrf_score, 9) desc, doc_id) - 1 as rank from fused order by rank limit {_LIMIT})
select t.doc_id, t.rank, round(rrf_score, 6) as rrf_score, d.source, d.n_chars, array_to_string(l.highlights, ' ') as highlights from t join documents d using (doc_id)
left join (select lex.doc_id, highlights from lex join lexr using (doc_id)) l on l.doc_id = t.doc_id""")
def hybrid_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six results of two lists of thirty each, with their documents and what the words found."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    out = fusion.response(sq._semantic(spark, sf_dir, _FETCHED), sq._lexical(spark, sf_dir, _FETCHED), docs, _LIMIT)
    return out.select("doc_id", F.col("rank").cast("bigint").alias("rank"), F.round("rrf_score", 6).alias("rrf_score"), "source", "n_chars", F.array_join("highlights", " ").alias("highlights"))


_CALLS = "text || chr(10) || 'Store' || (doc_id % 40) || '.get(1)' || chr(10) || '  Store' || (doc_id % 50) || ' . drop(2); JSON.parse(x)' || chr(10) || 'helper' || doc_id || '.fetch' || (doc_id % 3) || '(3) + none.at(4)'"


@query(f"""with {cq._SRC}, {cq._LINES}, called as (select doc_id, unnest(range(1, len(l) + 1)) as line, unnest(l) as t from (select doc_id, string_split({_CALLS}, chr(10)) as l from src)),
calls as (select doc_id, line, o as object, m as method from (select doc_id, line, unnest(regexp_extract_all(t, {sql_string(chunking.CALL)}, 1)) as o, unnest(regexp_extract_all(t, {sql_string(chunking.CALL)}, 2)) as m from called)
  where o not in ({', '.join(map(sql_string, cq.BUILT_IN))})),
defs as (select doc_id, s.name as name from (select doc_id, unnest([{cq._SYM}]) as s from tl) where s.name <> ''),
judged as (select c.object, c.method, bool_or(contains(s.text, c.method)) as there from (select distinct object, method from calls) c join defs d on d.name = c.object join src s on s.doc_id = d.doc_id group by all)
select c.* from calls c join judged j using (object, method) where not there""")
def invalid_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of methods that no definition of their object mentions."""
    src = cq.sources(spark, sf_dir)
    calls = chunking.api_calls(src.withColumn("text", F.expr(_CALLS.replace("chr(10)", "'\\n'"))), cq.BUILT_IN)
    defs = chunking.symbols(src).select("name", F.col("doc_id").alias("chunk"))
    return chunking.invalid_calls(calls, defs, src.select(F.col("doc_id").alias("chunk"), F.col("text").alias("content"))).select("doc_id", "line", "object", "method")


@query("""with l as (select source as path, unnest(string_split(text, chr(10))) as line, doc_id from documents),
s as (select path, sha256(line) as hash, doc_id // 20 % 5 as part from l), now as (select distinct path, hash from s where part < 3 and path <> 'src4')
select path, part, count(*) as n from s where path not in (select path from now) or (path, hash) in (select (path, hash) from now) group by path, part""")
def stale_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored chunks, here lines of a source, that are left when only some hashes are named for each file."""
    l = table(spark, sf_dir, "documents").select(F.col("source").alias("path"), F.explode(F.split("text", "\n", -1)).alias("line"), (F.floor(F.col("doc_id") / 20) % 5).alias("part"))  # noqa: E741
    s = l.select("path", F.sha2("line", 256).alias("hash"), "part")
    return sync.without_stale(s, s.filter("part < 3 and path <> 'src4'")).groupBy("path", "part").agg(F.count("*").alias("n"))


@query("""with h as (select doc_id, hex(encode(text)) as h from documents),
b as (select doc_id, h, unnest(range(0, greatest(1, ceil(length(h) / 8192)::bigint))) as block from h)
select doc_id, block, sha256(unhex(substr(h, block * 8192 + 1, 8192))) as hash from b""")
def block_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hash of every block of 4096 bytes; an empty file is one empty block."""
    m = sync.manifest(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.col("text").cast("binary").alias("content")), 4096)
    return m.select(F.col("path").alias("doc_id"), F.explode("blocks").alias("b")).select("doc_id", F.col("b.index").cast("bigint").alias("block"), "b.hash")


_TYPED = "case e.type when 'click' then 'snippet' when 'view' then 'decision' when 'purchase' then 'dependency' else e.type end"


@query(f"""with {kq._V}, x as (select e.* exclude (type), {_TYPED} as type from e where {kq._LIVE} and (visibility <> 'private' or agent = 'agent1'))
select * from (select 'snippets' as list, key from x where type = 'snippet' and list_contains(tags, 't1') order by key limit 20)
union all select * from (select 'decisions', key from x where type = 'decision' order by ts desc, key limit 20)
union all select * from (select 'dependencies', key from x where type = 'dependency' order by key limit 20)""")
def context_shortcuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snippets of a language, decisions with the newest first, and dependencies that a reader may see."""
    named = F.expr(_TYPED.replace("e.type", "type"))
    e = kq.entries(spark, sf_dir).withColumn("type", named)
    lists = {
        "snippets": kvstore.snippets(e, kq.now(), "t1", "agent1"),
        "decisions": kvstore.newest_first(e, kq.now(), "agent1"),
        "dependencies": kvstore.dependencies(e, kq.now(), "agent1"),
    }
    out = [d.select(F.lit(name).alias("list"), "key") for name, d in lists.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


_KEYS = """k as (select event_id as id, 'w' || (user_id % 6) as workspace, 'a' || (user_id % 4) as agent, event_type <> 'error' as active, case when event_id % 3 > 0 then ts + interval 5 day end as expires_at from events)"""


@query(f"""with {_KEYS} select 'active' as list, id from k where workspace = 'w2' and agent = 'a0' and active and (expires_at is null or expires_at >= timestamp '{kq.NOW}')
union all select 'all', id from k where workspace = 'w3'""")
def key_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of a workspace and an agent that still count, and all keys of a workspace."""
    e = table(spark, sf_dir, "events").selectExpr(
        "event_id as id", "concat('w', user_id % 6) as workspace", "concat('a', user_id % 4) as agent", "event_type <> 'error' as active", "case when event_id % 3 > 0 then cast(ts as timestamp) + interval 5 day end as expires_at"
    )
    few = kvstore.api_keys(e, kq.now(), "w2", "a0").select(F.lit("active").alias("list"), "id")
    return few.unionByName(kvstore.api_keys(e, kq.now(), "w3", active_only=False).select(F.lit("all").alias("list"), "id"))


@query(f"""select event_id as id, coalesce((event_id % 4) <> 0 and epoch_us(timestamp '{kq.NOW}') - epoch_us(ts) > (event_id % 4) * 86400000000, false) as outlived,
  coalesce(case when event_id % 3 > 0 then ts + interval 5 day end < timestamp '{kq.NOW}', false) as expired from events""")
def expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which entries have outlived a life of so many days, 0 for none, and which have passed a date."""
    ts = F.col("ts").cast("timestamp")
    until = F.when(F.col("event_id") % 3 > 0, ts + F.expr("interval 5 day"))
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), kvstore.outlived(ts, F.col("event_id") % 4 * 86_400_000, kq.now()).alias("outlived"), kvstore.expired_at(until, kq.now()).alias("expired"))


_RUNS = "r as (select 'agent' || (user_id % 6) as agent, event_type <> 'error' as passed, event_type = 'purchase' as btp, user_id % 2 = 0 as enabled, value as cost, event_id % 900 as tokens, (event_id % 13) / 13.0 as vi, (event_id % 11) / 11.0 as da, (event_id % 7) / 7.0 as cvr, (event_id % 5) / 5.0 as sc from events)"


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    share = lambda n: f"(event_id % {n}) / {n}.0D"
    return table(spark, sf_dir, "events").selectExpr(
        "concat('agent', user_id % 6) as agent", "event_type <> 'error' as passed", "event_type = 'purchase' as btp", "user_id % 2 = 0 as enabled", "value as cost", "event_id % 900 as tokens",
        f"{share(13)} as vi", f"{share(11)} as da", f"{share(7)} as cvr", f"{share(5)} as sc",
    )


@query(f"""with {_RUNS} select agent, round(avg(vi), 6)::double as vi, round(avg(da), 6)::double as da, round(1 - avg(cvr), 6)::double as kept_constraints, round(1 - avg(sc), 6)::double as kept_scope, round(avg(btp::int), 6)::double as btp_rate from r group by agent""")
def agent_radar(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tasks.radar(_runs(spark, sf_dir))
    return d.select("agent", *(F.round(c, 6).alias(c) for c in d.columns[1:]))


@query(f"""with {_RUNS}, s as (select enabled, count(*) as n, round(sum(cost), 2) as cost, round(avg(tokens), 6) as tokens, round(100.0 * count(*) filter (where passed) / count(*), 6)::double as rate from r group by enabled)
select a.n as total_with, a.cost as total_cost_with, a.tokens as avg_tokens_with, a.rate as pass_rate_with, b.n as total_without, b.cost as total_cost_without, b.tokens as avg_tokens_without, b.rate as pass_rate_without, true as has_data
from s a, s b where a.enabled and not b.enabled""")
def mode_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs with the tool beside those without it."""
    d = tasks.with_and_without(_runs(spark, sf_dir))
    return d.select(*(F.round(c, 2 if "cost" in c else 6).alias(c) if t == "double" else c for c, t in d.dtypes))


@query(f"""with recursive c as (select event_id as id, case when event_id % 4 > 0 then event_id - (event_id % 4) - 4 * (event_id % 3) end as parent from events),
r(id, depth) as (select id, 0 from c where parent is null union all select c.id, r.depth + 1 from r join c on c.parent = r.id where r.depth < {services.CHAIN_DEPTH})
select id, depth, depth < {services.CHAIN_DEPTH} as ran from r""")
def chained_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls made by calls, as deep as they may be."""
    c = table(spark, sf_dir, "events").selectExpr("event_id as id", "case when event_id % 4 > 0 then event_id - (event_id % 4) - 4 * (event_id % 3) end as parent")
    return services.chained_calls(c)


@query(f"""with {cq._FIXED}, old as (select doc_id, start_line, end_line, md5(content) as hash, 0 as batch from chunk),
new as (select doc_id, start_line, end_line + doc_id % 2 as end_line, md5(content || '!') as hash, 1 + unnest([0, doc_id % 3]) as batch from chunk where doc_id % 4 = 1)
select doc_id, start_line, end_line, arg_max(case batch when 0 then hash else hash || batch end, batch) as stored from (select * from old union all select * from new) group by doc_id, start_line, end_line""")
def chunk_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks stored anew take the place of those with their file and lines; the last of a batch counts."""
    d = chunking.fixed_chunks(table(spark, sf_dir, "documents")).select("doc_id", "start_line", "end_line", "content")
    old = d.select("doc_id", "start_line", "end_line", F.md5("content").alias("stored"), F.lit(0).cast("bigint").alias("batch"))
    new = d.filter("doc_id % 4 = 1").withColumn("batch", F.explode(F.array(F.lit(1).cast("bigint"), F.col("doc_id") % 3 + 1)))
    new = new.select("doc_id", "start_line", (F.col("end_line") + F.col("doc_id") % 2).alias("end_line"), F.concat(F.md5(F.concat("content", F.lit("!"))), F.col("batch").cast("string")).alias("stored"), "batch")
    out = latest(old.withColumn("end_line", F.col("end_line").cast("bigint")).unionByName(new.withColumn("end_line", F.col("end_line").cast("bigint"))), ["doc_id", "start_line", "end_line"], ["batch"])
    return out.select("doc_id", F.col("start_line").cast("bigint").alias("start_line"), "end_line", "stored")


@query(f"""with {cq._FIXED} select doc_id, count(*) as n_chunks, any_value(h) as file_hash, (select count(*) from documents) as n_files from chunk join (select doc_id, sha256(text) as h from documents) using (doc_id) group by doc_id""")
def stored_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks without their vectors, hashes of files and figures about them as tables with commits, written once and read back."""
    docs = table(spark, sf_dir, "documents")
    schemas = {"chunks": "doc_id bigint, start_line int, end_line int, content string", "hashes": "doc_id bigint, file_hash string", "about": "n_files bigint"}

    def make(folder: str) -> None:
        chunks = chunking.fixed_chunks(docs).withColumn("embedding", F.array(F.lit(0.0)))
        rows = {"chunks": chunks.drop("embedding"), "hashes": docs.select("doc_id", F.sha2("text", 256).alias("file_hash")), "about": docs.agg(F.count("*").alias("n_files"))}
        for name, d in rows.items():
            Table(spark, f"{folder}/{name}", schemas[name]).append(d)

    folder = stored.folder_of(spark, f"{sf_dir}/documents.parquet", "chunk-store", make)
    chunks, hashes, about = (Table(spark, f"{folder}/{n}", s).read() for n, s in schemas.items())
    by = chunks.groupBy("doc_id").agg(F.count("*").alias("n_chunks"))
    return by.join(hashes, "doc_id").crossJoin(F.broadcast(about))  # one row


@query("""with c as (select user_id as session, 'changes' as kind, count(*) as n, max(event_id) as last from events where event_type in ('click', 'view') group by user_id),
a as (select user_id, 'assumptions', count(*), max(event_id) from events where event_type = 'signup' and user_id % 3 <> 0 group by user_id),
s as (select user_id, 'snapshots', 1, max(event_id) from events where event_type = 'purchase' group by user_id)
select session, kind, n, last from c union all select * from a union all select * from s""")
def session_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions in three tables, saved twice: a later save of a session takes the place of the earlier one, and one that is emptied has nothing left."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("session"), "event_id", "event_type")
    schema = "session bigint, event_id bigint, saved bigint"
    kinds = {"changes": ["click", "view"], "assumptions": ["signup"], "snapshots": ["purchase"]}

    def make(folder: str) -> None:
        for kind, types in kinds.items():
            t, rows = Table(spark, f"{folder}/{kind}", schema), e.filter(F.col("event_type").isin(types)).select("session", "event_id")
            t.append(rows.filter("event_id % 2 = 0").withColumn("saved", F.lit(1).cast("bigint")))
            now = rows.filter("session % 3 <> 0") if kind == "assumptions" else rows
            mark = e.select("session").distinct().select("session", F.lit(None).cast("bigint").alias("event_id"), F.lit(2).cast("bigint").alias("saved"))  # a save names its session
            t.append(now.withColumn("saved", F.lit(2).cast("bigint")).unionByName(mark))

    folder = stored.folder_of(spark, f"{sf_dir}/events.parquet", "sessions", make)
    out = None
    for kind in kinds:
        rows = Table(spark, f"{folder}/{kind}", schema).read()
        last = rows.groupBy("session").agg(F.max("saved").alias("saved"))
        rows = rows.join(last, ["session", "saved"]).filter("event_id is not null")
        n = F.lit(1).cast("bigint") if kind == "snapshots" else F.count("*")
        by = rows.groupBy("session").agg(n.alias("n"), F.max("event_id").alias("last")).select("session", F.lit(kind).alias("kind"), "n", "last")
        out = by if out is None else out.unionByName(by)
    return out


_GLOBS = [("path", "SRC1*/**/*.md"), ("strict", "src1?/**/*.md"), ("key", "src*1*.MD"), ("loose", "1*/7"), ("exact", "src1\\a/b.md"), ("exact", "src*/**/1*.md"), ("like", "src_/%/1*.md"), ("like", "src1*")]
_PATHS = "p as (select doc_id, source || case when doc_id % 3 = 0 then '\\a/' when doc_id % 3 = 1 then '/x/' else '/x/y/' end || doc_id || '.md' as path from documents)"


def _fit_sql(dialect: str, glob: str) -> str:
    if dialect == "like":
        return f"path like {sql_string(glob.replace('*', '%'))}"
    if dialect == "exact":
        g = glob.replace("\\", "/")
        return f"(replace(path, '\\', '/') = {sql_string(g)} or regexp_matches(replace(path, '\\', '/'), {sql_string(glob_regex(g, 'strict'))}))"
    return f"regexp_matches(path, {sql_string(glob_regex(glob, dialect))})"


@query(f"with {_PATHS} " + " union all ".join(f"select {i} as rule, doc_id from p where {_fit_sql(d, g)}" for i, (d, g) in enumerate(_GLOBS)))
def glob_dialects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose path fits each of eight globs, of six dialects."""
    middle = F.when(F.col("doc_id") % 3 == 0, "\\a/").when(F.col("doc_id") % 3 == 1, "/x/").otherwise("/x/y/")
    p = table(spark, sf_dir, "documents").select("doc_id", F.concat("source", middle, F.col("doc_id").cast("string"), F.lit(".md")).alias("path"))
    found = F.array_compact(F.array(*(F.when(fits(F.col("path"), g, d), F.lit(i)) for i, (d, g) in enumerate(_GLOBS))))
    return p.select(F.explode(found).alias("rule"), "doc_id")


@query(f"""with {_PATHS}, n as (select doc_id, replace(path, '\\', '/') as p from p)
select doc_id, regexp_extract(p, '^(.*)/[^/]*$', 1) as folder, regexp_extract(p, '([^/]*)$', 1) as name, doc_id::varchar as stem, 'md' as extension,
  case when starts_with(p, 'src1/') then substr(p, 6) else p end as seen from n""")
def path_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths with either slash in parts, and as they are seen from a folder."""
    middle = F.when(F.col("doc_id") % 3 == 0, "\\a/").when(F.col("doc_id") % 3 == 1, "/x/").otherwise("/x/y/")
    p = table(spark, sf_dir, "documents").select("doc_id", F.concat("source", middle, F.col("doc_id").cast("string"), F.lit(".md")).alias("path"))
    return p.select("doc_id", parts(F.col("path")).alias("x"), relative(F.col("path"), F.lit("src1/")).alias("seen")).select("doc_id", "x.*", "seen")


@query(f"""with {pq._DOC} select doc_id, md5(printf('## %s:%d-%d (%.1f%% match)', file_path, 1, end_line, 100 * (doc_id % 97) / 97.0) || chr(10) || 'Type: other | Language: ' || lang
  || case when len(symbols) > 0 then chr(10) || 'Symbols: ' || array_to_string(symbols, ', ') else '' end || chr(10) || '```' || lang || chr(10) || text || chr(10) || '```') as digest from r""")
def full_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results with everything about them."""
    d = pq.results(spark, sf_dir).withColumns({"start_line": F.lit(1), "type": F.lit("other"), "score": (F.col("doc_id") % 97) / 97.0, "language": F.col("lang"), "content": F.col("text")})
    return d.select("doc_id", F.md5(present.full(d)).alias("digest"))


@query(f"""with s as (select user_id % 20 as client, (epoch_ms(ts) // 86400000)::bigint as session, event_id as id from events),
d as (select distinct client, session, (session + client) % 3 = 0 as reached from s),
next as (select *, (select min(e.session) from d e where e.client = d.client and e.session >= d.session and e.reached) as goes from d),
j as (select s.*, n.reached, n.goes from s join next n using (client, session)),
k as (select *, row_number() over (partition by client, goes, reached order by session desc, id desc) as place from j)
select client, session, id, case when reached then 'sent' when place > 40 then 'dropped' when goes is not null then 'sent' else 'waiting' end as state from k""")
def telemetry_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of daily sessions that are sent, wait for the next session, or fall out of a queue of forty."""
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 20).alias("client"), F.floor(millis(F.col("ts")) / 86_400_000).alias("session"), F.col("event_id").alias("id"))
    sessions = e.select("client", "session").distinct().withColumn("reached", (F.col("session") + F.col("client")) % 3 == 0)
    return services.sent_or_kept(e, sessions, 40)


@query("""with o as (select 'w' || doc_id % 60 as path, min(doc_id) as id, 'old ' || min(doc_id) as name, min(source) as note from documents where doc_id % 60 < 40 group by 1),
i as (select 'w' || doc_id % 60 as path, max(doc_id) as id, 'new ' || max(doc_id) as name, case when doc_id % 60 % 2 = 0 then arg_max(source, doc_id) end as note from documents where doc_id % 60 >= 25 group by 1, doc_id % 60),
m as (select coalesce(o.path, i.path) as path, o.path is not null as here, i.path is not null as there, o.id as oid, i.id as iid, o.name as oname, i.name as iname, o.note as onote, i.note as inote from o full outer join i on o.path = i.path)
select false as overwrite, path, coalesce(oid, iid) as id, coalesce(oname, iname) as name, case when here then onote else inote end as note, case when here then 'kept' else 'added' end as origin from m
union all select true, path, coalesce(iid, oid), coalesce(iname, oname), coalesce(inote, onote), case when not here then 'added' when there then 'replaced' else 'kept' end from m""")
def registry_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registry after the import of another one, with what is there kept, and with it replaced."""
    d = table(spark, sf_dir, "documents").withColumn("k", F.col("doc_id") % 60).withColumn("path", F.concat(F.lit("w"), F.col("k").cast("string")))
    old = d.filter("k < 40").groupBy("path").agg(F.min("doc_id").alias("id"), F.min("source").alias("note"))
    old = old.select("path", "id", F.concat(F.lit("old "), F.col("id").cast("string")).alias("name"), "note")
    new = d.filter("k >= 25").select("path", F.col("doc_id").alias("id"), F.concat(F.lit("new "), F.col("doc_id").cast("string")).alias("name"), F.when(F.col("k") % 2 == 0, F.col("source")).alias("note"))
    both = [services.imported(old, new, o).withColumn("overwrite", F.lit(o)) for o in (False, True)]
    return both[0].unionByName(both[1])
