"""Change ledger, assumptions, dependency drift, graphs, validators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlspike.functions.globs import glob_regex
from marlspike.functions.text import sql_string
from marlspike.operators import context, graph
from marlspike.operators.iterate import cut
from marlspike.plans.registry import query
from marlspike.sources.tables import spread, table

_CH = """ch as (select event_id as id, user_id as run_id, ts, 'src/f' || (json_extract_string(props, '$.k')::int % 40) || '.ts' as file,
  case event_type when 'signup' then 'create' when 'view' then 'read' when 'error' then 'delete' else 'modify' end as operation, 'because of ' || event_type as reason from events)"""


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a change ledger: user as run, the property k as file, the type as operation."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int") % 40
    op = F.when(F.col("event_type") == "signup", "create").when(F.col("event_type") == "view", "read").when(F.col("event_type") == "error", "delete").otherwise("modify")
    return e.select(F.col("event_id").alias("id"), F.col("user_id").alias("run_id"), "ts", F.concat(F.lit("src/f"), k.cast("string"), F.lit(".ts")).alias("file"), op.alias("operation"), F.concat(F.lit("because of "), "event_type").alias("reason"))


@query(f"with {_CH} select file, count(*) as n from ch group by file order by n desc, file limit 10")
def hotspots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.hotspots(changes(spark, sf_dir))


@query(f"""with {_CH} select count(*) as total, count(distinct file) as unique_files, count(distinct run_id) as unique_runs, count(*) filter (where operation = 'create') as n_create,
  count(*) filter (where operation = 'modify') as n_modify, count(*) filter (where operation = 'delete') as n_delete, round(count(*) / count(distinct run_id), 6) as avg_per_run from ch""")
def ledger_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.ledger_stats(changes(spark, sf_dir)).withColumn("avg_per_run", F.round("avg_per_run", 6))


@query(f"with {_CH} select run_id, min(ts) as first_ts, count(*) as n_changes, array_to_string(list_sort(list_distinct(list(file))), ',') as files from ch group by run_id")
def ledger_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.timeline(changes(spark, sf_dir)).withColumn("files", F.array_join("files", ","))


@query(f"""with {_CH}, l as (select file, arg_max(operation, ts) as last_operation, max(ts) as last_modified_at, count(*) as n_changes from ch group by file)
select *, case when last_operation = 'delete' then 'deleted' when last_operation in ('create', 'modify') then 'exists' else 'unknown' end as state from l""")
def file_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.file_state(changes(spark, sf_dir))


@query(f"with {_CH} select id, file, reason from ch where ts between timestamp '2024-01-05' and timestamp '2024-01-06' and contains(lower(reason), 'purch')")
def changes_in_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda s: F.lit(s).cast("timestamp_ntz")
    return context.in_range(changes(spark, sf_dir), at("2024-01-05"), at("2024-01-06"), "PURCH").select("id", "file", "reason")


_DEP = "dep as (select distinct json_extract_string(props, '$.k')::int as file, user_id % 100 as depends_on from events where event_type = 'purchase')"


@query(f"""with recursive {_DEP},
r(start, node, depth) as (select s, s, 0 from (values (9), (27), (45)) v(s) union select r.start, d.file, r.depth + 1 from r join dep d on d.depends_on = r.node where r.depth < 100)
select start, node, min(depth) as depth from r group by start, node having min(depth) > 1""")
def impact_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files at second hand and beyond that depend on three changed ones."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    d = e.filter("event_type = 'purchase'").select(k.alias("file"), (F.col("user_id") % 100).cast("int").alias("depends_on")).distinct()
    return context.impact(d, spark.createDataFrame([(9,), (27,), (45,)], "start int"))


# Assumptions as a small rule table: id, type, description, globs, confidence, valid.
RULES = [
    (1, "schema", "English pages keep their shape", ["/en/**"], 0.9, True),
    (2, "interface", "French and German pages", ["/fr/*", "/DE/?????.html"], 0.5, True),
    (3, "config", "old", ["/en/*"], 0.95, False),
    (4, "behavior", "all html", ["**/*.html"], 0.8, True),
    (5, "dependency", "needs part 7 and PKG-3 to stay", ["/none/*"], 0.7, True),
    (6, "dependency", "needs pkg-11", ["/es/1*"], 0.2, True),
]
_RULES = ", ".join(f"({i}, '{t}', {sql_string(d)}, [{', '.join(sql_string(glob_regex(g)) for g in gs)}], {c}::double, {v})" for i, t, d, gs, c, v in RULES)
_AS = f"""rules as (select * from (values {_RULES}) v(id, type, description, regexes, confidence, valid)),
rx as (select id, confidence, unnest(regexes) as rx from rules where valid),
files as (select distinct regexp_extract(url, '://[^/?#]*([^?#]*)', 1) as file from pages),
met as (select distinct id, confidence, file from files join rx on regexp_matches(file, rx))"""


def assumptions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RULES, "id int, type string, description string, related_files array<string>, confidence double, valid boolean")


def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(F.regexp_extract("url", "://[^/?#]*([^?#]*)", 1).alias("file")).distinct()


@query(f"with {_AS} select id, 'File(s) modified: ' || array_to_string(list_sort(list(file)), ', ') as reason from met group by id")
def assumption_invalidation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.invalidated(assumptions(spark), page_files(spark, sf_dir))


@query(f"with {_AS} select id, file as planned_file, case when confidence >= 0.8 then 'error' else 'warning' end as severity from met")
def assumption_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.conflicts(assumptions(spark), page_files(spark, sf_dir))


@query("""with s as (select user_id as id, arg_max(event_type, ts) as last, user_id % 5 as kind from events group by user_id)
select kind, count(*) as total, count(*) filter (where last <> 'error') as valid, count(*) filter (where last = 'error') as invalid from s group by kind""")
def assumption_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user as an assumption that an error invalidates and anything later revalidates."""
    e = table(spark, sf_dir, "events")
    log = e.select(F.col("user_id").alias("id"), "ts", F.when(F.col("event_type") == "error", "invalidate").otherwise("revalidate").alias("action"))
    d = context.states(log).withColumn("kind", F.col("id") % 5)
    return d.groupBy("kind").agg(F.count("*").alias("total"), F.count_if("valid").alias("valid"), F.count_if(~F.col("valid")).alias("invalid"))


@query("""with f as (select 'src/' || case user_id % 6 when 0 then 'types/a' when 1 then 'prisma/schema.config' when 2 then 'x.d.ts' when 3 then 'app.config.ts' when 4 then 'u.schema.ts' else 'main' end || user_id as file from (select distinct user_id from events)),
r as (select file, unnest(list_filter([case when contains(file, 'prisma/schema') or contains(file, '.schema.') then 'schema' end, case when contains(file, '.d.ts') or contains(file, 'types/') then 'interface' end,
  case when contains(file, 'config') then 'config' end], lambda x: x is not null)) as type from f) select file, type from r""")
def infer_assumptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = table(spark, sf_dir, "events").select("user_id").distinct()
    names = F.array(*map(F.lit, ["types/a", "prisma/schema.config", "x.d.ts", "app.config.ts", "u.schema.ts", "main"]))
    return context.inferred(u.select(F.concat(F.lit("src/"), F.get(names, (F.col("user_id") % 6).cast("int")), F.col("user_id").cast("string")).alias("file")))


# Orders of even and odd numbers as snapshots before and after; the later one knows more packages.
_SNAP = lambda half: f"select 'pkg-' || (l_partkey % {300 + 10 * half}) as package, (sum(l_suppkey) % 9)::bigint::varchar as version from lineitem where l_orderkey % 2 = {half} group by 1"
_DIFF = f"""o as ({_SNAP(0)}), n as ({_SNAP(1)}), d as (select coalesce(o.package, n.package) as package, case when o.package is null then 'added' when n.package is null then 'removed' when o.version <> n.version then 'updated' end as change,
  o.version as old_version, n.version as new_version from o full outer join n on o.package = n.package)"""


def _snapshot(spark: SparkSession, sf_dir: str, half: int) -> DataFrame:
    d = table(spark, sf_dir, "lineitem").filter(F.col("l_orderkey") % 2 == half)
    return d.groupBy(F.concat(F.lit("pkg-"), (F.col("l_partkey") % (300 + 10 * half)).cast("string")).alias("package")).agg((F.sum("l_suppkey") % 9).cast("string").alias("version"))


@query(f"with {_DIFF} select * from d where change is not null")
def dependency_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.dependency_diff(_snapshot(spark, sf_dir, 0), _snapshot(spark, sf_dir, 1))


@query(f"with {_AS}, {_DIFF} select id, description from rules where type = 'dependency' and valid and exists (select 1 from d where change is not null and contains(lower(description), lower(package)))")
def dependency_affected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.affected(assumptions(spark), dependency_diff(spark, sf_dir)).select("id", "description")


@query("""with s as (select user_id % 7 as repo, ts as taken_at, md5((value > 10)::varchar) as manifest_hash, case when event_type = 'view' then null else md5(event_type) end as lock_hash from events),
w as (select *, lag(manifest_hash) over (partition by repo order by taken_at) as m0, lag(lock_hash) over (partition by repo order by taken_at) as l0, row_number() over (partition by repo order by taken_at) as k from s)
select repo, taken_at, manifest_hash is distinct from m0 as manifest_changed, lock_hash is not null and lock_hash is distinct from l0 as lock_changed from w where k > 1""")
def snapshot_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    s = e.select((F.col("user_id") % 7).alias("repo"), F.col("ts").alias("taken_at"), F.md5((F.col("value") > 10).cast("string")).alias("manifest_hash"), F.when(F.col("event_type") != "view", F.md5("event_type")).alias("lock_hash"))
    return context.drift(s)


# --- graphs ---

_HOST = "regexp_extract(url, '://([^/?#]*)', 1)"
_HREF = "regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)"


@query(f"""with p as (select {_HOST} as file, {_HREF} as h from pages), e as (select file, unnest(h) as h from p)
select n.file, chunk_count, coalesce(d, 0) as n_exports, coalesce(i, 0) as internal_imports, coalesce(x, 0) as external_imports from (select file, count(*) as chunk_count from p group by file) n
left join (select file, count(distinct h) as d, count(*) filter (where h[1] = '/') as i, count(*) filter (where h[1] <> '/') as x from e group by file) e using (file)""")
def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts as files: their chunks, distinct links, and links inside and outside."""
    p = table(spark, sf_dir, "pages").select(F.regexp_extract("url", "://([^/?#]*)", 1).alias("file"), F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1)).alias("h"))
    e = p.select("file", F.explode("h").alias("h")).groupBy("file").agg(F.count_distinct("h").alias("n_exports"), F.count_if(F.col("h").startswith("/")).alias("internal_imports"), F.count_if(~F.col("h").startswith("/")).alias("external_imports"))
    d = p.groupBy("file").agg(F.count("*").alias("chunk_count")).join(e, "file", "left")
    return d.fillna(0)


# A file for each part, twenty folders with an index each, and six imports of each file: of two files nearby, one by an
# alias, a folder's index, a package, and a file that is not there.
_FILE_OF = lambda k: f"'src/m' || cast(({k}) % 20 as varchar(20)) || '/f' || cast({k} as varchar(20)) || '.ts'"
_SPECIFIERS = [
    "'./f' || cast(p_partkey + 20 as varchar(20))",
    "'../m' || cast((p_partkey + 1) % 20 as varchar(20)) || '/f' || cast(p_partkey + 1 as varchar(20)) || '.ts'",
    "'@/m' || cast(p_partkey * 7 % 20 as varchar(20)) || '/f' || cast(p_partkey * 7 as varchar(20))",
    "'./../m' || cast(p_size % 20 as varchar(20))",
    "case p_size % 3 when 0 then 'lib' || cast(p_size as varchar(20)) || '/deep/part' when 1 then '@scope/pkg' || cast(p_size as varchar(20)) || '/deep' else 'react' end",
    "'./missing'",
]
#: What each resolves to, as SQL says it of the same rows.
_FOUND = lambda k: f"select {_FILE_OF('p_partkey')}, {_FILE_OF(k)}, false from part where {k} in (select p_partkey from part)"
_EDGES = f"""e(source, target, is_external) as ({_FOUND('p_partkey + 20')} union {_FOUND('p_partkey + 1')} union {_FOUND('p_partkey * 7')}
  union select {_FILE_OF('p_partkey')}, 'src/m' || (p_size % 20) || '/index.ts', false from part
  union select {_FILE_OF('p_partkey')}, case p_size % 3 when 0 then 'lib' || p_size when 1 then '@scope/pkg' || p_size else 'react' end, true from part)"""


def import_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spread(table(spark, sf_dir, "part"))
    files = part.selectExpr(f"{_FILE_OF('p_partkey')} as path").unionByName(spark.range(20).selectExpr("concat('src/m', id, '/index.ts') as path"))
    imports = part.selectExpr(f"{_FILE_OF('p_partkey')} as source", f"explode(array({', '.join(_SPECIFIERS)})) as specifier")
    return graph.resolve(imports, files, {"@/": "src/"})


@query(f"with {_EDGES} select * from e")
def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return import_edges(spark, sf_dir)


@query(f"with {_EDGES} select distinct target as package from e where is_external")
def external_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return import_edges(spark, sf_dir).filter("is_external").select(F.col("target").alias("package")).distinct()


@query(f"""with {_EDGES}, d as (select regexp_extract(source, '^(.*)/[^/]*$', 1) as source_dir, regexp_extract(target, '^(.*)/[^/]*$', 1) as target_dir from e where not is_external)
select distinct * from d where source_dir <> target_dir""")
def dir_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.folder_edges(import_edges(spark, sf_dir))


@query("""with recursive e as (select distinct json_extract_string(props, '$.k')::int as source, (user_id % 100)::int as target from events where event_type = 'error' and json_extract_string(props, '$.k')::int <> user_id % 100),
r(start, node) as (select source, target from e union select r.start, e.target from r join e on e.source = r.node)
select distinct start as node from r where start = node""")
def cycle_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes that reach themselves, over links drawn from the events."""
    e = table(spark, sf_dir, "events").filter("event_type = 'error'")
    d = e.select(F.get_json_object("props", "$.k").cast("int").alias("source"), (F.col("user_id") % 100).cast("int").alias("target")).filter("source <> target")
    return graph.cycle_members(d)


@query(f"""with {_EDGES}, n as (select distinct source as name from e union select target from e where not is_external),
o as (select name, 'component' as kind, regexp_extract(name, '^(.*)/[^/]*$', 1) as parent from n union all select distinct regexp_extract(name, '^(.*)/[^/]*$', 1), 'container', regexp_extract(name, '^([^/]*)', 1) from n
  union all select distinct target, 'external', '' from e where is_external) select * from o""")
def architecture_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects of three levels: files, their folders, and external packages."""
    e = cut(import_edges(spark, sf_dir))
    inside = e.select(F.col("source").alias("name")).union(e.filter("not is_external").select("target")).distinct()
    files = inside.select("name", F.lit("component").alias("kind"), graph.folder(F.col("name")).alias("parent"))
    folders = inside.select(graph.folder(F.col("name")).alias("name"), F.lit("container").alias("kind"), F.regexp_extract("name", "^([^/]*)", 1).alias("parent")).distinct()
    outside = e.filter("is_external").select(F.col("target").alias("name"), F.lit("external").alias("kind"), F.lit("").alias("parent")).distinct()
    return files.unionByName(folders).unionByName(outside)


# --- validators ---

FORBIDDEN, FORBIDDEN_TEXT = ["/es/**", "/fr/1*"], "worthless|loser"
ALLOWED, BLOCKED = ["/en/**", "/fr/**", "/de/*"], ["/en/1*", "/de/*.html"]
_FILE = "regexp_extract(url, '://[^/?#]*([^?#]*)', 1)"
_ANY = lambda col, globs, d="strict": "(" + " or ".join(f"regexp_matches({col}, {sql_string(glob_regex(g, d))})" for g in globs) + ")"


def _fits(col, globs: list[str], dialect: str = "strict"):
    out = F.lit(False)
    for g in globs:
        out = out | F.rlike(col, F.lit(glob_regex(g, dialect)))
    return out


@query(f"""with f as (select page_id, {_FILE} as file, html from pages)
select page_id, case when {_ANY('file', FORBIDDEN)} then 'forbidden_file' else 'forbidden_pattern' end as violation from f where {_ANY('file', FORBIDDEN)} or regexp_matches(html, '(?i){FORBIDDEN_TEXT}')""")
def constraint_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first constraint that a page breaks: a forbidden path, else a forbidden text."""
    d = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "://[^/?#]*([^?#]*)", 1).alias("file"), "html")
    v = F.when(_fits("file", FORBIDDEN), "forbidden_file").when(F.rlike("html", F.lit(f"(?i){FORBIDDEN_TEXT}")), "forbidden_pattern")
    return d.select("page_id", v.alias("violation")).filter("violation is not null")


@query(f"""with f as (select page_id % 10 as task, {_FILE} as file from pages), s as (select *, {_ANY('file', ALLOWED)} as expected, {_ANY('file', ['/es/*'])} as ignored from f)
select task, count(*) filter (where not ignored) as actual, count(*) filter (where not expected and not ignored) as extra, round(coalesce(count(*) filter (where not expected and not ignored) / nullif(count(*) filter (where not ignored), 0), 0), 6) as scope_creep from s group by task""")
def scope_creep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of a task that no expected glob fits, as a share of those that are not ignored."""
    d = table(spark, sf_dir, "pages").select((F.col("page_id") % 10).alias("task"), F.regexp_extract("url", "://[^/?#]*([^?#]*)", 1).alias("file"))
    d = d.withColumns({"expected": _fits("file", ALLOWED), "ignored": _fits("file", ["/es/*"])})
    extra, actual = F.count_if(~F.col("expected") & ~F.col("ignored")), F.count_if(~F.col("ignored"))
    return d.groupBy("task").agg(actual.alias("actual"), extra.alias("extra"), F.round(F.coalesce(F.try_divide(extra, actual), F.lit(0.0)), 6).alias("scope_creep"))


@query(f"with f as (select page_id, {_FILE} as file from pages) select page_id, not {_ANY('file', BLOCKED)} and {_ANY('file', ALLOWED)} as allowed from f")
def file_acl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocked globs win, then allowed ones; the rest is denied."""
    d = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "://[^/?#]*([^?#]*)", 1).alias("file"))
    return d.select("page_id", (~_fits("file", BLOCKED) & _fits("file", ALLOWED)).alias("allowed"))


# Address rules: first and last address of each as numbers.
CIDR = ["10.0.0.0/8", "192.168.4.0/22", "172.16.5.9/32"]


def cidr_range(rule: str) -> tuple[int, int]:
    base, _, bits = rule.partition("/")
    n = sum(int(p) << 8 * (3 - i) for i, p in enumerate(base.split(".")))
    size = 1 << (32 - int(bits or 32))
    first = n // size * size
    return first, first + size - 1


@query("""with a as (select user_id, [10, 192, 172][(user_id % 3 + 1)::int] as a, [0, 168, 16][(user_id % 3 + 1)::int] as b, user_id % 9 as c, user_id % 11 as d from (select distinct user_id from events)),
n as (select user_id, a || '.' || b || '.' || c || '.' || d as ip, ((a * 256 + b) * 256 + c) * 256 + d as n from a)
select user_id, ip, """ + " or ".join(f"n between {a} and {b}" for a, b in map(cidr_range, CIDR)) + " as allowed from n")  # fmt: skip
def ip_allowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = table(spark, sf_dir, "events").select("user_id").distinct()
    i = (F.col("user_id") % 3).cast("int")
    part = [F.get(F.array(F.lit(10), F.lit(192), F.lit(172)), i), F.get(F.array(F.lit(0), F.lit(168), F.lit(16)), i), F.col("user_id") % 9, F.col("user_id") % 11]
    d = u.withColumn("ip", F.concat_ws(".", *(p.cast("string") for p in part)))
    p = F.split("ip", r"\.")
    n = sum((F.get(p, F.lit(k)).cast("bigint") * (1 << 8 * (3 - k)) for k in range(4)), F.lit(0))
    ok = F.lit(False)
    for a, b in map(cidr_range, CIDR):
        ok = ok | n.between(a, b)
    return d.select("user_id", "ip", ok.alias("allowed"))
