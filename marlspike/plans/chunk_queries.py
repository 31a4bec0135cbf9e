"""Chunks, their records and contents, and content-addressed storage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlspike.functions.text import sql_string
from marlspike.operators import chunking as c
from marlspike.operators import sync
from marlspike.plans.registry import query
from marlspike.sources.tables import spread, table

# A source file for each part, as text and as a place: what the documents, being prose, do not hold.
LINES = [
    "import {{ util{z} }} from './f{more}'", "import React from 'react'", "", "// part {k}", "export function run{k}(x) {{", "  return new Worker{z}(x)", "}}", "",
    "export class Store{k} extends Base{z} {{", "  size = {z}", "  get(k) {{ return cache.read(k) }}", "}}", "const helper{k} = function () {{ return JSON.parse('1') }}",
    "export interface Shape{k} {{ area: number }}", "export type Base{base} = Id",
]
_HOLES = {"k": "p_partkey", "z": "p_size", "more": "p_partkey + 20", "base": "p_partkey % 40"}


def _filled(line: str) -> str:
    """A line with its holes filled from a row of part, in SQL of both engines."""
    out = sql_string(line.replace("{{", "\1").replace("}}", "\2"))
    for h, e in _HOLES.items():
        out = out.replace("{" + h + "}", f"' || cast({e} as varchar(20)) || '")
    return "(" + out.replace("\1", "{").replace("\2", "}") + ")"


_TEXT = " || chr(10) || ".join(map(_filled, LINES))
_PATH = "'src/m' || cast(p_partkey % 20 as varchar(20)) || '/f' || cast(p_partkey as varchar(20)) || case p_partkey % 3 when 0 then '.ts' when 1 then '.md' else '.py' end"
_SRC = f"src as (select p_partkey as doc_id, {_PATH} as path, {_TEXT} as text from part)"


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr("cast(p_partkey as bigint) as doc_id", f"{_PATH} as path", f"{_TEXT} as text")


_SIZE, _STEP = c.window_sizes(512, 50)
_FIXED = f"""l as (select doc_id, string_split(text, chr(10)) as l from documents),
w as (select doc_id, l, unnest(range(0, len(l), {_STEP})) as i from l),
chunk as (select doc_id, i + 1 as start_line, i + len(l[i + 1:i + {_SIZE}]) as end_line, array_to_string(l[i + 1:i + {_SIZE}], chr(10)) as content from w)"""


@query(f"with {_FIXED} select doc_id, start_line, end_line, sha256(content) as content_hash from chunk")
def fixed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = c.fixed_chunks(table(spark, sf_dir, "documents"))
    return d.select("doc_id", "start_line", "end_line", F.sha2("content", 256).alias("content_hash"))


@query("""with p as (select doc_id, string_split(text, chr(10) || chr(10)) as p from documents),
e as (select doc_id, unnest(range(0, len(p))) as ordinal, p from p)
select doc_id, ordinal, length(p[ordinal + 1]) as n_chars, md5(p[ordinal + 1]) as content_hash from e where length(trim(p[ordinal + 1])) > 0""")
def paragraph_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = c.paragraph_chunks(table(spark, sf_dir, "documents"))
    return d.select("doc_id", "ordinal", F.length("content").alias("n_chars"), F.md5("content").alias("content_hash"))


_TYPE = "case " + " ".join(f"when regexp_matches(ltrim(content), {sql_string(r)}) then '{k}'" for r, k in c.TYPES) + " else 'other' end"


@query(f"""with {_FIXED}, r as (select chunk.*, source || '/' || doc_id as file_path from chunk join documents using (doc_id))
select file_path, start_line, end_line, sha256(content) as hash, substr(sha256(file_path || ':' || start_line || ':' || end_line || ':' || content), 1, 16) as chunk_id,
  {_TYPE} as type, ceil(length(content) / 3)::bigint as tokens from r""")
def chunk_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    size, step = c.window_sizes(512, 50)
    # the windows of a document with its path beside them: no join back
    d = docs.select(F.concat_ws("/", "source", "doc_id").alias("doc_id"), "text")
    return c.chunk_records(c.fixed_chunks(d), F.col("doc_id")).drop("doc_id", "content")


_VISIBLE = lambda x: f"length(trim({x}, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) > 0"


@query(f"""with recursive s as (select doc_id, list_filter(string_split(coalesce(text, ''), chr(10) || chr(10)), lambda x: {_VISIBLE('x')}) as l from documents),
p as materialized (select doc_id, unnest(range(1, len(l) + 1)) as k, unnest(l) as p from s),
r(doc_id, k, g, held) as (
  select doc_id, k, 1, case when ceil(length(p) / 3) >= 307 then -1 else length(p) end from p where k = 1
  union all
  select p.doc_id, p.k,
    case when r.held >= 0 and ceil(length(p.p) / 3) < 307 and ceil(r.held / 3) + ceil(length(p.p) / 3) <= 512 then r.g else r.g + 1 end,
    case when ceil(length(p.p) / 3) >= 307 then -1 when r.held >= 0 and ceil(r.held / 3) + ceil(length(p.p) / 3) <= 512 then r.held + 2 + length(p.p) else length(p.p) end
  from r join p on p.doc_id = r.doc_id and p.k = r.k + 1)
select r.doc_id, g - 1 as ordinal, string_agg(p, chr(10) || chr(10) order by r.k) as content from r join p on p.doc_id = r.doc_id and p.k = r.k group by r.doc_id, g""")
def merge_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order-dependent fold for each document, in SQL by recursion over its paragraphs."""
    return c.merged_chunks(table(spark, sf_dir, "documents"))


_PARTS = lambda x, mark: f"list_filter(string_split({x}, {mark}), lambda x: {_VISIBLE('x')})"
_NL = "chr(10)"


@query(f"""with a as (select doc_id, unnest(range(len(l))) as i, unnest(l) as p from (select doc_id, {_PARTS("coalesce(text, '')", f"{_NL} || {_NL} || {_NL}")} as l from documents)),
b as (select doc_id, i, -1 as j, p from a where ceil(length(p) / 3) <= 512
  union all select doc_id, i, unnest(range(len(l))), unnest(l) from (select doc_id, i, {_PARTS('p', f"{_NL} || {_NL}")} as l from a where ceil(length(p) / 3) > 512)),
c as (select doc_id, i, j, -1 as k, p from b where j < 0 or ceil(length(p) / 3) <= 512
  union all select doc_id, i, j, unnest(range(len(l))), unnest(l) from (select doc_id, i, j, {_PARTS('p', _NL)} as l from b where j >= 0 and ceil(length(p) / 3) > 512))
select doc_id, row_number() over (partition by doc_id order by i, j, k) - 1 as ordinal, p as content from c""")
def recursive_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.recursive_chunks(table(spark, sf_dir, "documents"))


@query()
def code_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.code_chunks(table(spark, sf_dir, "documents"))


_CUT = lambda lines: " || chr(10) || ".join(_filled(LINES[i]) for i in lines)
_MEMBERS = [f"{_CUT([0, 1])} || chr(10) || chr(10) || {_CUT([4, 5, 6])}", _CUT([9]), f"{_CUT([8, 9])} || chr(10) || '  // ...' || chr(10) || {_CUT([10])}", " || chr(10) || chr(10) || ".join(_CUT([i]) for i in (12, 13, 14))]


@query(f"""select p_partkey as doc_id, 'code' as strategy, i as ordinal, [{', '.join(_MEMBERS)}][i + 1] as content from part, (select unnest(range(0, 4)) as i) where p_partkey % 3 = 0
union all select p_partkey, case p_partkey % 3 when 1 then 'recursive' else 'fixed' end, 0, {_TEXT} from part where p_partkey % 3 <> 0""")
def file_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files cut as their language asks; the SQL says what the lines of each file have to become."""
    return c.chunk_files(sources(spark, sf_dir)).withColumn("ordinal", F.col("ordinal").cast("bigint"))


# Shapes of source text that brackets alone would cut wrongly: lines, and the units (kind, name, exported, lines) that they are.
_FIELDS, _HEAD = ["  open: string = '{{'", "  static all = {{ k: {z} }}"], "export default class Pool{k}<T extends {{ id: {z} }}> extends Base {{"
SHAPES = [
    (["/** Reads {{ and {z}.", " */", "export async function load{k}(p: {{ q: number }} = {{}}): Promise<void> {{", "  return p.q / {z} / 2 // }}", "}}"], [("function", "load{k}", True, range(5))]),
    (["const re{k} = /[}}/]{{1,{z}}}/g"], [("variable", "re{k}", False, [0])]),
    (["const text{k} = `a ${{ f(`}}${{ '}}' }}`) }} {{`", "  + '{z}'"], [("variable", "text{k}", False, [0, 1])]),
    (["const make{k} = async (x) => {{", "  if (x) {{ return '}}' }} else {{ return {z} }}", "}}"], [("function", "make{k}", False, range(3))]),
    (["export type Kind{k} =", "  | 'open{{'", "  | {z}"], [("type", "Kind{k}", True, range(3))]),
    (["if (a{k} < {z}) {{", "  go('{{')", "}}", "else {{", "  stop(/}}/)", "}}"], [("other", "", False, range(6))]),
    ([_HEAD, *_FIELDS, "", "  // kept apart {{", "  /** Runs }}. */", "  async *run(a = {{}}) {{ yield `${{ a }}}}` }}", "  get size() {{ return {z} }}", "}}"],
     [("property", "Pool{k}.open", True, [1]), ("property", "Pool{k}.all", True, [2]), ("method", "Pool{k}.run", True, [0, 1, 2, None, 5, 6]), ("method", "Pool{k}.size", True, [0, 1, 2, None, 7])]),
    (["@Named('{{{z}')", "export class Bare{k} {{ }}"], [("class", "Bare{k}", True, [0, 1])]),
    (["/* one */ export interface Shape{k} {{ area: {{ of: number }} }}"], [("interface", "Shape{k}", True, [0])]),
    (["export {{ a{k} as b{z} }}", "export * from './x'"], [("other", "", True, [0]), ("other", "", True, [1])]),
]
BROUGHT = ["import a, {{ b{k} }} from './{{{z}'", "import {{", "  c", "}} from './y'"]
_N = len(SHAPES)
_JOINED = lambda lines: " || chr(10) || ".join(map(_filled, lines))
_SHAPE = f"[{', '.join(_JOINED(lines) for lines, _ in SHAPES)}]"
_PICKS = [f"(p_partkey * 7 + p_size * {j} + {j * j}) % {_N}" for j in range(5)]
_UNIT = lambda kind, name, exported, lines: f"{{'kind': '{kind}', 'name': {_filled(name)}, 'exported': {str(exported).lower()}, 'content': {_JOINED(lines)}}}"
_UNITS = ", ".join("[" + ", ".join(_UNIT(k, n, e, ["  // ..." if i is None else lines[i] for i in at]) for k, n, e, at in units) + "]" for lines, units in SHAPES)


@query(f"""with u as (select p_partkey as doc_id, [{_UNIT('module', '', False, BROUGHT)}] || flatten([{', '.join(f'[{_UNITS}][{p} + 1]' for p in _PICKS)}]) as u from part)
select doc_id, i as ordinal, u[i + 1].kind as kind, u[i + 1].name as name, u[i + 1].exported as exported, u[i + 1].content as content from (select doc_id, u, unnest(range(0, len(u))) as i from u)""")
def syntax_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five shapes of source text for each part, with brackets in strings, templates, patterns and comments; the SQL says what each shape is."""
    picked = " || chr(10) || chr(10) || ".join(f"element_at(shapes, cast({p} as int) + 1)" for p in _PICKS)
    parts = spread(table(spark, sf_dir, "part")).selectExpr("*", f"array{_SHAPE[0].replace('[', '(')}{_SHAPE[1:-1]}) as shapes")
    files = parts.selectExpr("cast(p_partkey as bigint) as doc_id", f"{_JOINED(BROUGHT)} || chr(10) || {picked} as text")
    return c.syntax_units(files).withColumn("ordinal", F.col("ordinal").cast("bigint"))


_SYM = ", ".join(f"{{'name': regexp_extract(t, {sql_string(r)}, 1), 'kind': '{k}'}}" for r, k in c.SYMBOLS)
_LINES = "ln as (select doc_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) as line, string_split(text, chr(10)) as l from src), tl as (select doc_id, line, trim(l[line]) as t from ln)"


@query(f"""with {_SRC}, {_LINES}, x as (select doc_id, line, starts_with(t, 'export') as exported, unnest([{_SYM}]) as s from tl)
select doc_id, line, s.name as name, s.kind as kind, exported from x where s.name <> ''""")
def symbol_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.symbols(sources(spark, sf_dir)).withColumn("line", F.col("line").cast("bigint"))


@query(f"""with {_SRC} select doc_id, array_to_string(regexp_extract_all(text, {sql_string(c.IMPORT)}, 1), ',') as imports,
  array_to_string(regexp_extract_all(text, {sql_string(c.EXPORT)}, 1), ',') as exports from src""")
def import_export_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources(spark, sf_dir).select("doc_id", F.array_join(c.imports(F.col("text")), ",").alias("imports"), F.array_join(c.exports(F.col("text")), ",").alias("exports"))


# Names that are never taken for symbols of the code itself.
BUILT_IN = """Array Object String Number Boolean Function Symbol Map Set WeakMap WeakSet Promise Date RegExp Error JSON Math console
setTimeout setInterval clearTimeout clearInterval parseInt parseFloat isNaN isFinite this super null undefined true false process
Buffer global require module exports __dirname __filename any unknown never void""".split()
# How a name is used.
USES = [r"new\s+(\w+)\s*\(", r"extends\s+(\w+)", r"implements\s+(\w+)", r":\s*(\w+)(?:\s*[,;)\]=])", r"(\w+)\s*\.\s*\w+\s*\("]
_USES = " || ".join(f"regexp_extract_all(t, {sql_string(r)}, 1)" for r in USES)


@query(f"""with {_SRC}, {_LINES}, used as (select distinct doc_id, line, unnest({_USES}) as name from tl),
known as (select unnest(regexp_extract_all(text, {sql_string(c.EXPORT)}, 1)) as name from src
  union select s.name from (select unnest([{_SYM}]) as s from tl) where s.name <> '')
select doc_id, line, name from used where name not in ({', '.join(map(sql_string, BUILT_IN))}) and name not in (select name from known)""")
def verify_missing_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Used names that no source defines or exports."""
    src = sources(spark, sf_dir)
    lines = src.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("i", "l")).select("doc_id", (F.col("i") + 1).cast("bigint").alias("line"), F.trim("l").alias("t"))
    used = lines.select("doc_id", "line", F.explode(F.concat(*(F.regexp_extract_all("t", F.lit(r), F.lit(1)) for r in USES))).alias("name")).distinct()
    known = src.select(F.explode(c.exports(F.col("text"))).alias("name")).union(c.symbols(src).select("name")).distinct()
    return used.filter(~F.col("name").isin(BUILT_IN)).join(known, "name", "left_anti").select("doc_id", "line", "name")


@query("""with stored as (select doc_id, sha256(case when doc_id % 10 = 3 then text || 'x' else text end) as h from documents where doc_id % 7 <> 0)
select d.doc_id, case when s.doc_id is null then 'new' else 'changed' end as status from documents d left join stored s using (doc_id) where s.h is null or s.h <> sha256(d.text)""")
def incremental_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files whose content hash is not the stored one; the stored table is derived: some ids missing, some texts other."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), "text", "doc_id")
    other = F.when(F.col("doc_id") % 10 == 3, F.concat("text", F.lit("x"))).otherwise(F.col("text"))
    stored = docs.filter("doc_id % 7 <> 0").select("path", F.sha2(other, 256).alias("hash"))
    return sync.changed_files(docs, stored).select(F.col("path").cast("bigint").alias("doc_id"), "status")


_BLOCKS = """b as (select doc_id, octet_length(encode(text)) as n, encode(text) as raw from documents)"""


@query("""with p as (select unnest(range(0, greatest(1, ceil(length(text) / 512)::bigint))) as i, text from documents),
k as (select sha256(substr(text, i * 512 + 1, 512)) as h, length(substr(text, i * 512 + 1, 512)) as size from p)
select count(*) as n_chunks, count(distinct h) as n_distinct, sum(size)::bigint as total_size, (select sum(size)::bigint from (select h, any_value(size) as size from k group by h)) as stored_size from k""")
def chunk_dedup_savings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What content-addressed storage of 512-character blocks saves."""
    return sync.dedup_savings(sync.text_blocks(table(spark, sf_dir, "documents"), 512))


@query("""select doc_id, sha256(text) as file_hash, strlen(text) as size, contains(text[1:8192], chr(0)) as is_binary, greatest(1, ceil(strlen(text) / 4096)::bigint) as n_blocks from documents""")
def binary_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = sync.manifest(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.col("text").cast("binary").alias("content")), 4096)
    return m.select(F.col("path").alias("doc_id"), "file_hash", "size", "is_binary", F.size("blocks").cast("bigint").alias("n_blocks"))
