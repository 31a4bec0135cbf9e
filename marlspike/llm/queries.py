"""The training-data operators as queries ``(spark, sf_dir) -> DataFrame``, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlspike.llm import language_id, lattice_lm, piece_encoding
from marlspike.llm.common import table
from marlspike.llm.conversations import damage, repair_conversations
from marlspike.llm.jaccard_join import near_duplicates
from marlspike.llm.line_dedup import dedup_lines
from marlspike.llm.packing import pack_documents
from marlspike.llm.quality_rules import GRID, MEASURES, RARITIES, judge_quality
from marlspike.llm.secrets import KINDS, find_secrets
from marlspike.llm.source_audit import divergence
from marlspike.llm.token_counts import token_counts
from marlspike.llm.url_filters import Rule, judge_urls, tracking_hosts
from marlspike.llm.vector_dedup import near_duplicate_vectors
from marlspike.sources.tables import spread


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A network fitted on documents that are not held out, applied to all."""
    docs = spread(table(spark, sf_dir, "documents"))
    net = language_id.learn(docs.filter(~language_id.held_out(F.col("doc_id"))))
    out = language_id.predict(docs, net)
    return out.select("doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The histogram of byte-level BPE lengths of all documents, with its suffix sums."""
    return token_counts(spread(table(spark, sf_dir, "documents")))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four-word shingles, links from 85 hundredths on."""
    return near_duplicates(spread(table(spark, sf_dir, "documents")), k=4, similarity=85)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of at least one code point in at least ten documents go."""
    out = dedup_lines(table(spark, sf_dir, "documents"), min_docs=10, min_chars=1)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op5_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of cosine 0.9 and more among all embeddings."""
    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"), threshold=0.9).rows


def op6_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the fixed patterns and all spans."""
    found = find_secrets(spread(table(spark, sf_dir, "documents")))
    of = lambda *kinds: F.filter("spans", lambda s: s["kind"].isin(*kinds))
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    counts = [F.size(of(k)).cast("bigint").alias(f"n_{k}") for k in KINDS[:3]]
    return found.select("doc_id", *counts, F.sha2(text(of(*KINDS[:3])), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and the verdict; the rarity and its stratum's cutoff, with the held-out good documents and how many of them it rejects."""
    out = judge_quality(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels"))
    more = ["rarity", "cutoff", "n_held", "n_false", F.array_join("failed", ",").alias("failed")]
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", *more)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens."""
    return pack_documents(spread(table(spark, sf_dir, "documents")))


#: Fixed rules of the query.
RULES = [
    Rule("block", "com", "/en/"),
    Rule("allow", "example.com", "/en/7"),
    Rule("allow", "net", "/de/"),
    Rule("block", "example.net", "/de/8"),
    Rule("block", "org", "/es/"),
]


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fixed rules, then hosts with many tracking links."""
    pages = table(spark, sf_dir, "pages")
    return judge_urls(pages, RULES, tracking_hosts(pages))


def op10_piece_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merge-dropout of a tenth; what the ids decode to is held against the text."""
    encoded = piece_encoding.encode(spread(table(spark, sf_dir, "documents")), dropout=0.1, seed=1)
    out = piece_encoding.decode(encoded)
    ids = [(F.length("ids") / 4).cast("bigint").alias("n_ids"), F.crc32("ids").alias("ids_crc32")]
    return out.select("doc_id", *ids, (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("lossless"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances between the sources of each language, and the terms that set a source apart."""
    return divergence(spread(table(spark, sf_dir, "documents")), min_docs=10, top=10)


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations with faults put in, and the cheapest edits that repair them."""
    return repair_conversations(damage(table(spark, sf_dir, "conversations"))).audits


def op13_lattice_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probabilities of all texts by words and by pieces, learned from those that are not held out."""
    docs = spread(table(spark, sf_dir, "documents"))
    out = lattice_lm.score_texts(docs, docs.filter(lattice_lm.learned(F.col("doc_id"))))
    return out.withColumn("held_out", ~lattice_lm.learned(F.col("doc_id")))


def queries() -> dict:
    return {
        f.__name__: f
        for f in (
            op1_language_id,
            op2_token_counts,
            op3_ngram_jaccard_join,
            op4_line_dedup,
            op5_vector_dedup,
            op6_secret_scans,
            op7_quality_rules,
            op8_best_fit_packing,
            op9_url_filters,
            op10_piece_encoding,
            op11_source_divergence,
            op12_conversation_repair,
            op13_lattice_scoring,
        )
    }


_OP4 = """
with lines as (
  select doc_id, pos, string_split(coalesce(text, ''), chr(10))[pos] as line
  from (select doc_id, text, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) as pos from documents)
),
keyed as (
  select *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k
  from lines
),
common as (select k from keyed where k <> '' group by k having count(distinct doc_id) >= 10)
select doc_id, count(*) as n_lines, count(*) filter (where k in (select k from common)) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where k not in (select k from common)), '')) as kept_sha256
from keyed group by doc_id
"""


_OP9 = """
with cut as (
  select page_id, url, case when contains(url, '://') then substr(url, instr(url, '://') + 3) else '' end as rest from pages
),
parts as (
  select page_id, url, translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) as path
  from cut
),
listed as (
  select host from parts where url is not null and host <> '' group by host
  having 100 * count(*) filter (where contains(url, 'utm_')) >= 25 * count(*)
),
rules(verdict, rhost, rpath) as (values ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'),
  ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
found as (
  select p.page_id, p.host, p.path, arg_max(r.rhost || r.rpath, length(r.rhost || r.rpath)) as rule,
         arg_max(r.verdict, length(r.rhost || r.rpath)) as verdict
  from parts p left join rules r
    on (p.host = r.rhost or ends_with(p.host, '.' || r.rhost)) and starts_with(p.path, r.rpath)
  group by p.page_id, p.host, p.path
)
select page_id, host, path, rule,
       coalesce(verdict, case when host in (select host from listed) then 'block' else 'allow' end) as verdict
from found
"""


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

_OP3 = f"""
with recursive w as (select doc_id, {_WORDS.format(_LOWER.format("coalesce(text, '')"))} as w from documents),
g as (
  select distinct doc_id, array_to_string(w[i:i + 3], ' ') as g
  from (select doc_id, w, unnest(range(1, greatest(2, len(w) - 2))) as i from w where len(w) > 0)
),
n as (select doc_id, count(*) as n from g group by doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as c from g a join g b on a.g = b.g and a.doc_id < b.doc_id group by all),
e as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 85 * (x.n + y.n - c)),
e2 as (select a, b from e union all select b, a from e),
r(node, comp) as (select doc_id, doc_id from documents union select e2.b, r.comp from r join e2 on e2.a = r.node)
select d.doc_id, coalesce(n.n, 0) as n_shingles, c.component_id
from documents d left join n using (doc_id) join (select node, min(comp) as component_id from r group by node) c on c.node = d.doc_id
"""

_OP5 = """
with recursive v as (
  select vec_id, list_transform(embedding, lambda x: x::double) as e from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0
),
u as (select vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) as n from v),
e as (
  select a.vec_id as a, b.vec_id as b from u a join u b on a.vec_id <> b.vec_id
  where list_sum(list_transform(list_zip(a.e, b.e), lambda x: x[1] * x[2])) / (a.n * b.n) >= 0.9
),
r(node, comp) as (select vec_id, vec_id from embeddings union select e.b, r.comp from r join e on e.a = r.node),
l as (select a as vec_id, count(*) as n_links from e group by a)
select c.vec_id, coalesce(n_links, 0) as n_links, component_id, c.vec_id = component_id as kept
from (select node as vec_id, min(comp) as component_id from r group by node) c left join l using (vec_id)
"""

_MEASURES_SQL = {
    "symbol_share": "coalesce(1000 * n_symbols / nullif(word_chars, 0), 0)",
    "dup_line_share": "coalesce(1000 * n_dup_lines / nullif(n_lines, 0), 0)",
    "repeat_share": "coalesce(1000 * n_repeat_words / nullif(n_words, 0), 0)",
    "long_words": "coalesce(1000 * word_chars / nullif(n_words, 0) / 20, 0)",
    "short_words": "coalesce(1000 - 1000 * word_chars / nullif(n_words, 0) / 20, 0)",
}
_STEPS = ", ".join(f"len(list_filter({GRID}, lambda c: c <= {e}))" for e in _MEASURES_SQL.values())
_NAMES = "[" + ", ".join(f"'{m}'" for m in MEASURES) + "]"
_OP7 = rf"""
with t as (select doc_id, coalesce(lang, '') as stratum, coalesce(text, '') as text from documents),
w as (select doc_id, stratum, text, {_WORDS.format("text")} as w, string_split(text, chr(10)) as l from t),
g as (select doc_id, i, w[i:i + 2] as g from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from w)),
again as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, g) as c from g) where c > 1),
covered as (select doc_id, count(distinct j) as n from (select doc_id, unnest([i, i + 1, i + 2]) as j from again) group by doc_id),
lines as (select doc_id, line, count(*) as c from (select doc_id, unnest(l) as line from w) where regexp_matches(line, '[^\x20\x09-\x0D]') group by all),
dup as (select doc_id, sum(c - 1)::bigint as n from lines group by doc_id),
b as (
  select doc_id, stratum, len(w) as n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint as word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]')) as n_symbols, coalesce(dup.n, 0) as n_dup_lines, coalesce(covered.n, 0) as n_repeat_words, len(l) as n_lines
  from w left join dup using (doc_id) left join covered using (doc_id)
),
m as (select *, [{_STEPS}] as steps from b),
q as (
  select doc_id, case when max(quality) = 0 then 'bad' when substr(md5(doc_id::varchar), 1, 1) < '8' then 'fit' else 'held' end as part
  from labels where quality in (0, 1) group by doc_id
),
known as (select m.stratum, m.steps, q.part from m join q using (doc_id)),
fit as (select i as measure, steps[i] as step from known, (select unnest(range(1, {len(MEASURES) + 1})) as i) where part = 'fit'),
share as (
  select measure, k, floor(count(*) filter (where step >= k) * 1000000 / count(*))::bigint as share
  from fit, (select unnest(range(0, {len(GRID) + 1})) as k) group by all
),
shared as (select list(share order by measure) as shares from (select measure, list(share order by k) as share from share group by all)),
rare as (
  select stratum, part, list_min(list_transform(range(1, {len(MEASURES) + 1}), lambda i: shares[i][steps[i] + 1])) as rarity
  from known, shared where part <> 'fit'
),
tried as (
  select stratum, cutoff, count(*) filter (where part = 'held') as n_held, count(*) filter (where part = 'held' and rarity <= cutoff) as n_false,
    count(*) filter (where part = 'bad' and rarity <= cutoff) as n_bad
  from rare, (select unnest({RARITIES}) as cutoff) group by all
),
testable as (select * from tried where n_held * ln(0.95) <= ln(0.05)),
tested as (
  select *, n_false < n_held * 0.05 and list_sum(list_transform(range(0, n_false + 1), lambda j: exp(lgamma(n_held + 1) - (case when j = 0 then 0 else lgamma(j + 1) end) - lgamma(n_held - j + 1) + j * ln(0.05) + (n_held - j) * ln(0.95))))
    <= 0.05 / (select count(distinct stratum) from testable) as ok from testable
),
head as (select *, sum(case when ok then 0 else 1 end) over (partition by stratum order by cutoff) as failed from tested),
best as (select stratum, arg_min(struct_pack(cutoff := cutoff, n_held := n_held, n_false := n_false), struct_pack(a := -n_bad, b := cutoff)) as c from head where failed = 0 group by stratum),
v as (
  select m.*, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed, c.cutoff as cutoff, c.n_held as n_held, c.n_false as n_false,
    list_transform(range(1, {len(MEASURES) + 1}), lambda i: shares[i][steps[i] + 1]) as share
  from (select * from m, shared) m left join best using (stratum)
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, list_min(share) as rarity, cutoff, n_held, n_false,
  not base_failed and not coalesce(list_min(share) <= cutoff, false) as kept,
  coalesce(array_to_string(list_transform(list_filter(range(1, {len(MEASURES) + 1}), lambda i: share[i] <= cutoff), lambda i: ({_NAMES})[i]), ','), '') as failed
from v
"""


_OP11 = rf"""
with d as (
  select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source, {_LOWER.format("coalesce(text, '')")} as t from documents
),
w as (select r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from d),
kept as (select lang, term, count(*) as total from w group by all having count(distinct r) >= 10),
c as (select lang, source, term, count(*) as n from w semi join kept using (lang, term) group by all),
sizes as (select lang, count(*) as v, sum(total) as m from kept group by lang),
g as (
  select lang, source, coalesce(c.n, 0) as n, coalesce(v, 0) as v, m
  from (select distinct lang, source from d) left join (select lang, source, sum(n) as n from c group by all) c using (lang, source) left join sizes using (lang)
),
s as (
  select g.lang, g.source, k.term, coalesce(c.n, 0) as n,
    1 + (1000000000::hugeint * (coalesce(c.n, 0) + 2)) // (g.n + 2 * g.v)::hugeint as p,
    1 + (1000000000::hugeint * (k.total + 2)) // (g.m + 2 * g.v)::hugeint as q
  from g join kept k using (lang) left join c on c.lang = g.lang and c.source = g.source and c.term = k.term
),
far as (
  select a.lang, a.source, b.source as item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) as value
  from s a join s b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all
),
pairs as (
  select a.lang, a.source, 'pair' as part, b.source as item, coalesce(f.value, 0)::bigint as value
  from g a join g b on a.lang = b.lang and a.source <> b.source
  left join far f on f.lang = a.lang and f.source = a.source and f.item = b.source
),
items as (select lang, source, 'term' as part, term as item, (((p - q) * (p - q)) // (p + q))::bigint as value from s where n > 0 and p > q)
select lang, source, part, item, value, row_number() over (partition by lang, source order by value desc, item)::integer as rank from pairs
union all
select * from (select *, row_number() over (partition by lang, source order by value desc, item)::integer as rank from items) where rank <= 10
"""


def _op12() -> str:
    """Forward over the rows of all conversations at once: for each state the cheapest edits so far as text, nine digits of cost before the audit."""
    add = lambda x, cost, letters: f"printf('%09d', {x}[:9]::bigint + {cost}) || {x}[10:] || '{letters}'"
    entered = {
        "e0": "s0",
        "e1": "s1",
        "e2": f"least(s2, {add('s0', 3, 'I')}, {add('s1', 3, 'I')}, {add('s3', 3, 'I')})",
        "e3": f"least(s3, {add('s2', 3, 'I')}, {add('s0', 6, 'II')}, {add('s1', 6, 'II')})",
    }
    closed = ", ".join(f"{e} as {k}" for k, e in entered.items())
    cut = "(case when fault = 'truncated' then 3 else 0 end)"
    alive = lambda when, x: f"case when fault not in ('blank', 'duplicate') and {when} then {x} end"
    keep = lambda initial, *states: [alive(f"initial = '{initial}'", add(e, cut, "K")) for e in states]
    give = lambda *states: [alive("true", add(e, f"3 + {cut}", "R")) for e in states]
    ways = {
        "s0": [add("e0", 4, "D")],
        "s1": [add("e1", 4, "D"), *keep("s", "e0")],
        "s2": [add("e2", 4, "D"), *keep("u", "e0", "e1", "e3"), *give("e0", "e1", "e3")],
        "s3": [add("e3", 4, "D"), *keep("a", "e2"), *give("e2")],
    }
    return f"""
with recursive src as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as k from conversations
),
drawn as (
  select *, xor(4294967295, list_reduce(list_prepend(4294967295::bigint, flatten(list_transform(range(1, length(k) + 1), lambda i: [ord(k[i])::bigint, 0, 0, 0, 0, 0, 0, 0]))),
    lambda c, x: xor(xor(c, x) >> 1, 3988292384 * (xor(c, x) & 1)))) % 20 as draw from src
),
damaged as (
  select conv_id, turn, case when draw = 4 then 'user' else role end as role,
    case when draw = 1 then '' when draw = 2 then translate(text, '.!?', '') else text end as text, unnest(range(case when draw = 3 then 2 else 1 end)) as copy
  from drawn where draw <> 0
),
placed as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, text, copy) as i,
    substr(role, 1, 1) as initial, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as body from damaged
),
judged as (
  select *, case when body = '' then 'blank' when row_number() over (partition by conv_id, role, text order by i) > 1 then 'duplicate'
      when right(body, 1) not in ('.', '!', '?') then 'truncated' else '' end as fault,
    coalesce(lag(initial) over (partition by conv_id order by i) || initial not in ('su', 'ua', 'au'), false) as illegal from placed
),
facts as (
  select conv_id, count(*) as n, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (where fault = 'blank') as blank,
    count(*) filter (where fault = 'duplicate') as duplicate, count(*) filter (where fault = 'truncated') as truncated, count(*) filter (where illegal) as illegal
  from judged group by conv_id
),
dp(conv_id, i, s0, s1, s2, s3) as (
  select conv_id, 0::bigint, '000000000', null::varchar, null::varchar, null::varchar from facts
  union all
  select conv_id, i, {", ".join(f"least({', '.join(v)})" for v in ways.values())}
  from (select d.conv_id, j.i, j.initial, j.fault, {closed} from dp d join judged j on j.conv_id is not distinct from d.conv_id and j.i = d.i + 1)
),
done as (
  select conv_id, least(e0, e3) as best from (select d.conv_id, {closed} from dp d join facts f on f.conv_id is not distinct from d.conv_id and f.n = d.i)
),
letters as (select conv_id, pos, best[9 + pos] as a, best from (select *, unnest(range(1, length(best) - 8)) as pos from done)),
read as (select *, count(*) filter (where a <> 'I') over (partition by conv_id order by pos) as i from letters),
met as (
  select l.conv_id, l.pos, l.a, j.role, j.text, row_number() over (partition by l.conv_id order by l.pos) as made, first_value(l.a = 'K' and j.initial = 's') over (partition by l.conv_id order by l.pos) as system
  from read l left join judged j on j.conv_id is not distinct from l.conv_id and j.i = l.i and l.a <> 'I' where l.a <> 'D'
),
repaired as (
  select conv_id, string_agg(case when a = 'K' then role when (made - system::int) % 2 = 1 then 'user' else 'assistant' end || ':' || case when a = 'I' then '' else text end, chr(10) order by pos) as text
  from met group by conv_id
)
select c.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal,
  coalesce(best[:9]::bigint, 0) as cost, coalesce(best[10:], '') as audit, sha256(coalesce(r.text, '')) as repaired_sha256
from (select distinct conv_id from conversations) c left join facts f on f.conv_id is not distinct from c.conv_id
left join done d on d.conv_id is not distinct from c.conv_id left join repaired r on r.conv_id is not distinct from c.conv_id
"""


def oracle_sql() -> dict[str, str]:
    """SQL of the operators that SQL can express; tokenizers, models and guess costs it cannot."""
    return {
        "op3_ngram_jaccard_join": _OP3,
        "op4_line_dedup": _OP4,
        "op5_vector_dedup": _OP5,
        "op7_quality_rules": _OP7,
        "op9_url_filters": _OP9,
        "op11_source_divergence": _OP11,
        "op12_conversation_repair": _op12(),
    }
