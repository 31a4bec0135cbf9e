"""Evaluation statistics over labelled documents, events and neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marlspike.functions.stats import ERF_A, ERF_P, mcnemar as mcnemar_test
from marlspike.functions.stats import t_critical_sql, wilson
from marlspike.functions.text import ASCII_EDGE
from marlspike.operators import evalstats, vector
from marlspike.plans.registry import query
from marlspike.sources.tables import table

#: The rule whose detections are judged, and a second one it is paired with.
RULE = r"(?i)\b(worthless|loser|disgusting|idiot|pathetic|stupid)\b"
OTHER = r"(?i)\b(worthless|loser)\b"

_R = f"""r as (select d.doc_id, coalesce(d.lang, 'unknown') as category,
    case when d.n_chars < 1000 then 'easy' when d.n_chars < 4000 then 'medium' else 'hard' end as difficulty,
    l.toxic = 1 as expected, regexp_matches(d.text, '{RULE}') as detected, regexp_matches(d.text, '{OTHER}') as other,
    least(1, len(regexp_extract_all(d.text, '{RULE}')) / 5) as score
  from labels l join documents d using (doc_id)),
o as (select *, case when expected and detected then 'TP' when expected then 'FN' when detected then 'FP' else 'TN' end as outcome from r)"""
_COUNTS = """count(*) filter (where outcome = 'TP') as tp, count(*) filter (where outcome = 'FP') as fp, count(*) filter (where outcome = 'TN') as tn,
  count(*) filter (where outcome = 'FN') as fn, count(*) as n, round(avg(score), 6) as avg_score"""


def _rates(source: str, default: int = 1) -> str:
    return f"""x as (select *, coalesce(tp / nullif(tp + fn, 0), {default}) as dr, coalesce(fp / nullif(fp + tn, 0), 0) as fpr, coalesce(tp / nullif(tp + fp, 0), 1) as pr from {source}),
  y as (select *, coalesce(2 * pr * dr / nullif(pr + dr, 0), 0) as f from x)"""


_OUT = "tp, fp, tn, fn, n, avg_score, round(dr, 6) as detection_rate, round(fpr, 6) as false_positive_rate, round(pr, 6) as precision, round(f, 6) as f1"


def _wilson(s: str, n: str, sign: str) -> str:
    return f"round(case when {n} = 0 then 0 else (({s} / {n} + 3.8416 / (2 * {n})) {sign} 1.96 * sqrt(({s} / {n} * (1 - {s} / {n}) + 3.8416 / (4 * {n})) / {n})) / (1 + 3.8416 / {n}) end, 6)"


_BOUNDS = f"""greatest(0, {_wilson('tp', '(tp + fn)', '-')}) as dr_lower, least(1, {_wilson('tp', '(tp + fn)', '+')}) as dr_upper,
  greatest(0, {_wilson('fp', '(fp + tn)', '-')}) as fpr_lower, least(1, {_wilson('fp', '(fp + tn)', '+')}) as fpr_upper"""


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id")
    tier = F.when(F.col("n_chars") < 1000, "easy").when(F.col("n_chars") < 4000, "medium").otherwise("hard")
    rule, other = (r.replace(r"\b", ASCII_EDGE) for r in (RULE, OTHER))
    d = d.select(
        "doc_id", F.coalesce("lang", F.lit("unknown")).alias("category"), tier.alias("difficulty"), (F.col("toxic") == 1).alias("expected"),
        F.rlike("text", F.lit(rule)).alias("detected"), F.rlike("text", F.lit(other)).alias("other"),
        F.least(F.lit(1.0), F.regexp_count("text", F.lit(rule)) / 5).alias("score"),
    )
    return d.withColumn("outcome", evalstats.outcome(F.col("expected"), F.col("detected")))


def _rounded(d: DataFrame) -> DataFrame:
    return d.withColumns({c: F.round(c, 6) for c, t in d.dtypes if t == "double"})


@query(f"with {_R}, c as (select {_COUNTS} from o), {_rates('c')} select {_OUT}, {_BOUNDS} from y")
def headline_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(evalstats.intervals(evalstats.rates(judged(spark, sf_dir))))


@query(f"with {_R}, c as (select category, {_COUNTS} from o group by category), {_rates('c')} select category, {_OUT} from y")
def category_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(evalstats.rates(judged(spark, sf_dir), "category"))


@query(f"with {_R}, c as (select difficulty, {_COUNTS} from o group by difficulty), {_rates('c')} select difficulty, {_OUT} from y")
def difficulty_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(evalstats.rates(judged(spark, sf_dir), "difficulty"))


@query(f"""with {_R}, l as (select 'rule' as layer, detected = expected as ok from o union all select 'short_rule', other = expected from o union all select 'score', (score >= 0.2) = expected from o)
select layer, count(*) as n, count(*) filter (where ok) as passed, round(count(*) filter (where ok) / count(*), 6) as pass_rate from l group by layer""")
def layer_pass_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = judged(spark, sf_dir)
    layers = F.array(*(F.struct(F.lit(n).alias("layer"), (v == F.col("expected")).alias("ok")) for n, v in (("rule", F.col("detected")), ("short_rule", F.col("other")), ("score", F.round("score", 9) >= 0.2))))
    e = d.select(F.explode(layers).alias("x")).select("x.*")
    return e.groupBy("layer").agg(F.count("*").alias("n"), F.count_if("ok").alias("passed"), F.round(F.count_if("ok") / F.count("*"), 6).alias("pass_rate"))


@query(f"""with {_R}, c as (select category, count(*) as n, count(*) filter (where detected) as k from o group by category)
select category, n, k, round(k / n, 6) as point, greatest(0, {_wilson('k', 'n', '-')}) as lower, least(1, {_wilson('k', 'n', '+')}) as upper from c""")
def wilson_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = judged(spark, sf_dir).groupBy("category").agg(F.count("*").alias("n"), F.count_if("detected").alias("k"))
    p, low, high = wilson(F.col("k"), F.col("n"))
    return _rounded(d.withColumns({"point": p, "lower": low, "upper": high}))


_ERF = " + ".join(f"{a} * pow(t, {i + 1})" for i, a in enumerate(ERF_A))


@query(f"""with {_R}, m as (select count(*) filter (where expected <> detected and expected = other) as b, count(*) filter (where expected = detected and expected <> other) as c from o),
s as (select b, c, case when b + c = 0 then 0 else pow(abs(b - c) - 1, 2) / (b + c) end as chi2 from m),
t as (select *, 1 / (1 + {ERF_P} * sqrt(chi2 / 2)) as t from s)
select b, c, round(chi2, 6) as chi2, round(case when chi2 <= 0 then 1 else 1 - (1 - ({_ERF}) * exp(-chi2 / 2)) end, 6) as p_value from t""")
def mcnemar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rules on the same documents: does one err where the other does not?"""
    d = judged(spark, sf_dir)
    right, other = F.col("expected") == F.col("detected"), F.col("expected") == F.col("other")
    m = d.agg(F.count_if(~right & other).alias("b"), F.count_if(right & ~other).alias("c"))
    chi2, p = mcnemar_test(F.col("b"), F.col("c"))
    return _rounded(m.withColumns({"chi2": chi2, "p_value": p}))


@query("""with t as (select user_id, event_type <> 'error' as passed from events), g as (select user_id, count(*) as n, count(*) filter (where passed) as c from t group by user_id)
select user_id, n, c, round(case when c >= n then 1 when 5 > n then case when c > 0 then 1 else 0 end when n - c - 4 <= 0 then 1
  else 1 - exp(list_sum(list_transform(range(0, 5), lambda i: ln(greatest(n - c - i, 1)) - ln(n - i)))) end, 6)::double as pass_at_k, round(pow(c / n, 5), 6) as pass_hat_k from g""")
def pass_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "events").select("user_id", (F.col("event_type") != "error").alias("passed"))
    return _rounded(evalstats.pass_rates(t, "user_id", 5))


@query("select event_type, quantile_disc(value, 0.5) as p50, quantile_disc(value, 0.95) as p95, quantile_disc(value, 0.99) as p99 from events group by event_type")
def percentiles_nearest_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evalstats.percentiles(table(spark, sf_dir, "events"), "event_type", "value")


@query(f"""with v as (select floor(sqrt(event_id))::bigint as run, case when event_type = 'error' then 0.0 else 1.0 end::double as ok from events),
s as (select run, count(*) as n, avg(ok) as mean, coalesce(stddev_samp(ok), 0) as std, quantile_cont(ok, 0.5) as median, min(ok) as min, max(ok) as max from v group by run)
select run, n, round(mean, 6) as mean, round(std, 6) as std, median, min, max,
  round(greatest(0, mean - case when n >= 30 then 1.96 else {t_critical_sql('(n - 1)')} end * std / sqrt(n)), 6) as ci_lower,
  round(least(1, mean + case when n >= 30 then 1.96 else {t_critical_sql('(n - 1)')} end * std / sqrt(n)), 6) as ci_upper from s""")
def aggregate_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of one, three, five events and so on: all of them, and the short ones need the table of critical values."""
    e = table(spark, sf_dir, "events")
    v = e.select(F.floor(F.sqrt("event_id")).cast("bigint").alias("run"), F.when(F.col("event_type") == "error", 0.0).otherwise(1.0).alias("ok"))
    return _rounded(evalstats.run_stats(v, "run", "ok"))


@query()
def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hash-seeded, so it repeats; no SQL twin, as hashes differ between engines."""
    d = judged(spark, sf_dir).select("category", F.col("doc_id").alias("id"), F.col("detected").cast("double").alias("x"))
    return evalstats.bootstrap(d, "category", "x")


@query(f"""with {_R}, c as (select category, {_COUNTS} from o group by category)
select category, round(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) as point, true as ordered from c""")
def bootstrap_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1 by category, and whether its bounds enclose it; bounds come from hashes, so the tests hold them against plain resampling."""
    one = lambda c: F.when(c, 1).otherwise(0)
    hit, bad = F.col("detected"), F.col("expected")
    sums = {"tp": one(hit & bad), "fp": one(hit & ~bad), "fn": one(~hit & bad)}
    f1 = lambda tp, fp, fn: F.try_divide(2 * tp, 2 * tp + fp + fn)
    d = evalstats.bootstrap_metric(judged(spark, sf_dir).withColumn("id", F.col("doc_id")), "category", sums, f1)
    return d.select("category", F.round("point", 6).alias("point"), ((F.col("lower") <= F.col("point")) & (F.col("point") <= F.col("upper"))).alias("ordered"))


_DOT = "list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda x: x[1]::double * x[2]::double))"
_NORM = lambda v: f"sqrt(list_sum(list_transform({v}.embedding, lambda x: x::double * x::double)))"
_QUALITY = f"""s as (select a.vec_id as query_id, b.vec_id as item, b.label = a.label as rel, round({_DOT} / ({_NORM('a')} * {_NORM('b')}), 9) as score
    from embeddings a join embeddings b on a.vec_id <> b.vec_id where a.vec_id % 50 = 0),
  k as (select *, row_number() over (partition by query_id order by score desc, item) as place from s),
  t as (select query_id, count(*) as returned, count(*) filter (where rel) as found, min(place) filter (where rel) as first from k where place <= 5 group by query_id),
  w as (select query_id, count(*) filter (where rel) as wanted from s group by query_id having count(*) filter (where rel) > 0),
  q as (select w.query_id, found / returned as precision, found / wanted as recall, coalesce(1 / first, 0) as mrr, found > 0 as hit from w join t using (query_id))"""


def _quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    block = v.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    near = vector.knn(v, block, 6).filter("vec_id <> query_id").select("query_id", F.col("vec_id").alias("item"), "rank")
    # an item is relevant if it has the query's label: the few found are marked, and the others counted by label
    a = v.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("label").alias("asked"))
    found = near.join(v.select(F.col("vec_id").alias("item"), "label"), "item").join(a, "query_id")
    found = found.select("query_id", "item", "rank", F.when(F.col("label") == F.col("asked"), 1).alias("rel"))
    counts = v.groupBy(F.col("label").alias("asked")).agg((F.count("*") - 1).alias("wanted"))
    return evalstats.marked_quality(found, a.join(counts, "asked").filter("wanted > 0").select("query_id", "wanted"), 5)


@query(f"with {_QUALITY} select query_id, round(precision, 6) as precision, round(recall, 6) as recall, round(mrr, 6) as mrr, hit from q")
def precision_recall_mrr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five neighbours of each stated query vector, relevant if of its label."""
    return _rounded(_quality(spark, sf_dir))


@query(f"""with {_QUALITY}, t2 as (select 'all' as type, * from q union all select case when query_id % 100 = 0 then 'even' else 'odd' end, * from q),
g as (select type, count(*) as n, avg(precision) as p, avg(recall) as r, avg(mrr) as m, count(*) filter (where hit) / count(*) as h, round(avg(precision) * count(*)) as k from t2 group by type)
select type, n, round(p, 6) as precision, round(r, 6) as recall, round(m, 6) as mrr, round(h, 6) as hit_rate,
  greatest(0, {_wilson('k', 'n', '-')}) as precision_lower, least(1, {_wilson('k', 'n', '+')}) as precision_upper from g""")
def search_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means over all queries and by type; the interval takes the mean as so many successes, rounded."""
    q = _quality(spark, sf_dir)
    kinds = F.array(F.lit("all"), F.when(F.col("query_id") % 100 == 0, "even").otherwise("odd"))
    d = q.select("*", F.explode(kinds).alias("type")).groupBy("type").agg(F.count("*").alias("n"), F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.avg("mrr").alias("mrr"), (F.count_if("hit") / F.count("*")).alias("hit_rate"))
    _, low, high = wilson(F.round(F.col("precision") * F.col("n")), F.col("n"))
    return _rounded(d.withColumns({"precision_lower": low, "precision_upper": high}))


@query(f"""with {_R}, c as (select category, {_COUNTS} from o where expected group by category), {_rates('c', 0)} select category, {_OUT} from y""")
def context_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates over positives alone, whose detection rate defaults to 0."""
    return _rounded(evalstats.rates(judged(spark, sf_dir).filter("expected"), "category", default_detection=0.0))
