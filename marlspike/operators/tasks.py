"""Metrics of task runs, by run, agent, task and model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlspike.functions.stats import ratio


def checks_passed(*checks: Column) -> tuple[Column, Column]:
    """Whether all checks that ran passed, and the share that did; true and 1 if none ran."""
    ran = F.filter(F.array(*checks), lambda c: c.isNotNull())
    ok = F.filter(ran, lambda c: c)
    return F.size(ok) == F.size(ran), F.coalesce(F.try_divide(F.size(ok).cast("double"), F.size(ran)), F.lit(1.0))


def diff_lines(diff: Column) -> Column:
    """Added and removed lines of a diff, file headers apart."""
    return F.size(F.filter(F.split(diff, "\n", -1), lambda x: (x.startswith("+") & ~x.startswith("+++")) | (x.startswith("-") & ~x.startswith("---"))))


def diff_accuracy(actual: Column, expected: Column) -> Column:
    return F.when(expected.isNull(), 1.0).when(expected == 0, F.when(actual == 0, 1.0).otherwise(0.0)).otherwise(F.greatest(F.lit(0.0), 1 - F.try_divide(F.abs(actual - expected), expected)))


def agent_rollup(runs: DataFrame, key: str = "agent") -> DataFrame:
    """By agent: pass rate, means, correct refusals among those judged (1 if none was), cost and tokens."""
    return runs.groupBy(key).agg(
        F.count("*").alias("n"),
        (F.count_if("btp") / F.count("*")).alias("pass_rate"),
        F.avg("vi").alias("avg_vi"),
        F.avg("ttg").alias("avg_ttg"),
        ratio(F.count_if(F.col("rc")), F.count("rc"), 1.0).alias("refusal_rate"),
        F.sum("cost").alias("total_cost"),
        F.sum("tokens").alias("total_tokens"),
    )


def radar(runs: DataFrame, key: str = "agent") -> DataFrame:
    """By agent five axes from 0 to 1, the higher the better: ``vi, da``, what is left of ``cvr`` and ``sc``, and the rate of ``btp``."""
    rest = lambda c: 1 - F.avg(c)
    return runs.groupBy(key).agg(F.avg("vi").alias("vi"), F.avg("da").alias("da"), rest("cvr").alias("kept_constraints"), rest("sc").alias("kept_scope"), F.avg(F.col("btp").cast("double")).alias("btp_rate"))


def with_and_without(runs: DataFrame) -> DataFrame:
    """Cost, tokens and pass rate of runs with and without the tool, side by side; ``has_data`` if there are both."""
    sides = [
        part.alias(f"{name}_{side}")
        for side, on in (("with", F.col("enabled")), ("without", ~F.col("enabled")))
        for name, part in (
            ("total", F.count_if(on)),
            ("total_cost", F.coalesce(F.sum(F.when(on, F.col("cost"))), F.lit(0.0))),
            ("avg_tokens", F.coalesce(F.avg(F.when(on, F.col("tokens"))), F.lit(0.0))),
            ("pass_rate", 100 * ratio(F.count_if(on & F.col("passed")), F.count_if(on), 0.0)),
        )
    ]
    d = runs.agg(*sides)
    return d.withColumn("has_data", (F.col("total_with") > 0) & (F.col("total_without") > 0))


def timeline(runs: DataFrame, agents: list[str]) -> DataFrame:
    """Pass rate by run and agent, 0 where an agent has no trial."""
    d = runs.groupBy("run").pivot("agent", agents).agg(F.avg(F.col("btp").cast("double")))
    return d.fillna(0.0)


def heatmap(runs: DataFrame, agents: list[str]) -> DataFrame:
    """Whether each task passed with each agent in its latest run."""
    return runs.groupBy("task").pivot("agent", agents).agg(F.max_by("btp", F.struct("ts", "id")))


def attack_rates(trials: DataFrame, by: str) -> DataFrame:
    """Share of attacks that succeed with and without a defence, and by how much it lowers it."""
    d = trials.groupBy(by).agg(
        ratio(F.count_if(F.col("defended") & F.col("hit")), F.count_if("defended"), 0.0).alias("rate_with"),
        ratio(F.count_if(~F.col("defended") & F.col("hit")), F.count_if(~F.col("defended")), 0.0).alias("rate_without"),
    )
    return d.withColumn("reduction", ratio(F.col("rate_without") - F.col("rate_with"), F.col("rate_without"), 0.0))


def cost_efficiency(trials: DataFrame, by: str) -> DataFrame:
    return trials.groupBy(by).agg(F.sum("cost").alias("cost"), F.count_if(~F.col("hit")).alias("defences"), F.try_divide(F.sum("cost"), F.count_if(~F.col("hit"))).alias("cost_per_defence"))
