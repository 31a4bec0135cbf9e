"""Log and report files: tolerant readers, rotation, corpus validation, sinks."""

from __future__ import annotations

from html import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: Bytes at which a log starts anew, and how many old ones stay.
ROTATE, KEEP = 10 * 1024 * 1024, 5
#: Ids whose sizes are summed together.
BLOCK = 100_000

AUDIT_DDL = "id string, timestamp timestamp, category string, action string, actor struct<type:string,id:string>, target struct<type:string,id:string>, outcome string, details map<string,string>"


def audit_log(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines under a fixed schema; lines that are no JSON are left out."""
    return spark.read.schema(AUDIT_DDL).option("mode", "DROPMALFORMED").json(path)


def results(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Rows of result files with the file they come from, and the lines that could not be read."""
    d = spark.read.schema(f"{schema}, _corrupt string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path).withColumn("file", F.input_file_name())
    lines = spark.read.text(path).withColumn("file", F.input_file_name())
    fields = T._parse_datatype_string(schema)
    bad = lines.filter(F.from_json("value", fields, {"mode": "PERMISSIVE"}).isNull() | ~F.rlike("value", F.lit(r"^\s*\{.*\}\s*$")))
    return d.filter("_corrupt is null").drop("_corrupt"), bad.select("file", F.col("value").alias("line"))


#: An object over several lines, in a file that is neither JSON lines nor one JSON value.
_OBJECTS = r"(?s)\{.*?\n\}"


def collected_runs(spark: SparkSession, folder: str) -> DataFrame:
    """``run, ordinal, result`` (JSON text) of every ``<folder>/<run>/results.jsonl``, whatever its shape.

    JSON lines if the first line is an object, else one JSON value or array, else
    the objects that can be cut out; what is no JSON is left out. Runs are
    files of results, so each fits a row.
    """
    d = spark.read.text(f"{folder}/*/results.jsonl", wholetext=True).withColumn("run", F.regexp_extract(F.input_file_name(), r"([^/]+)/results\.jsonl$", 1))
    text = F.trim(F.regexp_replace("value", r"^\s+|\s+$", ""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.length(F.trim(x)) > 0)
    whole = F.try_parse_json(text)
    array = F.from_json(text, "array<string>")
    found = (
        F.when(F.rlike(F.get(lines, F.lit(0)), F.lit(r"^\s*\{.*\}\s*$")), lines)
        .when(whole.isNotNull() & text.startswith("["), array)
        .when(whole.isNotNull(), F.array(text))
        .otherwise(F.regexp_extract_all(text, F.lit(_OBJECTS), F.lit(0)))
    )
    sound = F.filter(found, lambda x: F.try_parse_json(x).isNotNull())
    return d.select("run", F.posexplode(sound).alias("ordinal", "result"))


def newest_runs(runs: DataFrame) -> DataFrame:
    """``run, timestamp, n`` of collected runs, newest first by their first result's timestamp or else their name."""
    first = F.min_by(F.get_json_object("result", "$.timestamp"), "ordinal")
    d = runs.groupBy("run").agg(F.coalesce(first, F.col("run")).alias("timestamp"), F.count("*").alias("n"))
    return d.orderBy(F.desc("timestamp"), "run")


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def rotation(sizes: DataFrame, limit: int = ROTATE, keep: int = KEEP) -> DataFrame:
    """``id, file_no, kept`` of ``sizes(id, size)`` written in order of id: a file is closed before it would pass the limit.

    The running sum runs within blocks of ``BLOCK`` ids and over the blocks, so
    no task gets more than a block or the blocks.
    """
    d = sizes.withColumn("_b", F.floor(F.col("id") / BLOCK))
    blocks = d.groupBy("_b").agg(F.sum("size").alias("_s"))
    ahead = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("_b", F.coalesce(F.sum("_s").over(ahead), F.lit(0)).alias("_ahead"))
    within = F.coalesce(F.sum("size").over(Window.partitionBy("_b").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    d = d.join(blocks, "_b").select("id", F.floor((F.col("_ahead") + within) / limit).alias("file_no"))
    last = d.agg(F.max("file_no").alias("last"))
    return d.crossJoin(F.broadcast(last)).select("id", "file_no", (F.col("file_no") >= F.col("last") - keep).alias("kept"))  # one row


LEVELS = ["easy", "medium", "hard"]


def validated(samples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Samples that are sound, and ``id, error`` for those that are not; of a repeated id none is sound."""
    n = samples.groupBy("id").agg(F.count("*").alias("_n"))
    d = samples.join(n, "id", "left")
    rules = [
        ("missing id", F.col("id").isNull() | (F.col("id") == "")),
        ("missing content", F.col("content").isNull() | (F.length(F.trim("content")) == 0)),
        ("missing expected_detection", F.col("expected_detection").isNull()),
        ("unknown difficulty", ~F.coalesce(F.col("difficulty").isin(LEVELS), F.lit(False))),
        ("duplicate id", F.col("_n") > 1),
    ]
    found = F.filter(F.array(*(F.when(c, F.lit(e)) for e, c in rules)), lambda x: x.isNotNull())
    d = d.withColumn("_errors", found)
    return d.filter(F.size("_errors") == 0).drop("_n", "_errors"), d.select("id", F.explode("_errors").alias("error"))


def corpus_rows(documents: list[str]) -> list[dict]:
    """Samples of YAML documents, each with its file's category."""
    import yaml

    out = []
    for text in documents:
        data = yaml.safe_load(text) or {}
        for s in data.get("samples") or []:
            out.append({k: s.get(k) for k in ("id", "content", "expected_detection", "difficulty", "context")} | {"category": data.get("category", "unknown")})
    return out


def report_markdown(rows: DataFrame, title: str, limit: int = 500) -> str:
    """A Markdown table of a small result."""
    names = rows.columns
    lines = [f"# {title}", "", "| " + " | ".join(names) + " |", "|" + "---|" * len(names)]
    lines += ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows.limit(limit).collect()]
    return "\n".join(lines) + "\n"


def report_csv(rows: DataFrame, path: str) -> None:
    """Rows of a report as one CSV file with a header; reports are small."""
    rows.coalesce(1).write.mode("overwrite").option("header", "true").option("quoteAll", "true").csv(path)


def by_category(samples: DataFrame) -> DataFrame:
    """``category, n, detected, rate`` of ``samples(category, detected)``, for a report."""
    d = samples.groupBy("category").agg(F.count("*").alias("n"), F.count_if("detected").alias("detected"))
    return d.withColumn("rate", F.col("detected") / F.col("n")).orderBy("category")


def report_html(tables: dict[str, DataFrame], title: str, limit: int = 500) -> str:
    """A page with one table for each small result; values are escaped."""
    out = [f"<!DOCTYPE html><html><head><meta charset=\"utf-8\"><title>{escape(title)}</title></head><body><h1>{escape(title)}</h1>"]
    for name, rows in tables.items():
        cells = lambda tag, values: "<tr>" + "".join(f"<{tag}>{'' if v is None else escape(str(v))}</{tag}>" for v in values) + "</tr>"
        out += [f"<h2>{escape(name)}</h2><table>", cells("th", rows.columns), *(cells("td", r) for r in rows.limit(limit).collect()), "</table>"]
    return "".join([*out, "</body></html>"])
