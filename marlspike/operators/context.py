"""Change ledger, assumptions and dependency drift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marlspike.functions.globs import glob_column, normal
from marlspike.operators.iterate import closure, in_blocks, reach_counts


def hotspots(changes: DataFrame, k: int = 10) -> DataFrame:
    return changes.groupBy("file").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "file").limit(k)


def ledger_stats(changes: DataFrame) -> DataFrame:
    ops = [F.count_if(F.col("operation") == o).alias(f"n_{o}") for o in ("create", "modify", "delete")]
    return changes.agg(F.count("*").alias("total"), F.count_distinct("file").alias("unique_files"), F.count_distinct("run_id").alias("unique_runs"), *ops).withColumn("avg_per_run", F.coalesce(F.try_divide("total", "unique_runs"), F.lit(0.0)))


def timeline(changes: DataFrame) -> DataFrame:
    """``run_id, first_ts, n_changes, files``: a run by its first change."""
    return changes.groupBy("run_id").agg(F.min("ts").alias("first_ts"), F.count("*").alias("n_changes"), F.array_sort(F.collect_set("file")).alias("files"))


def file_state(changes: DataFrame) -> DataFrame:
    """``file, state, last_operation, last_modified_at, n_changes`` by each file's latest change."""
    d = changes.groupBy("file").agg(F.max_by("operation", F.struct("ts", "id")).alias("last_operation"), F.max("ts").alias("last_modified_at"), F.count("*").alias("n_changes"))
    return d.withColumn("state", F.when(F.col("last_operation") == "delete", "deleted").when(F.col("last_operation").isin("create", "modify"), "exists").otherwise("unknown"))


def impact(depends: DataFrame, changed: DataFrame) -> DataFrame:
    """``start, node, depth``: files that depend on ``changed(start)`` at second hand, of ``depends(file, depends_on)``."""
    edges = depends.select(F.col("depends_on").alias("source"), F.col("file").alias("target"))
    return closure(edges, changed).filter("depth > 1")


#: Lock files in the order in which the first that is there counts.
LOCK_FILES = ["pnpm-lock.yaml", "yarn.lock", "package-lock.json"]


def lock_file(present: Column) -> Column:
    """The lock file that counts among an array of file names; null if there is none."""
    return F.get(F.filter(F.array(*map(F.lit, LOCK_FILES)), lambda x: F.array_contains(present, x)), F.lit(0))


def dependents(depends: DataFrame, changed: DataFrame) -> DataFrame:
    """``start, file``: files that depend on ``changed(start)`` themselves, of ``depends(file, depends_on)``."""
    return depends.join(changed.select("start").distinct(), F.col("depends_on") == F.col("start")).select("start", "file").distinct()


def in_range(changes: DataFrame, since: Column, until: Column, text: str | None = None) -> DataFrame:
    d = changes.filter((F.col("ts") >= since) & (F.col("ts") <= until))
    return d if text is None else d.filter(F.contains(F.lower("reason"), F.lit(text.lower())))


#: Rules that are broadcast at once.
RULES = 10_000


def _met(assumptions: DataFrame, files: DataFrame) -> DataFrame:
    """Valid assumptions beside the files that any of their globs fits.

    Globs without a wildcard meet paths by equality; the others are counted and
    broadcast in blocks of ``RULES``.
    """
    rules = assumptions.filter("valid").withColumn("glob", F.explode("related_files")).withColumn("glob", normal(F.col("glob")))
    paths = files.select(normal(F.col("file")).alias("file")).distinct()
    wild = F.rlike("glob", F.lit(r"[*?\[\]{}!]"))
    out = paths.withColumn("_low", F.lower("file")).join(rules.withColumn("_low", F.lower("glob")), "_low").select("file", *rules.columns)
    for block in in_blocks(rules.filter(wild).withColumn("regex", glob_column(F.col("glob"))), "glob", RULES):
        out = out.unionByName(paths.join(F.broadcast(block), F.expr("file rlike regex")).select("file", *rules.columns))
    return out


def invalidated(assumptions: DataFrame, modified: DataFrame) -> DataFrame:
    """``id, reason`` of valid assumptions that a modified file breaks."""
    by = _met(assumptions, modified).groupBy("id").agg(F.array_sort(F.collect_set("file")).alias("files"))
    return by.select("id", F.concat(F.lit("File(s) modified: "), F.array_join("files", ", ")).alias("reason"))


def conflicts(assumptions: DataFrame, planned: DataFrame) -> DataFrame:
    """``id, planned_file, severity``: one row for each assumption and planned file."""
    d = _met(assumptions, planned).select("id", F.col("file").alias("planned_file"), "confidence").distinct()
    return d.select("id", "planned_file", F.when(F.col("confidence") >= 0.8, "error").otherwise("warning").alias("severity"))


def states(events: DataFrame) -> DataFrame:
    """``id, valid`` after a log of ``events(id, ts, action)``: the latest of invalidate and revalidate counts."""
    return events.groupBy("id").agg(F.max_by("action", "ts").alias("last")).select("id", (F.col("last") != "invalidate").alias("valid"))


def inferred(changes: DataFrame) -> DataFrame:
    """``file, type`` of assumptions that a changed path suggests; up to three for one path."""
    f = normal(F.col("file"))
    rules = [
        ("schema", f.contains("prisma/schema") | f.contains(".schema.")),
        ("interface", f.contains(".d.ts") | f.contains("types/")),
        ("config", f.contains("config")),
    ]
    found = F.filter(F.array(*(F.when(c, F.lit(n)) for n, c in rules)), lambda x: x.isNotNull())
    return changes.select(f.alias("file"), F.explode(found).alias("type"))


def preflight(planned: DataFrame, depends: DataFrame, assumptions: DataFrame, drift: DataFrame) -> DataFrame:
    """``file, errors, warnings, dependents, drift`` of ``planned(start, file)``.

    Conflicts with valid assumptions by severity, how many files depend on each planned one at any
    hand, of ``depends(file, depends_on)`` by ``start``, and whether ``drift`` has any row.
    """
    c = conflicts(assumptions, planned).groupBy(F.col("planned_file").alias("file"))
    c = c.agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))
    edges = depends.select(F.col("depends_on").alias("source"), F.col("file").alias("target"))
    reached = reach_counts(edges, planned.select("start")).withColumnRenamed("n", "dependents")
    d = planned.join(c, "file", "left").join(reached, "start", "left").fillna(0, ["errors", "warnings", "dependents"])
    return d.select("file", "errors", "warnings", "dependents", F.lit(not drift.isEmpty()).alias("drift"))


def dependency_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """``package, change, old_version, new_version`` between snapshots ``(package, version)``; only versions count as updates."""
    d = old.select("package", F.col("version").alias("old_version")).join(new.select("package", F.col("version").alias("new_version")), "package", "full_outer")
    change = F.when(F.col("old_version").isNull(), "added").when(F.col("new_version").isNull(), "removed").when(F.col("old_version") != F.col("new_version"), "updated")
    return d.withColumn("change", change).filter("change is not null").select("package", "change", "old_version", "new_version")


def affected(assumptions: DataFrame, changed: DataFrame) -> DataFrame:
    """Dependency assumptions whose description names a changed package; the descriptions are counted and broadcast in blocks, the packages stay where they are."""
    d = assumptions.filter("type = 'dependency' and valid")
    packages, named = changed.select("package").distinct(), None
    for block in in_blocks(d.select("id", "description"), "id", RULES):
        part = packages.join(F.broadcast(block), F.expr("contains(lower(description), lower(package))")).select("id").distinct()
        named = part if named is None else named.unionByName(part)
    return d.join(named, "id", "left_semi")


def drift(snapshots: DataFrame) -> DataFrame:
    """``repo, taken_at, manifest_changed, lock_changed`` against the snapshot before; a lock file that went counts as no change."""
    w = Window.partitionBy("repo").orderBy("taken_at")
    before = lambda c: F.lag(c).over(w)
    d = snapshots.withColumns({"m0": before("manifest_hash"), "l0": before("lock_hash"), "k": F.row_number().over(w)})
    return d.filter("k > 1").select(
        "repo", "taken_at", (~F.col("manifest_hash").eqNullSafe(F.col("m0"))).alias("manifest_changed"),
        (F.col("lock_hash").isNotNull() & ~F.col("lock_hash").eqNullSafe(F.col("l0"))).alias("lock_changed"),
    )
