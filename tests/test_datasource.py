"""Tables with commits through ``spark.read.format``, in batches and as a stream."""

import pytest
from pyspark.sql import functions as F

from marlspike.sources.commits import Table
from marlspike.sources.datasource import NAME, CommitsSource

SCHEMA = "k string, n bigint"


@pytest.fixture(scope="module")
def source(spark):
    spark.dataSource.register(CommitsSource)
    before = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    yield spark
    spark.conf.set("spark.sql.python.filterPushdown.enabled", before)


def rows(spark, n, start=0):
    return spark.range(start, start + n).select(F.concat(F.lit("k"), (F.col("id") % 3).cast("string")).alias("k"), F.col("id").alias("n"))


def test_written_and_read(source, tmp_path):
    spark, where = source, str(tmp_path / "t")
    rows(spark, 10).repartition(3).write.format(NAME).mode("append").option("path", where).save()
    rows(spark, 5, 10).write.format(NAME).mode("append").option("path", f"file://{where}").save()
    d = spark.read.format(NAME).load(where)
    assert dict(d.dtypes) == {"k": "string", "n": "bigint"} and sorted(r.n for r in d.collect()) == list(range(15))
    some = d.filter("n >= 8 and k in ('k0', 'k1') and n % 2 = 0")
    assert sorted(r.n for r in some.collect()) == [10, 12] and "n % 2" not in str(d.filter("n >= 8").collect())
    assert sorted(r.n for r in spark.read.format(NAME).option("version", 0).load(where).collect()) == list(range(10))
    # the same table by the other reader, and what it writes by this one
    t = Table(spark, where, SCHEMA)
    assert t.read().count() == 15
    t.append(rows(spark, 2, 20))
    assert spark.read.format(NAME).load(where).agg(F.sum("n")).first()[0] == sum(range(15)) + 41
    rows(spark, 1, 99).write.format(NAME).mode("overwrite").option("path", where).save()
    assert [r.n for r in spark.read.format(NAME).load(where).collect()] == [99] and t.read().count() == 1


def test_stream(source, tmp_path):
    spark, where = source, str(tmp_path / "s")
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    t = Table(spark, where, SCHEMA)
    t.append(rows(spark, 4))

    def run():
        s = spark.readStream.format(NAME).schema(SCHEMA).load(where)
        s.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
        return sorted(r.n for r in spark.read.schema(SCHEMA).parquet(out).collect())

    assert run() == [0, 1, 2, 3]
    t.append(rows(spark, 2, 4))
    t.append(rows(spark, 2, 6))
    assert run() == list(range(8))  # from where it stopped
    assert run() == list(range(8))


def test_a_failed_write_leaves_nothing(source, tmp_path):
    spark, where = source, str(tmp_path / "f")
    rows(spark, 3).write.format(NAME).mode("append").option("path", where).save()
    bad = rows(spark, 3).withColumn("n", F.when(F.col("n") == 2, F.raise_error(F.lit("no")).cast("bigint")).otherwise(F.col("n")))
    with pytest.raises(Exception):  # noqa: B017
        bad.write.format(NAME).mode("append").option("path", where).save()
    assert spark.read.format(NAME).load(where).count() == 3 and len(Table(spark, where, SCHEMA).state().folders) == 1
    with pytest.raises(Exception, match="schema"):
        spark.read.format(NAME).load(str(tmp_path / "none")).collect()
