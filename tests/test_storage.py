"""Versions under several writers, cut buckets, lookups by row group, a database, requests in a stream."""

import os
import uuid
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from haggle.operators import feed, upsert
from haggle.sources.storage import Conflict, Versions, jdbc, write_keyed
from haggle.streaming.ingest import first_requests


def test_of_two_writers_of_a_version_one_tries_again(spark, tmp_path):
    users = spark.createDataFrame([("a", 1), ("b", 1)], "name string, x int")
    table = Versions(spark, f"file://{tmp_path}/t", users.schema, "name", 3)
    assert table.update(lambda t: upsert.insert_missing(t, users, "name")) == 0
    calls = []

    def slow(t):
        calls.append(t.count())
        if len(calls) == 1:  # while this writer works on version 1, another one makes it
            new = spark.createDataFrame([("b", 9), ("c", 2)], users.schema)
            assert Versions(spark, table.path, users.schema, "name", 3).update(lambda u: upsert.insert_missing(u, new, "name")) == 1
        return upsert.insert_missing(t, spark.createDataFrame([("c", 3), ("d", 3)], users.schema), "name")

    assert table.update(slow) == 2 and calls == [2, 3]
    assert sorted(map(tuple, table.read().collect())) == [("a", 1), ("b", 1), ("c", 2), ("d", 3)]
    assert sorted(map(tuple, table.read(0).collect())) == [("a", 1), ("b", 1)]
    folders = [n for n in os.listdir(tmp_path / "t") if n.startswith("v")]
    assert len(folders) == 3  # nothing is left of the attempt that came second


def test_a_key_twice_changes_nothing(spark, tmp_path):
    df = spark.createDataFrame([("a", 1)], "name string, x int")
    table = Versions(spark, f"file://{tmp_path}/t", df.schema, "name")
    table.update(lambda t: df)
    with pytest.raises(ValueError, match="twice"):
        table.update(lambda t: t.union(df))
    assert table.latest() == 0 and len([n for n in os.listdir(tmp_path / "t") if n.startswith("v")]) == 1
    with pytest.raises(Conflict):
        table._commit(0, table.manifest(), replace=False)
    assert table.update(lambda t: t.where("false")) == 1 and table.read().count() == 0


def test_full_buckets_are_cut_and_listings_do_not_grow(spark, tmp_path):
    df = spark.range(300).select(F.col("id").cast("string").alias("name"), F.lit(0).alias("x"))
    table = Versions(spark, f"file://{tmp_path}/t", df.schema, "name", most_rows=100)
    for v in range(6):
        some = df.where(f"cast(name as int) < {50 * (v + 1)}").withColumn("x", F.lit(v))
        hit = table.touched(some, v - 1)
        table.write(v, table.read(v - 1, hit).join(some.select("name"), "name", "left_anti").unionByName(some))
        table.tidy()
    assert table.read().count() == 300 and table.read().select("name").distinct().count() == 300 and table.read().where("x = 5").count() == 300
    sizes = table.manifest()
    assert len(sizes) > 2 and sum(n for _, n in sizes.values()) == 300
    assert len(os.listdir(tmp_path / "t/manifests")) <= 2 * 2  # two versions and their checksums
    one = table.touched(spark.createDataFrame([("7", 9)], df.schema), 5)
    table.write(6, table.read(5, one).withColumn("x", F.lit(6)))
    assert len(one) == 1 and table.read().where("x = 6").count() == sizes[next(iter(one))][1]
    (tmp_path / "t/v9-left").mkdir()
    table.sweep()
    assert not (tmp_path / "t/v9-left").exists() and table.read().count() == 300


def scanned(df):
    """Rows that came out of the file scans of a query that has run."""
    plan, total = df._jdf.queryExecution().executedPlan(), 0
    leaves = plan.collectLeaves()
    for k in range(leaves.size()):
        metric = leaves.apply(k).metrics().get("numOutputRows")
        total += metric.get().value() if metric.isDefined() else 0
    return total


def test_a_lookup_reads_a_row_group_in_ten(spark, tmp_path):
    rows = spark.range(0, 20_000, 1, 6).select("id", F.sha2(F.col("id").cast("string"), 256).alias("email"))
    write_keyed(rows, f"file://{tmp_path}/u", "id", ("email",), 500)
    stored = spark.read.parquet(f"file://{tmp_path}/u")
    by_key = stored.where("id = 4321")
    assert by_key.collect()[0].id == 4321 and scanned(by_key) <= 20_000 / 10
    email = rows.where("id = 777").first().email
    by_email = stored.where(F.col("email") == email)
    assert by_email.collect()[0].id == 777 and scanned(by_email) <= 20_000 / 10
    missing = stored.where("email = 'none'")
    assert missing.collect() == [] and scanned(missing) <= 20_000 / 10
    assert feed.only(stored, "id", 5).collect()[0].id == 5


def test_a_database(spark):
    url = f"jdbc:derby:memory:{uuid.uuid4().hex};create=true"
    deals = spark.range(1, 101).select(F.col("id").alias("ID"), F.concat(F.lit("deal "), F.col("id").cast("string")).alias("SUBJECT"), F.when(F.col("id") % 3 > 0, F.col("id").cast("int")).alias("PRICE"))
    deals.write.format("jdbc").options(url=url, dbtable="DEALS", createTableColumnTypes="SUBJECT VARCHAR(64)").save()
    read = jdbc(spark, url, "DEALS", "ID", 4)
    assert read.rdd.getNumPartitions() == 4
    assert sorted(map(tuple, read.collect())) == sorted(map(tuple, deals.collect()))
    found = read.where("ID > 90 AND SUBJECT <> 'deal 95'").select("SUBJECT")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [*IsNotNull(ID)" in plan and "*GreaterThan(ID,90)" in plan and "PRICE" not in plan.split("ReadSchema")[1]
    assert len(found.collect()) == 9
    deals.limit(0).write.format("jdbc").options(url=url, dbtable="NONE_YET", createTableColumnTypes="SUBJECT VARCHAR(64)").save()
    assert jdbc(spark, url, "NONE_YET", "ID", 4).collect() == []


def test_requests_of_a_stream_come_once(spark, tmp_path):
    def run(*rows):
        at = spark.createDataFrame([(u, datetime(2024, 1, 1, h, m)) for u, h, m in rows], "url string, at timestamp")
        at.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(at.schema).parquet(f"{tmp_path}/in")
        query = first_requests(stream, ["url"], "at", "1 hour").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/offsets").trigger(availableNow=True).start()
        query.awaitTermination()
        return sorted(r.url for r in spark.read.parquet(f"{tmp_path}/out").collect()) if os.path.exists(tmp_path / "out") else []

    assert run(("a", 10, 0), ("b", 10, 5), ("a", 10, 1)) == ["a", "b"]
    assert run(("a", 10, 30), ("c", 10, 40), ("b", 10, 50)) == ["a", "b", "c"]
    assert run(("d", 13, 0)) == ["a", "b", "c", "d"]
    # more than an hour late: no longer known whether it came before, so it goes
    assert run(("a", 10, 30), ("e", 11, 0)) == ["a", "b", "c", "d"]
    # the same URL at a later time is a new request
    assert run(("a", 13, 5)) == ["a", "a", "b", "c", "d"]
