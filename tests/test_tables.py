"""Stored tables: commits of several at once, buckets, refreshed partitions, zone maps, persisted views and footers."""

import glob
import os
import re
import shutil

import pytest
from pyspark.sql import functions as F

from tidemark.operators import activate
from tidemark.sources import tables
from tidemark.sources.commits import Conflict, TableSet
from tidemark.sources.scratch import scratch

SCHEMAS = {"decisions": "run_id string, id long, v string", "runs": "run_id string, n long"}
KEYS = {"decisions": ["run_id", "id"], "runs": ["run_id"]}


@pytest.fixture()
def store(spark):
    return TableSet(spark, scratch(spark, "test-set"), SCHEMAS)


def staged(spark, run, ids, v="a"):
    return {
        "decisions": (spark.createDataFrame([(run, i, v) for i in ids], SCHEMAS["decisions"]), KEYS["decisions"]),
        "runs": (spark.createDataFrame([(run, len(ids))], SCHEMAS["runs"]), KEYS["runs"]),
    }


def held(store):
    return sorted((r.run_id, r.id) for r in store.read("decisions").collect()), sorted(r.run_id for r in store.read("runs").collect())


def test_commit_is_idempotent_and_refuses_changes(spark, store):
    assert held(store) == ([], []) and store.snapshot().version == 0
    assert activate.ingest_atomic(store, staged(spark, "r1", [1, 2])) == {"decisions": 2, "runs": 1}
    assert activate.ingest_atomic(store, staged(spark, "r1", [1, 2])) == {"decisions": 0, "runs": 0}
    assert store.snapshot().version == 1 and store.orphans() == []
    with pytest.raises(ValueError, match="conflicting_rows"):
        activate.ingest_atomic(store, staged(spark, "r1", [2], "b"))
    with pytest.raises(ValueError, match="staged_duplicates"):
        activate.ingest_atomic(store, staged(spark, "r2", [5, 5]))
    assert held(store) == ([("r1", 1), ("r1", 2)], ["r1"]) and store.snapshot().version == 1
    activate.ingest_atomic(store, staged(spark, "r2", [1]))
    assert [r.id for r in store.read("decisions", store.snapshot(1)).orderBy("id").collect()] == [1, 2] and store.versions() == [1, 2]


def test_a_crash_between_tables_leaves_nothing(spark, store, monkeypatch):
    real = TableSet.stage

    def stage(self, table, rows):
        if table == "runs":
            raise RuntimeError("lost")
        return real(self, table, rows)

    monkeypatch.setattr(TableSet, "stage", stage)
    with pytest.raises(RuntimeError, match="lost"):
        activate.ingest_atomic(store, staged(spark, "r1", [1, 2]))
    monkeypatch.undo()
    assert held(store) == ([], []) and len(store.orphans()) == 1 and store.orphans()[0].startswith("data/decisions/")
    assert activate.ingest_atomic(store, staged(spark, "r1", [1, 2])) == {"decisions": 2, "runs": 1}
    assert held(store) == ([("r1", 1), ("r1", 2)], ["r1"])


def test_of_two_writers_one_wins_and_the_other_goes_on(spark, store, monkeypatch):
    real, raced = TableSet.put, []

    def put(self, base, added):
        if not raced:  # another writer commits between this one's check and its commit
            raced.append(True)
            assert activate.ingest_atomic(TableSet(spark, store.root, SCHEMAS), staged(spark, "r1", [1, 2])) == {"decisions": 2, "runs": 1}
        return real(self, base, added)

    monkeypatch.setattr(TableSet, "put", put)
    assert activate.ingest_atomic(store, staged(spark, "r1", [1, 2])) == {"decisions": 0, "runs": 0}
    monkeypatch.undo()
    assert held(store) == ([("r1", 1), ("r1", 2)], ["r1"]) and store.versions() == [1] and store.orphans() == []
    with pytest.raises(Conflict):
        store.put(store.snapshot(0), {})
    assert activate.ingest_atomic(store, staged(spark, "r2", [3])) == {"decisions": 1, "runs": 1} and store.versions() == [1, 2]


def test_drafts_are_not_versions(spark, store):
    activate.ingest_atomic(store, staged(spark, "r1", [1]))
    path = store.root.removeprefix("file:").replace("//", "/")
    os.makedirs(f"{path}/drafts", exist_ok=True)
    shutil.copy(f"{path}/manifests/1.json", f"{path}/drafts/2.json")
    assert store.versions() == [1] and len(held(store)[0]) == 1


def over(plan, leaf):
    """What stands above each line of a plan that `leaf` is found in."""
    out, stack = [], []
    for line in plan.splitlines():
        depth = len(line) - len(line.lstrip(" :+-"))
        stack = [(d, t) for d, t in stack if d < depth]
        if re.search(leaf, line):
            out.append([t for _, t in stack])
        stack.append((depth, line))
    return out


def test_conflicts_with_a_bucketed_table_do_not_shuffle_it(spark):
    rows = spark.range(1000).select((F.col("id") % 100).alias("k"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") / 100).cast("int")).alias("day"), F.col("id").cast("string").alias("v"))
    tables.write_bucketed(rows.withColumn("part", F.col("day")), "test_bucketed", ["k", "day"], 4, "part")
    batch = rows.filter("day < '2024-01-03'").withColumn("part", F.col("day"))
    batch = batch.withColumn("v", F.when(F.col("k") < 5, "new").otherwise(F.col("v"))).unionByName(spark.createDataFrame([(None, None, "x", None), (7, None, "x", None)], batch.schema))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        told = activate.stored_conflicts(spark, "test_bucketed", batch, ["k", "day"], "part")
        plan = told._jdf.queryExecution().executedPlan().toString()
        got = told.first().asDict()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == {"target_duplicates": 0, "staged_duplicates": 0, "conflicting_rows": 10, "known_rows": 200, "null_keys": 2}
    scans = over(plan, "test_bucketed")
    assert len(scans) == 2 and not any("hashpartitioning" in line for s in scans for line in s)
    assert len(re.findall(r"PartitionFilters: \[[^\]]*part#\d+ IN", plan)) == 2
    spark.sql("DROP TABLE test_bucketed")


def test_refresh_replaces_touched_days_only(spark):
    path = scratch(spark, "test-refresh")
    rows = spark.range(300).select("id", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 10).cast("int")).alias("day"), (F.col("id") % 7).alias("v"))
    rebuilt = lambda df: df.groupBy("day", "v").agg(F.count(F.lit(1)).alias("n"))
    late = rows.filter("id IN (13, 33, 46)")  # days 3 and 6
    tables.write_partitioned(rebuilt(rows.join(late.select("id"), "id", "left_anti")), path, "day", ["v"])
    local = path.removeprefix("file:").replace("//", "/")
    before = {d: sorted(os.listdir(d)) for d in glob.glob(f"{local}/day=*")}
    touched = tables.refresh_partitions(path, "day", late, lambda t: rebuilt(rows.join(F.broadcast(t), "day", "left_semi")), ["v"])
    after = {d: sorted(os.listdir(d)) for d in glob.glob(f"{local}/day=*")}
    assert sorted(str(r.day) for r in touched.collect()) == ["2024-01-04", "2024-01-07"]
    assert before.keys() == after.keys() and {d[-2:] for d in before if before[d] != after[d]} == {"04", "07"}
    columns = ["day", "v", "n"]
    assert sorted(map(tuple, spark.read.parquet(path).select(columns).collect())) == sorted(map(tuple, rebuilt(rows).select(columns).collect()))
    tables.refresh_partitions(path, "day", late.limit(0), lambda t: rebuilt(rows.join(F.broadcast(t), "day", "left_semi")), ["v"])
    assert {d: sorted(os.listdir(d)) for d in glob.glob(f"{local}/day=*")} == after


def test_zone_map_catches_swapped_files(spark):
    path = scratch(spark, "test-zones")
    df = spark.range(4000).select(F.when(F.col("id") % 50 > 0, F.col("id") * 7919 % 1009).alias("a"), F.col("id").alias("b")).repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    tables.export_ordered(df, ["a", "b"], {}, ["a", "b"], path)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    kept, order = spark.read.parquet(f"{path}.zones"), ["a", "b"]
    assert kept.count() > 1 and tables.ordered_violations(spark.read.parquet(path), order, kept).count() == 0
    assert kept.agg(F.sum("rows")).first()[0] == 4000 and kept.orderBy("place").first().low.a is None
    local = path.removeprefix("file:").replace("//", "/")
    one, two = sorted(glob.glob(f"{local}/part-*"))[:2]
    os.rename(one, f"{local}/x")
    os.rename(two, one)
    os.rename(f"{local}/x", two)
    for crc in glob.glob(f"{local}/.*.crc"):
        os.remove(crc)
    spark.catalog.refreshByPath(path)
    found = tables.ordered_violations(spark.read.parquet(path), order)
    assert found.count() == 1 and {r.file for r in found.collect()} == {os.path.basename(two)}
    os.remove(two)
    spark.catalog.refreshByPath(path)
    assert os.path.basename(two) in {r.file for r in tables.ordered_violations(spark.read.parquet(path), order, kept).collect()}


def test_views_outlive_the_session_and_keep_their_columns(spark):
    path = scratch(spark, "test-views")
    spark.range(5).withColumn("v", F.col("id") * 2).write.parquet(path)
    tables.publish_persistent(spark, "test_views", {"src": path}, {"doubled": "SELECT id, v FROM src WHERE v > 2", "total": "SELECT sum(v) AS s FROM doubled"})
    other = spark.newSession()
    assert other.sql("SELECT s FROM test_views.total").first().s == 18 and spark.catalog.currentDatabase() == "default"
    spark.range(1).select(F.lit(9).cast("long").alias("id"), F.lit(100).cast("long").alias("v")).write.mode("append").parquet(path)
    other.catalog.refreshTable("test_views.src")
    assert other.sql("SELECT s FROM test_views.total").first().s == 118
    with pytest.raises(ValueError, match="columns"):
        tables.publish_persistent(spark, "test_views", {"src": path}, {"doubled": "SELECT v, id FROM src"})
    tables.publish_persistent(spark, "test_views", {"src": path}, {"doubled": "SELECT id, v FROM src WHERE v > 4"})
    assert spark.newSession().sql("SELECT count(*) AS n FROM test_views.doubled").first().n == 3
    spark.sql("DROP DATABASE test_views CASCADE")


def test_footers_answer_without_reading_columns(spark):
    path = scratch(spark, "test-footers")
    spark.range(1000).withColumn("d", F.col("id") / 7).repartition(3).write.parquet(path)
    got = tables.footer_facts(spark, "t", path, ["id", "d"]).first().asDict()
    assert got == {"table_name": "t", "row_count": 1000, "min_id": 0, "max_id": 999, "min_d": 0.0, "max_d": 999 / 7}
    own = spark.newSession()
    own.conf.set("spark.sql.sources.useV1SourceList", "")
    own.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    assert re.search(r"PushedAggregation: \[COUNT\(\*\), MIN\(id\), MAX\(id\)\]", tables._pushed(own, path, ["id"])._jdf.queryExecution().executedPlan().toString())
    assert spark.conf.get("spark.sql.parquet.aggregatePushdown") == "false"
