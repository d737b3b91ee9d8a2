"""Event time on the events table, cut into files that arrive one by one."""

import pytest
from pyspark.sql import functions as F

from lumbre.streaming import bounded, events


@pytest.fixture(scope="module")
def arriving(spark, sf, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("events"))
    e = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    e.repartitionByRange(4, "ts").write.mode("overwrite").parquet(at)
    return at, e


@pytest.fixture
def name(tmp_path):
    """A folder of its own for each stream."""
    used = iter(range(100))
    return lambda: f"file://{tmp_path}/stream{next(used)}"


def test_windows_close_with_the_watermark(spark, arriving, name):
    at, e = arriving
    s = events.windowed(events.source(spark, at, e.schema, 1), "ts", "1 minute", "1 hour", "30 minutes", ["event_type"], F.count(F.lit(1)).alias("n"))
    got = {tuple(r) for r in events.run_available(s, name(), "append").collect()}
    want = {tuple(r) for r in e.groupBy(F.window("ts", "1 hour", "30 minutes").alias("w"), "event_type").count().select("w.start", "w.end", "event_type", "count").collect()}
    assert got and got <= want


def test_sessions_dedup_state(spark, arriving, name):
    at, e = arriving
    source = lambda: events.source(spark, at, e.schema)
    s = events.session_windows(source(), "ts", "1 minute", "10 minutes", ["user_id"], F.count(F.lit(1)).alias("n"))
    assert events.run_available(s, name(), "complete").agg(F.sum("n")).collect()[0][0] == e.count()
    twice = source().union(source())
    assert events.run_available(events.deduplicated(twice, "ts", "3650 days", ["event_id"]), name()).count() == e.count()
    out = events.run_available(events.running_totals(source(), "event_type", "value"), name(), "update")
    want = {r.event_type: r["count"] for r in e.groupBy("event_type").count().collect()}
    assert {r.event_type: r.n for r in out.groupBy("event_type").agg(F.max("n").alias("n")).collect()} == want


def test_interval_join_and_foreach(spark, arriving, tmp_path, name):
    at, e = arriving
    views = events.source(spark, at, e.schema).filter("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("a"))
    buys = events.source(spark, at, e.schema).filter("event_type = 'purchase'").select("user_id", F.col("ts").alias("ts2"), F.col("event_id").alias("b"))
    j = events.interval_join(views, buys, "user_id", "ts", "ts2", "1 day", "1 HOUR").select("a", "b")
    v, b = e.filter("event_type = 'view'"), e.filter("event_type = 'purchase'")
    want = v.alias("v").join(b.alias("b"), (F.col("v.user_id") == F.col("b.user_id")) & (F.col("b.ts") >= F.col("v.ts")) & (F.col("b.ts") <= F.col("v.ts") + F.expr("INTERVAL 1 HOUR"))).count()
    assert events.run_available(j, name()).count() == want
    seen = []
    q = events.each_batch(events.source(spark, at, e.schema, 1), lambda df, k: seen.append((k, df.count())), str(tmp_path / "c"))
    q.awaitTermination()
    assert sum(n for _, n in seen) == e.count() and [k for k, _ in seen] == sorted({k for k, _ in seen})


def test_single_metric(spark):
    df = spark.createDataFrame([("1.5",), ("2.5",), ("",)], "valor string")
    assert bounded.single_sum_or_count(df, "valor", "suma").collect()[0].valor == 4 and bounded.single_sum_or_count(df, "valor", "conteo").collect()[0].valor == 2
    with pytest.raises(Exception, match="not a number"):
        bounded.single_sum_or_count(df.union(spark.createDataFrame([("x",)], "valor string")), "valor", "suma").collect()
