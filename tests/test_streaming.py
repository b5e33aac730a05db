from datetime import datetime

from gridcast.sources import stores
from gridcast.streaming import telemetry as S
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def run(df, name, mode, spark):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return spark.table(name)


def events(spark, tmp_path):
    ev = spark.read.parquet(f"{SF}/events.parquet").select(F.col("event_type").alias("region"), "ts", "value")
    ev.union(ev.limit(20)).coalesce(1).write.parquet(str(tmp_path / "in"))
    return ev, spark.readStream.schema(ev.schema).parquet(str(tmp_path / "in"))


def test_windows_match_batch(spark, tmp_path):
    ev, s = events(spark, tmp_path)
    got = run(S.tumbling(S.prepared(s), ["region"], ["value"], width="1 hour"), "tumbling", "complete", spark)
    want = S.tumbling(ev.withColumn("ts", F.col("ts").cast("timestamp")), ["region"], ["value"], width="1 hour")
    key = lambda df: sorted((r["region"], r["window_start"], r["n"], round(r["value"], 6)) for r in df.collect())
    assert key(got) == key(want)
    both = s.withColumn("ts", F.col("ts").cast("timestamp")).withColumnsRenamed({"value": "y"}).withColumn("p", F.col("y") + 1)
    assert {round(r["mae"], 6) for r in run(S.sliding_errors(both, ["region"]), "sliding", "complete", spark).collect()} == {1.0}
    gaps = run(S.gap_sessions(s.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "1 hour"), ["region"], gap="12 hours"), "gaps", "complete", spark)
    assert gaps.agg(F.sum("n")).first()[0] == ev.count() + 20


def test_state_and_upserts(spark, tmp_path):
    rows = [("a", datetime(2024, 1, 1, h), v) for h, v in enumerate([1.0, None, 3.0, 2.0])]
    schema = "region string, ts timestamp, value double"
    for k in (0, 1):
        spark.createDataFrame(rows[2 * k : 2 * k + 2], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    store = str(tmp_path / "store")
    q = S.upsert_stream(s, store, ["region"], str(tmp_path / "ck"), "ts").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert stores.read_store(spark, store).count() == 1
    stores.upsert_store(spark.createDataFrame(rows[:1], schema), store, ["region"])
    assert stores.read_store(spark, store).first()["value"] == 1.0
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        top = run(S.running_maximum(s, "region"), "running", "append", spark).collect()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert sorted((r["ts"].hour, r["top"]) for r in top if r["top"] is not None)[-1] == (3, 3.0)


def test_join_with_forecast(spark, tmp_path):
    ev, s = events(spark, tmp_path)
    f = ev.dropDuplicates(["region", "ts"]).withColumnRenamed("value", "p")
    assert run(S.with_forecast(s, f, ["region"]), "joined", "append", spark).count() == ev.count() + 20
