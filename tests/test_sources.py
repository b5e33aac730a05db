import json
import time
from datetime import datetime

import pytest
from gridcast.sources import ledger, readers, rest, stores, writers
from pyspark.sql import functions as F


def test_grid_actuals_with_quirks(spark, tmp_path):
    head = "meta\n" * 4
    body = "Datum;Von;bis; Onshore MW\n27.10.2024;02:00;02:15;12858,45\n27.10.2024;02:15;02:30;-\n27.10.2024;02:00;02:15;n.v.\n27.10.2024;02:15;02:30;1.234,5\n27.10.2024;03:00;03:15;7\n"
    (tmp_path / "wind_2024.csv").write_bytes((head + body).encode("utf-16-le"))
    (tmp_path / "wind_1999.csv").write_bytes((head + body).encode("utf-16-le"))
    got = readers.read_grid_actuals(spark, str(tmp_path), "MW", "wind_mw").orderBy("line").collect()
    assert [r["wind_mw"] for r in got] == [12858.45, None, None, None, 7.0]
    assert got[0]["local"] == datetime(2024, 10, 27, 2, 0) and {r["file"] for r in got} == {"wind_2024.csv"}
    (tmp_path / "bad_2024.csv").write_bytes((head + "Datum;von;x\n01.01.2024;00:00;1\n").encode("utf-16-le"))
    with pytest.raises(Exception, match="no value column"):
        readers.read_grid_actuals(spark, str(tmp_path / "bad_2024.csv"), "MW", "wind_mw").collect()


def test_geojson_round_trip(spark, tmp_path):
    rows = [("a", "town", 0, i, x, y) for i, (x, y) in enumerate([(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)])] + [("a", "town", 1, i, x, y) for i, (x, y) in enumerate([(0.5, 0.5), (1.0, 0.5), (1.0, 1.0)])]
    rings = spark.createDataFrame(rows, "name string, kind string, ring int, pos int, x double, y double")
    writers.write_geojson(rings, str(tmp_path / "g"))
    back = readers.read_geojson(spark, str(tmp_path / "g")).select("name", "kind", "ring", "pos", "x", "y").collect()
    assert sorted(map(tuple, back)) == sorted(rows)


def test_xml_and_curves(spark, tmp_path):
    (tmp_path / "u.xml").write_text("<Units><Unit><Id>1</Id><Power>5.5</Power></Unit><Unit><Id>2</Id></Unit></Units>")
    got = readers.read_xml(spark, str(tmp_path / "u.xml"), "Unit", "Id string, Power string").orderBy("Id").collect()
    assert [tuple(r) for r in got] == [("1", "5.5"), ("2", None)]
    (tmp_path / "c.csv").write_text("maker,turbine,kW at 3 m/s\n'A, B','T''1',0\n")
    assert readers.read_csv(spark, str(tmp_path / "c.csv"), "maker string, turbine string, kw double", quote="'").first()["maker"] == "A, B"


def test_node_files(spark, tmp_path):
    spark.range(2).write.parquet(str(tmp_path / "node_51.3_-11.0.parquet"))
    got = readers.read_node_files(spark, str(tmp_path / "node_*")).collect()
    assert {(r["node_lat"], r["node_lon"]) for r in got} == {(513, -110)}


def test_stores(spark, tmp_path):
    path = str(tmp_path / "store")
    row = lambda *x: spark.createDataFrame(list(x), "model string, fold int, mae double")
    writers.upsert_parquet(row(("a", 1, 1.0), ("a", None, 2.0)), path, ["model", "fold"])
    writers.upsert_parquet(row(("a", None, 3.0), ("b", 1, 4.0)), path, ["model", "fold"])
    writers.upsert_parquet(row(("a", None, 3.0)).limit(0), path, ["model", "fold"])
    assert sorted(map(tuple, spark.read.parquet(path).collect()), key=repr) == [("a", 1, 1.0), ("a", None, 3.0), ("b", 1, 4.0)]
    writers.replace_parquet(row(("b", 9, 9.0)), path, F.col("model") == "b")
    assert sorted(r["mae"] for r in spark.read.parquet(path).collect()) == [1.0, 3.0, 9.0]
    log = str(tmp_path / "log")
    writers.append_rows(row(("a", 1, 1.0)), log)
    writers.append_rows(row(("a", 1, 1.0)), log)
    assert spark.read.parquet(log).count() == 2
    with pytest.raises(ValueError, match="columns"):
        writers.append_rows(spark.range(1), log)
    writers.write_report(row(("a", 1, 1.0)), str(tmp_path / "md"), "Gap", F.format_string("- %s: %.1f", "model", "mae"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "md")).collect()][0] == "# Gap"


def fake(url):
    lat = url.split("latitude=")[1].split("&")[0].split(",")
    one = [{"hourly": {"time": ["2024-01-01T00:00"], "t": [float(x)]}} for x in lat]
    return one if len(one) > 1 else one[0]


def meter(url):
    if "bad" in url:
        raise OSError("down")
    return {"url": url}


def test_rest_sources(spark, tmp_path):
    rest.register(spark)
    got = spark.read.format("gridcast_weather").option("nodes", "513:110,514:111,513:110,515:1").option("variables", "t").option("batch", 2).option("transport", "tests.test_sources:fake").load().collect()
    assert sorted((r["node_lat"], r["node_lon"], r["t"]) for r in got) == [(513, 110, 51.3), (514, 111, 51.4), (515, 1, 51.5)]
    s = spark.readStream.format("gridcast_meters").option("regions", "x,bad").option("polls", str(tmp_path / "p")).option("transport", "tests.test_sources:meter").load()
    q = s.writeStream.format("parquet").option("path", str(tmp_path / "m")).option("checkpointLocation", str(tmp_path / "c")).trigger(once=True).start()
    q.awaitTermination(60)
    rows = spark.read.parquet(str(tmp_path / "m")).collect()
    got = {r["region"]: r for r in rows}
    assert json.loads(got["x"]["json"])["url"].startswith("?region=x") and got["x"]["error"] is None
    assert got["bad"]["json"] is None and "down" in got["bad"]["error"]


def test_lanes_share_the_pace_and_the_budget(monkeypatch):
    slept = []
    monkeypatch.setattr(rest.time, "sleep", slept.append)
    nodes = ",".join(f"{500 + i}:{i}" for i in range(12))
    reader = rest.WeatherReader({"nodes": nodes, "variables": "t", "batch": "2", "lanes": "3", "pause": "2", "budget": "5", "transport": "tests.test_sources:fake"})
    lanes = reader.partitions()
    assert [len(x.batches) for x in lanes] == [2, 2, 1]
    assert len([row for lane in lanes for row in reader.read(lane)]) == 10 and slept == [6.0] * 5


def test_a_poll_read_again_is_the_same(tmp_path):
    reader = rest.MeterReader({"regions": "x,bad", "polls": str(tmp_path / "p"), "transport": "tests.test_sources:counted"})
    assert reader.latestOffset() == {"seq": 1} == reader.latestOffset()  # not moved on while nothing is read
    first = [row for p in reader.partitions({"seq": 0}, {"seq": 1}) for row in reader.read(p)]
    again = rest.MeterReader(reader.options)
    assert first == [row for p in again.partitions({"seq": 0}, {"seq": 1}) for row in again.read(p)]
    assert first[0][3] is None and "down" in first[1][3]
    assert reader.latestOffset() == {"seq": 2} == again.latestOffset()
    for seq in (1, 2, 3):
        again.poll("x", seq)
    rest.MeterReader(reader.options | {"kept": "1"}).commit({"seq": 4})
    assert sorted(p.name for p in (tmp_path / "p").iterdir()) == [f"{3:012d}"]


POLLS = iter(range(1, 1000))


def counted(url):
    """A reply that no second call repeats."""
    if "bad" in url:
        raise OSError("down")
    return {"call": next(POLLS), "at": datetime.now().isoformat()}


def test_a_query_stopped_before_its_commit_gives_the_same_batch(spark, tmp_path):
    """Stopped when the sink has the batch but the commit is not logged; the restarted query reads the same replies."""
    rest.register(spark)
    how = {"regions": "x,y", "polls": str(tmp_path / "p"), "transport": "tests.test_sources:counted"}
    seen = []

    def sink(batch, number):
        seen.append((number, sorted(map(tuple, batch.collect()))))
        if len(seen) == 1:
            raise RuntimeError("stopped")

    for attempt in range(2):
        q = spark.readStream.format("gridcast_meters").options(**how).load().writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "c")).trigger(once=True).start()
        if attempt:
            q.awaitTermination(60)
        else:
            with pytest.raises(Exception, match="stopped"):
                q.awaitTermination(60)
    assert len(seen) >= 2 and seen[0] == seen[1] and len(seen[0][1]) == 2


def test_the_poll_driver_appends_polls(spark, tmp_path):
    how = {"regions": "x,y", "polls": str(tmp_path / "p"), "transport": "tests.test_sources:counted"}
    q = rest.poll_meters(spark, how, str(tmp_path / "m"), str(tmp_path / "c"), "1 second")
    until = time.time() + 90
    while time.time() < until and (q.lastProgress is None or q.lastProgress["batchId"] < 1):
        time.sleep(0.2)
    q.stop()
    rows = spark.read.parquet(str(tmp_path / "m")).select("region", "seq").collect()
    assert {("x", 0), ("y", 0), ("x", 1), ("y", 1)} <= set(map(tuple, rows)) and len(rows) == len(set(rows))


def test_a_forecast_request_names_days_ahead():
    reader = rest.WeatherReader({"nodes": "513:110", "variables": "t,u", "url": "http://w", "forecast_days": "2", "timezone": "UTC"})
    assert reader.url([(513, 110)]) == "http://w?latitude=51.3&longitude=11.0&hourly=t,u&forecast_days=2&timezone=UTC"
    reader = rest.WeatherReader({"nodes": "513:110", "variables": "t", "start": "2024-01-01", "end": "2024-01-02"})
    assert reader.url([(513, 110)]) == "?latitude=51.3&longitude=11.0&hourly=t&start_date=2024-01-01&end_date=2024-01-02"


def test_retries_and_pauses():
    class Busy(Exception):
        code, reason = 429, "hourly limit"

    calls, slept = [], []

    def get(url):
        calls.append(url)
        if len(calls) < 3:
            raise Busy
        return 1

    assert rest.fetch(get, "u", sleep=slept.append) == 1 and len(slept) == 2 and all(0 < s <= 3601 for s in slept)
    with pytest.raises(ValueError):
        rest.fetch(lambda u: (_ for _ in ()).throw(ValueError()), "u")


def test_config(tmp_path):
    (tmp_path / "a.json").write_text('{"a": 1}')
    (tmp_path / "b.json").write_text("[1]")
    assert readers.read_config(str(tmp_path / "a.json")) == {"a": 1}
    with pytest.raises(ValueError):
        readers.read_config(str(tmp_path / "b.json"))


def days(url):
    first, last = (url.split(f"{k}_date=")[1].split("&")[0] for k in ("start", "end"))
    return [{"hourly": {"time": [f"{last}T00:00"], "t": [float(x)]}} for x in url.split("latitude=")[1].split("&")[0].split(",")] if first else []


def test_runs_of_a_day_share_its_budget(spark, tmp_path):
    """Fifteen nodes from two start days, two nodes a request: eight requests in all, of which a day allows five."""
    path = str(tmp_path / "w")
    old = [(500 + i, 0, datetime(2024, 1, 1 + i % 2), 1.0) for i in range(15)]
    stores.publish(spark.createDataFrame(old, "node_lat int, node_lon int, ts timestamp_ntz, t double"), path, rest.NODE_KEYS)
    how = {"variables": "t", "batch": "2", "transport": "tests.test_sources:days"}
    assert rest.extend_store(spark, path, how, "2024-01-03", daily=5) == 5 == ledger.used(spark, path)
    assert rest.extend_store(spark, path, how, "2024-01-03", daily=5) == 0
    new = lambda: stores.read_store(spark, path).filter("day(ts) = 3").count()
    assert new() == 10  # four requests for the eight nodes furthest behind, one for two others
    assert ledger.reserve(spark, path, 4, daily=7) == 2 and ledger.reserve(spark, path, 4, daily=7) == 0
    assert rest.extend_store(spark, path, how, "2024-01-03", daily=100) > 0 and new() == 15
    assert ledger.used(spark, path, "2001-01-01") == 0


def test_a_second_run_waits_or_raises(spark, tmp_path):
    path = str(tmp_path / "w")
    with ledger.lease(spark, path, 60):
        with pytest.raises(ledger.LeaseHeld), ledger.lease(spark, path):
            pass
        slept = []
        with pytest.raises(ledger.LeaseHeld), ledger.lease(spark, path, wait=0.2, sleep=lambda s: slept.append(s) or time.sleep(s)):
            pass
        assert slept
    with ledger.lease(spark, path, 0.01):  # ends at once, its holder goes on
        time.sleep(0.05)
        with ledger.lease(spark, path, 60) as taken:
            assert taken
    with ledger.lease(spark, path, 60):
        pass
    assert not list((tmp_path / "w").glob("_lease*"))
