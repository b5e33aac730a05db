"""REST sources as Python data sources: weather in batches, meters as a stream.

The transport is a parameter (an importable ``module:function`` from URL to parsed JSON), so tests and replays need no network.
Batches of nodes are dealt to ``lanes``; each lane is one partition and pauses so long after a request that all lanes together keep
the pace of a rate-limited service. A ``budget`` bounds the requests of one read: batches beyond it are left for the next run, which
``extend_store`` takes up where the store ends, within what the ledger has left of the day. Failures back off and retry.

Meters are polled in the tasks, one for each region, and each reply is written to shared storage before it is handed on: a batch that is read again, in the same
run or after a restart from its checkpoint, is the same.
"""

from __future__ import annotations

import importlib
import json
import time
import urllib.request
import uuid
from collections.abc import Iterator
from urllib.parse import quote

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from .ledger import DAILY, lease, reserve

RETRY_CODES = (429, 500, 502, 503, 504)
NODE_KEYS = ["node_lat", "node_lon", "ts"]


def http_json(url: str):
    with urllib.request.urlopen(url, timeout=60) as reply:  # noqa: S310
        return json.load(reply)


def transport(name: str | None):
    if not name:
        return http_json
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


def rate_limit_pause(reason: str, attempt: int) -> float:
    """Seconds to wait after a refusal, by the service's reason: to the next minute, hour or day, else doubling."""
    now = time.gmtime()
    low = (reason or "").lower()
    if "minut" in low:
        return 61.0 - now.tm_sec
    if "hour" in low:
        return 3601.0 - now.tm_min * 60 - now.tm_sec
    if "dai" in low or "day" in low:
        return 86401.0 - now.tm_hour * 3600 - now.tm_min * 60 - now.tm_sec
    return float(2 ** (attempt + 1))


def fetch(get, url: str, retries: int = 4, sleep=time.sleep):
    """The parsed reply; refusals and server errors are tried again after a pause."""
    for attempt in range(retries + 1):
        try:
            return get(url)
        except Exception as error:  # noqa: BLE001
            if attempt == retries or getattr(error, "code", None) not in RETRY_CODES:
                raise
            sleep(rate_limit_pause(str(getattr(error, "reason", "")), attempt))
    raise RuntimeError("unreachable")


class Lane(InputPartition):
    def __init__(self, batches: list[list[tuple[int, int]]]):
        self.batches = batches


class WeatherSource(DataSource):
    """Options: nodes (``lat:lon`` in tenths of a degree, comma-separated), variables, url, start and end or forecast_days (and past_days), timezone, apikey,
    batch, pause, lanes, budget, transport."""

    @classmethod
    def name(cls) -> str:
        return "gridcast_weather"

    def schema(self) -> str:
        return "node_lat int, node_lon int, ts string, " + ", ".join(f"{v} double" for v in self.options["variables"].split(","))

    def reader(self, schema) -> DataSourceReader:
        return WeatherReader(dict(self.options))


class WeatherReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options
        self.variables = options["variables"].split(",")

    def batches(self) -> list[list[tuple[int, int]]]:
        nodes = sorted({tuple(int(x) for x in n.split(":")) for n in self.options["nodes"].split(",") if n})
        size = int(self.options.get("batch", 5))
        return [nodes[i : i + size] for i in range(0, len(nodes), size)]

    def partitions(self) -> list[Lane]:
        own = self.batches()[: int(self.options["budget"]) if "budget" in self.options else None]
        lanes = max(1, int(self.options.get("lanes", 1)))
        return [Lane(own[i::lanes]) for i in range(min(lanes, len(own)))] or [Lane([])]

    def url(self, nodes: list[tuple[int, int]]) -> str:
        """One request for a batch: a forecast where ``forecast_days`` is given, else the days from start to end."""
        lat, lon = (",".join(f"{n[i] / 10:.1f}" for n in nodes) for i in (0, 1))
        query = {"latitude": lat, "longitude": lon, "hourly": ",".join(self.variables)}
        if "forecast_days" in self.options:
            query["forecast_days"] = self.options["forecast_days"]
        else:
            query |= {"start_date": self.options.get("start", ""), "end_date": self.options.get("end", "")}
        query |= {k: self.options[k] for k in ("past_days", "timezone", "apikey") if k in self.options}
        return f"{self.options.get('url', '')}?{'&'.join(f'{k}={v}' for k, v in query.items())}"

    def read(self, partition: Lane) -> Iterator[tuple]:
        get = transport(self.options.get("transport"))
        pause = float(self.options.get("pause", 0)) * max(1, int(self.options.get("lanes", 1)))
        for nodes in partition.batches:
            url = self.url(nodes)
            found = fetch(get, url, int(self.options.get("retries", 4)))
            time.sleep(pause)
            for node, item in zip(nodes, found if isinstance(found, list) else [found], strict=True):
                hourly = item.get("hourly") or {}
                for i, ts in enumerate(hourly.get("time") or []):
                    yield (*node, ts, *[None if (v := hourly.get(name, [None] * (i + 1))[i]) is None else float(v) for name in self.variables])


class MeterSource(DataSource):
    """A stream of meter readings as JSON text. Options: regions (comma-separated), polls (a shared folder for the replies), url, most (polls in one
    batch), transport."""

    @classmethod
    def name(cls) -> str:
        return "gridcast_meters"

    def schema(self) -> str:
        return "region string, seq bigint, json string, error string"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return MeterReader(dict(self.options))


class Poll(InputPartition):
    def __init__(self, region: str, seq: int):
        self.region, self.seq = region, seq


class MeterReader(DataSourceStreamReader):
    """One poll of all regions an offset, a partition for each region. A region that fails is a row without JSON but with the error."""

    def __init__(self, options: dict):
        self.options = options
        self.regions = options["regions"].split(",")
        self.offered = None

    def _files(self):
        from pyarrow import fs

        where = self.options["polls"]
        return fs.FileSystem.from_uri(where) if "://" in where else (fs.LocalFileSystem(), where)

    def _name(self, folder: str, region: str, seq: int) -> str:
        return f"{folder}/{seq:012d}/{quote(region, safe='')}.json"

    def initialOffset(self) -> dict:
        return {"seq": 0}

    def latestOffset(self) -> dict:
        """The poll after the last one that has replies: a poll that was begun is ended before the next."""
        from pyarrow import fs

        files, folder = self._files()
        found = files.get_file_info(fs.FileSelector(folder, allow_not_found=True))
        last = max((int(i.base_name) for i in found if i.base_name.isdigit()), default=-1)
        self.offered = last + 2 if self.offered is None or self.offered == last + 1 else self.offered
        return {"seq": self.offered}

    def partitions(self, start: dict, end: dict) -> list[Poll]:
        return [Poll(region, seq) for seq in range(start["seq"], end["seq"]) for region in self.regions]

    def read(self, partition: Poll) -> Iterator[tuple]:
        yield self.poll(partition.region, partition.seq)

    def poll(self, region: str, seq: int) -> tuple:
        """A region's reply to a poll: what was kept of it, else a new one, which is kept first."""
        from pyarrow import fs

        files, folder = self._files()
        name = self._name(folder, region, seq)
        if files.get_file_info(name).type == fs.FileType.NotFound:
            try:
                reply = {"json": json.dumps(fetch(transport(self.options.get("transport")), f"{self.options.get('url', '')}?region={region}&seq={seq}", 1, lambda s: None)), "error": None}
            except Exception as error:  # noqa: BLE001  the other regions are polled nonetheless
                reply = {"json": None, "error": f"{type(error).__name__}: {error}"}
            files.create_dir(name.rpartition("/")[0], recursive=True)
            staged = f"{name}.{uuid.uuid4().hex}"
            with files.open_output_stream(staged) as out:
                out.write(json.dumps(reply).encode())
            files.move(staged, name)
        with files.open_input_stream(name) as held:
            reply = json.loads(held.read())
        return region, seq, reply["json"], reply["error"]

    def commit(self, end: dict) -> None:
        """Replies of polls long committed go; the last ones stay, as they tell where the polls stand."""
        from pyarrow import fs

        files, folder = self._files()
        for i in files.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
            if i.base_name.isdigit() and int(i.base_name) < end["seq"] - int(self.options.get("kept", 100)):
                files.delete_dir(i.path)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WeatherSource)
    spark.dataSource.register(MeterSource)


def extend_store(spark: SparkSession, path: str, options: dict[str, str], end: str, daily: int = DAILY, wait: float = 0) -> int:
    """Fetch what each node of a weather store misses up to ``end`` and upsert it by node and time; all-null hours are dropped.

    All start days, and all runs of a day, share the day's budget of requests; what it leaves out the next run takes up. One run at a time holds the store's
    lease; another waits ``wait`` seconds for it, then raises. Returns the number of requests.
    """
    from pyspark.sql import functions as F

    from ..operators.clean import drop_all_null
    from .stores import read_store, upsert_store

    register(spark)
    names, size, made = options["variables"].split(","), int(options.get("batch", 5)), 0
    with lease(spark, path, wait=wait) as run:
        last = read_store(spark, path).groupBy("node_lat", "node_lon").agg(F.date_format(F.max("ts"), "yyyy-MM-dd").alias("start"))
        # One request series for each start day, the longest behind first; nodes are a registry of some hundred.
        for row in last.groupBy("start").agg(F.collect_set(F.concat_ws(":", "node_lat", "node_lon")).alias("nodes")).orderBy("start").collect():
            granted = reserve(spark, path, -(-len(row["nodes"]) // size), daily, run)
            if not granted:
                break
            made += granted
            df = spark.read.format("gridcast_weather").options(**options, nodes=",".join(sorted(row["nodes"])), start=row["start"], end=end, budget=granted).load()
            new = drop_all_null(df.withColumn("ts", F.to_timestamp_ntz(F.replace(F.col("ts"), F.lit("T"), F.lit(" ")), F.lit("yyyy-MM-dd HH:mm"))), names)
            upsert_store(new, path, NODE_KEYS)
    return made


def poll_meters(spark: SparkSession, options: dict[str, str], sink: str, checkpoint: str, every: str = "15 minutes"):
    """The poll driver: one poll of all regions ``every`` so often, appended to a Parquet folder; returns the running query."""
    register(spark)
    rows = spark.readStream.format("gridcast_meters").options(**options).load()
    return rows.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(processingTime=every).start()
