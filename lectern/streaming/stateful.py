"""Stream jobs that keep state of their own per key: limiters, expiry of idle keys, recalibration by count.

Each is a processor with named states and event-time timers (`transformWithStateInPandas`). Requests of a key are taken in
the order of time inside a micro-batch, and as they arrive between micro-batches, as a limiter must. Every request
gets its row when it comes, so nothing waits for a watermark at the end of the input.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lectern.registry import register
from lectern.storage import scratch
from lectern.streaming.jobs import events, plain_time

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY = 86_400_000


def drain(stream: DataFrame) -> DataFrame:
    """Run a stream with states over all there is; such states need the embedded store, which is set for this start only."""
    spark = stream.sparkSession
    path, state = scratch(spark, "out"), scratch(spark, "state")
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKS)
    try:
        running = stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", state).trigger(availableNow=True).start()
    finally:
        spark.conf.set(STORE, before) if before else spark.conf.unset(STORE)
    running.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def in_order(rows: Iterator[pd.DataFrame], *columns: str) -> list[tuple]:
    """Values of all rows of a key in a micro-batch, by time and number."""
    ordered = pd.concat(list(rows)).sort_values(["ms", "event_id"], kind="stable")
    return list(zip(*(ordered[c].tolist() for c in columns), strict=True))


class Limiter(StatefulProcessor):
    """A weighted counter per client: requests let through in the present window count less as the window passes.

    The first request opens the window, which moves on by whole windows. A request passes while count x (1 - share of the
    window gone) is under the limit. A client that had nothing let through for `idle` starts anew. Time never runs back.
    """

    def __init__(self, limit: int, window: int, idle: int):
        self.limit, self.window, self.idle = limit, window, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("window", "start long, count long, last long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  the interface's name
        start, count, last = self.state.get() if self.state.exists() else (None, 0, 0)
        out = []
        for event, ms in in_order(rows, "event_id", "ms"):
            ms = max(ms, last)
            if start is None or ms - last > self.idle:
                start, count = ms, 0
            if ms - start >= self.window:
                start, count = start + (ms - start) // self.window * self.window, 0
            weighted = count * (1 - (ms - start) / self.window)
            allowed = weighted < self.limit
            if allowed:
                count, last = count + 1, ms
            out.append((key[0], event, allowed, max(0, int(self.limit - weighted - 1)) if allowed else 0, self.window - (ms - start)))
        self.state.update((start, count, last))
        yield pd.DataFrame(out, columns=["user_id", "event_id", "allowed", "remaining", "reset_ms"])

    def close(self) -> None:
        pass


class Lives(StatefulProcessor):
    """Rows of clients whose state has expired: requests in that life and the last of them.

    A life ends when a client is idle for longer than `idle` of event time: by a timer once the watermark is there, or by the
    next request if that comes first.
    """

    def __init__(self, idle: int):
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("life", "requests long, last long, timer long")

    def _rows(self, key, found: list[tuple[int, int]]) -> pd.DataFrame:
        return pd.DataFrame({"user_id": [key[0]] * len(found), "requests": [f[0] for f in found], "last_ms": [f[1] for f in found]}).astype("int64")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        requests, last, timer = self.state.get() if self.state.exists() else (0, 0, 0)
        ended = []
        for (ms,) in in_order(rows, "ms"):
            if requests and ms - last > self.idle:
                ended.append((requests, last))
                requests = 0
            requests, last = requests + 1, max(last, ms)
        if timer:
            self.handle.deleteTimer(timer)
        timer = last + self.idle + 1
        self.handle.registerTimer(timer)
        self.state.update((requests, last, timer))
        yield self._rows(key, ended)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        requests, last, _ = self.state.get()
        self.state.clear()
        yield self._rows(key, [(requests, last)])

    def close(self) -> None:
        pass


class Calibration(StatefulProcessor):
    """Every `every` outcomes of a stage, how often predictions of each tenth were right among the last `kept`."""

    def __init__(self, kept: int, every: int):
        self.kept, self.every = kept, every

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "n long")
        self.recent = handle.getListState("recent", "bucket int, correct boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        n = self.seen.get()[0] if self.seen.exists() else 0
        recent = deque(self.recent.get() if self.recent.exists() else [], maxlen=self.kept)
        out = []
        for outcome in in_order(rows, "bucket", "correct"):
            recent.append(outcome)
            n += 1
            if n % self.every == 0:
                found: dict[int, list[int]] = {}
                for bucket, correct in recent:
                    hits = found.setdefault(bucket, [0, 0])
                    hits[0] += 1
                    hits[1] += bool(correct)
                out += [(key[0], n // self.every, bucket, samples, right / samples) for bucket, (samples, right) in found.items()]
        self.seen.update((n,))
        self.recent.put([(int(b), bool(c)) for b, c in recent])
        yield pd.DataFrame(out, columns=["event_type", "round", "bucket", "samples", "accuracy"]).astype({"event_type": "object", "round": "int64", "bucket": "int32", "samples": "int64", "accuracy": "float64"})

    def close(self) -> None:
        pass


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).withWatermark("at", "1 hour").withColumn("ms", F.unix_millis("at")).where("user_id is not null and ms is not null")


def weighted_limits(stream: DataFrame, limit: int, window: int, idle: int) -> DataFrame:
    """(user_id, event_id, allowed, remaining, reset_ms) of each request."""
    rows = stream.select("user_id", "event_id", "ms", "at")
    return rows.groupBy("user_id").transformWithStateInPandas(Limiter(limit, window, idle), "user_id long, event_id long, allowed boolean, remaining long, reset_ms long", "Append", "None")


def expired(stream: DataFrame, idle: int) -> DataFrame:
    """(user_id, requests, last_ms) of states that expired."""
    return stream.select("user_id", "event_id", "ms", "at").groupBy("user_id").transformWithStateInPandas(Lives(idle), "user_id long, requests long, last_ms long", "Append", "EventTime")


def recalibrated(stream: DataFrame, kept: int = 500, every: int = 100) -> DataFrame:
    """(event_type, round, bucket, samples, accuracy); stream has event_type, event_id, ms, bucket, correct."""
    return stream.groupBy("event_type").transformWithStateInPandas(Calibration(kept, every), "event_type string, round long, bucket int, samples long, accuracy double", "Append", "None")


def latency_sketches(stream: DataFrame, window: str = "1 day") -> DataFrame:
    """(event_type, w, n, least, greatest, sketch) of each event-time window; late rows beyond the watermark are left out.

    The sketches (KLL, k = 200: a rank error of 1.65 % at 99 % confidence) have a fixed size and can be merged over windows.
    """
    return stream.groupBy("event_type", F.window("at", window).alias("w")).agg(F.count("*").alias("n"), F.min("value").alias("least"), F.max("value").alias("greatest"), F.kll_sketch_agg_double("value").alias("sketch"))


def complete(stream: DataFrame, keys: list[str]) -> DataFrame:
    """Run a windowed aggregate in update mode and merge each micro-batch into a table by key: open windows are there too."""
    spark = stream.sparkSession
    path, state = scratch(spark, "out"), scratch(spark, "state")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number:012d}")

    stream.writeStream.outputMode("update").option("checkpointLocation", state).foreachBatch(write).trigger(availableNow=True).start().awaitTermination()
    rest = [c for c in stream.columns if c not in keys]
    found = spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])).parquet(path)
    return found.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*keys, "r.*")


def latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of each stage on demand: the windows' sketches merged."""
    found = complete(latency_sketches(requests(spark, sf_dir)), ["event_type", "w"])
    merged = found.groupBy("event_type").agg(F.count("*").alias("windows"), F.sum("n").alias("n"), F.min("least").alias("least"), F.max("greatest").alias("greatest"), F.kll_merge_agg_double("sketch").alias("sketch"))
    return merged.select("event_type", "windows", "n", "least", "greatest", *[F.kll_sketch_get_quantile_double("sketch", F.lit(q)).alias(name) for q, name in ((0.5, "p50"), (0.9, "p90"), (0.95, "p95"), (0.99, "p99"))])


def sliding_counts(stream: DataFrame) -> DataFrame:
    """Requests per client in sliding windows."""
    counted = stream.groupBy(F.window("at", "1 hour", "30 minutes").alias("w"), "user_id").agg(F.count("*").alias("requests"))
    return counted.select("user_id", F.col("w.start").alias("window_start"), "requests")


LIMIT, IDLE = 2, 3 * DAY

register(
    "stream_sliding_limit", lambda s, d: drain(weighted_limits(requests(s, d), LIMIT, DAY, IDLE)), ["latency"],
    f"""with recursive r as (select user_id, event_id, (epoch_us(ts) // 1000) as ms, row_number() over (partition by user_id order by (epoch_us(ts) // 1000), event_id) as i from latency),
          walk as (
            select user_id, event_id, i, ms as start, 1::bigint as count, ms as last, true as allowed, 0::double as weighted, ms from r where i = 1
            union all
            select user_id, event_id, i, start, case when ok then count + 1 else count end, case when ok then ms else last end, ok, weighted, ms from (
              select *, weighted < {LIMIT} as ok from (
                select *, count * (1 - (ms - start)::double / {DAY}) as weighted from (
                  select user_id, event_id, i, ms, last, case when fresh then ms when ms - start >= {DAY} then start + (ms - start) // {DAY} * {DAY} else start end as start, case when fresh or ms - start >= {DAY} then 0 else count end as count
                  from (select n.user_id, n.event_id, n.i, n.ms, w.start, w.count, w.last, n.ms - w.last > {IDLE} as fresh from walk w join r n on n.user_id = w.user_id and n.i = w.i + 1)))))
        select user_id, event_id, allowed, case when allowed then greatest(0, cast(trunc({LIMIT} - weighted - 1) as bigint)) else 0 end as remaining, {DAY} - (ms - start) as reset_ms from walk""",
)
register(
    "stream_sliding_windows", lambda s, d: plain_time(complete(sliding_counts(requests(s, d)), ["user_id", "window_start"]), "window_start"), ["latency"],
    """with w as (select user_id, unnest([time_bucket(interval '30 minutes', ts), time_bucket(interval '30 minutes', ts) - interval '30 minutes']) as window_start from latency)
       select user_id, window_start, count(*) as requests from w group by user_id, window_start""",
)
register(
    "stream_state_ttl", lambda s, d: drain(expired(requests(s, d), IDLE)), ["latency"],
    f"""with r as (select user_id, (epoch_us(ts) // 1000) as ms, event_id, lag((epoch_us(ts) // 1000)) over (partition by user_id order by (epoch_us(ts) // 1000), event_id) as before from latency),
          lives as (select *, sum(case when ms - before > {IDLE} then 1 else 0 end) over (partition by user_id order by ms, event_id rows unbounded preceding) as life from r),
          ended as (select user_id, life, count(*) as requests, max(ms) as last_ms, max(life) over (partition by user_id) as final from lives group by user_id, life)
        select user_id, requests, last_ms from ended where life < final or last_ms + {IDLE} < (select max((epoch_us(ts) // 1000)) - 3600000 from latency)""",
)


def _outcomes(s: SparkSession, d: str) -> DataFrame:
    share = F.least(F.lit(1.0), F.col("value") / 100)
    return requests(s, d).select("event_type", "event_id", "ms", F.bround(share * 10, 0).cast("int").alias("bucket"), (F.col("event_id") % 100 < F.col("value")).alias("correct"))


register(
    "stream_calibration", lambda s, d: drain(recalibrated(_outcomes(s, d))).select("event_type", "round", "bucket", "samples", F.round("accuracy", 6).alias("accuracy")), ["latency"],
    """with o as (select stage, row_number() over (partition by stage order by (epoch_us(ts) // 1000), event_id) as i, cast(round_even(least(1.0, ms / 100) * 10, 0) as int) as bucket, event_id % 100 < ms as correct from latency),
          rounds as (select stage, unnest(range(1, cast(max(i) // 100 + 1 as bigint))) as round from o group by stage)
       select r.stage as event_type, r.round, o.bucket, count(*) as samples, round(avg(case when o.correct then 1.0::double else 0 end), 6) as accuracy
       from rounds r join o on o.stage = r.stage and o.i between r.round * 100 - 499 and r.round * 100 group by r.stage, r.round, o.bucket""",
)
register("stream_latency", latency)
