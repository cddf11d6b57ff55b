"""Structured Streaming jobs over event and conversation logs.

Each query runs its stream to the end of the input (`availableNow`) into a table that the batch twin equals.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lectern.registry import register
from lectern.storage import scratch


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log as a stream, with a time column that watermarks accept."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events*.parquet").withColumn("at", F.col("ts").cast("timestamp"))


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over all there is and return what it wrote."""
    spark = stream.sparkSession
    path, state = scratch(spark, "out"), scratch(spark, "state")
    stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def keep_latest(stream: DataFrame, keys: list[str]) -> DataFrame:
    """Run an updating aggregate; each micro-batch replaces the rows of its keys."""
    spark = stream.sparkSession
    path, state = scratch(spark, "out"), scratch(spark, "state")

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("append").parquet(path)

    stream.writeStream.outputMode("update").option("checkpointLocation", state).foreachBatch(write).trigger(availableNow=True).start().awaitTermination()
    found = spark.read.parquet(path)
    rest = [c for c in found.columns if c not in keys and c != "_batch"]
    return found.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_batch").alias("r")).select(*keys, "r.*")


def token_bucket(per_minute: float, capacity: float) -> Callable:
    """Decisions of a refilling bucket per client; idle clients are forgotten after an hour of event time."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        tokens, last = state.get if state.exists else (capacity, 0.0)
        rows = pd.concat(list(parts)).sort_values(["at", "event_id"])
        out = []
        for event, at in zip(rows["event_id"], rows["at"].astype("int64") / 1e9 if rows["at"].dtype.kind == "M" and rows["at"].dtype.name.startswith("datetime64[ns") else rows["at"].map(lambda t: t.timestamp()), strict=True):
            tokens = min(capacity, tokens + max(0.0, at - last) * per_minute / 60) if last else tokens
            last = max(last, at)
            allowed = tokens >= 1
            tokens -= allowed
            out.append((key[0], event, bool(allowed), float(tokens)))
        state.update((float(tokens), float(last)))
        state.setTimeoutTimestamp(max(int(last * 1000) + 3_600_000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["user_id", "event_id", "allowed", "remaining"])

    return run


def limited(stream: DataFrame, per_minute: float = 0.02, capacity: float = 3) -> DataFrame:
    kind = "user_id long, event_id long, allowed boolean, remaining double"
    rows = stream.withWatermark("at", "1 hour").select("user_id", "event_id", "at")
    return rows.groupBy("user_id").applyInPandasWithState(token_bucket(per_minute, capacity), kind, "tokens double, last double", "append", GroupStateTimeout.EventTimeTimeout)


register("stream_token_bucket", lambda s, d: drain(limited(events(s, d))))


def fold_context(limit: int = 50) -> Callable:
    """Books mentioned in a conversation, in the order of first mention, at most limit of them."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        books = list(state.get[0]) if state.exists else []
        for book in pd.concat(list(parts)).sort_values("turn")["book_id"].tolist():
            if book not in books:
                books.append(book)
        books = books[:limit]
        state.update((books,))
        yield pd.DataFrame({"conv_id": [key[0]], "mentioned": [len(books)], "first_book": [books[0]], "last_book": [books[-1]]})

    return run


def _context(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/conversations.parquet").schema
    books = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    turns = spark.readStream.schema(schema).parquet(f"{sf_dir}/conversations*.parquet").select("conv_id", "turn", ((F.col("conv_id") * 7 + F.col("turn")) % books).alias("book_id"))
    folded = turns.groupBy("conv_id").applyInPandasWithState(fold_context(), "conv_id long, mentioned long, first_book long, last_book long", "books array<long>", "update", GroupStateTimeout.NoTimeout)
    return keep_latest(folded, ["conv_id"])


register("stream_context_fold", _context, ["turns"], "select conv_id, count(distinct book_id) as mentioned, arg_min(book_id, turn) as first_book, arg_max(book_id, turn) as last_book from turns group by conv_id")


def log(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder as a stream."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}*.parquet")


def fixed_windows(stream: DataFrame, limit: int = 1) -> DataFrame:
    """Requests per client and minute, and whether they exceed the limit; rows later than an hour are left out."""
    counted = stream.withWatermark("at", "1 hour").groupBy(F.window("at", "1 minute").alias("w"), "user_id").agg(F.count("*").alias("requests"))
    return counted.select("user_id", F.col("w.start").alias("window_start"), "requests", (F.col("requests") > limit).alias("over_limit"))


def conversation_counters(stream: DataFrame) -> DataFrame:
    return stream.groupBy("conv_id").agg(F.count("*").alias("messages"), F.sum(F.coalesce(F.length("text"), F.lit(0)).cast("long")).alias("tokens"), F.max("turn").alias("last_turn"))


def sessions(stream: DataFrame, gap: str = "24 hours") -> DataFrame:
    """Runs of events of a user without a longer pause than the gap."""
    runs = stream.withWatermark("at", "1 hour").groupBy("user_id", F.session_window("at", gap).alias("w")).agg(F.count("*").alias("events"), F.min("at").alias("started_at"), F.max("at").alias("ended_at"))
    return runs.select("user_id", "events", "started_at", "ended_at")


def final_state(stream: DataFrame) -> DataFrame:
    """Run an aggregate over all there is; each micro-batch writes it whole, and the last one counts."""
    spark = stream.sparkSession
    path, state = scratch(spark, "out"), scratch(spark, "state")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    stream.writeStream.outputMode("complete").option("checkpointLocation", state).foreachBatch(write).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def plain_time(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.to_timestamp_ntz(F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit("yyyy-MM-dd HH:mm:ss.SSSSSS")) for c in columns})


register(
    "stream_fixed_window", lambda s, d: plain_time(keep_latest(fixed_windows(events(s, d)), ["user_id", "window_start"]), "window_start"), ["latency"],
    "select user_id, date_trunc('minute', ts) as window_start, count(*) as requests, count(*) > 1 as over_limit from latency group by user_id, date_trunc('minute', ts)",
)
register("stream_conversation_stats", lambda s, d: keep_latest(conversation_counters(log(s, d, "conversations")), ["conv_id"]), ["turns"], "select conv_id, count(*) as messages, cast(sum(coalesce(token_count, 0)) as bigint) as tokens, max(turn) as last_turn from turns group by conv_id")
register(
    "stream_session", lambda s, d: plain_time(final_state(sessions(events(s, d))), "started_at", "ended_at"), ["latency"],
    """with gaps as (select user_id, ts, event_id, case when ts - lag(ts) over (partition by user_id order by ts, event_id) < interval '24' hour then 0 else 1 end as opens from latency),
            numbered as (select *, sum(opens) over (partition by user_id order by ts, event_id rows between unbounded preceding and current row) as session_no from gaps)
       select user_id, count(*) as events, min(ts) as started_at, max(ts) as ended_at from numbered group by user_id, session_no""",
)
