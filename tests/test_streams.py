"""Stateful stream jobs over several micro-batches against plain Python."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lectern.streaming import stateful

HOUR = 3_600_000


@pytest.fixture(scope="module")
def feed(spark, tmp_path_factory):
    """(rows in order, stream of three files, each a micro-batch)."""
    draw, ms, rows = random.Random(6), 1_700_000_000_000, []
    for k in range(900):
        ms += draw.choice([100, 5_000, 60_000, 20 * 60_000])
        rows.append((k, draw.choice([1, 1, 1, 2, 3, 4 if k < 200 else 1]), ms, draw.choice("ab"), draw.random() * 100))
    place = str(tmp_path_factory.mktemp("feed"))
    schema = "event_id long, user_id long, ms long, event_type string, value double"
    for k in range(3):
        spark.createDataFrame(rows[300 * k : 300 * k + 300], schema).coalesce(1).write.mode("append").parquet(f"{place}/{k}")

    def stream():
        read = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{place}/*")
        return read.withColumn("at", F.timestamp_millis("ms")).withWatermark("at", "1 minute")

    return rows, stream


def test_weighted_limits(feed):
    rows, stream = feed
    limit, window, idle = 3, 10 * 60_000, HOUR
    state, want = {}, {}
    for event, user, ms, _, _ in rows:
        start, count, last = state.get(user, (None, 0, 0))
        if start is None or ms - last > idle:
            start, count = ms, 0
        while ms - start >= window:
            start, count = start + window, 0
        weighted = count * (1 - (ms - start) / window)
        allowed = weighted < limit
        want[event] = (allowed, max(0, int(limit - weighted - 1)) if allowed else 0, window - (ms - start))
        state[user] = (start, count + allowed, ms if allowed else last)
    made = stateful.drain(stateful.weighted_limits(stream(), limit, window, idle)).collect()
    assert {r.event_id: (r.allowed, r.remaining, r.reset_ms) for r in made} == want and len(made) == len(rows)
    assert 0 < sum(a for a, _, _ in want.values()) < len(rows)


def test_expired_lives(feed):
    rows, stream = feed
    idle, lives = 2 * HOUR, defaultdict(list)
    for _, user, ms, _, _ in rows:
        if not lives[user] or ms - lives[user][-1][1] > idle:
            lives[user].append([0, ms])
        lives[user][-1][0] += 1
        lives[user][-1][1] = ms
    end = rows[-1][2] - 60_000
    want = sorted((u, n, last) for u, found in lives.items() for k, (n, last) in enumerate(found) if k + 1 < len(found) or last + idle < end)
    made = stateful.drain(stateful.expired(stream(), idle)).collect()
    assert sorted((r.user_id, r.requests, r.last_ms) for r in made) == want and want


def test_recalibration(feed):
    rows, stream = feed
    history, want = defaultdict(list), set()
    for _, _, _, kind, value in rows:
        history[kind].append((int(value // 10), value > 40))
        if len(history[kind]) % 50 == 0:
            last = history[kind][-120:]
            for bucket in {b for b, _ in last}:
                right = [c for b, c in last if b == bucket]
                want.add((kind, len(history[kind]) // 50, bucket, len(right), round(sum(right) / len(right), 9)))
    outcomes = stream().select("event_type", "event_id", "ms", F.floor(F.col("value") / 10).cast("int").alias("bucket"), (F.col("value") > 40).alias("correct"))
    made = stateful.drain(stateful.recalibrated(outcomes, 120, 50)).collect()
    assert {(r.event_type, r.round, r.bucket, r.samples, round(r.accuracy, 9)) for r in made} == want and len(made) == len(want)


def test_sketches_keep_their_rank_error(spark, feed):
    rows, stream = feed
    found = stateful.complete(stateful.latency_sketches(stream(), "1 hour"), ["event_type", "w"])
    merged = found.groupBy("event_type").agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("s"))
    for r in merged.select("event_type", "n", *[F.kll_sketch_get_quantile_double("s", F.lit(q)).alias(f"q{int(100 * q)}") for q in (0.5, 0.9, 0.99)]).collect():
        values = sorted(v for _, _, _, kind, v in rows if kind == r.event_type)
        assert r.n == len(values)  # no window is missing at the end of the input
        for q in (0.5, 0.9, 0.99):
            assert abs(sum(v <= r[f"q{int(100 * q)}"] for v in values) / len(values) - q) < 0.03
