"""Markers on a stream against the batch operator, however the stream is cut."""

import random

import pytest
from pyspark.sql import functions as F

from gapline.operators import timeseries
from gapline.streaming import markers

SCHEMA = "item int, sample_id long, sampled_at timestamp, players long"


def samples(seed):
    """Series with jumps, drops, blips, real zeros and equal times."""
    rng = random.Random(seed)
    out, number = [], 0
    for item in range(4):
        at = 1_700_000_000 + rng.randrange(100_000)
        for _ in range(120):
            at += rng.choice([0, 1, 1, 2, 3, 9]) * 3600
            number += 1
            out.append((item, number, at, rng.choice([0, 0, 6000, 9000, 12000, 18000, 30000])))
    days = [(0, 40), (1, 41), (2, 42), (3, 43), (4, 44), (5, 45), (8, 25), (11, 38)]
    return out + [(5, 1000 + d, 1_700_000_000 + d * 86_400, n * 1000) for d, n in days]


@pytest.fixture
def rocksdb(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


@pytest.mark.parametrize("cuts", [1, 3])
def test_stream_equals_batch(spark, rocksdb, tmp_path, cuts):
    rows = samples(cuts)
    frame = lambda some: spark.createDataFrame(some, "item int, sample_id long, s long, players long").select("item", "sample_id", F.timestamp_seconds("s").alias("sampled_at"), "players")
    want = {tuple(r) for r in timeseries.markers(frame(rows)).collect()}
    assert {r[3] for r in want} >= {"first_tracked", "major_surge", "major_drop", "rebound"}
    # Batches in the order of time, shuffled within; then a series of its own moves the watermark far ahead.
    rows.sort(key=lambda r: r[2])
    size = -(-len(rows) // cuts)
    parts = [random.Random(7).sample(rows[i : i + size], len(rows[i : i + size])) for i in range(0, len(rows), size)]
    end = rows[-1][2]
    parts += [[(99, 10**6 + i, end + day * 86_400, 5)] for i, day in enumerate((40, 80, 120))]
    for i, part in enumerate(parts):
        frame(part).coalesce(1).write.parquet(f"{tmp_path}/in/{i:03d}")
        stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in/*")
        query = markers.markers(stream).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").option("path", f"{tmp_path}/out").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    got = [tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").filter("item < 99").collect()]
    assert len(got) == len(set(got)) and set(got) == want
