import os
from datetime import datetime, timedelta

import pytest

from dealscope.streaming import sessions

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    """Files in order of time; the last event of another key comes much later and closes what is open."""
    start = datetime(2024, 1, 1)
    rows = [(k, f"k{k * 7 % 5}", start + timedelta(minutes=(k * k) % 50 + 40 * k), (k // 6) % 4) for k in range(60)]
    rows.sort(key=lambda r: (r[2], r[0]))
    at = str(tmp_path_factory.mktemp("events"))
    for n in range(0, 60, 20):
        spark.createDataFrame(rows[n : n + 20], "id long, key string, ts timestamp, price long").coalesce(1).write.mode("append").parquet(f"{at}/{n:03}")
    spark.createDataFrame([(99, "end", start + timedelta(days=90), 1)], "id long, key string, ts timestamp, price long").coalesce(1).write.parquet(f"{at}/999")
    return at, rows


def replayed(spark, df, at, mark):
    out = f"{mark}/out"
    q = df.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{mark}/mark").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert not q.isActive
    return sorted(map(tuple, spark.read.parquet(out).collect()))


def stream(spark, at):
    return spark.readStream.schema("id long, key string, ts timestamp, price long").option("maxFilesPerTrigger", 1).parquet(f"{at}/*")


def test_sessions_of_a_stream_equal_those_of_the_table(spark, events, tmp_path):
    at, rows = events
    table = spark.read.schema("id long, key string, ts timestamp, price long").parquet(f"{at}/*")
    batch = sorted(map(tuple, sessions.session_totals(table, "ts", "key", "price", "3 hours").collect()))
    plain = {}
    for _, key, ts, price in rows:
        own = plain.setdefault(key, [])
        if own and ts - own[-1][1] < timedelta(hours=3):
            own[-1][1:] = [ts, own[-1][2] + 1, own[-1][3] + price]
        else:
            own.append([ts, ts, 1, price])
    want = sorted((k, a, b + timedelta(hours=3), n, t) for k, own in plain.items() for a, b, n, t in own)
    assert [r for r in batch if r[0] != "end"] == want and len(want) > 8
    assert replayed(spark, sessions.session_totals(stream(spark, at), "ts", "key", "price", "3 hours"), at, str(tmp_path)) == want


def test_changes_of_a_stream_equal_those_of_the_table(spark, events, tmp_path):
    at, _ = events
    table = spark.read.schema("id long, key string, ts timestamp, price long").parquet(f"{at}/*")
    want = sorted(map(tuple, sessions.changes(table, "key", "ts", "price", "id").collect()))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:
        got = replayed(spark, sessions.change_stream(stream(spark, at), "key", "ts", "price", "id"), at, str(tmp_path))
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert got == want and len(want) > 10 and os.path.isdir(tmp_path)
