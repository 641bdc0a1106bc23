"""Packets out of order come out of a stream as they stand in the table, across restarts."""

import datetime
import random

from cueframe.streaming.ordered import STORE, order_packet_stream, order_packets

START = datetime.datetime(2024, 1, 1)
KIND = "track string, ts timestamp, read_order long, row string, note int"


def packets(n, seed):
    rnd = random.Random(seed)
    return [(rnd.choice("ab"), START + datetime.timedelta(milliseconds=100 * i, microseconds=rnd.randint(0, 3)), i + rnd.choice([0, 0, 0, -5]), rnd.choice([None, f"row {i}"]), 1) for i in range(n)]


def key(r):
    return (r["track"], r["ordinal"])


def test_table(spark):
    rows = [("a", START, 5, "x", 0), ("a", START, 5, "x", 0), ("a", START, 3, "y", 0), ("a", None, 1, "z", 0), (None, START, 1, "z", 0), ("a", START + datetime.timedelta(1), 9, None, 0)]
    got = sorted(order_packets(spark.createDataFrame(rows, KIND)).collect(), key=key)
    assert [(r["ordinal"], r["read_order"], r["rising"]) for r in got] == [(0, 3, True), (1, 5, True), (2, 5, False), (3, 9, True)]


def test_stream_is_the_table(spark, tmp_path):
    before = spark.conf.get(STORE[0])
    spark.conf.set(*STORE)
    try:
        rows = packets(240, 3)
        rnd = random.Random(5)
        # Each comes up to three seconds late; the last one lets the others go.
        late = sorted(rows, key=lambda r: r[1] + datetime.timedelta(seconds=3 * rnd.random()))
        late.append(("end", START + datetime.timedelta(hours=1), 0, None, 1))
        want = [r for r in order_packets(spark.createDataFrame(rows, KIND)).collect()]
        source, out, state = (str(tmp_path / p) for p in ("in", "out", "state"))
        # Four runs, each stopped and started again from the checkpoint.
        for k in range(4):
            part = late[k * 61 : (k + 1) * 61]
            spark.createDataFrame(part, KIND).coalesce(1).write.mode("append").parquet(source)
            stream = order_packet_stream(spark.readStream.schema(KIND).parquet(source), "4 seconds")
            query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
            query.awaitTermination()
        got = spark.read.parquet(out).collect()
        assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, want), key=repr)
    finally:
        spark.conf.set(STORE[0], before)
