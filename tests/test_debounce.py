"""A burst of changes is told of once, when it is over."""

import time
from datetime import datetime

from symweave.streaming import sync

SCHEMA = "project string, at timestamp"


def test_a_burst_gives_one_row(spark, tmp_path):
    source = str(tmp_path / "in")
    put = lambda *rows: spark.createDataFrame([(p, datetime(2024, 1, 1, 0, 0, s)) for p, s in rows], SCHEMA).coalesce(1).write.mode("append").parquet(source)
    put(("a", 1), ("a", 2), ("b", 9))
    put(("a", 5), ("a", 3))  # a batch of its own, within the quiet time
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    query = sync.debounced(stream, 12000).writeStream.format("memory").queryName("bursts").option("checkpointLocation", str(tmp_path / "check")).trigger(processingTime="300 milliseconds").start()
    try:
        until = time.time() + 90
        while time.time() < until and spark.table("bursts").count() < 2:
            time.sleep(0.5)
        time.sleep(1)
        got = {r.project: (r.n, r.first_at.second, r.last_at.second) for r in spark.table("bursts").collect()}
        assert got == {"a": (4, 1, 5), "b": (1, 9, 9)} and spark.table("bursts").count() == 2
    finally:
        query.stop()
