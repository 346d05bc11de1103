import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from statewright.operators import counts
from statewright.streaming import live

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_windows_add_up_to_the_batch_count(rocks, tmp_path):
    rng = random.Random(5)
    rows = [(s, t, 60 * t + s, rng.choice("ab"), rng.choice("01")) for s, n in ((1, 40), (2, 23), (3, 2)) for t in range(n)]
    symbols = rocks.createDataFrame(rows, "series_id long, t long, at long, x string, y string").withColumn("ts", F.timestamp_seconds("at")).drop("at")
    for i, (low, high) in enumerate(((0, 900), (900, 1500), (1500, 9000))):
        part = symbols.where((F.unix_timestamp("ts") >= low) & (F.unix_timestamp("ts") < high)).orderBy(F.rand(i))
        part.coalesce(1).write.parquet(str(tmp_path / "in" / f"b{i}"))
    last = rocks.createDataFrame([(9, 0, "a", "0")], "series_id long, t long, x string, y string").withColumn("ts", F.timestamp_seconds(F.lit(900_000)))
    last.select(symbols.columns).coalesce(1).write.parquet(str(tmp_path / "in" / "b3"))
    stream = rocks.readStream.schema(symbols.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(str(tmp_path / "in"))
    query = live.carried_words(stream, 2, 300, "1 minute").writeStream.format("memory").queryName("carried").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    query.stop()
    got = Counter()
    for r in rocks.sql("select * from carried").collect():
        got[r["xs"], r["ys"]] += r["n"]
    want = {(r["xs"], r["ys"]): r["n"] for r in counts.full_words(symbols, 2).collect()}
    assert got == want
    windows = {r["window_start"] for r in rocks.sql("select window_start from carried").collect()}
    assert len(windows) == 8
