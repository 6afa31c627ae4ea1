"""The streams give what the batch operators give, over several micro-batches."""

import datetime

from pyspark.sql import Window
from pyspark.sql import functions as F

from quirefold.operators import session
from quirefold.streaming import history, sessions


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_id", "user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    events = events.where("user_id < 12")  # a few sessions: the state store is slow to start
    ordered = events.orderBy("t", "event_id").collect()
    for k in range(3):
        part = ordered[k * len(ordered) // 3 : (k + 1) * len(ordered) // 3]
        spark.createDataFrame(part, events.schema).coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
    gap = 3_600_000_000
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    out = sessions.coalesced(stream, "user_id", "event_type", "t", "event_id", gap).writeStream.format("memory").queryName("bursts").option("checkpointLocation", str(tmp_path / "state")).start()
    out.processAllAvailable()  # returns only without batches for timeouts alone, see streaming.sessions
    out.stop()
    got = {(r.seq, r.burst) for r in spark.table("bursts").collect()}
    want = {(r.event_id, r.burst) for r in session.coalesced(events, "user_id", "event_type", "t", ["event_id"], gap).collect()}
    assert got == want


def test_undo_and_redo_as_a_stream(spark, tmp_path):
    """Out of order between micro-batches, null values, and a restart from the checkpoint."""
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").where("user_id < 6")
    kind = F.when(F.col("event_id") % 5 == 3, "undo").when(F.col("event_id") % 5 == 4, "redo").otherwise("edit")
    ts = F.timestamp_seconds(F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000))
    acts = events.select("user_id", "event_id", ts.alias("at"), kind.alias("act"), F.when(F.col("event_id") % 11 != 0, F.col("event_type")).alias("what"))
    ordered = acts.orderBy("at", "event_id").collect()
    third = len(ordered) // 3
    parts = [ordered[: third + 5], ordered[third + 5 : 2 * third], ordered[2 * third :]]
    late = parts[0][third - 5 :]  # come with the next file only
    parts = [parts[0][: third - 5], parts[1] + late, parts[2]]
    end = [(99, 10**9, ordered[-1].at + datetime.timedelta(days=60), "edit", "end")]  # lets the watermark pass all others
    for k, part in enumerate([*parts, end]):
        spark.createDataFrame(part, acts.schema).coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "true")
    try:
        for files in (["0", "1"], ["0", "1", "2", "3"]):  # the second query goes on where the first one stopped
            seen = tmp_path / "seen"
            seen.mkdir(exist_ok=True)
            for f in files:
                if not (seen / f).exists():
                    (tmp_path / "in" / f).rename(seen / f)
            stream = spark.readStream.schema(acts.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(seen))
            out = history.replayed(stream, "user_id", "event_id", "at", "act", "what", late="40 days", forget="3650 days")
            run = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
            assert run.awaitTermination(240)
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).where("session != 99").collect()), key=str)
    ranked = acts.withColumn("n", F.row_number().over(Window.partitionBy("user_id").orderBy("at", "event_id")))
    want = session.replay(ranked, "user_id", "n", "act", "what").join(ranked.select(F.col("user_id").alias("session"), F.col("n").alias("seq"), "event_id"), ["session", "seq"])
    assert got == sorted(map(tuple, want.select("session", F.col("event_id").alias("seq"), "present", "undo_depth", "redo_depth").collect()), key=str)
