import datetime as dt
import glob
import os
import time

from pyspark.sql import functions as F

from marlstone.streaming import incremental as inc


def run(spark, df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    done = q.awaitTermination(60)
    q.stop()
    assert done
    return spark.table(name)


def test_windows_of_a_stream_are_those_of_a_table(spark, sf_dir, tmp_path):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    e.write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "e"))
    got = run(spark, inc.windowed_counts(stream, "1 day"), "w", "complete")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, inc.windowed_counts(e, "1 day").collect()))


def test_events_behind_the_watermark_are_dropped(spark, tmp_path):
    t = lambda h, m=0: dt.datetime(2024, 1, 1, h, m)
    src, schema = str(tmp_path / "s"), "ts timestamp, event_type string, value double"
    seen: set[str] = set()
    for i, rows in enumerate([[(t(1), "a", 1.0)], [(t(2, 30), "b", 1.0)], [(t(1, 30), "in time", 1.0)], [(t(20), "a", 1.0)], [(t(21), "a", 1.0)], [(t(22), "a", 1.0)], [(t(1, 40), "too late", 1.0)], [(t(23), "a", 1.0)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        for f in set(glob.glob(f"{src}/*.parquet")) - seen:  # the source reads files in the order of their times
            os.utime(f, (1_700_000_000 + 60 * i,) * 2)
            seen.add(f)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    got = {(r["start"].hour, r["event_type"]) for r in run(spark, inc.windowed_counts(stream, "1 hour", late="2 hours"), "late").collect()}
    assert (1, "in time") in got and (1, "a") in got and (1, "too late") not in got


def test_runs_close_when_their_end_comes(spark, tmp_path):
    src, schema = str(tmp_path / "r"), "run string, stage string, status string"
    spark.createDataFrame([("a", "begin", None), ("b", "begin", None), ("a", "end", "failed")], schema).coalesce(1).write.parquet(src)
    # time-outs keep such a query busy, so it is watched and stopped
    q = inc.fold_open_runs(spark.readStream.schema(schema).parquet(src)).writeStream.format("memory").queryName("runs").outputMode("append").start()
    for _ in range(60):
        time.sleep(0.5)
        if spark.table("runs").count():
            break
    got = [tuple(r) for r in spark.table("runs").collect()]
    q.stop()
    assert got == [("a", "failed", 2)]


def test_log(spark, tmp_path):
    p = str(tmp_path / "log")
    for i in range(3):
        inc.append_log(spark.createDataFrame([(f"2024-01-0{i + 1}", i)], "started string, n int"), p)
    inc.compact_log(spark.read.json(p), p + "2", keep=2)
    assert sorted(r["n"] for r in spark.read.json(p + "2").collect()) == [1, 2]
