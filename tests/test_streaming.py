import datetime as dt

from pyspark.sql import functions as F

from cuelake.operators.intervals import merge_intervals
from cuelake.streaming import segments as live


def run(spark, df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_intervals_stream_ends_as_the_batch(spark, tmp_path):
    rows = [("a", 1, 0, 5), ("a", 1, 20, 30), ("a", 1, 4, 8), ("a", 1, 8, 9), ("b", 2, 1, 2), ("a", 1, 25, 40), ("a", 1, 7, 7)]
    schema = "origin string, media_id long, f long, t long"
    for i in range(0, len(rows), 3):
        spark.createDataFrame(rows[i : i + 3], schema).coalesce(1).write.mode("append").parquet(str(tmp_path))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path))
    seen = run(spark, live.merge_intervals_stream(stream), "intervals", "update").collect()
    want = {tuple(r) for r in merge_intervals(spark.createDataFrame(rows, schema), ["origin", "media_id"], F.col("f"), F.col("t")).collect()}
    assert want <= {tuple(r) for r in seen}


def test_cue_stream_carries_the_end(spark, tmp_path):
    rows = [(1, 0.0, 0.2, "hello"), (1, 0.5, 2.0, "there"), (1, 1.5, 3.0, "friend"), (1, None, None, None)]
    schema = "media_id long, start_s double, end_s double, text string"
    for r in rows:
        spark.createDataFrame([r], schema).coalesce(1).write.mode("append").parquet(str(tmp_path))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path))
    got = run(spark, live.timed_cues_stream(stream), "cues_live", "append").orderBy("cue_index").collect()
    assert [r.text for r in got] == ["hello", "there", "friend"]
    assert all(a.end_s <= b.start_s for a, b in zip(got, got[1:], strict=False))


def test_turn_stream_splits_at_silence(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    at = lambda s: t0 + dt.timedelta(seconds=s)
    rows = [(1, at(0), at(2)), (1, at(3), at(4)), (1, at(5.3), at(6)), (1, at(600), at(601))]
    spark.createDataFrame(rows, "media_id long, start_ts timestamp, end_ts timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path))
    stream = spark.readStream.schema("media_id long, start_ts timestamp, end_ts timestamp").parquet(str(tmp_path))
    got = run(spark, live.silence_turns_stream(stream, 1.2), "turns_live", "append").orderBy("turn_start").collect()
    assert [r.n_segments for r in got][:2] == [2, 1]


def test_hop_windows_progress_resume_and_breaker(spark, tmp_path):
    """Windows over a stream; a second run only takes what is new; a fatal error of one micro-batch opens the breaker."""

    from cuelake.operators.completion import ServiceError

    src, out, mark = (str(tmp_path / n) for n in ("src", "out", "mark"))
    at = dt.datetime(2024, 5, 1)
    kind = "media_id long, start_ts timestamp"
    told = []
    watch = live.Progress(lambda rows, batches: told.append(rows))
    spark.streams.addListener(watch)
    for part in ([(1, at), (1, at + dt.timedelta(seconds=29))], [(1, at + dt.timedelta(minutes=10))]):
        spark.createDataFrame(part, kind).write.mode("append").parquet(src)
        assert live.resume(spark.readStream.schema(kind).parquet(src), out, mark, 60)
    assert spark.read.parquet(out).count() == 3
    assert live.resume(live.hop_windows_stream(spark.readStream.schema(kind).parquet(src)), str(tmp_path / "hops"), str(tmp_path / "hopmark"), 60)
    hops = {(r.w.start.replace(tzinfo=None), r.n_segments) for r in spark.read.parquet(str(tmp_path / "hops")).collect()}
    assert any(n == 1 for _, n in hops)
    calls = []

    def fatal(messages):
        raise ServiceError("no key", 401, fatal=True)

    seen = []
    prompts = str(tmp_path / "prompts")
    for i in range(2):
        spark.createDataFrame([(i, "x")], "media_id long, text string").coalesce(1).write.mode("append").parquet(prompts)
    stream = spark.readStream.schema("media_id long, text string").option("maxFilesPerTrigger", 1).parquet(prompts)
    live.completed_stream(stream, "media_id", "text", fatal, "s", lambda df: seen.append([r.error for r in df.collect()]), str(tmp_path / "cm")).awaitTermination(60)
    errors = [e for part in seen for e in part]
    assert len(errors) == 2 and errors[0] == "fatal: no key" and errors[1].startswith("switched off")
    spark.streams.removeListener(watch)
    assert not calls
