from cinelode.sources.readers import lines_of
from cinelode.streaming import logs, loop

LOG = ["10:00 Show #1: laid 100 lines, squeezed 40, 2 too long", "10:01 pitch of A BEAR: wanted 100 Hz, heard 150 Hz in 9 lines", "10:02 pitch of B: wanted 100 Hz, heard 150 Hz in 2 lines", "\0Traceback (most recent)", "10:03 Show #2: laid 100 lines, squeezed 1, 0 too long"]
WANT = [(0, "Show #1", "tight"), (1, "Show #1", "drift"), (3, "Show #1", "loud")]


def test_batch(spark):
    df = spark.createDataFrame([("l", "\n".join(LOG))], "log string, text string")
    got = logs.findings(lines_of(df, "log", "text"), "log").orderBy("n").collect()
    assert [(r.n, r.episode, r.finding) for r in got] == WANT


def test_stream_keeps_the_episode_between_batches(spark, tmp_path):
    src, out = tmp_path / "in", []
    for i, part in enumerate((LOG[:1], LOG[1:])):
        rows = [("l", n, line) for n, line in enumerate(LOG) if line in part]
        spark.createDataFrame(rows, "log string, n bigint, line string").coalesce(1).write.mode("append").parquet(str(src))
        stream = spark.readStream.schema("log string, n bigint, line string").parquet(str(src))
        q = logs.monitored(stream).writeStream.foreachBatch(lambda b, _: out.extend(map(tuple, b.collect()))).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert not q.isActive
    assert sorted((n, e, f) for _, n, e, f in out) == WANT


def test_loop_runs_slow_jobs_every_few_turns(spark, tmp_path):
    seen = {"each": 0, "second": 0}
    for turn in range(3):
        spark.range(turn + 1).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("id bigint").parquet(str(tmp_path / "in"))
        jobs = [(1, lambda b: seen.__setitem__("each", seen["each"] + b.count())), (2, lambda b: seen.__setitem__("second", seen["second"] + 1))]
        loop.every(stream, jobs, str(tmp_path / "cp"), None).awaitTermination(120)
    assert seen == {"each": 6, "second": 2}
