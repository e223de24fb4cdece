"""The stream that gives each decision its latest print, over batches with late rows."""

import datetime as dt

from pyspark.sql import functions as F

from asofkit.streaming import jobs


def test_late_prints_count_until_the_watermark_passes_the_decision(spark, tmp_path):
    t = lambda h, m: dt.datetime(2024, 1, 2, h, m)
    batches = [
        [(1, "a", t(10, 0), False), (2, "a", t(10, 10), True), (3, "b", t(10, 10), True)],
        [(4, "a", t(10, 8), False), (5, "a", t(10, 12), False), (6, "b", t(9, 50), False)],  # a late print before the decision, one after it, and one that is too old
        [(7, "c", t(11, 0), False)],  # the watermark goes to 10:50: both decisions are due with the next batch
        [(13, "e", t(11, 1), False)],
        [(8, "a", t(10, 9), False), (9, "c", t(11, 14), True), (10, "c", t(11, 15), True), (11, "c", t(11, 16), True)],  # too late for its decision
        [(12, "d", t(13, 0), True)],
    ]
    schema = "id bigint, user string, ts timestamp, decides boolean"
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    files = sorted((tmp_path / "in").glob("*.parquet"), key=lambda f: f.stat().st_mtime_ns)
    assert len(files) == len(batches)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = jobs.finish(jobs.latest_before(stream, key="user", ts="ts", row_id="id", decides="decides", seconds=900, late="10 minutes"), "latest")
    got = {r["decision"]: (r["print"], r["printed"]) for r in out.collect()}
    assert got == {2: (4, t(10, 8)), 3: (None, None), 9: (7, t(11, 0)), 10: (7, t(11, 0)), 11: (None, None)}


def test_a_replay_keeps_every_row_once_in_files_that_no_task_reads_whole(spark, monkeypatch):
    began = dt.datetime(2024, 1, 2)
    rows = [(k, began + dt.timedelta(seconds=k)) for k in range(4000)] + [(4000, None)]
    table = spark.createDataFrame(rows, "id bigint, ts timestamp")
    # a percentile that comes out differently in every job, as an approximate one may on a cluster
    monkeypatch.setattr(jobs.F, "percentile_approx", lambda c, at: F.array(*[F.min(c) + 800 * (k + 1) + F.pmod(F.unix_micros(F.current_timestamp()), F.lit(700)) for k in range(len(at))]))
    whole = jobs.finish(jobs.replay(table, "ts", "rows"), "kept")
    assert sorted(r["id"] for r in whole.collect()) == list(range(4001))
    stream = jobs.replay(table, "ts", "rows", most=300)
    kept = jobs.finish(stream.withColumn("file", F.col("_metadata.file_name")), "kept").collect()
    assert sorted(r["id"] for r in kept) == list(range(4001))
    files = {f: [r["id"] for r in kept if r["file"] == f] for f in {r["file"] for r in kept}}
    assert len(files) % 4 == 0 and len(files) >= 16 and max(len(ids) for ids in files.values()) < 600
    # a batch is a part: no window is passed by the watermark before its rows come
    bars = jobs.finish(jobs.window_bars(jobs.replay(table.dropna().withColumn("key", F.lit("a")), "ts", "rows", most=300), key="key", ts="ts", value="id", size="1 minute", late="0 seconds"), "bars")
    assert {r["volume"] for r in bars.collect()} == {60} and bars.count() >= 65


def test_a_replay_of_few_times_has_no_batch_of_two_parts(spark):
    t = lambda m: dt.datetime(2024, 1, 2, 10, m)
    table = spark.createDataFrame([(k, t(k % 2)) for k in range(2000)], "id bigint, ts timestamp")
    kept = jobs.finish(jobs.replay(table, "ts", "rows", most=100), "kept")
    assert sorted(r["id"] for r in kept.collect()) == list(range(2000))
