"""Structured Streaming forms: bars by window, late data, prints joined to decisions, kept walks, captures, idempotent appends, closed outcomes."""

from __future__ import annotations

import bisect
import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from asofkit.operators import regimes
from asofkit.sources.files import work_folder


def replay(table: DataFrame, order: str, name: str, batches: int = 4, most: int = 250_000) -> DataFrame:
    """A stream over a stored table, in ``batches`` parts in order of time, read one at a time.

    Every part has the same number of files, of about ``most`` rows, so that a batch of the stream is one part and no task holds a part whole.
    The bounds of the parts are found once: an approximate percentile may come out differently in every job, and rows between two answers would be lost or doubled.
    """
    spark = table.sparkSession
    whole, path = work_folder(spark, f"{name}-all"), work_folder(spark, name)
    table.write.parquet(whole)
    table = spark.read.schema(table.schema).parquet(whole)
    moment = F.unix_timestamp(F.col(order).cast("timestamp"))
    bounds = table.agg(F.percentile_approx(moment, [k / batches for k in range(1, batches)]).alias("b")).first()["b"] or []
    part = sum((F.coalesce(moment > b, F.lit(False)).cast("int") for b in bounds), F.lit(0))
    files, held = _files(table.select(part.alias("part"), F.xxhash64(*table.columns).alias("h")), most)
    for k in range(batches):
        one = table.filter(part == k)
        if files == 1:
            one.coalesce(1).write.mode("append").parquet(path)
        elif k in held:  # nothing to write would still be one file
            one.repartitionById(files, F.pmod(F.xxhash64(*table.columns), F.lit(files)).cast("int")).write.mode("append").parquet(path)
    return spark.readStream.schema(table.schema).option("maxFilesPerTrigger", files).parquet(path)


def _files(rows: DataFrame, most: int) -> tuple[int, set[int]]:
    """(files of a part, parts with rows): so many files that each has about ``most`` rows, and that in every part a row falls to each, as an empty file is not written."""
    counts = {r["part"]: r["count"] for r in rows.groupBy("part").count().collect()}  # one row a part
    files = -(-max(counts.values(), default=0) // most)
    while files > 1:
        filled = rows.groupBy("part").agg(F.count_distinct(F.pmod("h", F.lit(files))).alias("n")).collect()
        if all(r["n"] == files for r in filled):
            break
        files //= 2
    return max(files, 1), set(counts)


def finish(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there, into a table of the shared folder, and read the table."""
    spark = stream.sparkSession
    out, kept = work_folder(spark, name), work_folder(spark, f"{name}-progress")
    stream.writeStream.outputMode(mode).option("checkpointLocation", kept).trigger(availableNow=True).format("parquet").start(out).awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def window_bars(events: DataFrame, *, key: str, ts: str, value: str, size: str, late: str) -> DataFrame:
    """Tumbling bars; a window is given out once, when the watermark has passed it."""
    g = events.withWatermark(ts, late).groupBy(key, F.window(ts, size).alias("w"))
    return g.agg(F.max(value).alias("high"), F.min(value).alias("low"), F.count(F.lit(1)).alias("volume")).select(key, F.col("w.start").alias("start"), "high", "low", "volume")


def seen_in_time(records: DataFrame, *, event: str, clocks: list[str], decision: str, late: str) -> DataFrame:
    """Records that had passed all their clocks at the decision; what came later never enters it, whenever it is read."""
    kept = records.withWatermark(event, late)
    for c in clocks:
        kept = kept.filter(F.col(c) <= F.col(decision))
    return kept


def prints_before(decisions: DataFrame, prints: DataFrame, *, key: str, at: str, ts: str, seconds: int, late: str) -> DataFrame:
    """Two streams joined by interval: the prints within ``seconds`` before each decision."""
    d, p = decisions.withWatermark(at, late).alias("d"), prints.withWatermark(ts, late).alias("p")
    on = (F.col(f"d.{key}") == F.col(f"p.{key}")) & (F.col(f"p.{ts}") <= F.col(f"d.{at}")) & (F.col(f"p.{ts}") >= F.col(f"d.{at}") - F.make_dt_interval(secs=F.lit(seconds)))
    return d.join(p, on).select("d.*", F.col(f"p.{ts}").alias(ts), *[F.col(f"p.{c}").alias(c) for c in prints.columns if c not in (key, ts)])


def latest_before(rows: DataFrame, *, key: str, ts: str, row_id: str, decides: str, seconds: int, late: str) -> DataFrame:
    """One stream of decisions and prints (``decides`` tells which): each decision with its *latest* print of the last ``seconds``, or NULL; ``key, decision, at, print, printed``.

    The state of a key holds its open decisions and the prints that one of them, or one still to come, may need. A decision is given out once, when the
    watermark has passed it, so prints that come late, but before it is given out, still count; an event-time timer wakes a key that gets no more rows. Of prints of one
    time the one with the greater id counts.
    """
    kinds = dict(rows.dtypes)
    names = [key, "decision", "at", "print", "printed"]

    def each(at, frames, state):
        open_, prints = json.loads(state.get[0]) if state.exists else ([], [])
        for pdf in frames:
            moments = pdf[ts].astype("datetime64[us]").astype("int64")
            for moment, own, asks in zip(moments.tolist(), pdf[row_id].tolist(), pdf[decides].tolist()):
                (open_ if asks else prints).append([moment, own])
        mark = state.getCurrentWatermarkMs() * 1000
        prints.sort()
        times = [p[0] for p in prints]
        done = []
        for moment, own in sorted(d for d in open_ if d[0] < mark):
            k = bisect.bisect_right(times, moment) - 1
            hit = prints[k] if k >= 0 and times[k] >= moment - seconds * 1_000_000 else [None, None]
            done.append((at[0], own, moment, hit[1], hit[0]))
        open_ = [d for d in open_ if d[0] >= mark]
        needed = min([mark, *(d[0] for d in open_)]) - seconds * 1_000_000
        prints = prints[bisect.bisect_left(times, needed) :]
        if open_ or prints:
            state.update((json.dumps((open_, prints)),))
            wake = min(d[0] for d in open_) // 1000 if open_ else prints[-1][0] // 1000 + seconds * 1000
            state.setTimeoutTimestamp(max(wake, mark // 1000) + 1)
        elif state.exists:
            state.remove()
        out = pd.DataFrame(done, columns=names).astype({"print": "Int64", "printed": "Int64"})
        yield out.assign(at=pd.to_datetime(out["at"], unit="us"), printed=pd.to_datetime(out["printed"].astype("float64"), unit="us") if not len(out) else pd.Series([pd.NaT if v is None else pd.Timestamp(v, unit="us") for v in (d[4] for d in done)], dtype="datetime64[us]"))

    marked = rows.withWatermark(ts, late)
    schema = f"{key} {kinds[key]}, decision bigint, at timestamp, print bigint, printed timestamp"
    return marked.groupBy(key).applyInPandasWithState(each, schema, "held string", "append", "EventTimeTimeout")


def walk_stream(features: DataFrame, x: list[str], *, key: str, order: str, cooldown: int = 3, capital: float = 10_000.0) -> DataFrame:
    """``regimes.walk_history`` over a stream: the walk of a key goes on from the state that was kept after its last row."""
    kinds = dict(features.dtypes)
    names = [c.split()[0] for c in regimes.WALKED.split(", ")]

    def each(at, frames, state):
        s = json.loads(state.get[0]) if state.exists else regimes.new_walk()
        pdf = pd.concat(list(frames)).sort_values(order)
        done = regimes.walk(s, pdf, regimes._unpack(pdf["model"].iloc[0], len(x)), x, order, cooldown=cooldown, capital=capital)
        state.update((json.dumps(s),))
        yield pd.DataFrame(done, columns=names).assign(**{key: at[0], order: pdf[order].to_numpy()})[[key, order, *names]]

    return features.groupBy(key).applyInPandasWithState(each, f"{key} {kinds[key]}, {order} {kinds[order]}, {regimes.WALKED}", "walk string", "append", "NoTimeout")


def captured(records: DataFrame, *, at: str, captured_at: str, observed_at: str, most_lag: int = 600, most_stale: int = 900) -> DataFrame:
    """Captures with a ``reason`` where they came too late or show what is too old."""
    seconds = lambda a, b: F.unix_timestamp(a) - F.unix_timestamp(b)
    reason = F.when(seconds(captured_at, at) > most_lag, "late capture").when(seconds(captured_at, observed_at) > most_stale, "stale").when(seconds(captured_at, at) < 0, "before the decision")
    return records.withColumn("reason", reason)


def append_once(events: DataFrame, key: str, name: str) -> tuple[SparkSession, str]:
    """Append a stream of events to a store, each idempotency key once, also across batches and reruns of a batch."""
    spark = events.sparkSession
    store, kept = work_folder(spark, name), work_folder(spark, f"{name}-progress")

    def add(batch: DataFrame, number: int) -> None:
        new = batch.dropDuplicates([key])
        if number > 0:
            stored = batch.sparkSession.read.parquet(store).filter(F.col("batch") < number)  # a rerun of a batch replaces its own part
            new = new.join(stored.select(key), key, "left_anti")
        new.write.mode("overwrite").parquet(f"{store}/batch={number}")

    events.writeStream.foreachBatch(add).option("checkpointLocation", kept).trigger(availableNow=True).start().awaitTermination()
    return spark, store


def closed_outcomes(events: DataFrame, *, key: str, ts: str, value: str, horizon: str, late: str) -> DataFrame:
    """Sums over horizons that have closed; an open horizon gives no row."""
    g = events.withWatermark(ts, late).groupBy(key, F.window(ts, horizon).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return g.select(key, F.col("w.start").alias("opened"), F.col("w.end").alias("matured"), "n", "total")
