"""Bursts at an exact gap, live debounce over restarts, and the folder-change source."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from quillspark.sources.changes import FolderChanges
from quillspark.streaming import events

T0 = dt.datetime(2024, 1, 1, 23, 50)


def at(**kw):
    return T0 + dt.timedelta(**kw)


def frame(spark, rows):
    """Rows of (key, time)."""
    return spark.createDataFrame([(k, t, i) for i, (k, t) in enumerate(rows)], "k string, ts timestamp, order long")


def bursts(rows, gap):
    out = {}
    for k, t in sorted(rows):
        runs = out.setdefault(k, [])
        if runs and t - runs[-1][1] < gap:
            runs[-1] = (runs[-1][0], t, runs[-1][2] + 1)
        else:
            runs.append((t, t, 1))
    return sorted((k, *r) for k, runs in out.items() for r in runs)


EXACT = [("a", at()), ("a", at(minutes=30)), ("a", at(minutes=30)), ("a", at(minutes=59, seconds=59, microseconds=999_999)), ("a", at(minutes=90)), ("b", at(minutes=10)), ("b", at(days=3))]


def found(df, *keys):
    return sorted((*[r[k] for k in keys], r.first_ts, r.last_ts, r.events) for r in df.collect())


def test_a_full_gap_parts_bursts(spark):
    gap = dt.timedelta(minutes=30)
    assert found(events.quiet_sessions(frame(spark, EXACT), "30 minutes", "k"), "k") == bursts(EXACT, gap)
    alone = [("", t) for _, t in EXACT]
    assert found(events.quiet_sessions(frame(spark, EXACT), "30 minutes")) == [x[1:] for x in bursts(alone, gap)]
    changes = frame(spark, EXACT).select("k", "ts", "order", F.lit("page_updated").alias("kind"), F.concat(F.lit("p"), "order").alias("key"))
    assert sorted((r.k, r.first_ts, r.events) for r in events.commit_batches(changes, "30 minutes", "k").collect()) == [(k, a, n) for k, a, _, n in bursts(EXACT, gap)]
    assert sorted((r.first_ts, r.events) for r in events.commit_batches(changes, "30 minutes").collect()) == [(a, n) for _, a, _, n in bursts(alone, gap)]


def test_bursts_go_over_buckets_and_chunks(spark):
    """Gaps of a second: chunks are some 68 minutes long, and bursts run over several of them."""
    rows = [("", T0 + dt.timedelta(milliseconds=900 * i)) for i in range(12_000)] + [("", at(days=2, milliseconds=1000 * i)) for i in range(5)]
    assert found(events.quiet_sessions(frame(spark, rows), "1 second")) == [x[1:] for x in bursts(rows, dt.timedelta(seconds=1))]
    assert events.quiet_sessions(frame(spark, rows).limit(0), "1 second").count() == 0


def test_messages_of_many_changes(spark):
    rows = [("a", at(seconds=i // 10)) for i in range(500)]
    changes = frame(spark, rows).select("ts", "order", F.lit("page_updated").alias("kind"), F.concat(F.lit("p"), F.col("order") % 40).alias("key"))
    assert [(r.events, r.message) for r in events.commit_batches(changes, "1 minute").collect()] == [(500, "wiki: 40 alterações")]
    few = changes.where("order < 3")
    assert [r.message for r in events.commit_batches(few, "1 minute").collect()] == ["wiki: atualiza p0, atualiza p1, atualiza p2"]


def test_live_bursts_close_once_over_restarts(spark, tmp_path):
    gap = dt.timedelta(minutes=30)
    first = EXACT
    second = [("a", at(minutes=100)), ("b", at(days=3, minutes=29)), ("c", at(days=3, minutes=45)), ("b", at(days=3, minutes=58))]
    third = [("d", at(days=9))]
    schema = "k string, ts timestamp, order long"
    (tmp_path / "in").mkdir()
    for n, rows in enumerate((first, second, third)):
        frame(spark, rows).coalesce(1).write.parquet(str(tmp_path / f"w{n}"))
        part = next((tmp_path / f"w{n}").glob("*.parquet"))
        part.rename(tmp_path / "in" / f"{n}.parquet")
        rows = spark.readStream.schema(schema).parquet(str(tmp_path / "in")).withWatermark("ts", "4 days")
        out = events.debounced(rows, "30 minutes", "k")
        writer = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True)
        running = events.started(writer)  # each time from the checkpoint
        running.awaitTermination()
    got = found(spark.read.schema(out.schema).parquet(str(tmp_path / "out")), "k")
    every = [*first, *second, *third]
    watermark = max(t for _, t in every) - dt.timedelta(days=4)
    want = [x for x in bursts(every, gap) if x[2] + gap <= watermark]
    assert got == want and len(want) == len(bursts(every, gap)) - 1
    kept = [o for p in running.recentProgress for o in p["stateOperators"]]
    assert kept[-1]["numRowsTotal"] <= 12  # closed bursts have left the state


def test_live_bursts_need_no_call_a_burst(spark, tmp_path):
    """Many bursts of one event each go through the state in the engine, not by a timer and a call into Python each."""
    rows = [(f"k{i % 50}", at(hours=i)) for i in range(5000)]
    frame(spark, rows).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k string, ts timestamp, order long").parquet(str(tmp_path / "in")).withWatermark("ts", "1 hour")
    out = events.debounced(stream, "30 minutes", "k")
    running = events.started(out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True))
    running.awaitTermination()
    assert found(spark.read.schema(out.schema).parquet(str(tmp_path / "out")), "k") == [x for x in bursts(rows, dt.timedelta(minutes=30)) if x[2] + dt.timedelta(minutes=90) <= at(hours=4999)]
    assert {o["operatorName"] for p in running.recentProgress for o in p["stateOperators"]} == {"sessionWindowStateStoreSaveExec"}


def test_stream_sessions_part_at_a_full_gap(spark, tmp_path):
    frame(spark, EXACT).coalesce(1).write.parquet(str(tmp_path / "in"))
    rows = spark.readStream.schema("k string, ts timestamp, order long").parquet(str(tmp_path / "in")).withWatermark("ts", "1 hour")
    writer = events.quiet_sessions(rows, "30 minutes", "k").writeStream.outputMode("complete").format("memory").queryName("full_gap")
    writer.trigger(availableNow=True).start().awaitTermination()
    assert found(spark.table("full_gap"), "k") == bursts(EXACT, dt.timedelta(minutes=30))


def test_folder_changes_over_restarts(spark, tmp_path):
    spark.dataSource.register(FolderChanges)
    root = tmp_path / "wiki"
    (root / "pages").mkdir(parents=True)
    (root / "sources").mkdir()
    told = []

    def run():
        rows = spark.readStream.format("folder_changes").option("path", str(root)).option("state", str(tmp_path / "state")).option("buckets", 3).load()
        writer = events.domain_events(rows).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "log"))
        running = writer.trigger(once=True).start()
        running.awaitTermination()
        now = sorted((r.kind, r.key or "") for r in spark.read.schema("ts timestamp, kind string, key string").parquet(str(tmp_path / "out")).collect())
        new = list(now)
        for x in told:
            new.remove(x)
        told.extend(new)
        return new

    (root / "pages/a.md").write_text("one")
    (root / "pages/b.md").write_text("one")
    (root / "sources/s.txt").write_text("raw")
    assert run() == [("page_created", "a"), ("page_created", "b"), ("raw_updated", "s.txt")]
    (root / "pages/a.md").write_text("longer")
    (root / "log.md").write_text("x")
    assert run() == [("log_changed", ""), ("page_updated", "a")]
    assert run() == []
    os.rename(root / "pages/b.md", root / "pages/c.md")
    (root / "sources/s.txt").unlink()
    assert run() == [("page_created", "c"), ("page_deleted", "b"), ("raw_deleted", "s.txt")]
    os.utime(root / "pages/c.md", (1, 1))
    assert run() == [("page_updated", "c")]
    assert len(list((tmp_path / "state").glob("done-*"))) <= 2  # committed listings are removed


@pytest.mark.parametrize("gap, micros", [("2 hours", 7_200_000_000), ("1 second", 1_000_000), ("3 days", 259_200_000_000)])
def test_gaps(gap, micros):
    assert events.gap_micros(gap) == micros
