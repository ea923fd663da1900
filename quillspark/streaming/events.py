"""Change events: from file events to domain events, sessions, and incremental maintenance.

The same functions serve batch and stream; event time and watermarks make a replay give what
the live stream gave.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery
from pyspark.sql.window import Window

from ..functions.text import commit_description, commit_message
from ..operators.mutation import apply_changes


def split_renames(events: DataFrame) -> DataFrame:
    """File events (ts, op, paths): a rename of two paths is a deletion and a creation."""
    both = F.array(F.struct(F.lit("delete").alias("op"), F.get("paths", F.lit(0)).alias("path"), F.lit(0).alias("n")), F.struct(F.lit("create").alias("op"), F.get("paths", F.lit(1)).alias("path"), F.lit(1).alias("n")))
    op = F.when(F.col("op") == "rename_from", "delete").when(F.col("op") == "rename_to", "create").otherwise(F.col("op"))
    each = F.transform("paths", lambda p: F.struct(op.alias("op"), p.alias("path"), F.lit(0).alias("n")))
    two = (F.col("op") == "rename") & (F.size("paths") == 2)
    return events.where("op <> 'access'").select("ts", F.explode(F.when(two, both).otherwise(each)).alias("x")).select("ts", "x.*")


def domain_events(changes: DataFrame) -> DataFrame:
    """ts, kind, key of file changes (ts, op, path)."""
    path = F.regexp_replace("path", r"\\", "/")
    page = F.regexp_extract(path, r"(?:^|/)pages/([^/.][^/]*)\.md$", 1)
    raw = F.regexp_extract(path, r"(?:^|/)sources/([^/]+)$", 1)
    meta = F.regexp_extract(path, r"(?:^|/)metadata/([^/]+)\.json$", 1)
    gone = F.col("op") == "delete"
    name = lambda kind: F.when(gone, f"{kind}_deleted").when((F.lit(kind) == "page") & (F.col("op") == "create"), "page_created").otherwise(f"{kind}_updated")
    kind = F.when(page != "", name("page")).when((raw != "") | (meta != ""), name("raw")).when(path.rlike(r"(^|/)rawindex\.md$"), "index_changed").when(path.rlike(r"(^|/)log\.md$"), "log_changed").otherwise("unknown")
    kept = changes.where(~path.rlike(r"(^|/)(\.git|proposals)(/|$)"))
    return kept.select("ts", kind.alias("kind"), F.nullif(F.concat(page, F.when(page == "", F.concat(raw, F.when(raw == "", meta).otherwise(""))).otherwise("")), F.lit("")).alias("key"))


def dirties_index(kind: Column, key: Column) -> Column:
    """Whether the catalogue page needs a new version; its own changes don't count."""
    return kind.isin("page_created", "page_updated", "page_deleted") & (key != "index")


#: Microseconds of the units that a gap may have.
_UNITS = {"microsecond": 1, "millisecond": 1000, "second": 1_000_000, "minute": 60_000_000, "hour": 3_600_000_000, "day": 86_400_000_000}


def gap_micros(gap: str) -> int:
    """A gap such as ``2 hours`` in microseconds."""
    number, unit = gap.split()
    return int(number) * _UNITS[unit.rstrip("s")]


def _buckets(events: DataFrame, gap: str, *keys: str) -> DataFrame:
    """Keys, ``_bucket`` and the events of each stretch of one gap's length, with ``_burst``: the first bucket of its burst.

    Events of one bucket are less than a gap apart, so they are one burst, and are combined
    before any shuffle.  Buckets then follow each other within the keys and a chunk of 4096
    buckets; only the first and last burst of each chunk go on to be joined over its borders.
    """
    micros = gap_micros(gap)
    at = F.floor(F.unix_micros("ts") / F.lit(micros))
    found = events.where("ts is not null").groupBy(*keys, at.alias("_bucket")).agg(F.count("*").alias("events"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    found = found.withColumn("_chunk", F.floor(F.col("_bucket") / 4096))

    def chained(rows: DataFrame, parts: list[str]) -> DataFrame:
        order = Window.partitionBy(*parts).orderBy("_bucket")
        apart = F.unix_micros("first_ts") - F.unix_micros(F.lag("last_ts").over(order)) >= micros
        starts = rows.withColumn("_new", F.coalesce(apart, F.lit(True)))
        return starts.withColumn("_burst", F.last(F.when(F.col("_new"), F.col("_bucket")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))

    local = chained(found, [*keys, "_chunk"])
    ends = local.groupBy(*keys, "_chunk", "_burst").agg(F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"))
    # a burst inside a chunk is whole; the first of a chunk may go on from the last of the one before
    outer = ends.withColumn("_first", F.min("_burst").over(Window.partitionBy(*keys, "_chunk"))).withColumn("_last", F.max("_burst").over(Window.partitionBy(*keys, "_chunk")))
    edges = chained(outer.where("_burst in (_first, _last)").withColumn("_bucket", F.col("_burst")).drop("_burst"), list(keys))
    edges = edges.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_bucket").alias("_b"), F.col("_burst").alias("_whole"))
    on = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys] + [F.col("_burst") == F.col("_b")]
    return local.join(edges, on, "left").withColumn("_burst", F.coalesce("_whole", "_burst")).select(*keys, "_bucket", "_burst", "events", "first_ts", "last_ts")


def quiet_sessions(events: DataFrame, gap: str, *keys: str) -> DataFrame:
    """Bursts of events: keys, events, first_ts and last_ts.  A quiet time of the full gap parts two bursts, in batch and stream.

    Events without time belong to no burst.  A stream needs a watermark and ends a burst once
    the watermark has passed its last event by the gap.
    """
    if events.isStreaming:
        session = F.session_window("ts", f"{gap_micros(gap) - 1} microseconds")  # Spark joins events that are a window apart
        found = events.groupBy(*keys, session).agg(F.count("*").alias("events"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
        return found.drop("session_window")
    found = _buckets(events, gap, *keys).groupBy(*keys, "_burst")
    return found.agg(F.sum("events").alias("events"), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts")).drop("_burst")


#: More descriptions than these can't fit a message that spells them out.
SPELLED = 30


def commit_batches(events: DataFrame, gap: str = "3 seconds", *keys: str) -> DataFrame:
    """One message for each burst of described changes (ts, order, kind, key); descriptions in order of time, each once.

    Descriptions are made distinct before they are gathered, and a burst gathers no more of
    them than its message can hold, however many events it has.
    """
    rows = events.withColumn("d", commit_description(F.col("kind"), F.col("key"))).where("d is not null and ts is not null")
    bursts = _buckets(rows, gap, *keys).select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_bucket").alias("_b"), "_burst")
    each = rows.groupBy(*keys, F.floor(F.unix_micros("ts") / F.lit(gap_micros(gap))).alias("_bucket"), "d").agg(F.count("*").alias("n"), F.min(F.struct("ts", "order")).alias("o"))
    on = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys] + [F.col("_bucket") == F.col("_b")]
    each = each.join(bursts, on).groupBy(*keys, "_burst", "d").agg(F.sum("n").alias("n"), F.min("o").alias("o"))
    ranked = each.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys, "_burst").orderBy("o", "d")))
    first = F.when(F.col("_rank") <= SPELLED + 1, F.struct("o", "d"))
    found = ranked.groupBy(*keys, "_burst").agg(F.sum("n").alias("events"), F.min("o.ts").alias("first_ts"), F.count("*").alias("_all"), F.sort_array(F.collect_list(first)).alias("l"))
    return found.select(*keys, "first_ts", "events", commit_message(F.transform("l", lambda x: x.d), F.col("_all")).alias("message"))


def debounced(events: DataFrame, gap: str, key: str) -> DataFrame:
    """A live stream's closed bursts, each sent once: key, first_ts, last_ts, events (append mode).

    ``events`` streams ``ts``, with a watermark, and ``key``.  A batch's events become bursts before they
    meet the state, which holds only open bursts (as many as fit between the watermark and the newest
    event); all bursts whose end plus the gap the watermark has passed are sent and leave the state
    in one pass, without a call into Python for any key, event or burst.  Late events
    within the watermark still join bursts.  Bursts that the watermark hasn't passed stay open when
    a stream stops, and go on from its checkpoint.  Meant for the RocksDB state store.
    """
    found = quiet_sessions(events.where("ts is not null"), gap, key)
    return found.select(key, "first_ts", "last_ts", "events")


STATE_STORE = "spark.sql.streaming.stateStore.providerClass"


def started(writer: DataStreamWriter) -> StreamingQuery:
    """Start a stream with many open bursts in state on the RocksDB state store; the session keeps its own setting otherwise."""
    spark = SparkSession.active()
    before = spark.conf.get(STATE_STORE, None)
    spark.conf.set(STATE_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        return writer.start()
    finally:
        spark.conf.set(STATE_STORE, before) if before else spark.conf.unset(STATE_STORE)


def maintain(table_path: str, keys: list[str], order: str = "ts", deleted: str = "deleted") -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that keeps a Parquet table of the last state of each key.

    Each batch writes a new version beside the old one; the version number is the batch's, so
    a batch that runs again after a failure gives the same table.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        columns = [c for c in batch.columns if c not in (order, deleted)]
        old = spark.read.parquet(f"{table_path}/v{batch_id - 1}") if batch_id else batch.select(*columns).limit(0)
        changes = batch.select(*columns, order, deleted)
        apply_changes(old, changes, keys, order, deleted).write.mode("overwrite").parquet(f"{table_path}/v{batch_id}")

    return apply
