"""The same scoring and counting over unbounded page feeds."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from pagescout import settings as S
from pagescout.functions import urls as U
from pagescout.operators.signals import page_signals, product_pages
from pagescout.sources.tables import FETCHED_SCHEMA, scan_pages
from pagescout.storage import new_path

#: Groups of domains that share their state in a stream of stalls, counts of domains that may wait there to be added up, ticks told at one time.
STALL_BUCKETS, PIECES, TICKS = 256, 4096, 100_000


def read_page_stream(
    spark: SparkSession, path: str, schema: str = FETCHED_SCHEMA, files_per_trigger: int | None = None
) -> DataFrame:
    """Pages that land as Parquet files in a folder."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def stream_product_pages(pages: DataFrame, **options) -> DataFrame:
    """Scored product pages as they arrive; stateless. What was not fetched is no page."""
    return product_pages(page_signals(scan_pages(pages), **options))


def stream_dedup_urls(pages: DataFrame, horizon: str | None = None) -> DataFrame:
    """Pages whose normalized URL was not seen before.

    Without ``horizon`` the answer is exact and the state grows with the number of URLs. With
    one (for instance ``"7 days"``, on the column ``fetched_at``) the state is bounded, and a
    URL may appear again after that time.
    """
    keyed = U.with_normal_url(pages, "url", "url_key")
    if horizon is None:
        return keyed.dropDuplicates(["url_key"])
    return keyed.withWatermark("fetched_at", horizon).dropDuplicatesWithinWatermark(["url_key"])


def stream_dedup_in_windows(pages: DataFrame, horizon: str, lateness: str) -> DataFrame:
    """The pages whose normalized URL is new in its window of ``fetched_at``, ``horizon`` long.

    Which repeats return does not depend on how the feed is cut into batches: a URL appears once in each
    window in which it was fetched. The state of a window goes when ``fetched_at`` has come ``lateness`` beyond its
    end; rows that come later than that are dropped.
    """
    keyed = U.with_normal_url(pages, "url", "url_key").withWatermark("fetched_at", lateness)
    return keyed.withColumn("window", F.window("fetched_at", horizon)).dropDuplicates(["url_key", "window"])


def stream_progress(
    feed: DataFrame, interval_seconds: int = S.MONITOR_SECONDS, lateness: str = "10 minutes"
) -> DataFrame:
    """Z3: visited pages, products and errors per interval and domain.

    ``feed`` has ``fetched_at``, ``domain``, ``status`` and ``is_product``. Intervals without
    pages do not appear; ``stall_monitor`` over the written counts finds the stalls.
    """
    return (
        feed.withWatermark("fetched_at", lateness)
        .groupBy(F.window("fetched_at", f"{interval_seconds} seconds"), "domain")
        .agg(
            F.count("*").alias("visited"),
            F.count_if("is_product").alias("products"),
            F.count_if(F.col("status") != 200).alias("errors"),
        )
        .select(F.col("window.start").alias("start"), "domain", "visited", "products", "errors")
    )


class _Ticks(StatefulProcessor):
    """Per bucket of domains: of each domain the last tick that was told, the count up to it and the counts of ticks that are still open.

    A bucket costs a few calls to the state store a batch, however many domains and ticks it holds. New counts are appended;
    they meet the older ones when time passes a tick, or when there are more of them than of those.
    """

    def __init__(self, step_ms: int):
        self.step = step_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.domains = handle.getListState("domains", "domain string, told long, visited long, ticks array<long>, added array<long>")
        self.told = handle.getValueState("told", "tick long, kept long, appended long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        told, kept, appended = self.told.get() if self.told.exists() else (None, 0, 0)
        counts: dict[str | None, Counter] = {}
        for frame in rows:
            for (domain, tick), n in frame.groupby(["domain", "tick_ms"], dropna=False).size().items():
                counts.setdefault(domain if isinstance(domain, str) else None, Counter())[int(tick)] += int(n)
        if not counts:
            return iter(())
        self.domains.appendList([(domain, None, 0, list(new), list(new.values())) for domain, new in counts.items()])
        appended += len(counts)
        if appended > kept + PIECES:
            whole = [(domain, last, visited, *self._summed(ticks, added)) for domain, (last, visited, ticks, added) in self._whole().items()]
            self.domains.put(whole)
            kept, appended = len(whole), 0
        self.told.update((told, kept, appended))
        if told is None:
            self.handle.registerTimer(min(min(new) for new in counts.values()))
        return iter(())

    def _whole(self) -> dict[str | None, list]:
        """Of each domain ``[told, visited, ticks, added]``, its rows in the state put together."""
        out: dict[str | None, list] = {}
        for domain, last, visited, ticks, added in self.domains.get():
            one = out.setdefault(domain, [None, 0, [], []])
            if last is not None:
                one[:2] = last, visited
            one[2].extend(ticks)
            one[3].extend(added)
        return out

    @staticmethod
    def _summed(ticks, added) -> tuple[list[int], list[int]]:
        different, place = np.unique(np.array(ticks, np.int64), return_inverse=True)
        total = np.zeros(different.size, np.int64)
        np.add.at(total, place, np.array(added, np.int64))
        return different.tolist(), total.tolist()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Tells every tick up to the watermark, also those without rows, and waits for the next one."""
        due = timerValues.getCurrentWatermarkInMs() // self.step * self.step
        told = self.told.get()[0]
        if told is not None and told >= due:
            self.handle.registerTimer(told + self.step)
            return
        kept, out, size = [], [], 0
        for domain, (last, visited, ticks, added) in self._whole().items():
            # What comes behind its tick was dropped by the watermark already.
            open_ = np.array(ticks, np.int64) > (-1 if last is None else last)
            ticks, added = np.array(ticks, np.int64)[open_], np.array(added, np.int64)[open_]
            before = int(ticks.min()) - self.step if last is None else last
            for first in range(before, due, self.step * TICKS):
                end = min(due, first + self.step * TICKS)
                now = (ticks > first) & (ticks <= end)
                counts = np.zeros((end - first) // self.step, np.int64)
                np.add.at(counts, (ticks[now] - first) // self.step - 1, added[now])
                total = visited + np.cumsum(counts)
                out.append(pd.DataFrame({"domain": domain, "tick": np.arange(first + self.step, end + 1, self.step), "visited": total, "stalled": counts == 0}))
                last, visited, size = end, int(total[-1]), size + counts.size
                if size >= TICKS:
                    yield self._rows(out)
                    out, size = [], 0
            later = ticks > due
            kept.append((domain, last, visited, *self._summed(ticks[later], added[later])))
        self.domains.put(kept)
        self.told.update((due, len(kept), 0))
        self.handle.registerTimer(due + self.step)
        if out:
            yield self._rows(out)

    @staticmethod
    def _rows(out: list[pd.DataFrame]) -> pd.DataFrame:
        frame = pd.concat(out, ignore_index=True)
        return frame.assign(tick=pd.to_datetime(frame["tick"], unit="ms", utc=True))

    def close(self) -> None:
        pass


def stream_stalls(feed: DataFrame, interval_seconds: int = S.MONITOR_SECONDS, lateness: str = "10 minutes", buckets: int = STALL_BUCKETS) -> DataFrame:
    """Z3: ``(domain, tick, visited, stalled)``, the ticks of each domain as time passes them.

    Like :func:`pagescout.operators.reports.stall_monitor` of each domain, but as a stream: a timer goes off at every tick, so
    that a tick in which *nothing* came is told as soon as the watermark passes it. ``feed`` has ``fetched_at`` and ``domain``. A
    domain is followed from its first row on; rows without a time do not count. State: open ticks, one count each, and two numbers a domain, kept by ``buckets``
    hashed groups of domains, whose number stays the same over restarts. Needs the state store that :func:`keyed_state` sets.
    """
    step = interval_seconds
    tick_ms = F.ceil((F.unix_timestamp("fetched_at") + 1) / step).cast("long") * step * 1000
    bucket = F.pmod(F.xxhash64("domain"), F.lit(buckets))
    ticks = feed.where(F.col("fetched_at").isNotNull()).withWatermark("fetched_at", lateness).select(bucket.alias("bucket"), "domain", "fetched_at", tick_ms.alias("tick_ms"))
    return ticks.groupBy("bucket").transformWithStateInPandas(
        _Ticks(step * 1000), "domain string, tick timestamp, visited long, stalled boolean", "Append", "EventTime"
    )


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB, beyond the heap of the executors."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def start_append(stream: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Append a stream to a Parquet table; with ``once`` it stops at the end of the present input."""
    writer = stream.writeStream.format("parquet").outputMode("append").option("path", path)
    return _start(writer.option("checkpointLocation", checkpoint), once)


def start_upsert(
    stream: DataFrame, path: str, checkpoint: str, once: bool = False
) -> StreamingQuery:
    """Write every change of an aggregated stream, numbered by batch, below ``path``.

    A batch that is repeated after a failure replaces its own folder, so counts stay exact.
    :func:`latest` reads the current state.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    writer = stream.writeStream.outputMode("update").foreachBatch(write)
    return _start(writer.option("checkpointLocation", checkpoint), once)


def _start(writer: DataStreamWriter, once: bool) -> StreamingQuery:
    return (writer.trigger(availableNow=True) if once else writer).start()


def latest(spark: SparkSession, path: str, keys: list[str], schema: str) -> DataFrame:
    """Current state of a table written by :func:`start_upsert`: the newest row of each key."""
    rows = spark.read.schema(f"{schema}, batch BIGINT").parquet(path)
    others = [c for c in rows.columns if c not in keys and c != "batch"]
    newest = F.max_by(F.struct(*others), "batch").alias("row")
    return rows.groupBy(*keys).agg(newest).select(*keys, "row.*")


def run_to_end(stream: DataFrame, name: str) -> DataFrame:
    """Run an append-mode stream over all present input and return what it wrote."""
    spark = stream.sparkSession
    path = new_path(spark, name)
    start_append(stream, path, f"{path}-checkpoint", once=True).awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def run_in_parts(parts: list[DataFrame], build: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """What the stream ``build`` makes of a feed writes, if the feed arrives in parts and the stream is started anew for each.

    Each part is one or more batches; state and progress live in the checkpoint alone.
    """
    spark = parts[0].sparkSession
    landing, path = new_path(spark, f"{name}-landing"), new_path(spark, name)
    for part in parts:
        part.write.mode("append").parquet(landing)
        made = build(spark.readStream.schema(part.schema).parquet(landing))
        with keyed_state(spark):
            start_append(made, path, f"{path}-checkpoint", once=True).awaitTermination()
    return spark.read.schema(made.schema).parquet(path)
