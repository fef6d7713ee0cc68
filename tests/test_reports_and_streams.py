from datetime import datetime, timedelta

from pyspark.sql import functions as F

from pagescout.functions import urls as U
from pagescout.operators import reports as RP
from pagescout.operators import signals as SG
from pagescout.streaming import pages as ST
from queryset import corpus as C

SF = "/root/testdata/sf0.001"


def test_stall_monitor_crosses_days(spark):
    start = datetime(2024, 1, 1, 23, 58, 10)
    seconds = [0, 1, 29, 95, 100, 86400 * 2]
    df = spark.createDataFrame([(start + timedelta(seconds=s),) for s in seconds], "ts TIMESTAMP")
    rows = RP.stall_monitor(df, 30).orderBy("tick").collect()
    ticks = []
    tick = datetime(2024, 1, 1, 23, 58, 30)
    last = 0
    while True:
        total = sum(start + timedelta(seconds=s) < tick for s in seconds)
        ticks.append((tick, total, total == last))
        last = total
        if total == len(seconds):
            break
        tick += timedelta(seconds=30)
    assert [(r.tick, r.visited, r.stalled) for r in rows] == ticks


def test_accuracy(spark):
    said = spark.createDataFrame([("a", True), ("b", True), ("c", False), ("d", False), ("e", True)], "url_key STRING, is_product BOOLEAN")
    true = spark.createDataFrame([("a", True), ("b", False), ("c", True), ("d", False), ("z", True)], "url_key STRING, label BOOLEAN")
    row = RP.detection_accuracy(said, true).first()
    assert tuple(row) == (1, 1, 1, 1, 0.5, 0.5, 0.5)


def test_approximate_visited_count(spark):
    df = spark.range(5000).select(F.col("id").cast("string").alias("url_key"))
    assert RP.visited_count(df).first()[0] == 5000
    assert abs(RP.visited_count(df, approximate=True).first()[0] - 5000) < 500


def _landing(spark, tmp_path, with_time=False):
    """Pages in several files, as a crawler would drop them."""
    path = str(tmp_path / "landing")
    pages = C.pages(spark, SF)
    if with_time:
        pages = pages.withColumn("fetched_at", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("page_id") % 100))
    pages.repartition(5).write.parquet(path)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema)
    return path, schema


def test_stream_equals_batch(spark, tmp_path):
    path, schema = _landing(spark, tmp_path)
    feed = ST.read_page_stream(spark, path, schema, files_per_trigger=2)
    streamed = ST.run_to_end(ST.stream_product_pages(feed).select("page_id", "score"), "scored")
    batch = SG.product_pages(SG.page_signals(spark.read.parquet(path).where("status = 200"))).select("page_id", "score")
    assert streamed.count() == batch.count() > 0
    assert streamed.exceptAll(batch).isEmpty()


def test_stream_dedup(spark, tmp_path):
    path, schema = _landing(spark, tmp_path, with_time=True)
    keys = U.with_normal_url(spark.read.parquet(path), "url", "url_key").select("url_key").distinct()
    for horizon in (None, "1 day"):
        feed = ST.read_page_stream(spark, path, schema, files_per_trigger=2)
        fresh = ST.run_to_end(ST.stream_dedup_urls(feed, horizon).select("url_key"), "fresh")
        assert fresh.count() == keys.count()
        assert fresh.exceptAll(keys).isEmpty()


def test_a_page_that_was_not_fetched_is_no_product(spark):
    html = '<html><head><meta property="og:type" content="product"></head></html>'
    pages = spark.createDataFrame([(1, "https://h/product/1", html, 200), (2, "https://h/product/2", html, 404)], "page_id BIGINT, url STRING, html STRING, status INT")
    assert [r.page_id for r in ST.stream_product_pages(pages, threshold=15).collect()] == [1]


def _feed(spark):
    rows = [(f"https://h{i % 3}.com/{i % 7}", f"h{i % 3}", i * 97 % 4000 if i % 3 else i * 31 % 900) for i in range(300)]
    start = F.lit(1_700_000_000)
    feed = spark.createDataFrame(rows, "url STRING, domain STRING, s INT").withColumn("fetched_at", F.timestamp_seconds(start + F.col("s")))
    return [feed.where("s < 1500"), feed.where("s >= 1500 AND s < 2500"), feed.where("s >= 2500")]


def test_streamed_stalls_equal_the_batch_monitor_after_restarts(spark):
    parts = _feed(spark)
    told = ST.run_in_parts(parts, lambda feed: ST.stream_stalls(feed, 30, "1 second"), "stalls")
    whole = parts[0].union(parts[1]).union(parts[2])
    until = whole.agg((F.max("fetched_at") - F.expr("INTERVAL 1 SECOND")).alias("t")).first().t
    for domain in ("h0", "h1", "h2"):
        mine = {(r.tick, r.visited, r.stalled) for r in told.where(F.col("domain") == domain).collect()}
        batch = RP.stall_monitor(whole.where(F.col("domain") == domain).select(F.col("fetched_at").alias("ts")), 30)
        want = {(r.tick, r.visited, r.stalled) for r in batch.collect() if r.tick <= until}
        # The monitor ends with a domain's last row, the stream goes on to the watermark.
        after = {m for m in mine if m[0] > max(w[0] for w in want)}
        assert mine - after == want and all(stalled for _, _, stalled in after)
    assert any(r.stalled for r in told.collect()) and told.where("domain = 'h0' AND stalled").count() > 50


def test_dedup_in_windows_over_restarts(spark):
    parts = _feed(spark)
    keep = lambda feed: ST.stream_dedup_in_windows(feed, "10 minutes", "1 minute").select("url_key", F.col("window.start").alias("start"))
    fresh = ST.run_in_parts(parts, keep, "windowed")
    whole = parts[0].union(parts[1]).union(parts[2])
    want = whole.select(F.col("url").alias("url_key"), F.window("fetched_at", "10 minutes").start.alias("start")).distinct()
    assert fresh.exceptAll(want).isEmpty() and want.exceptAll(fresh).isEmpty()


class _Store:
    """A state store for one bucket that counts its calls."""

    def __init__(self):
        self.calls, self.timers, self.kept = 0, [], {}

    def getListState(self, name, schema):
        return _Variable(self, name)

    getValueState = getListState

    def registerTimer(self, at):
        self.calls += 1
        self.timers.append(at)


class _Variable:
    def __init__(self, store, name):
        self.store, self.name = store, name

    def _call(self, *value, add=False):
        self.store.calls += 1
        if value:
            self.store.kept[self.name] = (self.store.kept.get(self.name, []) if add else []) + list(value[0])
        return self.store.kept.get(self.name)

    def exists(self):
        return self._call() is not None

    def get(self):
        return iter(self._call() or [])

    def put(self, rows):
        self._call(rows)

    def appendList(self, rows):
        self._call(rows, add=True)

    def update(self, row):
        self._call(row)


class _Value(_Variable):
    def get(self):
        return tuple(self._call())


def test_stalls_cost_calls_by_bucket_and_not_by_domain_or_tick(monkeypatch):
    import random
    from types import SimpleNamespace

    import pandas as pd

    monkeypatch.setattr(ST, "PIECES", 100)
    monkeypatch.setattr(ST, "TICKS", 64)
    store = _Store()
    store.getValueState = lambda name, schema: _Value(store, name)
    ticks, rng = ST._Ticks(10), random.Random(3)
    ticks.init(store)
    names = [*(f"d{i}" for i in range(200)), None]
    fed, told, calls = [], [], []
    for low, high, watermark in ((0, 500, -1), (50, 700, 305), (400, 900, 308), (310, 2000, 1500), (1510, 1600, 2777)):
        rows = [(rng.choice(names), rng.randrange(low // 10 + 1, high // 10) * 10) for _ in range(1500)]
        fed += rows
        store.calls = 0
        frame = pd.DataFrame(rows, columns=["domain", "tick_ms"])
        list(ticks.handleInputRows((0,), iter([frame[:700], frame[700:]]), None))
        if any(t <= watermark for t in store.timers):
            store.timers.clear()
            for out in ticks.handleExpiredTimer((0,), SimpleNamespace(getCurrentWatermarkInMs=lambda w=watermark: w), None):
                told += [(None if d != d or d is None else d, t.value // 10**6, v, s) for d, t, v, s in out.itertuples(index=False)]
        calls.append(store.calls)
    want = []
    for name in names:
        mine = [t for d, t in fed if d == name]
        want += [(name, t, sum(x <= t for x in mine), t not in mine) for t in range(min(mine), 2771, 10)]
    assert sorted(told, key=str) == sorted(want, key=str)
    assert max(calls) < 20


def test_stalls_of_rows_without_time_or_domain(spark):
    at = datetime(2024, 1, 1, 10, 0, 5)
    rows = [("a", at), ("a", None), (None, at), ("b", None), ("a", at + timedelta(seconds=95))]
    feed = spark.createDataFrame(rows, "domain string, fetched_at timestamp")
    told = ST.run_in_parts([feed], lambda f: ST.stream_stalls(f, 30, "1 second"), "stalls")
    assert sorted((r.domain or "", r.visited, r.stalled) for r in told.collect()) == [("", 1, False), ("", 1, True), ("", 1, True), ("a", 1, False), ("a", 1, True), ("a", 1, True)]
