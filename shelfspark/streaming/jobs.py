"""Structured Streaming jobs: keyed price summaries, request metrics, snapshot ingestion."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..sources.snapshot import shared_dir
from .store import BucketStore

SUMMARY = "product_id long, epoch long, status string, lowest_price long, observed_at timestamp"
STATE = "leaders binary, timer long"
BUCKETS = 1024  # fixed value: groups of products whose summaries are one value of the state
# state with timers lives in RocksDB, on disk and in the checkpoint, not on the heap
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table's files as a stream."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parquet*")


def run_available(stream: DataFrame, mode: str, each: Callable[[DataFrame, int], None]) -> None:
    """Process what is there now, batch by batch, with a checkpoint in the shared folder."""
    spark = stream.sparkSession
    at = f"{shared_dir(spark)}/stream/{uuid.uuid4().hex}"
    before = spark.conf.get(STORE[0])
    spark.conf.set(*STORE)  # a query keeps the settings it started with
    try:
        q = stream.writeStream.outputMode(mode).option("checkpointLocation", at).trigger(availableNow=True).foreachBatch(each).start()
    finally:
        spark.conf.set(STORE[0], before)
    q.awaitTermination()


def request_metrics(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and cost of requests per class and tumbling window. Run in update mode (``latest_updates``):
    a window's state goes when the watermark has passed it, and rows later than that are dropped."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "class")
    return w.agg(F.count("*").alias("requests"), F.sum("cost").alias("cost"), F.max("cost").alias("largest")).select(F.col("w.start").alias("start"), "class", "requests", "cost", "largest")


def budget_excess(events: DataFrame, limit: int, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Requests above the limit per class and window."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "class").agg(F.count("*").alias("n"))
    return w.select(F.col("w.start").alias("start"), "class", "n", F.greatest(F.lit(0), F.col("n") - limit).alias("excess"))


class _NewestOffer(StatefulProcessor):
    """Keeps the leading offers of a bucket of products: of each the highest epoch, then the newest observation,
    then the highest offer_id. A bucket is one value (rows of product, epoch, time, offer and price), read and
    written once a batch whatever its products, with one event-time timer for the first that its time to live
    ends."""

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("leaders", STATE)

    def _held(self) -> tuple[np.ndarray, int | None]:
        got = self.state.get()
        return (np.frombuffer(got[0], np.int64).reshape(-1, 5), got[1]) if got else (np.empty((0, 5), np.int64), None)

    def _keep(self, leaders: np.ndarray, timer: int | None) -> None:
        """``leaders`` stay; ``timer`` is the one that stands."""
        due = int(leaders[:, 2].min()) + self.ttl_ms if len(leaders) else None
        if timer is not None and timer != due:
            self.handle.deleteTimer(timer)
        if due is None:
            self.state.clear()
            return
        if timer != due:
            self.handle.registerTimer(due)
        self.state.update((np.ascontiguousarray(leaders).tobytes(), due))

    def _rows(self, leaders: np.ndarray, done: np.ndarray) -> pd.DataFrame:
        price = pd.array(leaders[:, 4], "Int64")
        price[~done] = None
        observed = pd.Series(leaders[:, 2].astype("datetime64[ms]")).where(done)
        return pd.DataFrame({"product_id": leaders[:, 0], "epoch": leaders[:, 1], "status": np.where(done, "complete", "pending"), "lowest_price": price, "observed_at": observed})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held, timer = self._held()
        best = held
        for f in rows:
            ms = f["observed_at"].astype("datetime64[ms]").astype("int64")
            new = np.column_stack([f["product_id"], f["epoch"], ms, f["offer_id"], f["price"]]).astype(np.int64)
            best = np.concatenate([best, new])
            best = best[np.lexsort(best.T[::-1])]
            best = best[np.append(best[1:, 0] != best[:-1, 0], True)]
        # leaders lie by product; those that stand as they were change nothing
        at = np.searchsorted(held[:, 0], best[:, 0])
        known = at < len(held)
        known[known] = (held[at[known]] == best[known]).all(axis=1)
        done = best[:, 2] + self.ttl_ms > timerValues.getCurrentWatermarkInMs()
        if known.all():
            return
        self._keep(best[known | done], timer)
        yield self._rows(best[~known], done[~known])  # those not done were over before they came

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held, _ = self._held()
        due = expiredTimerInfo.getExpiryTimeInMs()
        stay = held[:, 2] + self.ttl_ms > max(due, timerValues.getCurrentWatermarkInMs())
        self._keep(held[stay], None)  # the timer that ended goes by itself
        yield self._rows(held[~stay], np.zeros((~stay).sum(), bool))

    def close(self) -> None:
        pass


def offer_summary(offers: DataFrame, ttl_days: int = 60, late: str = "10 minutes") -> DataFrame:
    """The summary of every product of a stream (product_id, epoch, offer_id, price, observed_at), run in
    update mode by ``latest_updates``. The newest observation stands and older ones that come later change
    nothing; an offer of a higher epoch ends what an earlier one left, whatever its time, and offers of
    an earlier epoch then change nothing; after the time to live the summary is pending again and its
    state is freed. Rows without product, epoch, offer, price or time say nothing."""
    needed = ["product_id", "epoch", "offer_id", "price", "observed_at"]
    rows = offers.select(*needed).withWatermark("observed_at", late).dropna(subset=needed)
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("product_id"), F.lit(BUCKETS)).cast("int"))
    return rows.groupBy("bucket").transformWithStateInPandas(_NewestOffer(ttl_days * 86_400_000), SUMMARY, "Update", "EventTime")


def latest_updates(stream: DataFrame, *keys: str) -> DataFrame:
    """Run an update-mode stream; the last update of each key. A stream without input gives no rows."""
    spark = stream.sparkSession
    at = f"{shared_dir(spark)}/stream-out/{uuid.uuid4().hex}"
    spark.createDataFrame([], stream.schema).withColumn("batch", F.lit(-1)).write.parquet(f"{at}/batch_id=-1")
    run_available(stream, "update", lambda batch, n: batch.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{at}/batch_id={n}"))
    got = spark.read.parquet(at)
    rest = F.struct(*[c for c in got.columns if c not in (*keys, "batch", "batch_id")])
    return got.groupBy(*keys).agg(F.max_by(rest, "batch").alias("r")).select(*keys, "r.*")


def ingest(stream: DataFrame, store: DataFrame, key: str, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """Merge every micro-batch into the keyed store: a batch rewrites the buckets that it touches and changes,
    and a repeated batch none."""
    spark = stream.sparkSession
    held = BucketStore(spark, f"{shared_dir(spark)}/store/{uuid.uuid4().hex}", key, store.schema.simpleString()[7:-1].replace(":", " "))
    held.merge(store, -1, lambda old, rows: rows)
    run_available(stream, "append", lambda batch, n: held.merge(batch, n, merge))
    return held.read()


def hit_rate(hit: Column) -> Column:
    return F.try_divide(F.count_if(hit), F.count("*"))
