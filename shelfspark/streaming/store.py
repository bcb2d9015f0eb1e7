"""A keyed store that micro-batches are merged into: buckets of keys, of which a batch rewrites those that
its rows touch. The newest generation of the manifest names the batch that wrote each bucket last, so
a batch that is tried again finds itself done, and one that fails leaves the store as it was."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class BucketStore:
    def __init__(self, spark: SparkSession, path: str, key: str, schema: str, buckets: int = 16):
        self.spark, self.path, self.key, self.schema, self.buckets = spark, path, key, schema, buckets

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int").alias("bucket")

    def live(self) -> dict[int, int]:
        """The batch that wrote each bucket last; a row for each bucket comes to the driver."""
        try:
            m = self.spark.read.schema("bucket int, batch long, generation long").parquet(f"{self.path}/manifest")
            last = m.agg(F.max("generation")).first()[0]
            return {r["bucket"]: r["batch"] for r in m.filter(F.col("generation") == last).collect()}
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return {}

    def last_batch(self) -> int | None:
        try:
            return self.spark.read.schema("generation long").parquet(f"{self.path}/manifest").agg(F.max("generation")).first()[0]
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        """The rows of all buckets, or of some."""
        paths = [f"{self.path}/data/batch={n}/bucket={b}" for b, n in sorted(self.live().items()) if buckets is None or b in buckets]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def merge(self, rows: DataFrame, batch: int, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> list[int]:
        """Merge ``rows`` into the buckets that they touch, as batch number ``batch``; these buckets. A batch
        that the store already holds changes nothing, nor does one whose rows change nothing."""
        last = self.last_batch()
        if last is not None and batch <= last:
            return []
        touched = [r[0] for r in rows.select(self._bucket()).distinct().collect()]
        if not touched and last is not None:
            return []
        live, old = self.live(), self.read(touched)
        names = old.columns
        new = merge(old, rows.select(*names)).select(*names)
        now = lambda df: {r["bucket"]: (r["n"], r["h"]) for r in df.select(self._bucket(), F.xxhash64(*names).cast("decimal(38,0)").alias("h")).groupBy("bucket").agg(F.count("*").alias("n"), F.sum("h").alias("h")).collect()}
        before, after = now(old), now(new)
        changed = sorted(b for b in touched if before.get(b) != after.get(b))
        if changed:
            out = new.withColumn("bucket", self._bucket()).filter(F.col("bucket").isin(changed))
            out.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/batch={batch}")
        live |= {b: batch for b in changed}
        manifest = self.spark.createDataFrame(sorted(live.items()), "bucket int, batch long")
        manifest.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/generation={batch}")
        return changed
