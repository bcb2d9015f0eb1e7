"""A stored inverted index in segments, kept up with its documents.

The first segment holds the postings of all documents. Each later one holds those of documents that
are new or changed, beside tombstones of documents that changed or went: a posting counts unless a
later segment has a tombstone of its document. Nothing that stands is rewritten until ``merge``
packs the buckets that lie in many segments, and those alone. Postings are partitioned by category
and bucket (a hash of the term) and sorted by term, so that a search reads the buckets of its terms.

A manifest names what is live, a new generation of it for every change, written last: a change that
fails leaves the generation before it. It holds a row for each (segment, category, bucket) and the
version of the source, and is the only part that the driver reads. One writer at a time."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .order import stored
from .search import postings

POSTINGS = "doc long, field string, pos int, term string, segment string, category string, bucket int"
DOCS = "category string, doc long, hash long, segment string"
MANIFEST = "kind string, n int, segment string, category string, bucket int, source string"


class SegmentIndex:
    def __init__(self, spark: SparkSession, path: str, buckets: int = 16):
        self.spark, self.path, self.buckets = spark, path, buckets
        self._live: list[Row] | None = None

    # ------------------------------------------------------------ what is live

    def live(self) -> list[Row]:
        """The rows of the newest generation of the manifest; none before the first ``sync``."""
        if self._live is None:
            try:
                m = self.spark.read.schema(f"{MANIFEST}, generation int").parquet(f"{self.path}/manifest")
                last = m.agg(F.max("generation")).first()[0]
                self._live = m.filter(F.col("generation") == last).collect() if last is not None else []
            except AnalysisException as e:
                if e.getCondition() != "PATH_NOT_FOUND":
                    raise
                self._live = []
        return self._live

    def source(self) -> str | None:
        """The version of the documents that the index stands for."""
        return next((r["source"] for r in self.live() if r["kind"] == "source"), None)

    def _commit(self, rows: list[tuple], source: str) -> None:
        """A new generation: ``rows`` (kind, n, segment, category, bucket), and the source's version."""
        generation = max((r["n"] for r in self.live() if r["kind"] == "source"), default=0) + 1
        every = [(*r, None) for r in rows] + [("source", generation, None, None, None, source)]
        self.spark.createDataFrame(every, MANIFEST).coalesce(1).write.parquet(f"{self.path}/manifest/generation={generation}")
        self._live = None

    def _kept(self) -> list[tuple]:
        return [(r["kind"], r["n"], r["segment"], r["category"], r["bucket"]) for r in self.live() if r["kind"] != "source"]

    def _next(self) -> int:
        return max((r["n"] for r in self.live() if r["kind"] != "source"), default=0) + 1

    def _segments(self, kind: str, schema: str) -> DataFrame:
        """All segments of a kind with their numbers ``n``."""
        held = sorted({(r["segment"], r["n"]) for r in self.live() if r["kind"] == kind})
        if not held:
            return self.spark.createDataFrame([], f"{schema}, n int")
        rows = self.spark.read.schema(schema).option("basePath", f"{self.path}/{kind}").parquet(*[f"{self.path}/{kind}/segment={s}" for s, _ in held])
        number = F.create_map(*[F.lit(x) for sn in held for x in sn])
        return rows.withColumn("n", number[F.col("segment")])

    def _standing(self, rows: DataFrame) -> DataFrame:
        """``rows`` of segments without those that a later segment's tombstone ends."""
        if not any(r["kind"] == "gone" for r in self.live()):
            return rows
        gone = self._segments("gone", "category string, doc long, segment string").groupBy("category", "doc").agg(F.max("n").alias("gone"))
        return rows.join(gone, ["category", "doc"], "left").filter(F.col("gone").isNull() | (F.col("n") >= F.col("gone"))).drop("gone")

    # ------------------------------------------------------------ reading

    def bucket(self, term: Column) -> Column:
        return F.pmod(F.xxhash64(term), F.lit(self.buckets)).cast("int")

    def _raw(self) -> DataFrame:
        rows = self._segments("postings", POSTINGS)
        parts = [(r["segment"], r["category"], r["bucket"]) for r in self.live() if r["kind"] == "postings"]
        merged = {(c, b) for s, c, b in parts if any(r["kind"] == "merged" and r["segment"] == s for r in self.live())}
        if merged:  # a packed bucket's old files lie in segments that are read for their other buckets
            rows = rows.join(F.broadcast(self.spark.createDataFrame(parts, "segment string, category string, bucket int")), ["segment", "category", "bucket"], "left_semi")
        return rows

    def read(self, categories: list[str] | None = None, terms: list[str] | None = None) -> DataFrame:
        """(category, doc, field, term, pos) of all standing postings. A bounded list of categories or
        terms becomes a filter on partitions, so that other buckets are not read."""
        rows = self._raw()
        if categories is not None:
            rows = rows.filter(F.col("category").isin(categories))
        if terms is not None:
            asked = self.spark.createDataFrame([(t,) for t in terms], "term string").select(self.bucket(F.col("term"))).distinct()
            rows = rows.filter(F.col("bucket").isin([r[0] for r in asked.collect()]) & F.col("term").isin(terms))
        return self._standing(rows).select("category", "doc", "field", "term", "pos")

    # ------------------------------------------------------------ writing

    def _write_postings(self, rows: DataFrame, name: str) -> list[tuple[str, int]]:
        """Write a segment's postings; its (category, bucket) pairs. Ranges of (category, bucket, term, doc)
        spread a frequent term over files."""
        keyed = rows.withColumn("bucket", self.bucket(F.col("term"))).select("doc", "field", "pos", "term", "category", "bucket")
        order = ["category", "bucket", "term", "doc"]
        at = f"{self.path}/postings/segment={name}"
        keyed.repartitionByRange(*order).sortWithinPartitions(*order).write.partitionBy("category", "bucket").parquet(at)
        if keyed.isEmpty():
            return []
        return [(r[0], r[1]) for r in self.spark.read.schema("doc long, category string, bucket int").parquet(at).select("category", "bucket").distinct().collect()]

    def sync(self, docs: DataFrame, doc: str, fields: list[str], source: str) -> bool:
        """Bring the index to ``docs`` (category, ``doc`` and text ``fields``), the documents' version
        being ``source``. Documents whose fields hash as before are not touched; without any change only the
        version is noted. Returns whether postings changed. The same source again does nothing."""
        if self.source() == source:
            return False
        now = docs.select("*", F.xxhash64("category", *fields).alias("hash"))
        had = self._standing(self._segments("docs", DOCS)).select("category", F.col("doc").alias(doc), "hash")
        key = ["category", doc, "hash"]
        fresh = stored(now.join(had, key, "left_anti"))
        gone = stored(had.join(now.select(*key), key, "left_anti").select("category", F.col(doc).alias("doc")))
        rows, n, name = self._kept(), self._next(), uuid.uuid4().hex
        some, ended = not fresh.isEmpty(), not gone.isEmpty()
        if some:
            pairs = self._write_postings(postings(fresh, doc, fields), name)
            fresh.select("category", F.col(doc).alias("doc"), "hash").write.parquet(f"{self.path}/docs/segment={name}")
            rows += [("postings", n, name, c, b) for c, b in pairs] + [("docs", n, name, None, None)]
        if ended:
            gone.distinct().write.parquet(f"{self.path}/gone/segment={name}")
            rows.append(("gone", n, name, None, None))
        self._commit(rows, source)
        return some or ended

    def merge(self, most: int = 4) -> list[tuple[str, int]]:
        """Pack each bucket that lies in more than ``most`` segments into one; the packed buckets.
        Other buckets' files stay as they are."""
        held: dict[tuple[str, int], set[str]] = {}
        for r in self.live():
            if r["kind"] == "postings":
                held.setdefault((r["category"], r["bucket"]), set()).add(r["segment"])
        chosen = {cb for cb, segments in held.items() if len(segments) > most}
        if not chosen:
            return []
        pick = F.broadcast(self.spark.createDataFrame(sorted(chosen), "category string, bucket int"))
        rows = self._standing(self._raw().join(pick, ["category", "bucket"], "left_semi"))
        n, name = self._next(), uuid.uuid4().hex
        pairs = self._write_postings(rows, name)
        kept = [r for r in self._kept() if not (r[0] == "postings" and (r[3], r[4]) in chosen)]
        old = {s for cb in chosen for s in held[cb]}
        kept += [("merged", n, s, None, None) for s in old if ("merged", s) not in {(r[0], r[2]) for r in kept}]
        self._commit(kept + [("postings", n, name, c, b) for c, b in pairs], self.source())
        return sorted(chosen)
