"""Query registration, and catalog views over the given tables.

Each view is one SQL text that both engines read the same way; queries build on them with the
DataFrame operators of the library, and their oracle SQL on the same views."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.order import stored
from ..operators.segments import SegmentIndex
from ..sources.snapshot import shared_dir
from . import raw_cases

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
STORED: dict[tuple[str, str, str], tuple] = {}

VIEWS = {
    "v_products": """SELECT p_partkey AS product_id, 'part' AS source, concat('K', p_partkey) AS upstream_key, lower(p_type) AS category,
        p_brand AS manufacturer, p_name AS name,
        CASE WHEN p_partkey % 5 = 0 THEN NULL WHEN p_partkey % 7 = 0 THEN '' ELSE split_part(p_name, ' ', 1) END AS series,
        CASE WHEN p_partkey % 20 <> 0 THEN 1 ELSE 0 END AS active,
        CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE 2000 + p_size % 25 END AS release_year FROM {part}""",
    "v_spec": """SELECT p_partkey AS product_id, CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE p_size END AS size_mm, p_retailprice AS price FROM {part}""",
    "v_facets": """SELECT DISTINCT p_partkey AS product_id, 'word' AS attribute, split_part(p_name, ' ', 1) AS value FROM {part}
        UNION SELECT DISTINCT p_partkey, 'word', split_part(p_name, ' ', 2) FROM {part}
        UNION SELECT p_partkey, 'size_band', CAST(CAST(floor(p_size / 10.0) AS INT) AS VARCHAR(10)) FROM {part}""",
    "v_identifiers": """SELECT p_partkey AS product_id, 'mpn' AS type, concat(p_brand, '-', p_size) AS value, concat(upper(p_brand), '-', p_size) AS value_key, 'upstream' AS origin FROM {part}
        UNION ALL SELECT p_partkey, 'ean', concat('4', lpad(CAST(p_partkey AS VARCHAR(20)), 12, '0')), concat('4', lpad(CAST(p_partkey AS VARCHAR(20)), 12, '0')), 'upstream' FROM {part} WHERE p_partkey % 4 <> 0
        UNION ALL SELECT p_partkey, 'mpn', concat('L-', p_partkey % 900), concat('L-', p_partkey % 900), 'local' FROM {part} WHERE p_partkey % 6 = 0""",
    "v_snapshot_a": """SELECT concat('K', p_partkey) AS upstream_key, lower(p_type) AS category, p_name AS name, p_brand AS manufacturer, p_retailprice AS price, p_size AS size_mm, CASE WHEN p_partkey % 20 <> 0 THEN 1 ELSE 0 END AS active FROM {part}""",
    "v_snapshot_b": """SELECT concat('K', p_partkey) AS upstream_key, lower(p_type) AS category, p_name AS name, p_brand AS manufacturer, CASE WHEN p_partkey % 7 = 0 THEN p_retailprice + 1 ELSE p_retailprice END AS price,
        CASE WHEN p_partkey % 19 = 0 THEN NULL ELSE p_size END AS size_mm, CASE WHEN p_partkey % 29 = 0 THEN 1 ELSE 0 END AS bad FROM {part} WHERE p_partkey % 17 <> 0
        UNION ALL SELECT concat('K', p_partkey + 1000000), lower(p_type), p_name, p_brand, p_retailprice, p_size, 0 FROM {part} WHERE p_partkey % 23 = 0""",
    "v_offers": """SELECT l_orderkey * 8 + l_linenumber AS offer_id, l_partkey AS product_id, l_suppkey AS seller_id, CAST(round(l_extendedprice / l_quantity) AS BIGINT) AS price,
        l_returnflag <> 'R' AS in_stock, CASE WHEN l_linestatus = 'F' THEN 'new' ELSE 'used' END AS condition, l_shipdate AS observed_at FROM {lineitem}""",
    "v_asks": """SELECT p_partkey AS query_id, CASE p_partkey % 8 WHEN 0 THEN 'memory' WHEN 1 THEN 'storage' WHEN 2 THEN 'gpu' WHEN 3 THEN 'psu' WHEN 4 THEN 'case_fan' WHEN 5 THEN 'cpu_cooler' WHEN 6 THEN 'motherboard' ELSE 'cpu' END AS category,
        p_size AS size, split_part(p_name, ' ', 1) AS word, CASE p_partkey % 8
        WHEN 0 THEN CASE WHEN p_partkey % 48 = 0 THEN concat(split_part(p_name, ' ', 1), ' 8gb 16gb') ELSE concat(split_part(p_name, ' ', 1), ' ', 8 + p_size % 8, CASE WHEN p_size % 2 = 0 THEN 'GB' ELSE ' gb' END, ' DDR', 3 + p_size % 3, ' ', 1600 + 100 * (p_size % 40), CASE p_size % 3 WHEN 0 THEN 'MHz' WHEN 1 THEN ' MT/s' ELSE '' END, ' CL', 14 + p_size % 20) END
        WHEN 1 THEN concat(1 + p_size % 4, CASE WHEN p_size % 2 = 0 THEN 'TB' ELSE ' tb' END, ' ', split_part(p_name, ' ', 1), CASE WHEN p_size % 3 = 0 THEN ' NVMe' ELSE '' END)
        WHEN 2 THEN concat('rtx', 5000 + p_size, ' ', 4 + p_size % 12, 'GB')
        WHEN 3 THEN concat(400 + 10 * p_size, 'W ', CASE p_size % 3 WHEN 0 THEN '80+ Gold' WHEN 1 THEN 'bronze' ELSE split_part(p_name, ' ', 1) END, CASE WHEN p_size % 2 = 0 THEN ' SFX-L psu' ELSE ' atx' END)
        WHEN 4 THEN concat(split_part(p_name, ' ', 1), ' ', 60 + p_size, CASE WHEN p_size % 2 = 0 THEN ' mm PWM' ELSE 'mm' END, ' fan')
        WHEN 5 THEN CASE p_size % 3 WHEN 0 THEN 'AIO 360 cooler' WHEN 1 THEN concat('air ', 80 + p_size, 'mm cooler master') ELSE concat('cooler ', split_part(p_name, ' ', 1)) END
        WHEN 6 THEN concat(CASE p_size % 3 WHEN 0 THEN 'AM5' WHEN 1 THEN 'lga1700' ELSE 'LGA 1851' END, ' ', CASE p_size % 4 WHEN 0 THEN 'micro-atx' WHEN 1 THEN 'mITX' WHEN 2 THEN 'ATX' ELSE 'eatx' END, ' ddr', 4 + p_size % 2, ' B', 600 + p_size, CASE WHEN p_size % 2 = 0 THEN concat(' ', split_part(p_name, ' ', 1)) ELSE '' END)
        ELSE CASE p_size % 4 WHEN 0 THEN 'AMD Ryzen 7' WHEN 1 THEN 'ultra 5' WHEN 2 THEN 'intel core i9' ELSE p_name END END AS query FROM {part}""",
    "v_models": """SELECT p_partkey AS product_id, lower(p_type) AS category, concat(split_part(p_name, ' ', 1), CASE p_partkey % 3 WHEN 0 THEN concat('-', p_size % 10) WHEN 1 THEN concat(' of ', p_size % 10) ELSE concat('', p_size % 10) END, ' ', split_part(p_name, ' ', 2)) AS name,
        split_part(p_name, ' ', 1) AS word, p_size % 10 AS digit, p_partkey % 3 AS kind FROM {part}""",
    "v_search": """SELECT product_id, category, active, release_year, concat(word, CASE product_id % 4 WHEN 0 THEN concat(' rtx', 1000 + size) WHEN 1 THEN concat(' RTX ', 1000 + size) ELSE '' END) AS name,
        CASE size % 5 WHEN 0 THEN 'Acme' WHEN 1 THEN 'Borea' WHEN 2 THEN 'Cyan' WHEN 3 THEN 'Delta' ELSE 'Blue' END AS manufacturer, CASE product_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'prime edge' WHEN 2 THEN 'prime' ELSE 'core' END AS series,
        CASE WHEN category = 'storage' THEN CASE size % 4 WHEN 0 THEN 'SATA' WHEN 1 THEN 'mSATA' WHEN 2 THEN 'SATA mSATA' ELSE '' END WHEN product_id % 3 = 0 THEN 'black' WHEN product_id % 3 = 1 THEN 'white oc' ELSE CASE size % 8 WHEN 0 THEN 'mx 4' WHEN 1 THEN 'MX4' WHEN 2 THEN 'mx4 4' WHEN 3 THEN 'mx fan 4' WHEN 4 THEN 'Type-C' WHEN 5 THEN 'c type' WHEN 6 THEN 'type c2 c' ELSE '' END END AS variant, CASE WHEN category = 'cpu' THEN CASE size % 4 WHEN 0 THEN 'Ryzen 7' WHEN 1 THEN 'Core i5' END END AS family, concat('K', product_id, ' ', part_number, CASE product_id % 7 WHEN 0 THEN ' mx4' WHEN 1 THEN concat(' ', 8 + size % 8, 'gb ddr', 3 + size % 3) ELSE '' END) AS text,
        CASE WHEN category = 'motherboard' THEN concat(CASE WHEN product_id % 2 = 0 THEN 'AMD B' ELSE 'B' END, 600 + size) END AS chipset,
        CASE WHEN product_id % 11 > 0 THEN CASE category WHEN 'memory' THEN concat('capacity_gb=', 8 + size % 8) WHEN 'case_fan' THEN concat('size_mm=', 60 + size) END END AS spec1, CASE WHEN category = 'memory' THEN concat('ram_type=DDR', 3 + size % 3) END AS spec2
        FROM (SELECT p_partkey AS product_id, CASE p_type WHEN 'ECONOMY' THEN 'gpu' WHEN 'SMALL' THEN 'case_fan' WHEN 'MEDIUM' THEN 'cpu' WHEN 'LARGE' THEN 'memory' WHEN 'PROMO' THEN 'motherboard' ELSE 'storage' END AS category,
            CASE WHEN p_partkey % 20 <> 0 THEN 1 ELSE 0 END AS active, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE 2010 + p_size % 25 END AS release_year, p_name AS word, p_size AS size, concat(upper(p_brand), '-', p_size) AS part_number FROM {part})""",
    "v_searches": """SELECT query_id, k, a, b, z, CASE k WHEN 11 THEN 'memory' WHEN 17 THEN 'memory' WHEN 12 THEN 'cpu' WHEN 13 THEN 'motherboard' WHEN 14 THEN 'case_fan' ELSE other END AS category,
        CASE k WHEN 0 THEN concat(a, ' ', b) WHEN 1 THEN concat(b, ' ', a) WHEN 2 THEN concat('rtx', 1000 + z) WHEN 3 THEN concat(a, ' RTX ', 1000 + z) WHEN 4 THEN concat(substr(b, 1, 3), ' ', substr(a, 1, 2)) WHEN 5 THEN CASE z % 4 WHEN 0 THEN 'ｐｒｉｍｅ　ｂｌａｃｋ' WHEN 1 THEN concat('prime black', repeat(' x', 12)) WHEN 2 THEN concat('prime black ', repeat('y', 200)) ELSE 'prime black' END
        WHEN 6 THEN concat(CASE WHEN other = 'storage' THEN 'sata ' ELSE 'black ' END, CASE WHEN other = 'storage' AND z % 2 = 0 THEN '' ELSE concat(b, ' ') END, 'acme') WHEN 7 THEN concat(a, ' ', b, ' RTX ', 1000 + z) WHEN 8 THEN concat('Brand#', 1 + z % 25, '-', 1 + z) WHEN 9 THEN concat('4', lpad(CAST(query_id AS VARCHAR(20)), 12, '0')) WHEN 10 THEN concat(a, ' x ', b, ' rtx', 1000 + z)
        WHEN 11 THEN concat(8 + z % 8, 'GB DDR', 3 + z % 3) WHEN 12 THEN CASE WHEN z % 2 = 0 THEN 'AMD Ryzen 7' ELSE 'core i5' END WHEN 13 THEN concat(a, ' B', 600 + z) WHEN 14 THEN concat(60 + z, 'mm ', b, ' fan')
        WHEN 15 THEN CASE WHEN z % 2 = 0 THEN 'MX-4' ELSE concat('mx-4 ', b) END WHEN 16 THEN CASE WHEN z % 2 = 0 THEN 'Type C' ELSE concat('mx4 ', b) END WHEN 17 THEN concat(a, ' ', 8 + z % 8, 'GB DDR', 3 + z % 3) ELSE concat('L-', 6 * z) END AS query
        FROM (SELECT c_custkey AS query_id, c_custkey % 19 AS k, c_custkey % 49 AS z, CASE c_custkey % 4 WHEN 0 THEN 'red' WHEN 1 THEN 'small' WHEN 2 THEN 'blue' ELSE 'hot' END AS a, CASE c_custkey % 7 WHEN 0 THEN 'ring' WHEN 1 THEN 'widget' WHEN 2 THEN 'bolt' WHEN 3 THEN 'gear' WHEN 4 THEN 'ring' WHEN 5 THEN 'gear' ELSE 'bolt' END AS b,
            CASE c_custkey % 11 WHEN 0 THEN 'gpu' WHEN 1 THEN 'case_fan' WHEN 2 THEN 'cpu' WHEN 3 THEN 'memory' WHEN 4 THEN 'motherboard' WHEN 5 THEN 'storage' WHEN 6 THEN 'gpu' WHEN 7 THEN 'cpu' ELSE 'case_fan' END AS other FROM {customer})""",
    "v_raw": raw_cases.raw_view(),
    "v_broken": raw_cases.broken_view(),
    "v_docs": "SELECT doc_id, lang AS category, text FROM {documents}",
    "v_events": "SELECT event_id, ts, user_id, event_type AS class, value AS cost, props FROM {events}",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A catalog view as a DataFrame."""
    text = VIEWS[name]
    return spark.sql(text, **{t: table(spark, sf_dir, t) for t in set(re.findall(r"\{(\w+)\}", text))})


def spread_view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view whose rows cost far more than their bytes: small files of many rows are dealt to all tasks
    before the view is made of them, as a split of a file is sized by its bytes alone."""
    text, n = VIEWS[name], int(spark.conf.get("spark.sql.shuffle.partitions"))
    return spark.sql(text, **{t: table(spark, sf_dir, t).repartition(n) for t in set(re.findall(r"\{(\w+)\}", text))})


class Catalog:
    """The views and tables of one data folder, by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self.versions: dict[str, str] = {}

    def version(self, *tables: str) -> str:
        """A fingerprint of the tables' files: their paths, sizes and times. One row comes to the driver."""
        for t in tables:
            if t not in self.versions:
                files = self.spark.read.format("binaryFile").load(f"{self.sf_dir}/{t}.parquet").select(F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)").alias("h"))
                self.versions[t] = "-".join(str(x) for x in files.agg(F.count("*"), F.sum("h"), F.min("h")).first())
        return ";".join(self.versions[t] for t in tables)

    def _at(self, name: str) -> tuple[str, str, str]:
        return self.spark.sparkContext.applicationId, self.sf_dir, name

    def stored(self, name: str, build: Callable[[], DataFrame], *tables: str) -> DataFrame:
        """What many queries read and ``tables`` decide, written once under the shared folder; written
        again when the tables' files are others than they were."""
        key, version = self._at(name), self.version(*tables)
        if key not in STORED or STORED[key][0] != version:
            df = stored(build())
            STORED[key] = (version, df.inputFiles()[0].rsplit("/", 1)[0] if df.inputFiles() else None, df.schema)
        _, path, schema = STORED[key]
        return self.spark.read.schema(schema).parquet(path) if path else self.spark.createDataFrame([], schema)

    def index(self, name: str, docs: Callable[[], DataFrame], doc: str, fields: list[str], *tables: str) -> DataFrame:
        """Postings of ``docs``, kept in a segment index for the session: when the tables' files are
        others than they were, the documents that differ are indexed again."""
        held = SegmentIndex(self.spark, f"{shared_dir(self.spark)}/index/{hashlib.md5(repr(self._at(name)).encode()).hexdigest()}")
        version = self.version(*tables)
        if held.source() != version:
            held.sync(docs(), doc, fields, version)
        return held.read()

    def spread(self, name: str) -> DataFrame:
        return spread_view(self.spark, self.sf_dir, f"v_{name}")

    def __getattr__(self, name: str) -> DataFrame:
        return view(self.spark, self.sf_dir, f"v_{name}") if f"v_{name}" in VIEWS else table(self.spark, self.sf_dir, name)


def with_views(sql: str) -> str:
    """``sql`` with the views that it names as common table expressions before it."""
    used = [f"{v} AS ({re.sub(r'{(\w+)}', r'\1', VIEWS[v])})" for v in VIEWS if re.search(rf"\b{v}\b", sql)]
    if not used:
        return sql
    body = sql.strip()
    return f"WITH {', '.join(used)}" + (", " + body[5:] if body[:5].upper() == "WITH " else " " + body)


def query(sql: str | None = None):
    """Register a function of a Catalog as the query of its name, with its SQL."""

    def register(f: Callable[[Catalog], DataFrame]) -> Callable[[Catalog], DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Catalog(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = with_views(sql)
        return f

    return register
