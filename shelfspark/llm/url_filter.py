"""URL filters by a temporal list join, in DataFrame functions alone.

List entries are dated edits: (list_name, pattern, action, effective_at), action being block,
allow or remove. Each entry holds from its date to the next edit of the same list and pattern (a
validity interval); an as-of join evaluates every capture against the entries active at its fetch
time. Patterns are ``domain:example.com`` (the domain and all below it) or
``prefix:host/path`` (whole path segments). Among the active entries that match, the most specific
wins (a prefix before a domain, then the longer one); at a tie allow wins over block, then the
smaller list name.

Intervals and captures meet on (pattern, time bucket), so that the captures of one hot host spread
over the buckets; Spark broadcasts the intervals where they are small and else splits skewed
buckets.

Defined cases: a null or malformed URL has no host, matches nothing and is kept; a null fetch time
matches nothing; edits of one pattern at the same instant count once (remove over allow over
block); repeated captures are judged each by id; empty lists keep all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, row_keys

URL = "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)(?::[0-9]*)?(/[^?#]*)?"


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), URL, 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), URL, 2)


def intervals(entries: DataFrame, bucket_days: int, until: Column) -> DataFrame:
    """Validity intervals of block and allow entries, one row for each time bucket they touch."""
    strength = F.when(F.col("action") == "remove", 3).when(F.col("action") == "allow", 2).otherwise(1)
    edits = entries.filter("pattern is not null and effective_at is not null").groupBy("list_name", "pattern", "effective_at").agg(F.max(strength).alias("strength"))
    w = Window.partitionBy("list_name", "pattern").orderBy("effective_at")
    held = edits.withColumn("valid_to", F.lead("effective_at").over(w)).filter("strength < 3")
    last = F.least(F.coalesce("valid_to", until), until)
    held = held.filter(F.col("effective_at") <= until)
    bucket = F.explode(F.sequence(_bucket(F.col("effective_at"), bucket_days), _bucket(last, bucket_days))).alias("bucket")
    return held.select("list_name", "pattern", F.col("effective_at").alias("valid_from"), "valid_to", (F.col("strength") == 2).alias("allows"), bucket)


def _bucket(at: Column, days: int) -> Column:
    return F.floor(F.unix_timestamp(at) / (86400 * days)).cast("long")


def temporal_url_filter(captures: DataFrame, entries: DataFrame, bucket_days: int = 7, id: str = "page_id") -> DataFrame:
    """(id, host, kept, matched_list, matched_pattern) of every capture (id, url, fetched_at)."""
    depth, latest = entries.agg(F.max(F.size(F.split("pattern", "/")) - 1)).first()[0] or 0, captures.agg(F.max("fetched_at").alias("t")).first()[0]
    rules = materialize(intervals(entries, bucket_days, F.lit(latest).cast("timestamp")))
    seen = captures.select(F.col(id).alias("id"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "fetched_at")
    seen = seen.withColumn("row", F.struct(*row_keys("id", "host", "path", "fetched_at")))
    labels = F.split("host", "\\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(F.lit("domain:"), F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    parts = F.filter(F.split("path", "/"), lambda x: x != "")
    prefixes = F.transform(
        F.sequence(F.lit(1), F.least(F.size(parts), F.lit(max(1, depth)))), lambda i: F.concat(F.lit("prefix:"), F.col("host"), F.lit("/"), F.array_join(F.slice(parts, F.lit(1), i), "/"))
    )
    keys = F.concat(domains, F.when(F.size(parts) > 0, prefixes).otherwise(F.array().cast("array<string>")))
    asked = seen.filter("host <> '' and fetched_at is not null").select("row", "fetched_at", _bucket(F.col("fetched_at"), bucket_days).alias("bucket"), F.explode(keys).alias("pattern"))
    active = (F.col("fetched_at") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("fetched_at") < F.col("valid_to")))
    found = asked.join(rules, ["pattern", "bucket"]).filter(active)
    rank = F.struct(F.col("pattern").startswith("prefix:").alias("is_prefix"), F.length("pattern").alias("long"), "allows")
    best = found.groupBy("row").agg(F.max(F.struct(rank.alias("rank"))).alias("best"), F.collect_set(F.struct(rank.alias("rank"), "list_name", "pattern")).alias("all"))  # as many as lists that match
    win = F.array_min(F.transform(F.filter("all", lambda x: x["rank"] == F.col("best.rank")), lambda x: F.struct(x["list_name"].alias("list_name"), x["pattern"].alias("pattern"))))
    best = best.select("row", F.col("best.rank.allows").alias("allows"), win.alias("win"))
    out = seen.join(best, "row", "left")
    return out.select(F.col("id").alias(id), "host", F.coalesce("allows", F.lit(True)).alias("kept"), F.col("win.list_name").alias("matched_list"), F.col("win.pattern").alias("matched_pattern"))


# ---------------------------------------------------------------- a dated list over the given pages

def captures_of(pages: DataFrame) -> DataFrame:
    """Captures with a fetch time spread over the year 2024 by page_id (the table has none)."""
    minutes = F.pmod(F.col("page_id") * 7919, F.lit(525600))
    return pages.select("page_id", "url", F.timestamp_seconds(F.lit(1704067200) + minutes * 60).alias("fetched_at"))


def entries_of(pages: DataFrame) -> DataFrame:
    """A dated list derived from the hosts of the pages: by the first hex digit of a host's md5,
    hosts are blocked, removed again, blocked anew, blocked for a path, or allowed for one."""
    hosts = pages.select(host_of(F.col("url")).alias("host")).filter("host <> ''").distinct()
    digit = F.conv(F.substring(F.md5(F.col("host").cast("binary")), 1, 1), 16, 10).cast("int")

    def entry(list_name: str, pattern: Column, action: str, day: Column) -> Column:
        return F.struct(F.lit(list_name).alias("list_name"), pattern.alias("pattern"), F.lit(action).alias("action"), F.timestamp_seconds(F.lit(1704067200) + day * 86400).alias("effective_at"))

    domain, fr, en = F.concat(F.lit("domain:"), "host"), F.concat(F.lit("prefix:"), "host", F.lit("/fr")), F.concat(F.lit("prefix:"), "host", F.lit("/en"))
    rows = F.array_compact(
        F.array(
            F.when(digit < 5, entry("spam", domain, "block", F.lit(60) + digit)),
            F.when(digit < 3, entry("spam", domain, "remove", F.lit(213))),
            F.when(digit < 1, entry("spam", domain, "block", F.lit(305))),
            F.when(digit.isin(0, 3), entry("partners", fr, "allow", F.lit(91))),
            F.when(digit.isin(5, 6, 7), entry("paths", en, "block", F.lit(31) + digit)),
            F.when(digit == 7, entry("paths", en, "remove", F.lit(200))),
        )
    )
    return hosts.select(F.inline(rows))


def filter_pages(pages: DataFrame) -> DataFrame:
    return temporal_url_filter(captures_of(pages), entries_of(pages))


ORACLE_SQL = r"""
WITH seen AS (
  SELECT page_id, lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)(?::[0-9]*)?(/[^?#]*)?', 1)) AS host,
         regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)(?::[0-9]*)?(/[^?#]*)?', 2) AS path,
         (page_id * 7919) % 525600 AS minute
  FROM pages
), hosts AS (
  SELECT DISTINCT host, ('0x' || substr(md5(host), 1, 1))::INT AS d FROM seen WHERE host <> ''
), held AS (
  SELECT 'spam' AS list_name, 'domain:' || host AS pattern, false AS allows, (60 + d) * 1440 AS a, CASE WHEN d < 3 THEN 213 * 1440 END AS b FROM hosts WHERE d < 5
  UNION ALL SELECT 'spam', 'domain:' || host, false, 305 * 1440, NULL FROM hosts WHERE d < 1
  UNION ALL SELECT 'partners', 'prefix:' || host || '/fr', true, 91 * 1440, NULL FROM hosts WHERE d IN (0, 3)
  UNION ALL SELECT 'paths', 'prefix:' || host || '/en', false, (31 + d) * 1440, CASE WHEN d = 7 THEN 200 * 1440 END FROM hosts WHERE d IN (5, 6, 7)
), labels AS (
  SELECT page_id, minute, host, path, string_split(host, '.') AS l, list_filter(string_split(path, '/'), lambda x: x <> '') AS p FROM seen WHERE host <> ''
), keys AS (
  SELECT page_id, minute, unnest(list_transform(range(1, len(l) + 1), lambda i: 'domain:' || array_to_string(l[i:], '.'))) AS pattern FROM labels
  UNION ALL
  SELECT page_id, minute, 'prefix:' || host || '/' || p[1] FROM labels WHERE len(p) > 0
), found AS (
  SELECT page_id, list_name, held.pattern, allows, row_number() OVER (
    PARTITION BY page_id ORDER BY starts_with(held.pattern, 'prefix:') DESC, length(held.pattern) DESC, allows DESC, list_name) AS nth
  FROM keys JOIN held ON keys.pattern = held.pattern AND minute >= a AND (b IS NULL OR minute < b)
)
SELECT seen.page_id, seen.host, coalesce(allows, true) AS kept, list_name AS matched_list, pattern AS matched_pattern
FROM seen LEFT JOIN found ON seen.page_id = found.page_id AND nth = 1
"""
