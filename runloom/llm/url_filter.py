"""Operator 5. URL filters by a temporal list join."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runloom.llm.base import broadcast_if_small, table, written


#: scheme, user, host, port; of these only the host must be there.
_HOST = r"^(?:(?:[A-Za-z][A-Za-z0-9+.-]*:)?//)?(?:[^/?#@]*@)?([^\s/?#:@]+)(?::\d*)?(?:[/?#]|$)"


def host_of(url):
    """The host of a URL, with or without its scheme, in lower case without user, port and final dot; empty if there is none."""
    return F.coalesce(F.regexp_replace(F.lower(F.regexp_extract(url, _HOST, 1)), r"\.+$", ""), F.lit(""))


def path_of(url):
    """The path of a URL, from its first slash; a lone slash if it has none."""
    return F.coalesce(F.nullif(F.regexp_extract(url, r"^(?:(?:[A-Za-z][A-Za-z0-9+.-]*:)?//)?[^/?#]*(/[^?#]*)", 1), F.lit("")), F.lit("/"))


def validity(entries: DataFrame, *, pattern: str = "pattern", name: str = "list", day: str = "day", active: str = "active") -> DataFrame:
    """Dated entries as intervals: pattern (a domain), path, list, from_day, to_day (exclusive; null: still open).

    An entry says that from its day on a pattern is on a list (active) or off it. A pattern is
    a domain, in any case, maybe with a scheme, a leading *. or a final dot; what follows its
    first slash is a path below which all is listed. Of several entries of one day the one
    that takes a pattern off wins. Entries with a null pattern, list or day, or without a
    domain, are void; a null `active` counts as off.
    """
    p = F.regexp_replace(F.trim(pattern), r"(^|//)\*?\.", "$1")
    e = entries.where(F.col(pattern).isNotNull() & F.col(name).isNotNull() & F.col(day).isNotNull())
    e = e.select(host_of(p).alias("pattern"), F.regexp_replace(path_of(p), "/+$", "").alias("path"), F.col(name).alias("list"), F.col(day).cast("date").alias("from_day"), F.coalesce(F.col(active), F.lit(False)).alias("_a")).where("pattern != ''")
    e = e.groupBy("pattern", "path", "list", "from_day").agg(F.min("_a").alias("_on"))
    e = e.withColumn("to_day", F.lead("from_day").over(Window.partitionBy("pattern", "path", "list").orderBy("from_day")))
    return e.where("_on").select("pattern", "path", "list", "from_day", "to_day")


def url_filter(captures: DataFrame, entries: DataFrame, *, key: str = "page_id", url: str = "url", at: str = "fetched", **names: str) -> DataFrame:
    """One row for each capture: key, url, at, host, blocked, n_lists, lists, since.

    A capture is blocked if, at its time, its host or a domain above it is on a list. The
    host's domains are joined to the intervals by equality (a hot host meets few intervals;
    its captures need not meet each other, so skewed partitions can be split), and the
    interval test is a condition of the join: the as-of entry of that time is the one whose
    interval holds the time. lists: the sorted names, comma-joined; since: the earliest day
    from which an entry that blocks has held.

    A listed path must be the capture's path or stand above it. A null URL or time blocks
    nothing. Repeated captures give repeated rows; so do null keys. Empty lists block nothing;
    empty captures give no rows. Other columns of either table are not looked at.
    """
    spans = broadcast_if_small(written(validity(entries, **names), "spans"), 16 << 20)
    c = captures.select(F.monotonically_increasing_id().alias("_row"), F.col(key).alias(key), F.col(url).alias(url), F.col(at).alias(at), host_of(F.col(url)).alias("host"))
    labels = F.split("host", r"\.")
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels), F.lit(1))), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    c = c.withColumn("_domain", F.explode(above))
    c = c.withColumn("_path", path_of(F.col(url)))
    below = (F.col("path") == "") | F.startswith(F.concat("_path", F.lit("/")), F.concat("path", F.lit("/")))
    held = (F.col("_domain") == F.col("pattern")) & below & (F.col(at).cast("date") >= F.col("from_day")) & (F.col("to_day").isNull() | (F.col(at).cast("date") < F.col("to_day")))
    j = c.join(spans, held, "left")
    out = j.groupBy("_row").agg(*[F.first(x).alias(x) for x in (key, url, at, "host")], F.array_sort(F.collect_set("list")).alias("_lists"), F.min("from_day").alias("since"))
    return out.select(key, url, at, "host", (F.size("_lists") > 0).alias("blocked"), F.size("_lists").cast("long").alias("n_lists"), F.array_join("_lists", ",").alias("lists"), "since")


def _number(c, salt: str):
    return F.conv(F.substring(F.md5(F.concat(c, F.lit(salt)).cast("binary")), 1, 8), 16, 10).cast("long")


def dated_lists(pages: DataFrame) -> DataFrame:
    """A list history made from the hosts of a table by rule: four of ten hosts and the domains above some are listed, most taken off later, some listed again."""
    hosts = pages.select(host_of(F.col("url")).alias("h")).distinct().where("h != ''")
    d = hosts.select("h", (_number(F.col("h"), "/kind") % 10).alias("k"), (_number(F.col("h"), "/day") % 500).cast("int").alias("d"), (_number(F.col("h"), "/gap") % 200 + 20).cast("int").alias("g"))
    day = lambda n: F.date_add(F.lit("2024-01-01").cast("date"), n)
    name = F.when(F.col("k") % 2 == 0, "spam").otherwise("adult")
    step = lambda i, on: F.struct(day(F.col("d") + F.col("g") * i).alias("day"), F.lit(on).alias("active"))
    e = d.where("k < 4").select("h", name.alias("list"), F.explode(F.when(F.col("k") == 0, F.array(step(0, True))).when(F.col("k") < 3, F.array(step(0, True), step(1, False))).otherwise(F.array(step(0, True), step(1, False), step(2, True)))).alias("e"))
    return e.select(F.when(F.col("list") == "spam", F.col("h")).otherwise(F.regexp_replace("h", r"^(www|m|blog)\.", "")).alias("pattern"), "list", "e.day", "e.active")


def op5_url_filters(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("fetched", F.date_add(F.lit("2024-01-01").cast("date"), (F.pmod(F.col("page_id") * 37, F.lit(730))).cast("int")))
    return url_filter(captures, dated_lists(pages))


OP5_SQL = r"""
WITH p AS (
  SELECT page_id, url, DATE '2024-01-01' + CAST(page_id * 37 % 730 AS INTEGER) AS fetched,
    coalesce(regexp_replace(lower(regexp_extract(url, '^(?:(?:[A-Za-z][A-Za-z0-9+.-]*:)?//)?(?:[^/?#@]*@)?([^\s/?#:@]+)(?::\d*)?(?:[/?#]|$)', 1)), '\.+$', ''), '') AS host
  FROM pages
), n AS (
  SELECT host AS h, CAST('0x' || substr(md5(host || '/kind'), 1, 8) AS BIGINT) % 10 AS k,
    CAST('0x' || substr(md5(host || '/day'), 1, 8) AS BIGINT) % 500 AS d, CAST('0x' || substr(md5(host || '/gap'), 1, 8) AS BIGINT) % 200 + 20 AS g
  FROM (SELECT DISTINCT host FROM p WHERE host != '')
), raw AS (
  SELECT CASE WHEN k % 2 = 0 THEN h ELSE regexp_replace(h, '^(www|m|blog)\.', '') END AS pattern,
    CASE WHEN k % 2 = 0 THEN 'spam' ELSE 'adult' END AS list, DATE '2024-01-01' + CAST(d + g * i AS INTEGER) AS from_day, i != 1 AS active
  FROM n, (VALUES (0), (1), (2)) s(i) WHERE k < 4 AND (i = 0 OR i = 1 AND k > 0 OR i = 2 AND k = 3)
), e AS (
  SELECT pattern, list, from_day, min(active) AS active FROM raw GROUP BY ALL
), v AS (
  SELECT *, lead(from_day) OVER (PARTITION BY pattern, list ORDER BY from_day) AS to_day FROM e
), hit AS (
  SELECT p.page_id, v.list, v.from_day FROM p JOIN v ON v.active AND (p.host = v.pattern OR ends_with(p.host, '.' || v.pattern))
    AND p.fetched >= v.from_day AND (v.to_day IS NULL OR p.fetched < v.to_day)
), a AS (
  SELECT page_id, string_agg(DISTINCT list, ',' ORDER BY list) AS lists, count(DISTINCT list) AS n_lists, min(from_day) AS since FROM hit GROUP BY page_id
)
SELECT p.page_id, p.url, p.fetched, p.host, a.page_id IS NOT NULL AS blocked, coalesce(n_lists, 0) AS n_lists, coalesce(lists, '') AS lists, since
FROM p LEFT JOIN a USING (page_id)
"""
