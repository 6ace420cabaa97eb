"""URL filters: a temporal join of captures with dated list entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm.common import Scratch, free_names

HOST = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/:?#]+)"
PATH = r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)"


def intervals(entries: DataFrame) -> DataFrame:
    """(key, verdict, since, until): each entry holds from its date to the key's next date; `remove` entries end one and open none.

    Entries (key, listed_on, action: block, allow or remove) of one key and date count as one: block before allow before
    remove. So a key has a row a date at most, however often it is listed. Entries with a null are left out.
    """
    rank = F.expr("CASE action WHEN 'block' THEN 3 WHEN 'allow' THEN 2 WHEN 'remove' THEN 1 END")
    daily = entries.select("key", "listed_on", rank.alias("r")).dropna().groupBy("key", "listed_on").agg(F.max("r").alias("r"))
    until = F.lead("listed_on").over(Window.partitionBy("key").orderBy("listed_on"))
    return daily.select("key", F.expr("CASE r WHEN 3 THEN 'block' WHEN 2 THEN 'allow' END").alias("verdict"), F.col("listed_on").alias("since"), until.alias("until")).where("verdict IS NOT NULL")


def keys_of(url: Column) -> Column:
    """All keys that may list a URL: each domain its host lies in, and each path prefix of its host at a slash."""
    host = F.rtrim(F.lower(F.regexp_extract(url, HOST, 1)), F.lit("."))
    labels = F.split(host, r"\.", -1)
    domains = F.transform(labels, lambda _, i: F.array_join(F.slice(labels, i + 1, F.size(labels)), "."))
    segments = F.filter(F.split(F.regexp_extract(url, PATH, 1), "/", -1), lambda x: x != "")
    paths = F.transform(segments, lambda _, i: F.concat(host, F.lit("/"), F.array_join(F.slice(segments, 1, i + 1), "/")))
    return F.when(host != "", F.array_distinct(F.concat(domains, paths)))


def url_filter(captures: DataFrame, entries: DataFrame, url: str = "url", fetched: str = "fetched_on",
               names: tuple[str, str, str] = ("verdict", "matched_key", "listed_since")) -> DataFrame:
    """Judge every capture by the list entries that were active when it was fetched.

    Entries become validity intervals; a capture meets those of its keys (domains, then path prefixes; upper and lower case
    count as one in the host only) that hold at its fetch date, and the longest key decides. Nothing active: verdict 'keep'
    with null key and date. All columns come back, those of `names` added or replaced.

    Null URLs or dates, and URLs without a host, are kept: nothing can list them. Repeated captures are judged each. Empty
    captures: empty result; empty lists: all kept. Columns of any name may come along.

    Intervals are written once, so that captures and intervals meet by key in a plain join: adaptive execution sends a small
    list to all tasks and splits a hot key, such as a top-level domain, otherwise. Keys are dealt out by month: a capture looks
    in the month of its date, an interval stands in each month it reaches into, up to the last capture, so that a key meets the
    dates of one month and not all of them. The longest match is found by grouped aggregation over row numbers, so a hot host is many groups.
    """
    row, best = free_names([*captures.columns, *names], "row", "best")
    rows = captures.drop(*names).withColumn(row, F.monotonically_increasing_id())
    month = lambda d: F.year(d) * 12 + F.month(d)
    last = captures.agg(F.max(fetched)).first()[0]
    held = intervals(entries).withColumn("end", F.least(F.coalesce("until", F.lit(last)), F.lit(last))).where("since <= end")
    listed = Scratch(captures.sparkSession).settle(held.withColumn("month", F.explode(F.sequence(month(F.col("since")), month(F.col("end"))))).drop("end"))
    looked = rows.select(F.col(row).alias("row"), F.col(fetched).alias("on"), month(F.col(fetched)).alias("month"), F.explode(keys_of(F.col(url))).alias("key"))
    active = looked.join(listed, ["key", "month"]).where("on >= since AND (until IS NULL OR on < until)")
    found = active.groupBy(F.col("row").alias(row)).agg(F.max(F.struct(F.length("key").alias("n"), "key", "verdict", "since")).alias(best))
    judged = rows.join(found, row, "left")
    return judged.select(*[F.col(c) for c in rows.columns if c != row], F.coalesce(f"{best}.verdict", F.lit("keep")).alias(names[0]), F.col(f"{best}.key").alias(names[1]), F.col(f"{best}.since").alias(names[2]))


def sample_list(pages: DataFrame) -> DataFrame:
    """A dated list drawn by rule from the sites of a table of pages, for want of a real one (key, listed_on, action)."""
    host = F.lower(F.regexp_extract("url", HOST, 1))
    sites = pages.select(F.regexp_replace(host, r"^(www|blog|m)\.", "").alias("site"), host.alias("host")).where("site <> ''").distinct()
    n = F.conv(F.substring(F.md5("site"), 1, 4), 16, 10).cast("int")
    day = lambda d: F.date_add(F.to_date(F.lit("2024-01-01")), d)
    made = sites.select("site", "host", n.alias("n"))
    return (
        made.where("n % 4 = 0").select(F.col("site").alias("key"), day(F.col("n") % 150).alias("listed_on"), F.lit("block").alias("action"))
        .union(made.where("n % 4 = 0").select("site", day(F.col("n") % 150 + 60), F.lit("remove")))
        .union(made.where("n % 8 = 0").select("site", day(F.col("n") % 150 + 120), F.lit("block")))
        .union(made.where("n % 5 = 0").select(F.concat("host", F.lit("/de")), day(F.col("n") % 200), F.lit("block")))
        .union(made.where("n % 4 = 0 AND host <> site").select("host", day(F.col("n") % 150 + 10), F.lit("allow")))
    )


SQL = r"""
WITH p AS (
  SELECT page_id, url, DATE '2024-01-01' + CAST(page_id % 365 AS INTEGER) AS fetched_on,
    rtrim(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/:?#]+)', 1)), '.') AS host,
    list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '') AS segs
  FROM pages),
m AS (
  SELECT *, CAST(concat('0x', substr(md5(site), 1, 4)) AS INTEGER) AS n FROM (
    SELECT DISTINCT regexp_replace(host, '^(www|blog|m)\.', '') AS site, host
    FROM (SELECT lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/:?#]+)', 1)) AS host FROM pages) h WHERE host <> '')),
e AS (
  SELECT site AS key, DATE '2024-01-01' + n % 150 AS listed_on, 3 AS r FROM m WHERE n % 4 = 0
  UNION ALL SELECT site, DATE '2024-01-01' + (n % 150 + 60), 1 FROM m WHERE n % 4 = 0
  UNION ALL SELECT site, DATE '2024-01-01' + (n % 150 + 120), 3 FROM m WHERE n % 8 = 0
  UNION ALL SELECT host || '/de', DATE '2024-01-01' + n % 200, 3 FROM m WHERE n % 5 = 0
  UNION ALL SELECT host, DATE '2024-01-01' + (n % 150 + 10), 2 FROM m WHERE n % 4 = 0 AND host <> site),
i AS (
  SELECT key, r, listed_on AS since, lead(listed_on) OVER (PARTITION BY key ORDER BY listed_on) AS until
  FROM (SELECT key, listed_on, max(r) AS r FROM e GROUP BY ALL)),
k AS (
  SELECT DISTINCT page_id, fetched_on, unnest(list_concat(
    list_transform(range(1, len(string_split(host, '.')) + 1), lambda j: array_to_string(list_slice(string_split(host, '.'), j, len(string_split(host, '.'))), '.')),
    list_transform(range(1, len(segs) + 1), lambda j: host || '/' || array_to_string(list_slice(segs, 1, j), '/')))) AS key
  FROM p WHERE host <> ''),
b AS (
  SELECT page_id, max({'n': length(k.key), 'key': k.key, 'verdict': CASE r WHEN 3 THEN 'block' ELSE 'allow' END, 'since': since}) AS best
  FROM k JOIN i ON k.key = i.key AND r > 1 AND fetched_on >= since AND (until IS NULL OR fetched_on < until) GROUP BY page_id)
SELECT p.page_id, p.url, p.fetched_on, coalesce(best.verdict, 'keep') AS verdict, best.key AS matched_key, best.since AS listed_since
FROM p LEFT JOIN b ON p.page_id = b.page_id
"""
