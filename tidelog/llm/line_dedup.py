"""Line dedup by site-relative frequency, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import Scratch

#: So many lines, of 8 bytes each and 8 for the host, may be sent to all tasks.
SENT = 500_000


def line_dedup(docs: DataFrame, host: str = "source", text: str = "text", max_ratio: float = 0.1,
               counts: tuple[str, str] | None = ("n_lines", "n_dropped"), sent: int = SENT) -> DataFrame:
    """Drop from every page the lines that stand on more than `max_ratio` of its host's pages.

    A line is a piece between newlines, compared without surrounding blanks. Pages are rows: repeated rows count each.
    A line that stands on one page of its host repeats nowhere and stays, however few pages the host has; there is no other
    floor. Blank lines are kept and not counted.
    Null host: a host of its own. Null text: stays null, no lines. Empty text: stays empty. Empty table: empty result.
    All columns and rows are returned, `text` cleaned; `counts` names two columns added at the end (None: none),
    in place of any of the same name.

    Only hashes of lines are shuffled for the counts, summed before the shuffle, so a hot host is many groups, not one.
    The lines to drop, counted first, are sent to all tasks where they are SENT at most, and texts are not shuffled at all. (A
    host has at most 1 / max_ratio times the lines of its average page of them.) Where there are more, the texts meet their
    own dropped lines in a join on (host, text); copies of one text are the only skew, and adaptive execution splits them.
    """
    keys = docs.select(F.struct("*").alias("row"), F.xxhash64(F.col(host)).alias("h"), F.col(text).alias("t"))
    keys = keys.withColumn("d", F.xxhash64("t", F.lit(7)))
    stripped = F.transform(F.split("t", "\n", -1), lambda x: F.trim(x))
    shown = F.array_distinct(F.filter(stripped, lambda x: x != ""))
    lines = keys.where(F.col("t").isNotNull()).select("h", "d", F.explode(F.transform(shown, lambda x: F.xxhash64(x))).alias("l"))
    totals = keys.groupBy("h").agg(F.count("*").alias("pages"))
    seen = lines.groupBy("h", "l").agg(F.count("*").alias("n")).where("n > 1")
    bad = Scratch(docs.sparkSession).settle(seen.join(totals, "h").where(F.col("n") / F.col("pages") > max_ratio).select("h", "l"))
    if bad.count() <= sent:
        joined = keys.join(F.broadcast(bad.groupBy("h").agg(F.collect_list("l").alias("bad"))), "h", "left")
    else:
        marked = lines.join(bad, ["h", "l"]).groupBy("h", "d").agg(F.collect_set("l").alias("bad"))
        joined = keys.join(marked, ["h", "d"], "left")
    parts = F.split("t", "\n", -1)
    keep = F.filter(parts, lambda x: (F.trim(x) == "") | ~F.array_contains(F.col("bad"), F.xxhash64(F.trim(x))))
    out = joined.withColumn("kept", F.when(F.col("bad").isNotNull(), keep).otherwise(parts))
    columns = [F.array_join("kept", "\n").alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns if c not in (counts or ())]
    if counts:
        n = F.when(F.col("t").isNull(), 0).otherwise(F.size(F.filter(stripped, lambda x: x != "")))
        gone = F.when(F.col("t").isNull(), 0).otherwise(F.size(parts) - F.size("kept"))
        columns += [n.cast("int").alias(counts[0]), gone.cast("int").alias(counts[1])]
    return out.select(*columns)


SQL = """
WITH d AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS parts FROM documents),
lines AS (SELECT DISTINCT doc_id, source, trim(x) AS line FROM (SELECT doc_id, source, unnest(parts) AS x FROM d) WHERE trim(x) <> ''),
bad AS (
  SELECT s.source, list(s.line) AS gone
  FROM (SELECT source, line, count(*) AS n FROM lines GROUP BY ALL HAVING count(*) > 1) s
  JOIN (SELECT source, count(*) AS pages FROM documents GROUP BY ALL) t ON s.source IS NOT DISTINCT FROM t.source
  WHERE s.n / t.pages > 0.1 GROUP BY ALL),
k AS (
  SELECT d.doc_id, d.source, d.parts, CASE WHEN gone IS NULL THEN parts
    ELSE list_filter(parts, lambda x: trim(x) = '' OR NOT list_contains(gone, trim(x))) END AS kept
  FROM d LEFT JOIN bad ON d.source IS NOT DISTINCT FROM bad.source)
SELECT doc_id, source, array_to_string(kept, chr(10)) AS text,
  CAST(len(list_filter(parts, lambda x: trim(x) <> '')) AS INTEGER) AS n_lines,
  CAST(len(parts) - len(kept) AS INTEGER) AS n_dropped
FROM k
"""
