"""Temporal URL lists: every capture is judged by the list entries that were active when it was fetched.

Dated entries (a host or parent domain, with an action from a day on) become validity intervals: each holds until the next
entry of its list and host. A capture's host and parent domains are looked up, and an as-of join picks the entry active at fetch
time; among the levels of a host the most specific one decides, and `block` wins over `allow` between lists.

A verdict depends on host and fetch time alone, so distinct pairs of these are looked up, and captures (ids, hosts and times,
never pages) are joined with the verdicts. Host levels and intervals meet in an equi-join; intervals of a host don't overlap,
so it gives at most one row for a pair, level and list. A list of at most BROADCAST_ROWS intervals (counted first) is broadcast, so that a host with a third of all captures
costs nothing. Beyond that, intervals are dealt to the months that they cover and joined on (host, month, salt): what is
looked up is salted, intervals are copied for each salt.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import checkpoint

SALTS = 16
BROADCAST_ROWS = 100_000


def host_of(url: Column) -> Column:
    """The lower-case host of a URL, without port, user or final dot; null if it has none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1))
    return F.nullif(F.regexp_replace(host, r"\.+$", ""), F.lit(""))


def intervals(entries: DataFrame) -> DataFrame:
    """list_name, host, action, valid_from and valid_to (exclusive; null: open) of each stretch of equal rule.

    Of entries with one list, host and day, the greatest action counts (`block` over `allow`, `remove` over both). An
    entry `remove` ends a stretch and gives none. Entries without list, host, action or day are ignored.
    """
    rows = entries.select("list_name", F.lower("host").alias("host"), "action", "since").dropna()
    rows = rows.groupBy("list_name", "host", "since").agg(F.max("action").alias("action"))
    order = Window.partitionBy("list_name", "host").orderBy("since")
    rows = rows.withColumn("valid_to", F.lead("since").over(order))
    return rows.where("action <> 'remove'").select("list_name", "host", "action", F.col("since").alias("valid_from"), "valid_to")


def levels(host: Column) -> Column:
    """The host and its parent domains of two labels at least, the shortest first; one label alone counts as it is."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    return F.transform(F.sequence(F.least(F.lit(2), n), n), lambda k: F.array_join(F.slice(labels, n - k + 1, k), "."))


def judge(captures: DataFrame, entries: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """capture_id, host, verdict (allow, block or none), rule_host and list_name of each row of captures(capture_id, url, fetched).

    A capture without host or date, or without an active entry, has verdict none. A host is looked up at all its levels. Ties between lists of one level: block first, then the least list name. Rows that repeat give
    their verdict each; a null capture_id is kept; an empty table gives no rows and an empty list gives none throughout.
    """
    spans = checkpoint(intervals(entries)).withColumnRenamed("host", "rule_host")
    base = captures.select("capture_id", host_of(F.col("url")).alias("host"), "fetched")
    asked = base.select("host", "fetched").dropna().distinct()
    looked = asked.select("host", "fetched", F.posexplode(levels(F.col("host"))).alias("level", "rule_host"))
    active = (F.col("fetched") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("fetched") < F.col("valid_to")))
    if spans.count() <= broadcast_rows:
        hits = looked.join(F.broadcast(spans), "rule_host").where(active)
    else:
        month = lambda d: (F.year(d) * 12 + F.month(d)).cast("int")
        seen = base.agg(F.min("fetched").alias("low"), F.max("fetched").alias("high"))
        low, high = seen.select(month(F.col("low")), month(F.col("high"))).first()
        first = F.greatest(month(F.col("valid_from")), F.lit(low))
        last = F.least(F.coalesce(month(F.date_sub("valid_to", 1)), F.lit(high)), F.lit(high))
        spans = spans.where(first <= last).withColumn("month", F.explode(F.sequence(first, last)))
        spans = spans.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        looked = looked.withColumns({"month": month(F.col("fetched")), "salt": F.pmod(F.xxhash64("host", "fetched"), F.lit(SALTS)).cast("int")})
        hits = looked.join(spans, ["rule_host", "month", "salt"]).where(active)
    order = F.struct((-F.col("level")).alias("l"), (F.col("action") != "block").alias("b"), F.col("list_name").alias("n"))
    top = hits.groupBy("host", "fetched").agg(F.min_by(F.struct("action", "rule_host", "list_name"), order).alias("t"))
    out = base.join(top, ["host", "fetched"], "left")
    return out.select("capture_id", "host", F.coalesce("t.action", F.lit("none")).alias("verdict"), F.col("t.rule_host").alias("rule_host"), F.col("t.list_name").alias("list_name"))
