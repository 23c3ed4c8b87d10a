"""URL filters by a temporal list join, with DataFrame functions only.

A list is a history of dated entries: a domain was added or taken off on a day. Entries become validity
intervals, and each capture is listed if its host or a parent domain of it was active on the day of its
fetch. Intervals are cut at the edges of PERIOD days, so that the as-of join is an equi-join on domain and
period whose candidates for a key are at most PERIOD intervals, whatever the history. Captures enter the
join as distinct (host, day) pairs, combined before the shuffle, so a host with a third of all captures
counts once a day; the verdicts go back to the captures on host and day.

The host is the authority without user and port, lower case, without a closing dot; an address (four numbers, or
within brackets) has no parent domains. Keys are dealt to SALT lanes by the host, with the intervals in each lane, so
that a suffix under which a third of all hosts stand is no single group.

An addition wins over a removal of the same day; a removal of what is not listed means nothing; equal entries
count once. Captures without a host or a day are never listed; entries without a domain or a day are ignored.
Repeated captures stay. Extra columns are ignored. An empty list lists nothing; empty captures give nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PERIOD, SALT = 32, 8
#: Days of the fetches and of the list's changes in the query, and shares: one domain in LISTED is on the list.
DAYS, LISTED = 730, 3


def host_of(url: Column) -> Column:
    """The lower-case host of a URL; null without one."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/:?#\[]+)", 1))
    host = F.regexp_replace(host, r"\.+$", "")
    return F.when(host != "", host)


def suffixes(host: Column) -> Column:
    """The host and its parent domains of two labels or more; an address alone."""
    labels = F.split(host, r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    return F.when(F.rlike(host, F.lit(r"^(\[.*\]|\d+\.\d+\.\d+\.\d+)$")), F.array(host)).otherwise(parents)


def intervals(entries: DataFrame) -> DataFrame:
    """(domain, since, until) from (domain, day, listed): active from since to before until (null: still)."""
    days = entries.filter("domain IS NOT NULL AND day IS NOT NULL AND listed IS NOT NULL").groupBy("domain", "day").agg(F.max("listed").alias("listed"))
    later = F.lead("day").over(W.partitionBy("domain").orderBy("day"))
    return days.withColumn("until", later).filter("listed").select("domain", F.col("day").alias("since"), "until")


def as_of(captures: DataFrame, entries: DataFrame, period: int = PERIOD) -> DataFrame:
    """(page_id, host, day, listed, domain, since) of captures (page_id, host, day): the longest active domain and the day of its entry."""
    pairs = captures.filter("host IS NOT NULL AND day IS NOT NULL").select("host", "day").distinct()
    keys = pairs.select("host", "day", F.explode(suffixes(F.col("host"))).alias("domain"), F.floor(F.col("day") / period).alias("period"), F.pmod(F.xxhash64("host"), F.lit(SALT)).cast("int").alias("lane"))
    last = captures.agg(F.max("day")).first()[0] or 0
    until = F.least(F.coalesce("until", F.lit(last + 1)), F.lit(last + 1))
    held = intervals(entries).withColumn("until", until).filter("since < until")
    held = held.withColumn("period", F.explode(F.sequence(F.floor(F.col("since") / period), F.floor((F.col("until") - 1) / period))))
    held = held.withColumn("lane", F.explode(F.array(*map(F.lit, range(SALT)))))
    active = keys.join(held, ["domain", "period", "lane"]).filter("since <= day AND day < until")
    best = active.groupBy("host", "day").agg(F.max(F.struct(F.length("domain").alias("n"), "domain", "since")).alias("best"))
    out = captures.select("page_id", "host", "day").join(best, ["host", "day"], "left")
    return out.select("page_id", "host", "day", F.col("best").isNotNull().alias("listed"), F.col("best.domain").alias("domain"), F.col("best.since").alias("since"))


def number(text: Column, n: int) -> Column:
    """A number in [0, n) from a text, by its md5."""
    return (F.conv(F.substring(F.md5(F.coalesce(text, F.lit(""))), 1, 8), 16, 10).cast("long") % n).cast("int")


def captures_of(pages: DataFrame) -> DataFrame:
    """Pages as captures; the table has no time of fetch, so the day comes from a hash of the id."""
    return pages.select("page_id", host_of(F.col("url")).alias("host"), number(F.concat(F.lit("day:"), F.col("page_id").cast("string")), DAYS).alias("day"))


def list_of(captures: DataFrame) -> DataFrame:
    """A dated list derived from the captures' domains: a hash says which are listed, from when to when, and which come back."""
    names = captures.filter("host IS NOT NULL").select("host").distinct().select(F.explode(suffixes(F.col("host"))).alias("domain")).distinct()
    name = F.col("domain")
    added, gone, back = number(F.concat(F.lit("add:"), name), DAYS), number(F.concat(F.lit("off:"), name), 200) + 1, number(F.concat(F.lit("back:"), name), 200) + 1
    drawn = names.filter(number(F.concat(F.lit("list:"), name), LISTED) == 0).select("domain", added.alias("a"), gone.alias("g"), back.alias("b"))
    events = F.array(F.struct(F.col("a").alias("day"), F.lit(True).alias("listed")), F.struct((F.col("a") + F.col("g")).alias("day"), F.lit(False).alias("listed")), F.struct((F.col("a") + F.col("g") + F.col("b")).alias("day"), (F.col("b") % 2 == 0).alias("listed")))
    return drawn.select("domain", F.inline(events))
