"""URL filtering against dated lists (operator 10), in DataFrame functions only.

A list is a log: on a date an entry (a host or a parent domain) is added to or removed from a list. The log of each (list, entry)
becomes validity intervals: from an addition up to, not including, the next change. Every capture is judged by the entries active on
the day it was fetched.

Captures collapse to distinct (host, day) pairs before anything is joined; the as-of join works on distinct (domain, day) pairs, so a
host with a third of all captures, or a domain above most hosts, is at most one row a day there. Verdicts go back to the captures
by (host, day), which spreads a hot host over its days.

Cases: a null URL, or one without a host, matches nothing; of a host of very many labels only domains as long as the longest list entry are
looked up; a null fetch day, a null entry, a null date or an unknown action never
match; of several changes of one entry on one day the last in the order add, remove counts, so a removal wins; an addition while the
entry is active starts a new interval; repeated captures are judged each; empty captures or lists give no matches; a column with an
output's name is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .buffers import quoted


def host_of(url: Column) -> Column:
    """The host of a URL in lower case, without user, port or a closing dot; null where there is none."""
    host = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1)
    return F.when(F.length(F.rtrim(host, F.lit("."))) > 0, F.rtrim(host, F.lit(".")))


def n_labels(host: Column) -> Column:
    return F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1


def domains(host: Column, most: int) -> Column:
    """The host, if it has at most so many labels, and the domains of at most so many labels above it; most specific first.

    `host` should be a column of a table: an expression would be computed anew for every domain.
    """
    counts = F.sequence(F.least(n_labels(host), F.lit(most)), F.lit(1), F.lit(-1))
    return F.when(host.isNotNull(), F.transform(counts, lambda k: F.call_function("substring_index", host, F.lit("."), -k)))


def intervals(log: DataFrame) -> DataFrame:
    """(list, entry, valid_from, valid_to) from a log of (list, entry, day, action); an open interval has a null end."""
    known = log.select("list", F.lower("entry").alias("entry"), F.col("day").cast("date").alias("day"), "action").where(F.col("action").isin("add", "remove") & F.col("entry").isNotNull() & F.col("list").isNotNull() & F.col("day").isNotNull())
    daily = known.groupBy("list", "entry", "day").agg(F.max("action").alias("action"))
    ahead = F.lead("day").over(Window.partitionBy("list", "entry").orderBy("day"))
    return daily.withColumn("valid_to", ahead).where(F.col("action") == "add").select("list", "entry", F.col("day").alias("valid_from"), "valid_to")


def judge(captures: DataFrame, log: DataFrame, url_col: str = "url", day_col: str = "fetch_day") -> DataFrame:
    """Adds `host`, `blocked`, `n_active` (active list entries that match), `lists` and `entry` (the most specific one) to each capture."""
    taken = {"host", "blocked", "n_active", "lists", "entry"}
    kept = [quoted(c) for c in captures.columns if c.lower() not in taken]
    rows = captures.select(*kept, host_of(quoted(url_col)).alias("host"), quoted(day_col).cast("date").alias("__day"))
    asked = rows.where(F.col("host").isNotNull() & F.col("__day").isNotNull()).select("host", "__day").distinct()
    valid = intervals(log)
    # a domain of more labels than the longest entry can't match: a host of many labels costs no more than its length
    most = valid.agg(F.max(n_labels(F.col("entry")))).first()[0] or 1
    parts = asked.select(F.col("host").alias("a_host"), F.col("__day").alias("a_day"), F.explode(domains(F.col("host"), most)).alias("a_domain"))
    days = parts.select(F.col("a_domain").alias("entry"), F.col("a_day").alias("day")).distinct()
    inside = (F.col("day") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("day") < F.col("valid_to")))
    active = days.join(valid, "entry").where(inside).groupBy("entry", "day").agg(F.sort_array(F.collect_set("list")).alias("in_lists"))
    hit = parts.join(active, (F.col("a_domain") == F.col("entry")) & (F.col("a_day") == F.col("day")))
    verdict = hit.groupBy(F.col("a_host").alias("__h"), F.col("a_day").alias("__d")).agg(
        F.sum(F.size("in_lists")).alias("__n"),
        F.array_join(F.sort_array(F.array_distinct(F.flatten(F.collect_list("in_lists")))), ",").alias("__lists"),
        F.max_by("entry", F.length("entry")).alias("__entry"),
    )
    out = rows.join(verdict, (F.col("host") == F.col("__h")) & (F.col("__day") == F.col("__d")), "left")
    return out.select(*kept, "host", F.col("__n").isNotNull().alias("blocked"), F.coalesce("__n", F.lit(0)).cast("bigint").alias("n_active"), F.coalesce("__lists", F.lit("")).alias("lists"), F.col("__entry").alias("entry"))
