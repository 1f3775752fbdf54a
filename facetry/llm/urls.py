"""Temporal URL lists: dated entries become validity intervals, joined to captures as of their fetch time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from facetry.runtime import scalar

#: Beginning of an address; an entry of a list may lack it.
SCHEME = r"^(?i:https?)://"


def host_of(url: Column) -> Column:
    """Host of an http or https address in lower case, without user, port and final dot; empty if there is none."""
    host = F.regexp_extract(url, r"^(?i:https?)://(?:[^/?#@]*@)?([^/?#:@]*)", 1)
    return F.regexp_replace(F.lower(host), r"\.$", "")


def steps_of(url: Column) -> Column:
    """Folders of the path, each with its slash in front, and the query with its mark; slashes at the end of the path and fragments are left out."""
    rest = F.regexp_extract(url, SCHEME + r"[^/?#]*([^#]*)", 1)
    return F.regexp_extract_all(F.regexp_replace(rest, r"^([^?]*?)/+(?=\?|$)", "$1"), F.lit(r"(/[^/?]*|\?.+)"), 1)


def normalised(entries: DataFrame) -> DataFrame:
    """``entries`` with the pattern as captures are read, and the number of its ``_steps``; what names no host is left out.

    A pattern is a host, or one with a path, or a full http or https address; user, port,
    fragment and slashes at the end do not count, and neither does the case of the host.
    """
    bare = F.trim("pattern")
    full = F.when(F.rlike(bare, F.lit(SCHEME)), bare).when(~F.contains(bare, F.lit("://")), F.concat(F.lit("http://"), bare))
    parts = entries.withColumn("_host", host_of(full)).withColumn("_steps", steps_of(full)).where("_host <> '' AND NOT startswith(_host, '[')")
    return parts.withColumn("pattern", F.concat("_host", F.array_join("_steps", ""))).withColumn("_steps", F.size("_steps")).drop("_host")


def intervals(entries: DataFrame) -> DataFrame:
    """pattern, action, valid_from, valid_to (exclusive, null: still valid) from (pattern, action, day).

    An entry holds until the next one of its pattern; ``remove`` ends it and starts
    nothing.  Of several on one day the alphabetically last action counts.  Entries
    with a null pattern, action or day are void.
    """
    days = entries.where("pattern IS NOT NULL AND action IS NOT NULL AND day IS NOT NULL").groupBy("pattern", "day").agg(F.max("action").alias("action"))
    until = F.lead("day").over(Window.partitionBy("pattern").orderBy("day"))
    return days.select("pattern", "action", F.col("day").alias("valid_from"), until.alias("valid_to")).where("action <> 'remove'")


def patterns(host: Column, steps: Column, least_labels: int = 1) -> Column:
    """Patterns that would match: every suffix of the host with ``least_labels`` or more, alone and with every beginning of the steps."""
    labels = F.split(host, r"\.")
    count = F.size(labels)
    starts = F.when((host != "") & (count >= least_labels), F.sequence(F.lit(1), count - least_labels + 1)).otherwise(F.array().cast("array<int>"))
    suffixes = F.transform(starts, lambda i: F.array_join(F.slice(labels, i, count), "."))
    paths = F.transform(F.sequence(F.lit(0), F.size(steps)), lambda k: F.array_join(F.slice(steps, 1, k), ""))
    return F.flatten(F.transform(suffixes, lambda s: F.transform(paths, lambda p: F.concat(s, p))))


def filter_urls(captures: DataFrame, entries: DataFrame, least_labels: int = 1) -> DataFrame:
    """Verdict of the list on every capture (capture_id, url, fetched) at its fetch day.

    A capture meets the entries of its host suffixes, alone or with a beginning of its path
    in whole folders, whose interval holds the fetch day; an entry with a query asks for this
    path and query.  The most specific one decides (more labels, then more folders).  Entries
    are normalised as captures are; hosts with fewer than ``least_labels`` labels match nothing.
    Captures of one host, day and path, as deep as the list's deepest entry, are judged once,
    so a hot host is a few rows in the join.

    Null or malformed addresses and null days match nothing and get the verdict ``none``;
    equal captures get equal verdicts; an empty list leaves all ``none``.
    Returns capture_id, url, fetched, n_active, pattern, verdict.
    """
    named = normalised(entries)
    deepest = F.coalesce(scalar(named, F.max("_steps")), F.lit(0))
    # the host joins back below, so names of its own keep clashes out
    wide = captures.select("capture_id", "url", "fetched", host_of(F.coalesce("url", F.lit(""))).alias("_host"), F.slice(steps_of(F.coalesce("url", F.lit(""))), F.lit(1), deepest).alias("_steps"))
    kinds = wide.select("_host", "_steps", "fetched").where("_host <> '' AND NOT startswith(_host, '[') AND fetched IS NOT NULL").distinct()
    asked = kinds.withColumn("_pattern", F.explode(patterns(F.col("_host"), F.col("_steps"), least_labels)))
    valid = intervals(named)
    hits = asked.join(valid, F.col("_pattern") == F.col("pattern")).where(
        (F.col("fetched") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("fetched") < F.col("valid_to"))))
    depth = F.size(steps_of(F.concat(F.lit("http://"), F.col("pattern"))))
    labels = F.size(F.split(host_of(F.concat(F.lit("http://"), F.col("pattern"))), r"\."))
    rank = F.struct(labels.alias("labels"), depth.alias("steps"), F.col("pattern"), F.col("action"))
    judged = hits.groupBy("_host", "_steps", "fetched").agg(F.count(F.lit(1)).alias("n_active"), F.max(rank).alias("_best"))
    judged = judged.select(F.col("_host").alias("_h"), F.col("_steps").alias("_s"), F.col("fetched").alias("_d"), "n_active", "_best")
    same = (F.col("_host") == F.col("_h")) & (F.col("_steps") == F.col("_s")) & (F.col("fetched") == F.col("_d"))
    return wide.join(judged, same, "left").select(
        "capture_id", "url", "fetched", F.coalesce("n_active", F.lit(0)).cast("bigint").alias("n_active"),
        F.col("_best.pattern").alias("pattern"), F.coalesce("_best.action", F.lit("none")).alias("verdict"))
