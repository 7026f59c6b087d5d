"""URL filter by dated lists: entries become validity intervals, each capture meets those valid when it was fetched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dateloom.llm.common import small, written


def host_of(url: Column) -> Column:
    """The host in lower case, without user, port and a final dot; '' if the URL has none."""
    found = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return F.coalesce(F.regexp_replace(found, r"\.$", ""), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)", 1), F.lit(""))


def keys_of(url: Column) -> Column:
    """What an entry may name of a URL: its host, the host's parent domains of two labels or more, the host with each leading path."""
    host = host_of(url)
    labels = F.split(host, r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(labels) - 1)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    steps = F.array_remove(F.split(path_of(url), "/"), "")
    paths = F.when(F.size(steps) > 0, F.transform(F.sequence(F.lit(1), F.size(steps)), lambda k: F.concat(host, F.lit("/"), F.array_join(F.slice(steps, 1, k), "/")))).otherwise(F.array().cast("array<string>"))
    return F.when(host != "", F.array_distinct(F.concat(parents, paths))).otherwise(F.array().cast("array<string>"))


def intervals(entries: DataFrame) -> DataFrame:
    """(pattern, valid_from, valid_to) from dated entries (pattern, listed, action): add opens, remove closes.

    valid_to is null while open and not part of the interval. Of entries of a pattern at one time a removal counts
    over additions; repeated entries count once. Hosts are lower-cased, paths are not. Entries with a null, or another action, say nothing.
    """
    host = F.substring_index("pattern", "/", 1)
    pattern = F.concat(F.lower(host), F.substr("pattern", F.length(host) + 1))
    known = entries.where("pattern is not null and listed is not null and action in ('add', 'remove')")
    known = known.groupBy(pattern.alias("pattern"), F.col("listed").cast("timestamp_ntz").alias("valid_from")).agg(F.max("action").alias("action"))
    turn = Window.partitionBy("pattern").orderBy("valid_from")
    changes = known.withColumn("before", F.lag("action").over(turn)).where("before is null or before <> action")
    return changes.withColumn("valid_to", F.lead("valid_from").over(turn)).where("action = 'add'").select("pattern", "valid_from", "valid_to")


def verdicts(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """Adds blocked, pattern, valid_from and valid_to to each capture (url, fetched, ...).

    The longest pattern valid at `fetched` is named, of equally long ones the last in order. Distinct pairs of URL
    and time are judged once and joined back, so a host that holds a third of the captures costs its distinct URLs. A null or
    malformed URL has no host and is never blocked, nor is a capture without time; an empty list blocks nothing.
    Columns of captures that bear an added name are replaced.
    """
    captures = captures.drop("blocked", "pattern", "valid_from", "valid_to")
    at = F.col("fetched").cast("timestamp_ntz")
    asked = captures.where("url is not null and fetched is not null").select(F.col("url").alias("_url"), at.alias("_at")).distinct()
    listed = written(intervals(entries), "intervals")
    # a string key narrows the search; the interval then holds the time
    asked = asked.withColumn("key", F.explode(keys_of(F.col("_url"))))
    active = asked.join(small(listed), (F.col("key") == F.col("pattern")) & (F.col("valid_from") <= F.col("_at")) & (F.col("valid_to").isNull() | (F.col("_at") < F.col("valid_to"))))
    best = F.max_by(F.struct("pattern", "valid_from", "valid_to"), F.struct(F.length("pattern"), F.col("pattern")))
    found = active.groupBy("_url", "_at").agg(best.alias("_best"))
    out = captures.join(found, (F.col("url") == F.col("_url")) & (at == F.col("_at")), "left").drop("_url", "_at")
    return out.withColumns({"blocked": F.col("_best").isNotNull(), "pattern": F.col("_best.pattern"), "valid_from": F.col("_best.valid_from"), "valid_to": F.col("_best.valid_to")}).drop("_best")
