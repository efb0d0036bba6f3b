"""URL filters by a temporal list join (operator 9), in DataFrame functions only.

Dated entries add a pattern to a list or take it off. They become validity intervals, and
every capture is evaluated against the intervals that hold on the day it was fetched.
Patterns are hosts with all their subdomains, or a host with a path prefix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boxlens.session import BROADCAST_ROW_LIMIT

SLICE_DAYS = 32  # captures and intervals meet by pattern and slice of time
FOREVER = "9999-01-01"


def host_of(url: Column) -> Column:
    """Lower-case host without scheme, user, port and a leading www; empty if there is none. IPv6 hosts keep their brackets."""
    after = F.regexp_replace(F.lower(url), r"^(?:[a-z][a-z0-9+.-]*:)?//", "")
    host = F.regexp_extract(after, r"^(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:@]*)", 1)
    return F.regexp_replace(F.regexp_replace(host, r"\.$", ""), r"^www\.", "")


def path_of(url: Column) -> Column:
    """Path with its leading slash, without query and fragment, steps of one or two dots resolved; a missing one is a slash."""
    path = F.regexp_extract(url, r"^(?:(?:[A-Za-z][A-Za-z0-9+.-]*:)?//)?[^/?#]*(/[^?#]*)", 1)
    # a last step of dots stands for a folder; the root has no parent
    steps = F.split(F.regexp_replace(path, r"/(\.\.?)$", "/$1/"), "/")
    onto = lambda done, step: (
        F.when(step == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(1)))).when(step == ".", done).otherwise(F.concat(done, F.array(step))))
    resolved = F.array_join(F.aggregate(steps, F.array().cast("array<string>"), onto), "/")
    return F.when(path == "", "/").when(F.contains(path, F.lit("/.")), resolved).otherwise(path)


def intervals(entries: DataFrame, list_col: str = "list", pattern_col: str = "pattern", active_col: str = "active", day_col: str = "day",
              seq_col: str = "seq") -> DataFrame:
    """(list, pattern, since, until) of the days [since, until) on which a pattern is on a list.

    The last entry of a day (greatest seq, an addition before a removal) decides from that
    day on. Entries fold to one per (list, pattern, day) before the exchange, so a pattern
    with very many entries takes a row per day. Entries with a null are left out.
    """
    clean = entries.select(
        F.col(list_col).alias("list"), F.col(pattern_col).alias("pattern"), F.col(active_col).cast("boolean").alias("active"),
        F.col(day_col).cast("date").alias("day"), F.col(seq_col).alias("seq")).na.drop()
    daily = clean.groupBy("list", "pattern", "day").agg(F.max(F.struct("seq", "active"))["active"].alias("active"))
    later = Window.partitionBy("list", "pattern").orderBy("day")
    spans = daily.withColumn("until", F.coalesce(F.lead("day").over(later), F.lit(FOREVER).cast("date")))
    return spans.filter("active").select("list", "pattern", F.col("day").alias("since"), "until")


def patterns_of(url: Column) -> Column:
    """All patterns that would match a URL: its host and every parent domain, and the host with every path prefix that ends in a slash.

    An IP address has no parent domains.
    """
    host = host_of(url)
    numeric = host.rlike(r"^[0-9]+(\.[0-9]+){3}$|^\[")
    labels = F.when(numeric, F.array(host)).otherwise(F.split(host, r"\."))
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    steps = F.split(path_of(url), "/")
    prefixes = F.when(F.size(steps) > 2, F.transform(
        F.sequence(F.lit(2), F.size(steps) - 1), lambda i: F.concat(host, F.array_join(F.slice(steps, 1, i), "/"), F.lit("/")))).otherwise(F.array())
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(parents, prefixes)))


def evaluate(captures: DataFrame, spans: DataFrame, id_col: str = "page_id", url_col: str = "url", day_col: str = "day") -> DataFrame:
    """One row per capture: id, day, host, n_matches, lists (sorted names), patterns (sorted), blocked.

    Patterns that no list names are dropped before the exchange where the named ones are few
    enough to be broadcast. Join keys are (pattern, slice of time), so a capture meets only intervals near its day,
    at most one of which holds per list and pattern; a host with very many captures is
    split where its partition is skewed. Very long URLs are read whole. Null URLs or days match nothing. Repeated
    captures come back once per occurrence; empty tables give empty results or no
    matches; other columns are not read.
    """
    rows = captures.select(captures[id_col].alias("id"), captures[url_col].cast("string").alias("url"), captures[day_col].cast("date").alias("day"))
    rows = rows.groupBy("id", "url", "day").agg(F.count("*").alias("copies"))
    asked = rows.select("id", "url", "day", F.explode(patterns_of(F.col("url"))).alias("pattern")).filter("day is not null")
    named = spans.select("pattern").distinct()
    if named.limit(BROADCAST_ROW_LIMIT + 1).count() <= BROADCAST_ROW_LIMIT:
        asked = asked.join(F.broadcast(named), "pattern", "left_semi")
    slice_of = lambda c: F.floor(F.unix_date(c) / SLICE_DAYS)
    last = rows.agg(F.max("day").alias("last"))  # no interval is cut into slices beyond the last capture
    cut = (
        spans.join(F.broadcast(last), F.col("since") <= F.col("last"))
        .select("list", "pattern", "since", "until", F.explode(F.sequence(slice_of(F.col("since")), slice_of(F.least("until", F.date_add("last", 1))))).alias("slice")))
    hits = asked.withColumn("slice", slice_of(F.col("day"))).join(cut, ["pattern", "slice"]).filter("since <= day and day < until")
    per_row = hits.groupBy(F.col("id").alias("id_"), F.col("url").alias("url_"), F.col("day").alias("day_")).agg(
        F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("list")), ",").alias("lists"),
        F.array_join(F.array_sort(F.collect_set("pattern")), ",").alias("patterns"))
    joined = rows.join(per_row, [F.col(c).eqNullSafe(F.col(c + "_")) for c in ("id", "url", "day")], "left")
    return joined.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(
        "id", "day", F.coalesce(host_of(F.col("url")), F.lit("")).alias("host"), F.coalesce("n", F.lit(0)).alias("n_matches"), F.coalesce("lists", F.lit("")).alias("lists"),
        F.coalesce("patterns", F.lit("")).alias("patterns"), (F.coalesce("n", F.lit(0)) > 0).alias("blocked"))
