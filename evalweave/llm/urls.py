"""URL filtering against dated lists: validity intervals and an as-of join.

List entries are dated additions and removals of a pattern (a domain with its subdomains, or a URL
prefix) in a category.  They become validity intervals; every capture is evaluated against the
entries active when it was fetched.  A capture asks for all parents of its host and all path
prefixes of its URL, so the join is an equality on the pattern plus a time condition.  A domain covers
its subdomains; a pattern with a path covers that path and below on its own host alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SALTS = 16


def host_of(url: Column) -> Column:
    """Lower-case host of an http(s) URL without user, port and trailing dot; NULL if there is none."""
    host = F.regexp_extract(F.lower(url), r"^https?://(?:[^/?#@]*@)?([^/?#:@]+)", 1)
    return F.nullif(F.regexp_replace(host, r"\.+$", ""), F.lit(""))


def intervals(entries: DataFrame) -> DataFrame:
    """(category, pattern, valid_from, valid_to) from rows (category, pattern, day, action).

    ``action`` is add or remove.  The state after a day is that of its last action by name order
    (remove after add on one day); repeated additions do not restart an interval; an open interval
    has NULL valid_to.  Valid from the day of the addition up to, not including, that of the removal.
    Rows with a NULL pattern or day, or another action, are ignored.
    """
    daily = entries.where(F.col("action").isin("add", "remove") & F.col("pattern").isNotNull() & F.col("day").isNotNull()).groupBy(
        "category", "pattern", "day").agg(F.max("action").alias("action"))
    order = Window.partitionBy("category", "pattern").orderBy("day")
    changes = daily.withColumn("was", F.lag("action").over(order)).where(
        ~F.col("action").eqNullSafe(F.col("was")) & ~(F.col("was").isNull() & (F.col("action") == "remove")))
    return changes.withColumn("valid_to", F.lead("day").over(order)).where("action = 'add'").select(
        "category", "pattern", F.col("day").alias("valid_from"), "valid_to")


def asked_patterns(url: Column) -> Column:
    """All patterns that cover a URL: its host, the parents of the host, the path prefixes with the host."""
    host = host_of(url)
    labels = F.split(host, r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    path = F.regexp_extract(url, r"^[A-Za-z]+://[^/?#]*(/[^?#]*)", 1)
    steps = F.filter(F.split(path, "/"), lambda s: s != "")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.concat(host, F.lit("/"), F.array_join(F.slice(steps, 1, i), "/")))
    return F.when(host.isNull(), F.array().cast("array<string>")).otherwise(
        F.concat(domains, F.when(F.size(steps) > 0, prefixes).otherwise(F.array().cast("array<string>"))))


def blocked(captures: DataFrame, valid: DataFrame, key: str, url: str, fetched: str) -> DataFrame:
    """Captures that an active entry covers: (key, category, pattern, valid_from), one row per entry.

    A pattern of very many captures spreads over SALTS parts, each with a copy of its intervals.
    Captures without host or fetch day match nothing.
    """
    asks = captures.where(F.col(fetched).isNotNull()).select(
        F.col(key).alias("key"), F.col(fetched).alias("at"), F.explode(F.array_distinct(asked_patterns(F.col(url)))).alias("pattern"),
    ).withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int"))
    spread = valid.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return asks.join(spread, ["pattern", "salt"]).where(
        (F.col("valid_from") <= F.col("at")) & (F.col("valid_to").isNull() | (F.col("at") < F.col("valid_to")))).select(
        F.col("key").alias(key), "category", "pattern", "valid_from")


def evaluate(captures: DataFrame, entries: DataFrame, key: str = "page_id", url: str = "url", fetched: str = "fetched") -> DataFrame:
    """(key, fetched, host, hits, category, pattern): every capture with its active entries counted.

    The category is the first by name, the pattern its longest (then first by name); both are NULL and
    hits 0 for allowed captures.  ``key`` should be unique; rows that repeat it share their hits.
    """
    hits = blocked(captures, intervals(entries), key, url, fetched).distinct()
    best = hits.groupBy(key).agg(
        F.count("*").alias("hits"),
        F.min(F.struct(F.col("category"), (-F.length("pattern")).alias("shorter"), F.col("pattern"))).alias("best"))
    return captures.select(key, fetched, host_of(F.col(url)).alias("host")).join(best, key, "left").select(
        key, fetched, "host", F.coalesce("hits", F.lit(0)).cast("long").alias("hits"), F.col("best.category").alias("category"),
        F.col("best.pattern").alias("pattern"))
