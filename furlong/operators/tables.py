"""Generic steps: first or last of a key, series, cache-first, venues."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from furlong.functions import scalars as S


def dedupe_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of the greatest order of each key, by partial aggregates."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*keys, "r.*").select(*df.columns)


def dedupe_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*keys, "r.*").select(*df.columns)


def pick_source(df: DataFrame, key: str, priority: str, valid: Column) -> DataFrame:
    """The valid row of the least priority of each key.

    Documents are scanned once; Spark keeps the first row of a key in each
    partition before it shuffles them.  A source has one row for a key.
    """
    rank = F.row_number().over(Window.partitionBy(key).orderBy(priority))
    return df.where(valid).withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def collect_series(df: DataFrame, keys: list[str], order: list[str], values: dict[str, Column]) -> DataFrame:
    """Arrays of values, ordered, one row a key."""
    item = F.struct(*order, *(c.alias(f"v_{n}") for n, c in values.items()))
    got = df.groupBy(*keys).agg(F.sort_array(F.collect_list(item)).alias("items"))
    return got.select(*keys, *(F.col(f"items.v_{n}").alias(n) for n in values))


def cap_history(df: DataFrame, keys: list[str], position: str, discipline: str, most: int = 6, examined: int = 40) -> DataFrame:
    """Of the first ``examined`` entries of each key, the first ``most`` that are no trot races."""
    seen = df.where((F.col(position) < examined) & ~F.upper(F.coalesce(F.col(discipline), F.lit(""))).isin(*S.TROT))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(position))
    return seen.withColumn("hist_rank", rank).where(F.col("hist_rank") <= most)


def count_tracked(df: DataFrame, keys: list[str], flag: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count_if(F.coalesce(F.col(flag), F.lit(False))).alias("nb_courses_trackers"))


def tracked_in(series: Column, flag: str) -> Column:
    """``count_tracked`` of entries that are an array already."""
    return F.size(F.filter(series, lambda x: F.coalesce(x[flag], F.lit(False)))).cast("long")


def with_cache_status(races: DataFrame, cache: DataFrame, keys: list[str]) -> DataFrame:
    return races.join(cache.select(*keys).distinct().withColumn("__hit", F.lit(True)), keys, "left").withColumn("cached", F.col("__hit").isNotNull()).drop("__hit")


def cache_first(requests: DataFrame, cache: DataFrame, keys: list[str], compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Requests with the values of the cache where it has some; the others are computed.  Adds from_cache.

    compute: from requests to their rows, with the same columns.  One join tells
    hits from misses.
    """
    values = [c for c in cache.columns if c not in keys]
    both = requests.join(cache.withColumn("__hit", F.lit(True)), keys, "left")
    hits = both.where("__hit").select(*requests.columns, *values).withColumn("from_cache", F.lit(True))
    misses = compute(both.where("__hit is null").select(*requests.columns)).withColumn("from_cache", F.lit(False))
    return hits.unionByName(misses)


def with_venue_code(df: DataFrame, name: str, out: str = "code", venues: tuple[tuple[str, str], ...] = S.VENUES) -> DataFrame:
    """Code of a venue: of the equal name, else of the first name that contains it or that it contains, else ''.

    The dictionary is a constant, so it is searched in the row, not joined; the
    name is normalised once, as a column.
    """
    known = F.array(*(F.struct(F.lit(key).alias("name"), F.lit(value).alias("code")) for key, value in venues))
    n = F.col("__venue")
    first = lambda fits: F.get(F.filter(known, fits), F.lit(0))["code"]
    code = F.coalesce(first(lambda v: v["name"] == n), first(lambda v: S.contains(n, v["name"]) | S.contains(v["name"], n)), F.lit(""))
    return df.withColumn("__venue", S.norm_name(F.col(name))).withColumn(out, code).drop("__venue")


def scan_tracking(wanted: DataFrame, tracking: DataFrame, keys: list[str], number: str, low: int = 1, high: int = 10) -> DataFrame:
    """For each key the sheet of the least race number from ``low`` to ``high``."""
    sheets = tracking.where(F.col(number).between(low, high))
    rest = [c for c in sheets.columns if c not in keys]
    first = wanted.select(*keys).distinct().join(sheets, keys).groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(F.col(number), *(c for c in rest if c != number))).alias("r"))
    return wanted.join(first.select(*keys, "r.*"), keys, "left")
