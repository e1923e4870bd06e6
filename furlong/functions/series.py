"""Indicators of ordered series: positions and speeds of a runner, section by section.

Sums run from left to right over the ordered array, so they do not depend on
how rows were spread; rounding is half to even.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def last(a: Column, n: int) -> Column:
    return F.slice(a, F.greatest(F.size(a) - n + 1, F.lit(1)), F.lit(n))


def places_gained(pos: Column) -> Column:
    return F.when(F.size(pos) >= 2, F.get(pos, F.lit(0)) - F.get(pos, F.size(pos) - 1))


def gain_score(pos: Column) -> Column:
    score = F.bround(places_gained(pos) * F.lit(1.5).cast("double")).cast("int")
    return F.when(F.size(pos) >= 2, F.least(F.lit(10), F.greatest(F.lit(0), score)))


def pct_top3(pos: Column) -> Column:
    return F.when(F.size(pos) >= 1, F.bround(F.size(F.filter(pos, lambda p: p <= 3)).cast("double") / F.size(pos) * 100).cast("int"))


def is_leader(pos: Column) -> Column:
    return pct_top3(pos) >= 60


def finish_score(v: Column) -> Column:
    return F.when(F.size(v) >= 4, F.bround((F.try_divide(total(last(v, 3)) / 3, total(v) / F.size(v)) - 1) * 100, 1))


def regularity(v: Column) -> Column:
    useful = F.slice(v, F.lit(2), F.greatest(F.size(v) - 1, F.lit(0)))
    return F.when(F.size(v) >= 3, F.bround(F.array_max(useful) - F.array_min(useful), 1))


def final_fade(v: Column) -> Column:
    middle = F.slice(v, F.lit(2), F.greatest(F.size(v) - 3, F.lit(0)))
    return F.when(F.size(v) >= 4, F.bround(total(middle) / (F.size(v) - 3) - total(last(v, 2)) / 2, 1))


def indicators(pos: Column, v: Column) -> list[Column]:
    return [
        places_gained(pos).alias("remontee_places"), gain_score(pos).alias("score_remontee"), pct_top3(pos).alias("pct_top3"), is_leader(pos).alias("profil_leader"),
        finish_score(v).alias("score_finish"), regularity(v).alias("regularite"), final_fade(v).alias("chute_finale"),
    ]


def duration_text(seconds: Column) -> Column:
    return F.format_string("%02d:%05.2f", F.floor(seconds / 60), F.pmod(seconds, F.lit(60.0)))


def clock_digits(hundredths: Column) -> Column:
    """1mmsscc of hundredths of a second below 100 minutes."""
    return (hundredths + F.floor(hundredths / 6_000) * 4_000 + 1_000_000).cast("string")


def clock_text(digits: Column, hundredths: Column) -> Column:
    """``duration_text`` of hundredths of a second, from their ``clock_digits``, which format nothing."""
    two = lambda at: F.substring(digits, at, 2)
    text = F.concat(two(2), F.lit(":"), two(4), F.lit("."), two(6))
    return F.when(hundredths.between(0, 599_999), text).otherwise(duration_text(hundredths / F.lit(100.0)))


def section_durations(cumulative: Column) -> Column:
    """Durations between cumulative times, rounded to 2 decimals; the first is the time itself."""
    return F.transform(cumulative, lambda t, i: F.when(i == 0, t).otherwise(F.bround(t - F.get(cumulative, i - 1), 2)))


def clean_times(times: Column, official: Column, kind: str = "double", seconds: Callable[[Column], Column] = lambda t: t) -> Column:
    """Fold over raw times: struct kept, t600.

    The official time itself is dropped; a time below 0.7 of the last one kept
    is that of the last 600 m; the others are kept.  Times may be structs of a
    kind, of which ``seconds`` takes the seconds.
    """
    start = F.struct(F.array().cast(f"array<{kind}>").alias("kept"), F.lit(None).cast(kind).alias("t600"))

    def step(s: Column, t: Column) -> Column:
        kept = s["kept"]
        final = F.coalesce((official != 0) & (F.abs(seconds(t) - official) < 0.1), F.lit(False))
        short = (F.size(kept) > 0) & (seconds(t) < seconds(F.get(kept, F.size(kept) - 1)) * 0.7)
        return F.when(final, s).when(short, F.struct(kept.alias("kept"), t.alias("t600"))).otherwise(F.struct(F.concat(kept, F.array(t)).alias("kept"), s["t600"].alias("t600")))

    return F.aggregate(times, start, step)


def kept_times(times: Column, official: Column, kind: str) -> Column:
    """``clean_times`` of structs with cs, the hundredths of a second, without the fold where it would keep them all: in rising times that all are far from the official one."""
    cs, far = times["cs"], official * 100
    rising = (F.array_sort(cs) == cs) & (F.array_min(cs) >= 0) & F.coalesce((far == 0) | (F.array_max(cs) < far - 20) | (F.array_min(cs) > far + 20), official.isNull())
    whole = F.struct(times.alias("kept"), F.lit(None).cast(kind).alias("t600"))
    return F.when(rising, whole).otherwise(clean_times(times, official, kind, lambda t: t["cs"] / F.lit(100.0)))


def merge_sections(n: Column, text: Column, geometry: Column) -> Column:
    """A value for each of n sections: from the geometry where it has one, else from the text; none for no sections."""
    merged = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.coalesce(F.get(geometry, i), F.get(text, i)))
    return F.slice(merged, F.lit(1), n)


def merged_series(text: Column, geometry: Column) -> Column:
    return F.when(F.size(geometry) > 0, geometry).otherwise(text)
