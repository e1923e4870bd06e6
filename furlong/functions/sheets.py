"""Values in the text of a timing sheet: header, labels, times, detail rows.

Patterns know Unicode digits, blanks and cases, which is slow; a text of ASCII
alone gives the same matches with the plain classes, so it is read with those.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from furlong.functions import scalars as S

# Patterns of the sheets' format, without flags.
TIME = r"(\d{2}):(\d{2})\.(\d{2})"
OFFICIAL = "(\\d+)['’](\\d{2})\"{1,2}(\\d{2})"
REDK = "redk\\s*:?\\s*(\\d+)[’'](\\d{2})[”\"](\\d{2})"
LABELS = r"(DEP\s*[-–]\s*\d+m|\d+m\s*[-–]\s*\d+m|\d+m\s*[-–]\s*ARR)"
GOING = r"(Bon|Souple|Lourd|Très lourd|Léger)[^(]*\(([\d.]+)\)"
DISTANCE = r"(\d{3,5})\s*m"
LINE_SPEED = r"(\d{2,3}[.,]\d)\s*km"
LINE_DISTANCE = r"(\d{3,5})[,.](\d{2})\s*$"
MAX_SPEED = r"Vitesse maximale\s+([\d,\.]+)"
MEAN_SPEED = r"Vitesse moyenne\s+([\d,\.]+)\s*$"
FASTEST = r"Tronçon le plus rapide\s+([\d:,.]+)\s+\(tronçon ([^)]+)\)"
ROW_NUMBER = r"(\d{1,3}(?:[,.]\d)?)"
SPEED_ROW = r"Vitesse moyenne\s*\(km/h\)"
POSITION_ROW = r"Position\s*en course"
STRIDE_ROW = r"Nombre de foulées"


# Decimal digits of all scripts, each with its value: numbers are read whatever their digits, as their patterns match any.
DIGITS = "".join(c for c in map(chr, range(128, sys.maxunicode + 1)) if unicodedata.category(c) == "Nd")
VALUES = "".join(str(unicodedata.decimal(c)) for c in DIGITS)

MARKS: dict[str, tuple[str, ...]] = {
    OFFICIAL: ("'", "’"), REDK: ("redk",), LABELS: ("-", "–"), GOING: ("(",), DISTANCE: ("m",), LINE_SPEED: (",", "."), LINE_DISTANCE: (",", "."), MAX_SPEED: ("Vitesse maximale",),
    MEAN_SPEED: ("Vitesse moyenne",), FASTEST: ("Tronçon le plus rapide",), TIME: (":",), SPEED_ROW: ("(km/h)",), POSITION_ROW: ("en course",), STRIDE_ROW: ("Nombre de foulées",),
}
"""What a text must contain, one or the other, to match: looked for before the pattern is."""


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def apart(value: Column) -> Column:
    """The value, by a higher-order function.

    Spark compiles a projection that has one to many short methods, and any other
    to a single one, which is too long for the JVM to compile if it has many searches.
    """
    return let(value, lambda x: x)


def is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.length(text)


def either(text: Column, f: Callable[[str], Column], flags: str = "", plain: Column | None = None) -> Column:
    """f of the flags for a text: none but the given ones if it is ASCII (plain, if that is known), with Unicode classes and cases if not."""
    return F.when(is_ascii(text) if plain is None else plain, f(f"(?{flags})" if flags else "")).otherwise(f(f"(?{flags}{'u' if 'i' in flags else ''}U)"))


def marked(text: Column, pattern: str) -> Column:
    return reduce(or_, (F.contains(text, F.lit(x)) for x in MARKS[pattern])) if pattern in MARKS else F.lit(True)


def found(text: Column, plain: Column, pattern: str, n: int = 1, flags: str = "") -> Column:
    """A group of the first match in a column, which is ASCII if plain; null or empty if there is none."""
    return F.when(marked(text, pattern), either(text, lambda start: F.regexp_extract(text, start + pattern, n), flags, plain))


def found_all(text: Column, plain: Column, pattern: str, n: int = 1, flags: str = "") -> Column:
    """A group of every match in a column, which is ASCII if plain."""
    return either(text, lambda start: F.regexp_extract_all(text, F.lit(start + pattern), F.lit(n)), flags, plain)


def in_line(pattern: str) -> str:
    """A pattern, of blanks and brackets at most, whose matches in a text of many lines keep to one."""
    return pattern.replace(r"\s", r"[\s&&[^\n]]").replace("[^(]", r"[^(\n]")


def group(text: Column, pattern: str, n: int = 1, flags: str = "") -> Column:
    """A group of the first match; null if there is none."""
    found = lambda x: either(x, lambda start: F.regexp_extract(x, start + pattern, n), flags)
    return let(text, lambda x: F.when(marked(x, pattern), F.nullif(found(x), F.lit(""))))


def part(match: Column, pattern: str, n: int, flags: str = "") -> Column:
    """A group of a match, as ``group`` gave it with n = 0; null if there is none or it is empty."""
    return F.nullif(F.regexp_extract(F.coalesce(match, F.lit("")), f"(?{flags}{'u' if 'i' in flags else ''}U)" + pattern, n), F.lit(""))


def all_groups(text: Column, pattern: str, n: int = 1, flags: str = "") -> Column:
    """A group of every match."""
    found = lambda x: either(x, lambda start: F.regexp_extract_all(x, F.lit(start + pattern), F.lit(n)), flags)
    return let(text, lambda x: F.when(marked(x, pattern), found(x)).otherwise(F.when(x.isNotNull(), F.array().cast("array<string>"))))


def plain_digits(text: Column) -> Column:
    """Digits of any script as 0 to 9."""
    return F.when(is_ascii(text), text).otherwise(F.translate(text, DIGITS, VALUES))


def integer(text: Column) -> Column:
    return plain_digits(text).try_cast("int")


def number(text: Column) -> Column:
    return F.replace(plain_digits(text), F.lit(","), F.lit(".")).try_cast("double")


def clock_numbers(match: Column) -> Column:
    """The numbers in a match of a clock's pattern, as texts: minutes, seconds, hundredths."""
    return F.regexp_extract_all(plain_digits(match), F.lit("[0-9]+"), F.lit(0))


def clock_values(numbers: Column) -> tuple[Column, Column]:
    """Text m'ss"cc and seconds of a clock's numbers; nulls if there are none."""
    m, s, c = (F.get(numbers, F.lit(i)).try_cast("int") for i in range(3))
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    return F.concat(m.cast("string"), F.lit("'"), two(s), F.lit('"'), two(c)), F.bround(m * 60 + s + c / F.lit(100.0), 2)


def clock(text: Column, pattern: str) -> Column:
    """Struct text (m'ss"cc) and sec of the first match; nulls if there is none."""
    # The text is searched once; the numbers are taken from the match.
    return let(clock_numbers(group(text, pattern, 0)), lambda x: F.struct(*(c.alias(n) for n, c in zip(("text", "sec"), clock_values(x), strict=True))))


def official_time(line: Column) -> tuple[Column, Column]:
    found = clock(line, OFFICIAL)
    return found["text"], found["sec"]


def line_max_speed(line: Column) -> Column:
    return number(group(line, LINE_SPEED, 1, "i"))


def line_end(line: Column) -> Column:
    """The end of a line that has all of a number at its end: ``LINE_DISTANCE`` matches no more than 8 characters but blanks."""
    return F.right(F.when(is_ascii(line), F.rtrim(line, F.lit(" \t\n\x0b\x0c\r"))).otherwise(S.strip(line)), F.lit(8))


def line_distance(line: Column) -> Column:
    """Metres at the end of a line; the last digits are the decimals."""
    return number(group(line_end(line), LINE_DISTANCE, 0))


def seconds(time: Column) -> Column:
    """Seconds of mm:ss.cc."""
    two = lambda digits, i: F.substring(digits, i, 2).try_cast("int")
    return let(plain_digits(time), lambda x: F.bround(two(x, 1) * 60 + two(x, 4) + two(x, 7) / F.lit(100.0), 2))


def time_texts(line: Column) -> Column:
    """All mm:ss.cc on a line."""
    return all_groups(line, TIME, 0)


def line_times(line: Column) -> Column:
    """Seconds of all mm:ss.cc on a line."""
    return F.transform(time_texts(line), seconds)


def going_of(match: Column) -> Column:
    """Struct terrain and penetrometre of a match of ``GOING``; nulls if there is none."""
    return F.struct(part(match, GOING, 1, "i").alias("terrain"), number(part(match, GOING, 2, "i")).alias("penetrometre"))


def going(line: Column) -> Column:
    """Struct terrain and penetrometre of the first match; nulls if there is none."""
    return let(group(line, GOING, 0, "i"), going_of)


# The first match in each line that has one, for the flags m and d; what the line must have is looked for first.
FIRST_DISTANCE = r"^[^\n]*?" + in_line(DISTANCE)
FIRST_GOING = r"^(?=[^\n(]*\()[^\n]*?(" + in_line(GOING) + ")"
LABELLED_LINE = rf"^(?=[^\n]*[-–])[^\n]*?(?>{in_line(LABELS)})[^\n]*?(?>{in_line(LABELS)})[^\n]*"
TIMED_LINE = rf"^[^\n]*?{TIME}[^\n]*"


def timed_lines(text: Column, plain: Column) -> Column:
    """The lines of a text that have a time."""
    return found_all(text, plain, TIMED_LINE, 0, "md")


def header_steps(text: Column) -> list[dict[str, Column]]:
    """Distance (first), going and penetrometer (last) and section labels (first) in the first 30 lines of a sheet's text, which is searched whole for each."""
    top, plain, first, line, match = (F.col(f"__{c}") for c in ("top", "plain", "first", "line", "match"))
    # A line whose first distance is 0 has none: only then are the distances of all lines listed.
    later = F.get(F.filter(F.transform(found_all(top, plain, FIRST_DISTANCE, 1, "md"), integer), lambda d: d > 0), F.lit(0))
    labels = F.array_join(found_all(line, plain, LABELS, 1, "i"), "\n")
    return [
        {"__top": F.substring_index(text, "\n", 30)},
        {"__plain": is_ascii(top)},
        {"__first": found(top, plain, FIRST_DISTANCE, 1, "md"), "__goings": found_all(top, plain, FIRST_GOING, 1, "imd"), "__line": found(top, plain, LABELLED_LINE, 0, "imd")},
        {"distance_m": F.when(integer(first) > 0, integer(first)).when(first != "", later), "__match": F.get("__goings", F.size("__goings") - 1), "labels": F.when(line != "", F.split(blank_free(labels), "\n"))},
        {"terrain": part(match, GOING, 1, "i"), "penetrometre": number(part(match, GOING, 2, "i"))},
    ]


def blank_free(label: Column) -> Column:
    return F.translate(label, "– ", "-")


def labels_of(found: Column) -> Column:
    """Labels without blanks if there are two or more."""
    return F.when(F.size(found) >= 2, F.transform(found, blank_free))


def section_labels(line: Column) -> Column:
    """Labels of the sections if a line has two or more."""
    return let(all_groups(line, LABELS, 1, "i"), labels_of)


def time_digits(times: Column) -> Column:
    """mmsscc of the texts of times, of which there is one at least."""
    return F.split(F.translate(plain_digits(F.array_join(times, " ")), ":.", ""), " ").try_cast("array<int>")


def numbered_times(digits: Column) -> Column:
    """Structs at (from 0) and cs (hundredths of a second) of times, given as mmsscc, which is 4,000 a minute more than the hundredths."""
    return F.transform(digits, lambda d, i: F.struct(i.alias("at"), (d - F.floor(d / 10_000) * 4_000).cast("int").alias("cs")))


NUMBERED = "struct<at: int, cs: int>"


def label_row(page: Column, label: str) -> Column:
    """The line after the one that has the label; null or empty if there is none."""
    return F.when(marked(page, label), F.regexp_extract(page, label + r"[^\n]*\n([^\n]+)", 1))


def row_numbers(row: Column) -> Column:
    """Numbers on a line; null if there is no line."""
    plain = F.replace(plain_digits(row), F.lit(","), F.lit("."))
    return F.regexp_extract_all(plain, F.lit("([0-9]{1,3}(?:[.][0-9])?)"), F.lit(1)).try_cast("array<double>")


def row_values(page: Column, label: str) -> Column:
    """Numbers on the line after the one that has the label."""
    return let(F.when(page.isNotNull(), F.coalesce(label_row(page, label), F.lit(""))), row_numbers)


# Values of a line or page in steps, each of which is to be columns of its own: what a column
# holds is computed once, however often later steps use it.


def line_steps(line: Column) -> list[dict[str, Column]]:
    """Official time, greatest speed and distance covered."""
    plain = F.col("__plain")
    return [
        {"__plain": is_ascii(line), "__end": line_end(line)},
        {"__official": found(line, plain, OFFICIAL, 0), "__speed": apart(found(line, plain, LINE_SPEED, 1, "i")), "__covered": found(F.col("__end"), plain, LINE_DISTANCE, 0)},
        {"__clock": clock_numbers(F.col("__official"))},
        {**dict(zip(("temps_officiel", "temps_officiel_sec"), clock_values(F.col("__clock")), strict=True)), "vitesse_max_ligne": number(F.col("__speed")), "distance_parcourue": number(F.col("__covered"))},
    ]


def head_steps(line: Column) -> list[dict[str, Column]]:
    """Distance, going, penetrometer, labels and times of a line."""
    return [
        {"__distance": group(line, DISTANCE), "__going": group(line, GOING, 0, "i"), "__labels": all_groups(line, LABELS, 1, "i"), "times": time_texts(line)},
        {"distance_m": integer(F.col("__distance")), "terrain": part(F.col("__going"), GOING, 1, "i"), "__firm": part(F.col("__going"), GOING, 2, "i"), "labels": labels_of(F.col("__labels"))},
        {"penetrometre": number(F.col("__firm"))},
    ]


def detail_steps(page: Column) -> list[dict[str, Column]]:
    """Times, speeds and fastest section of a detail page."""
    plain = F.col("__plain")
    return [
        {"__plain": is_ascii(page)},
        {"__redk": found(page, plain, REDK, 0), "__max": found(page, plain, MAX_SPEED), "__mean": apart(found(page, plain, MEAN_SPEED, 1, "md")), "__fastest": found(page, plain, FASTEST, 0)},
        {"__clock": clock_numbers(F.col("__redk"))},
        {
            **dict(zip(("redk", "redk_sec"), clock_values(F.col("__clock")), strict=True)), "vitesse_max_kmh": number(F.col("__max")), "vitesse_moyenne_kmh": number(F.col("__mean")),
            "troncon_plus_rapide": part(F.col("__fastest"), FASTEST, 1), "troncon_plus_rapide_label": F.trim(part(F.col("__fastest"), FASTEST, 2)),
        },
    ]


def detail_scalars(page: Column) -> list[Column]:
    """Values of ``detail_values`` of a page, each found by a search of its own."""
    redk = clock(page, REDK)
    fastest = let(group(page, FASTEST, 0), lambda m: F.struct(*(part(m, FASTEST, i).alias(n) for i, n in ((1, "time"), (2, "label")))))
    return [
        redk["text"].alias("redk"), redk["sec"].alias("redk_sec"), number(group(page, MAX_SPEED)).alias("vitesse_max_kmh"), number(group(page, MEAN_SPEED, 1, "md")).alias("vitesse_moyenne_kmh"),
        fastest["time"].alias("troncon_plus_rapide"), F.trim(fastest["label"]).alias("troncon_plus_rapide_label"),
    ]
