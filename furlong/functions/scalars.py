"""Names, dates, weights and other values of one row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MS = 86_400_000
DEFAULT_OFFSET_MS = 3_600_000
# Disciplines of trot races.
TROT = ("TROT_ATTELE", "TROT_MONTE", "ATTELE", "MONTE")
# Venue names and codes, in the order in which they are tried.
VENUES = (
    ("CHANTILLY", "CHA"), ("DEAUVILLE", "DEA"), ("LONGCHAMP", "LPA"), ("PARIS-LONGCHAMP", "LPA"), ("PARISLONGCHAMP", "LPA"), ("SAINT-CLOUD", "SAI"), ("MAISONS-LAFFITTE", "MAI"),
    ("EVRY", "EVR"), ("ÉVRY", "EVR"), ("COMPIEGNE", "COM"), ("COMPIÈGNE", "COM"), ("CLAIREFONTAINE", "CLF"), ("LE LION D'ANGERS", "LLA"), ("LION D'ANGERS", "LLA"),
    ("VICHY", "VIC"), ("NANTES", "NAR"), ("STRASBOURG", "STR"), ("LYON PARILLY", "LYO"), ("LYON-PARILLY", "LYO"), ("LYON LA SOIE", "LLS"), ("MARSEILLE", "MAR"),
    ("TOULOUSE", "TOU"), ("ANGERS", "ANG"), ("CAGNES", "CAG"), ("CAGNES-SUR-MER", "CAG"), ("BORDEAUX", "BOR"), ("BORDEAUX LE BOUSCAT", "BOR"), ("FONTAINEBLEAU", "FON"),
)


def text_or(c: Column, default: str = "") -> Column:
    return F.coalesce(c, F.lit(default))


def strip(c: Column) -> Column:
    """Without Unicode blanks at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def norm_name(c: Column) -> Column:
    return strip(F.upper(text_or(c)))


def tokens(c: Column, longer_than: int) -> Column:
    """Words of a name that have more than so many characters."""
    return F.filter(F.split(norm_name(c), r"(?U)\s+"), lambda t: F.length(t) > longer_than)


def first_truthy(*columns: Column, empty: object = "") -> Column:
    """First value that is neither null nor ``empty`` (0 for numbers)."""
    return F.coalesce(*(F.nullif(c, F.lit(empty)) for c in columns))


def weight_text(tenths: Column) -> Column:
    """Tenths of a kilogram as text with one decimal; nothing for 0 and null."""
    return F.when(tenths != 0, F.format_string("%.1f", tenths / 10)).otherwise("")


def is_flat(speciality: Column, discipline: Column) -> Column:
    return (F.upper(text_or(speciality)) == "PLAT") | (F.upper(text_or(discipline)) == "PLAT")


def surface(course: Column, track: Column) -> Column:
    course = F.upper(text_or(course))
    sand = course.contains("SABLE") | course.contains("PSF") | course.contains("FIBRE") | (F.upper(text_or(track)) == "PSF")
    return F.when(sand, "PSF").otherwise("GAZON")


def going(state: Column, ground: Column, penetrometer: Column) -> Column:
    return F.coalesce(state, ground, penetrometer, F.lit(""))


def local_date(ts_ms: Column, offset_ms: Column | None = None) -> Column:
    """Local day of an instant in milliseconds; does not depend on the session's time zone."""
    offset = F.lit(DEFAULT_OFFSET_MS) if offset_ms is None else F.coalesce(offset_ms, F.lit(DEFAULT_OFFSET_MS))
    return F.date_from_unix_date(F.floor((ts_ms + offset) / DAY_MS).cast("int"))


def date_pmu(day: Column) -> Column:
    return F.date_format(day, "ddMMyyyy")


def date_galop(day: Column) -> Column:
    return F.date_format(day, "yyyyMMdd")


def date_display(day: Column) -> Column:
    return F.date_format(day, "dd/MM/yyyy")


def tracking_file_name(day: Column, code: Column, number: Column) -> Column:
    return F.format_string("%s%s%02d_last_times_fr.pdf", day, code, number)


def race_cache_path(day: Column, code: Column, number: Column) -> Column:
    return F.format_string("data/%s/%s_C%02d.json", day, code, number)


def contains(whole: Column, part: Column) -> Column:
    return F.contains(whole, part)


def venue_matches(hint: Column, code: Column, long_name: Column, short_name: Column) -> Column:
    """Whether a venue is the one meant: equal code, or hint inside a name; an empty hint fits all."""
    up = F.upper(text_or(hint))
    return (up == "") | (text_or(code) == up) | contains(F.upper(text_or(long_name)), up) | contains(F.upper(text_or(short_name)), up)


def name_score(query: Column, label: Column, short_label: Column) -> Column:
    """100 for equal names, 80 or 70 for one inside the other, else 40 and 10 for each word in common."""
    return prepared_score(norm_name(query), tokens(query, 3), norm_name(label), norm_name(short_label), tokens(label, 3))


def prepared_score(q: Column, q_words: Column, long: Column, short: Column, words: Column) -> Column:
    """``name_score`` of names that are normalised, and cut to words, beforehand."""
    common = F.size(F.filter(q_words, lambda m: F.exists(words, lambda w: contains(w, m) | contains(m, w))))
    return (
        F.when((q == long) | (q == short), 100).when(contains(long, q) | contains(q, long), 80).when(contains(short, q) | contains(q, short), 70).when(common > 0, 40 + 10 * common).otherwise(0)
    )


def own_run(participants: Column) -> Column:
    """Place and jockey of the first participant that is the horse itself."""
    own = F.get(F.filter(participants, lambda p: F.coalesce(p["itsHim"], F.lit(False))), F.lit(0))
    return F.when(own.isNotNull(), F.struct(F.coalesce(own["place"]["place"], F.lit("?")).alias("place"), F.coalesce(own["nomJockey"], F.lit("")).alias("jockey")))
