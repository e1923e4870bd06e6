"""Programmes, cards and the resolution of past races."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furlong.functions import scalars as S
from furlong.operators.tables import dedupe_first, dedupe_last, with_venue_code


def text(c: str, default: str = "") -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(default))


def whole(*columns: str, default: int | None = 0) -> Column:
    return F.coalesce(*(F.col(c) for c in columns), *([F.lit(default)] if default is not None else []))


def races_of(programmes: DataFrame) -> DataFrame:
    """Every race of the programmes with its places in the document: date_pmu, reunion_pos, course_pos, r, c."""
    meetings = programmes.select("date_pmu", F.posexplode("programme.reunions").alias("reunion_pos", "r"))
    # A race's row has its meeting, but not all the meeting's other races.
    return meetings.select("date_pmu", "reunion_pos", F.col("r").dropFields("courses").alias("r"), F.posexplode("r.courses").alias("course_pos", "c"))


def flatten_races(programmes: DataFrame, flat_only: bool = True) -> DataFrame:
    """Race rows of a day's programme, with runners as an ordered array."""
    rows = races_of(programmes)
    if flat_only:
        rows = rows.where(S.is_flat(F.col("c.specialite"), F.col("c.discipline")))
    rows = rows.withColumn("nom_hippo", F.coalesce("r.hippodrome.libelleLong", "r.hippodrome.libelleCourt", F.lit("")))
    rows = with_venue_code(rows, "nom_hippo", "venue")
    return rows.select(
        "date_pmu", "reunion_pos", "course_pos", whole("r.numOfficiel", "r.numExterneReunion").alias("num_reunion"), whole("c.numOrdre").alias("num_course"),
        whole("c.numExterne", "c.numOrdre").alias("num_externe"), S.text_or(S.first_truthy(F.col("r.hippodrome.codeHippodrome"), F.col("venue"))).alias("code_hippo"), "nom_hippo",
        text("c.libelle").alias("libelle"), text("c.libelleCourt").alias("libelle_court"), whole("c.heureDepart").alias("heure"), whole("c.distance").alias("distance"),
        S.going(F.col("c.etatTerrain"), F.col("c.terrain"), F.col("c.penetrometre.intitule")).alias("terrain"), S.surface(F.col("c.parcours"), F.col("c.typePiste")).alias("surface"),
        whole("c.nombreDeclaresPartants").alias("nb_partants"), whole("c.montantPrix").alias("dotation"), text("c.conditions").alias("conditions"),
        F.coalesce("c.courseTrackee", F.lit(False)).alias("course_trackee"), runners_of(F.col("c.participants")).alias("partants"),
    )


def runners_of(participants: Column) -> Column:
    """Runners as structs, ordered by number and then by place in the document."""
    empty = F.lit("")

    def runner(p: Column, i: Column) -> Column:
        return F.struct(
            F.coalesce(p["numPmu"], F.lit(0)).alias("num"), i.alias("pos"), F.coalesce(p["nom"], empty).alias("nom"), F.coalesce(p["driver"], p["jockey"], empty).alias("jockey"),
            F.coalesce(p["entraineur"], empty).alias("entraineur"), F.coalesce(p["age"], empty).alias("age"), F.coalesce(p["sexe"], empty).alias("sexe"), F.coalesce(p["placeCorde"], empty).alias("corde"),
            F.coalesce(p["poids"], empty).alias("poids"), F.coalesce(p["musique"], empty).alias("musique"), F.coalesce(p["proprietaire"], empty).alias("proprietaire"),
            F.coalesce(p["nombreCourses"], p["nbCourses"]).alias("nb_courses"), F.coalesce(p["nombreVictoires"], p["nbVictoires"]).alias("nb_victoires"), F.coalesce(p["nombrePlaces"], p["nbPlaces"]).alias("nb_places"),
        )

    return F.array_sort(F.transform(participants, runner))


def flatten_runners(races: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return races.select(*(keys or ["date_pmu", "num_reunion", "num_course"]), F.explode("partants").alias("p")).select("*", "p.*").drop("p", "pos")


RACE = ["date_pmu", "num_reunion", "num_course"]
CARD = ("jockey", "entraineur", "age", "sexe", "poids", "corde", "musique", "nb_courses", "nb_victoires", "nb_places")


def participants_info(docs: DataFrame) -> DataFrame:
    """Card fields of a participants document; the last entry of a number counts."""
    p = docs.select(*RACE, F.posexplode("participants").alias("pos", "p"))
    rows = p.select(
        *RACE, "pos", whole("p.numPmu").alias("num"), text("p.driver").alias("jockey"), text("p.entraineur").alias("entraineur"), text("p.age").alias("age"), text("p.sexe").alias("sexe"),
        text("p.placeCorde").alias("corde"), S.weight_text(F.col("p.handicapPoids")).alias("poids"), text("p.musique").alias("musique"), text("p.proprietaire").alias("proprietaire"),
        whole("p.nombreCourses", "p.nbCourses", default=None).alias("nb_courses"), whole("p.nombreVictoires", "p.nbVictoires", default=None).alias("nb_victoires"), whole("p.nombrePlaces", "p.nbPlaces", default=None).alias("nb_places"),
    )
    return dedupe_last(rows, [*RACE, "num"], ["pos"]).drop("pos")


def performances_runners(docs: DataFrame) -> DataFrame:
    p = docs.select(*RACE, F.posexplode("participants").alias("pos", "p"))
    return p.select(
        *RACE, "pos", whole("p.numPmu").alias("num"), text("p.nomCheval").alias("nom"), text("p.nomJockey").alias("jockey"), text("p.entraineur").alias("entraineur"), text("p.age").alias("age"),
        text("p.sexe").alias("sexe"), F.lit("").alias("poids"), F.lit("").alias("corde"), text("p.musique").alias("musique"), F.coalesce("p.etatTerrain", "p.terrain", F.lit("")).alias("terrain"),
        whole("p.nombreCourses", "p.nbCourses", default=None).alias("nb_courses"), whole("p.nombreVictoires", "p.nbVictoires", default=None).alias("nb_victoires"), whole("p.nombrePlaces", "p.nbPlaces", default=None).alias("nb_places"),
        F.col("p.coursesCourues").alias("coursesCourues"),
    )


def runner_card(performances: DataFrame, info: DataFrame, keys: list[str], fields: tuple[str, ...] = CARD) -> DataFrame:
    """Fields of the participants document where it says something, else those of the performances."""
    other = info.select(*keys, *(F.col(f).alias(f"i_{f}") for f in fields))
    joined = performances.join(other, keys, "left")
    for f in fields:
        number = joined.schema[f].dataType.typeName() in ("integer", "long", "double")
        first = S.first_truthy(F.col(f"i_{f}"), empty=0 if number else "")
        joined = joined.withColumn(f, F.coalesce(first, F.col(f)))
    return joined.drop(*(f"i_{f}" for f in fields))


def with_race_header(cards: DataFrame, races: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first race of the same key beside each row; nulls if there is none."""
    return cards.join(dedupe_first(races, keys, order), keys, "left")


def fill_going(races: DataFrame, runners: DataFrame, keys: list[str], going: str = "terrain", order: str = "pos") -> DataFrame:
    """The going of a race, or else that of its first runner."""
    first = runners.groupBy(*keys).agg(F.min_by(F.coalesce(going, F.lit("")), order).alias("__going"))
    return races.join(first, keys, "left").withColumn(going, S.text_or(S.first_truthy(F.col(going), F.col("__going")))).drop("__going")


SPLIT = 1_000
"""Races of a meeting that are scored in one place; a larger meeting is split, and its lookups are repeated for each part."""


def resolve_races(lookups: DataFrame, races: DataFrame, day: str = "day", prize: str = "nom_prix", hint: str = "hint", threshold: int = 40, split: int = SPLIT) -> DataFrame:
    """The best race of the same day for each distinct (day, prize, hint).

    races: day, reunion_pos, course_pos, code, long_name, short_name (venue),
    label, short_label and what is to be returned.  Hints are matched to venues
    first, once for each day, so that races join by keys; a meeting's races are
    dealt to as many parts as their number asks for, so a busy day is scored by
    many tasks.  Of the best score the first in document order counts; below the
    threshold there is no row.
    """
    venue = [day, "reunion_pos"]
    meetings = races.groupBy(*venue, "code", "long_name", "short_name").agg(F.count("*").alias("__n"))
    asked = lookups.select(day, prize, hint).distinct()
    fits = S.venue_matches(F.col(hint), F.col("code"), F.col("long_name"), F.col("short_name"))
    # Names of one venue may differ between its races: parts are counted over all of them.
    sizes = meetings.groupBy(*venue).agg(F.ceil(F.sum("__n") / split).cast("int").alias("__parts"))
    hints = asked.select(day, hint).distinct().join(meetings, day).where(fits).select(day, F.coalesce(hint, F.lit("")).alias("__hint"), "reunion_pos").distinct()
    hints = hints.join(sizes, venue)
    # Names are normalised and cut to words once on either side, not for every pair.
    asked = asked.withColumns({"__hint": F.coalesce(hint, F.lit("")), "__q": S.norm_name(F.col(prize)), "__qw": S.tokens(F.col(prize), 3)})
    asked = asked.join(hints, [day, "__hint"]).withColumn("__part", F.explode(F.sequence(F.lit(0), F.col("__parts") - 1))).drop("__parts")
    ready = races.join(sizes, venue).withColumns({"__l": S.norm_name(F.col("label")), "__s": S.norm_name(F.col("short_label")), "__lw": S.tokens(F.col("label"), 3), "__part": F.pmod(F.xxhash64("course_pos", "label"), F.col("__parts")).cast("int")})
    pairs = asked.join(ready.drop("__parts"), [*venue, "__part"])
    score = S.prepared_score(*(F.col(c) for c in ("__q", "__qw", "__l", "__s", "__lw")))
    scored = pairs.withColumn("score", score).where(F.col("score") >= threshold)
    kept = [c for c in races.columns if c != day]
    best = scored.groupBy(day, prize, hint).agg(F.max_by(F.struct("score", *kept), F.struct("score", -F.col("reunion_pos"), -F.col("course_pos"))).alias("b"))
    return best.select(day, prize, hint, "b.*")


def find_runner(runners: DataFrame, names: DataFrame, keys: list[str], name: str = "nom", order: str = "pos") -> DataFrame:
    """The first runner of each name, after normalising both."""
    rest = [c for c in runners.columns if c not in keys]
    mine = runners.withColumn("__n", S.norm_name(F.col(name))).groupBy(*keys, "__n").agg(F.min_by(F.struct(*rest), order).alias("r"))
    return names.select(*keys, F.col(name).alias("asked"), S.norm_name(F.col(name)).alias("__n")).join(mine, [*keys, "__n"]).select(*keys, "asked", "r.*")
