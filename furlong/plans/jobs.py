"""Whole jobs: programme, card, history, race results, lookup of a horse."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furlong.functions import scalars as S
from furlong.operators import races as R
from furlong.operators import sheets as T
from furlong.operators import tables as B
from furlong.sources.documents import HISTORY, pick_programmes
from furlong.sources.scratch import written

SHEET = ["date_galop", "code_hippo", "num_course"]


def programme_job(documents: DataFrame) -> DataFrame:
    """Flat races of each day, from the first source that has meetings."""
    return R.flatten_races(pick_programmes(documents))


def card_job(performances: DataFrame, participants: DataFrame, races: DataFrame) -> DataFrame:
    """Runners of each race by number, with the race's header; the going is filled in from the first runner.

    historique is empty and nb_courses_trackers 0 until histories are asked for.
    """
    runners = R.performances_runners(performances)
    cards = R.runner_card(runners.drop("coursesCourues"), R.participants_info(participants), [*R.RACE, "num"])
    header = R.fill_going(races, runners, R.RACE).select(*R.RACE, F.struct("reunion_pos", "course_pos", "code_hippo", "nom_hippo", "libelle", "distance", "surface", "terrain").alias("course_ref"), "reunion_pos", "course_pos")
    cards = R.with_race_header(cards.drop("terrain"), header, R.RACE, ["reunion_pos", "course_pos"]).drop("reunion_pos", "course_pos")
    empty = {"historique": F.array().cast(f"array<struct<{HISTORY}>>"), "nb_courses_trackers": F.lit(0).cast("long")}
    return cards.withColumns(empty).orderBy(*R.RACE, "num", "pos")


def candidates(programmes: DataFrame) -> DataFrame:
    """All races of the programmes, one a day, as candidates for past races."""
    return R.races_of(programmes).select(
        F.to_date("date_pmu", "ddMMyyyy").alias("day"), "reunion_pos", "course_pos", F.coalesce("r.hippodrome.codeHippodrome", F.lit("")).alias("code"),
        F.coalesce("r.hippodrome.libelleLong", F.lit("")).alias("long_name"), F.coalesce("r.hippodrome.libelleCourt", F.lit("")).alias("short_name"),
        F.coalesce("c.libelle", F.lit("")).alias("label"), F.coalesce("c.libelleCourt", F.lit("")).alias("short_label"), F.coalesce("c.numOrdre", F.lit(0)).alias("num_course"),
        F.coalesce("r.numOfficiel", F.lit(1)).alias("num_reunion"), S.text_or(S.first_truthy(F.col("c.hippodrome.codeHippodrome"), F.col("r.hippodrome.codeHippodrome"))).alias("code_hippo"),
        F.coalesce("c.courseTrackee", F.lit(False)).alias("course_trackee"),
    )


RUNNER = [*R.RACE, "pos", "nom"]


def history_job(performances: DataFrame, programmes: DataFrame, pages: DataFrame, words: DataFrame, most: int = 6) -> DataFrame:
    """Past races of each named runner of the performances documents; see ``history_of``."""
    return history_of(R.performances_runners(performances).where("nom <> ''"), programmes, pages, words, most)


def history_of(runners: DataFrame, programmes: DataFrame, pages: DataFrame, words: DataFrame, most: int = 6) -> DataFrame:
    """Past races of runners (race, pos, nom, coursesCourues), resolved and with tracking where there is some.

    A row for each past race that is kept; ``card_course`` is the number of the
    runner's race, ``num_course`` that of the past one.
    """
    runner = [c if c != "num_course" else "card_course" for c in RUNNER]
    runs = runners.withColumnRenamed("num_course", "card_course").select(*runner, F.posexplode("coursesCourues").alias("hist_pos", "p"))
    runs = B.cap_history(runs.withColumn("discipline", F.col("p.discipline")), runner, "hist_pos", "discipline", most)
    own = S.own_run(F.col("p.participants"))
    day = S.local_date(F.coalesce("p.date", F.lit(0)), F.col("p.timezoneOffset"))
    runs = runs.select(
        *runner, "hist_rank", day.alias("day"), R.text("p.nomPrix").alias("nom_prix"), R.text("p.hippodrome").alias("hippodrome"), R.whole("p.distance").alias("distance"),
        R.text("p.etatTerrain").alias("terrain"), own["place"].alias("classement"), own["jockey"].alias("jockey"),
    )
    runs = B.with_venue_code(runs.withColumn("hint", F.col("hippodrome")), "hippodrome", "venue")
    found = R.resolve_races(runs, candidates(pick_programmes(programmes))).where("num_course <> 0").select("day", "nom_prix", "hint", "num_course", F.col("code_hippo").alias("r_code"), "course_trackee", F.col("label").alias("libelle"))
    runs = runs.join(found, ["day", "nom_prix", "hint"], "left").withColumn("date_galop", S.date_galop(F.col("day")))
    # Resolved runs are used several times below.
    runs = written(runs, "runs")
    known = runs.where("num_course is not null").withColumns({"code_hippo": S.first_truthy(F.col("r_code"), F.col("venue")), "resolution_strategy": F.lit("programme_pmu")})
    # Unresolved races ask the first ten sheets of their day and venue that exist, for the first that has the horse.
    sheets = T.sheet_rows(pages, SHEET)
    open_runs = runs.where("num_course is null").drop("num_course").withColumn("code_hippo", F.nullif("venue", F.lit("")))
    numbers = pages.select(*SHEET).distinct().where("num_course between 1 and 10")
    tried = open_runs.select("date_galop", "code_hippo", "nom").distinct().join(numbers, ["date_galop", "code_hippo"])
    scanned = B.scan_tracking(open_runs, T.listed(tried, sheets, SHEET), ["date_galop", "code_hippo", "nom"], "num_course")
    hit = F.col("num_course").isNotNull()
    scanned = scanned.withColumns({"course_trackee": hit, "resolution_strategy": F.when(hit, "scan_brute")})
    columns = [*runner, "hist_rank", "day", "date_galop", "nom_prix", "hippodrome", "distance", "terrain", "classement", "jockey", "code_hippo", "libelle", "num_course", "course_trackee", "resolution_strategy"]
    runs = known.select(*columns).unionByName(scanned.select(*columns)).withColumn("resolved", F.col("num_course").isNotNull())
    # Everything else is read from the chosen sheets alone.
    tracked = T.extract_tracking(runs.where("resolved").select(*SHEET, "nom").distinct(), pages, words, SHEET, sheets=sheets)
    columns = [*runner, "hist_rank", "nom_prix", "hippodrome", "distance", "terrain", "classement", "jockey", "code_hippo", "libelle", "resolved", "course_trackee", "resolution_strategy", "tracking", "num_course"]
    return join_tracking(runs, tracked).select(*columns, S.date_display(F.col("day")).alias("date_display"), F.col("tracking").isNotNull().alias("has_tracking_data"))


def join_tracking(runs: DataFrame, tracked: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """What was read from a race's sheet for a horse beside each of its runs; nulls where there is nothing."""
    return runs.join(tracked, keys or [*SHEET, "nom"], "left")


def with_history(runners: DataFrame, history: DataFrame) -> DataFrame:
    """historique (in order) and nb_courses_trackers beside each runner; empty and 0 for one without past races."""
    keys = ["date_pmu", "num_reunion", "card_course", "pos"]
    rest = [c for c in history.columns if c not in (*keys, "nom", "hist_rank")]
    lists = B.collect_series(history, keys, ["hist_rank"], {"historique": F.struct(*rest)})
    lists = lists.withColumn("nb_courses_trackers", B.tracked_in(F.col("historique"), "has_tracking_data"))
    lists = lists.withColumnRenamed("card_course", "num_course")
    none = F.array().cast(lists.schema["historique"].dataType)
    joined = runners.join(lists, [*R.RACE, "pos"], "left")
    return joined.withColumns({"historique": F.coalesce("historique", none), "nb_courses_trackers": F.coalesce("nb_courses_trackers", F.lit(0).cast("long"))})


def assemble_results(runners: DataFrame, races: DataFrame) -> DataFrame:
    """One row a race: its keys, and horses as a map from name to historique and nb_courses_trackers.

    runners: race, pos, nom, historique, nb_courses_trackers.  Empty names are
    skipped; of equal names in a race the last counts.  races: race, its place in
    the programme, code_hippo; a race that is not among them has an empty code.
    """
    last = B.dedupe_last(runners.where("nom <> ''").select(*RUNNER, "historique", "nb_courses_trackers"), [*R.RACE, "nom"], ["pos"])
    maps = last.groupBy(*R.RACE).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("nom", F.struct("historique", "nb_courses_trackers").alias("horse"))))).alias("horses"))
    named = R.with_race_header(maps, races.select(*R.RACE, "reunion_pos", "course_pos", "code_hippo"), R.RACE, ["reunion_pos", "course_pos"])
    return named.select(S.date_galop(F.to_date("date_pmu", "ddMMyyyy")).alias("date_galop"), "date_pmu", S.text_or(F.col("code_hippo")).alias("code_hippo"), "num_reunion", "num_course", "horses")


def race_results_job(performances: DataFrame, programmes: DataFrame, pages: DataFrame, words: DataFrame, most: int = 6) -> DataFrame:
    """The result document of each race of the performances documents, ready for ``write_race_results``."""
    runners = R.performances_runners(performances).where("nom <> ''")
    history = history_of(runners, programmes, pages, words, most)
    return assemble_results(with_history(runners.drop("coursesCourues"), history), programme_job(programmes))


def horse_lookup_job(requests: DataFrame, cache: DataFrame, performances: DataFrame, programmes: DataFrame, pages: DataFrame, words: DataFrame, most: int = 6) -> DataFrame:
    """History of requested horses: request, historique, nb_courses_trackers, from_cache.

    requests: date_pmu, date_galop, code_hippo, num_reunion, num_course, nom.
    cache: rows of ``read_race_results``, which reads the requests' folders alone
    if it is given them.  Blanks around a name and the case of a venue's code
    don't matter; a request without a name has no row.  A horse is taken from the
    results of its race by its exact name, if the request has a day and a venue;
    else its runner is found by the normalised name and its history is computed;
    a horse that doesn't run has an empty one.
    """
    request = ["date_pmu", "date_galop", "code_hippo", "num_reunion", "num_course", "nom"]
    asked = requests.select(*request).distinct().withColumns({"__nom": S.strip(F.col("nom")), "__code": F.upper("code_hippo")}).where("__nom <> ''")

    def compute(misses: DataFrame) -> DataFrame:
        found = R.find_runner(R.performances_runners(performances), misses.select(*R.RACE, F.col("__nom").alias("nom")).distinct(), R.RACE)
        done = with_history(found.select("asked", *RUNNER), history_of(found, programmes, pages, words, most))
        rows = misses.join(done.select(*R.RACE, F.col("asked").alias("__nom"), "historique", "nb_courses_trackers"), [*R.RACE, "__nom"], "left")
        none = F.array().cast(done.schema["historique"].dataType)
        return rows.select(*asked.columns, F.coalesce("historique", none).alias("historique"), F.coalesce("nb_courses_trackers", F.lit(0).cast("long")).alias("nb_courses_trackers"))

    kept = cache.select("date_galop", F.col("code_hippo").alias("__code"), "num_course", F.col("nom").alias("__nom"), "historique", "nb_courses_trackers").where("date_galop <> '' and __code <> ''")
    return B.cache_first(asked, kept, ["date_galop", "__code", "num_course", "__nom"], compute).select(*request, "historique", "nb_courses_trackers", "from_cache")
