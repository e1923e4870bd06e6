"""Nested JSON documents, sheet inventories and per-race results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from furlong.functions import scalars as S
from furlong.operators.tables import pick_source

RUNNER = (
    "numPmu int, nom string, driver string, jockey string, entraineur string, age string, sexe string, placeCorde string, poids string, musique string, proprietaire string, "
    "nombreCourses int, nbCourses int, nombreVictoires int, nbVictoires int, nombrePlaces int, nbPlaces int"
)
COURSE = (
    "numOrdre int, numExterne int, libelle string, libelleCourt string, specialite string, discipline string, parcours string, typePiste string, heureDepart bigint, distance int, "
    "etatTerrain string, terrain string, penetrometre struct<intitule: string>, nombreDeclaresPartants int, montantPrix bigint, conditions string, courseTrackee boolean, "
    f"hippodrome struct<codeHippodrome: string>, participants array<struct<{', '.join(f.replace(' ', ': ', 1) for f in RUNNER.split(', '))}>>"
)


def nested(fields: str) -> str:
    """Fields of a DDL table as fields of a struct."""
    return ", ".join(f if ":" in f.split(" ")[0] else f.replace(" ", ": ", 1) for f in _top(fields))


def _top(fields: str) -> list[str]:
    out, depth, at = [], 0, 0
    for i, c in enumerate(fields):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(fields[at:i].strip())
            at = i + 1
    return [*out, fields[at:].strip()]


PROGRAMME = (
    "date_pmu string, source string, programme struct<reunions: array<struct<hippodrome: struct<codeHippodrome: string, libelleLong: string, libelleCourt: string>, "
    f"numOfficiel: int, numExterneReunion: int, courses: array<struct<{nested(COURSE)}>>>>>"
)
PARTICIPANTS = (
    "date_pmu string, num_reunion int, num_course int, participants array<struct<numPmu: int, driver: string, entraineur: string, age: string, sexe: string, placeCorde: string, handicapPoids: int, "
    "musique: string, proprietaire: string, nombreCourses: int, nbCourses: int, nombreVictoires: int, nbVictoires: int, nombrePlaces: int, nbPlaces: int>>"
)
PERFORMANCES = (
    "date_pmu string, num_reunion int, num_course int, participants array<struct<nomCheval: string, numPmu: int, nomJockey: string, entraineur: string, age: string, sexe: string, musique: string, "
    "etatTerrain: string, terrain: string, nombreCourses: int, nbCourses: int, nombreVictoires: int, nbVictoires: int, nombrePlaces: int, nbPlaces: int, coursesCourues: array<struct<date: bigint, "
    "timezoneOffset: int, nomPrix: string, hippodrome: string, discipline: string, distance: int, etatTerrain: string, participants: array<struct<itsHim: boolean, place: struct<place: string>, nomJockey: string>>>>>>"
)
SOURCES = ("offline", "online")


def read_programmes(spark: SparkSession, path: str) -> DataFrame:
    """All documents, one for each day and source."""
    return spark.read.schema(PROGRAMME).json(path)


def pick_programmes(docs: DataFrame) -> DataFrame:
    """One document a day: of the first source that has meetings."""
    rank = F.coalesce(F.array_position(F.lit(list(SOURCES)), F.col("source")), F.lit(0)).cast("int")
    rank = F.when(rank == 0, len(SOURCES) + 1).otherwise(rank)
    return pick_source(docs.withColumn("priority", rank), "date_pmu", "priority", F.coalesce(F.size("programme.reunions") > 0, F.lit(False))).drop("priority")


def read_performances(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PERFORMANCES).json(path)


def read_participants(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PARTICIPANTS).json(path)


def tracking_inventory(files: DataFrame) -> DataFrame:
    """Keys of sheet files (path, length), beside their other columns: date_galop, code_hippo, num_course, size_kb."""
    name = r"(\d{8})([A-Z]{3})(\d{2})_last_times_fr\.pdf$"
    key = lambda i: F.regexp_extract("path", name, i)
    return files.where(F.col("path").rlike(name)).withColumns({"date_galop": key(1), "code_hippo": key(2), "num_course": key(3).cast("int"), "size_kb": F.floor(F.col("length") / 1024)}).drop("path", "length")


TRACKING = (
    "distance_m: int, terrain: string, penetrometre: double, temps_officiel: string, temps_officiel_sec: double, distance_parcourue: double, troncons: array<struct<index: int, label: string, temps: string, "
    "temps_sec: double, cumul: string, cumul_sec: double, vitesse_kmh: double, position: int, foulees: int>>, positions_troncons: array<int>, vitesses_troncons: array<double>, redk: string, redk_sec: double, "
    "vitesse_max_kmh: double, vitesse_moyenne_kmh: double, troncon_plus_rapide: string, troncon_plus_rapide_label: string, remontee_places: int, score_remontee: int, pct_top3: int, profil_leader: boolean, "
    "score_finish: double, regularite: double, chute_finale: double, temps_600m: string, temps_600m_sec: double"
)
HISTORY = (
    "nom_prix: string, hippodrome: string, distance: int, terrain: string, classement: string, jockey: string, code_hippo: string, libelle: string, resolved: boolean, course_trackee: boolean, "
    f"resolution_strategy: string, tracking: struct<{TRACKING}>, num_course: int, date_display: string, has_tracking_data: boolean"
)
RESULTS = f"date_galop string, date_pmu string, code_hippo string, num_reunion int, num_course int, horses map<string, struct<historique: array<struct<{HISTORY}>>, nb_courses_trackers: bigint>>, race_cache_path string"
FOLDER = ["date_galop", "code_hippo"]
FEW_FOLDERS = 100_000
"""Distinct races up to which a lookup's keys are sent to every task that lists or reads results; their number is counted first."""


def _races(spark: SparkSession, path: str, schema: StructType | str | None) -> DataFrame:
    return spark.read.schema(schema or RESULTS).option("basePath", path).json(path)


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def write_race_results(results: DataFrame, path: str) -> None:
    """One JSON line a race, in folders by day and venue; an empty code is the folder of no venue.

    Races that are there already are replaced, so a job that runs again leaves
    what it would have left at once: the folders that get new races are written
    anew, with the other races they hold, and take the place of the old ones when
    the job commits.  Two jobs must not write one folder at a time.
    """
    spark = results.sparkSession
    race = [*FOLDER, "num_course"]
    new = results.withColumns({"race_cache_path": S.race_cache_path(F.col("date_galop"), F.col("code_hippo"), F.col("num_course")), "code_hippo": F.nullif("code_hippo", F.lit(""))})
    if _exists(spark, path):
        old = _races(spark, path, new.schema)
        folders, races = new.select(*FOLDER).distinct().alias("f"), new.select(*race).distinct().alias("r")
        kept = old.alias("o").join(folders, [F.col(f"o.{k}").eqNullSafe(F.col(f"f.{k}")) for k in FOLDER], "left_semi")
        kept = kept.join(races, [F.col(f"o.{k}").eqNullSafe(F.col(f"r.{k}")) for k in race], "left_anti")
        new = new.unionByName(kept.select(*new.columns))
    new.repartition(*FOLDER).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*FOLDER).json(path)


def read_race_results(spark: SparkSession, path: str, schema: StructType | str | None = None, requests: DataFrame | None = None) -> DataFrame:
    """Results as one row a horse: race key, nom, historique, nb_courses_trackers.

    schema: that of the table that was written, if its history has other fields
    than ``RESULTS``.  requests (date_galop, code_hippo, num_course): only their
    races are read, and where they are few only their folders.
    """
    races = _races(spark, path, schema)
    if requests is not None:
        keys = [*FOLDER, "num_course"]
        asked = requests.where("date_galop > '' and code_hippo > ''").select(*keys).distinct()
        few = asked.limit(FEW_FOLDERS + 1).count() <= FEW_FOLDERS
        races = races.join(F.broadcast(asked) if few else asked, keys, "left_semi")
    races = races.select("date_galop", S.text_or(F.col("code_hippo")).alias("code_hippo"), "date_pmu", "num_reunion", "num_course", F.explode("horses").alias("nom", "h"))
    return races.select("*", "h.*").drop("h")
