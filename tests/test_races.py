"""Hand-computed cases of the race operators."""

import json
import re

from pyspark.sql import functions as F

from furlong.functions import scalars as S
from furlong.functions import series as V
from furlong.functions import sheets as X
from furlong.operators import sheets as T
from furlong.operators import tables as B
from furlong.plans import jobs
from furlong.sources import documents as D


def test_indicators(spark):
    rows = spark.createDataFrame([(1, [8, 6, 3, 1], [57.0, 59.0, 60.0, 62.0]), (2, [5], [60.0]), (3, [2, 3], [60.0, 61.0, 58.0]), (4, [], [])], "i int, p array<int>, v array<double>")
    got = {r["i"]: tuple(r)[1:] for r in rows.select("i", *V.indicators(F.col("p"), F.col("v"))).collect()}
    assert got[1] == (7, 10, 50, False, 1.4, 3.0, -2.0)
    assert got[2] == (None, None, 0, False, None, None, None)
    assert got[3] == (-1, 0, 100, True, None, 3.0, None)
    assert got[4] == (None,) * 7


def test_name_score(spark):
    cases = [("PRIX DU LAC", "PRIX DU LAC", "LAC", 100), ("PRIX DU LAC", "GRAND PRIX DU LAC", "GPL", 80), ("PRIX DU LAC", "COUPE", "DU LAC", 70), ("PRIX DE PRINTEMPS", "COUPE PRINTEMPS", "CP", 50), ("X", None, "Z", 80), ("PRIX DU LAC", "COUPE", "ZZ", 0), ("X", "Y", None, 70)]
    rows = spark.createDataFrame(cases, "q string, l string, s string, want int")
    assert all(r["got"] == r["want"] for r in rows.select("want", S.name_score(F.col("q"), F.col("l"), F.col("s")).alias("got")).collect())


def test_venue_codes(spark):
    rows = spark.createDataFrame([("LYON",), (" angers ",), ("Le Lion d'Angers",), ("",), ("NOWHERE",)], "n string")
    assert [r["code"] for r in B.with_venue_code(rows, "n").collect()] == ["LYO", "ANG", "LLA", "CHA", ""]


def test_dates_do_not_depend_on_the_session(spark):
    rows = spark.createDataFrame([(0, None), (82_799_999, None), (82_800_000, None), (-3_600_001, None), (0, -1)], "ts long, tz int")
    assert [r[0] for r in rows.select(S.date_pmu(S.local_date(F.col("ts"), F.col("tz")))).collect()] == ["01011970", "01011970", "02011970", "31121969", "31121969"]


def test_sheet_end_to_end(spark):
    first = "PRIX EXEMPLE - 1600m  Souple (3.4)\nDEP - 400m   400m – 800m   800m - ARR\n3 CHEVAL TEST  00:25.10 00:49.30 01:13.20 00:35.00  1'37\"42  68,4 km  1605,32"
    second = "CHEVAL TEST\nVitesse maximale 68,4\nTronçon le plus rapide 00:23.90 (tronçon 800m-ARR)\nVitesse moyenne (km/h)\n57,4 59,5 60,3 61,0\nPosition en course\n8 6 3 1\nNombre de foulées\n58 56 55 54"
    keys = ["date_galop", "code_hippo", "num_course"]
    pages = spark.createDataFrame([("20240101", "CHA", 1, 0, first), ("20240101", "CHA", 1, 1, second)], "date_galop string, code_hippo string, num_course int, page_no int, text string")
    words = spark.createDataFrame([], "date_galop string, code_hippo string, num_course int, page_no int, word_no int, text string, x0 double, top double")
    horses = spark.createDataFrame([("20240101", "CHA", 1, "Cheval Test"), ("20240101", "CHA", 1, "ab")], "date_galop string, code_hippo string, num_course int, nom string")
    (row,) = T.extract_tracking(horses, pages, words, keys).collect()
    t = row["tracking"]
    assert (t["temps_officiel"], t["temps_officiel_sec"], t["distance_m"], t["terrain"], t["penetrometre"], t["distance_parcourue"]) == ("1'37\"42", 97.42, 1600, "Souple", 3.4, 1605.32)
    assert [(s["label"], s["temps_sec"], s["cumul_sec"], s["position"], s["foulees"]) for s in t["troncons"]] == [("DEP-400m", 25.1, 25.1, 8, 58), ("400m-800m", 24.2, 49.3, 6, 56), ("800m-ARR", 23.9, 73.2, 3, 55)]
    assert [s["cumul"] for s in t["troncons"]] == ["00:25.10", "00:49.30", "01:13.20"] and t["temps_600m"] == "00:35.00"
    assert (t["temps_600m_sec"], t["vitesse_max_kmh"], t["remontee_places"], t["troncon_plus_rapide_label"]) == (35.0, 68.4, 7, "800m-ARR")
    assert t["positions_troncons"] == [8, 6, 3, 1] and t["vitesses_troncons"] == [57.4, 59.5, 60.3, 61.0]


def test_durations_and_history(spark):
    rows = spark.createDataFrame([([25.1, 49.3, 47.8],)], "t array<double>").select(V.section_durations(F.col("t")).alias("d"))
    assert rows.select("d", V.duration_text(F.get("d", F.lit(2))).alias("x")).first()[:] == ([25.1, 24.2, -1.5], "-1:58.50")
    runs = spark.createDataFrame([(1, i, "MONTE" if i < 37 else "PLAT") for i in range(45)], "h int, pos int, d string")
    assert [r["pos"] for r in B.cap_history(runs, ["h"], "pos", "d").orderBy("pos").collect()] == [37, 38, 39]


PAGES = "date_galop string, code_hippo string, num_course int, page_no int, text string"
WORDS = "date_galop string, code_hippo string, num_course int, page_no int, word_no int, text string, x0 double, top double"


def documents(spark, path):
    """Programmes, performances, pages and words of two races, read from files."""
    course = {"numOrdre": 4, "libelle": "PRIX DU LAC", "libelleCourt": "LAC", "specialite": "Plat", "parcours": "piste en sable", "participants": [{"numPmu": 2, "nom": "B"}, {"numPmu": 1, "nom": "A", "jockey": "J"}]}
    online = {"date_pmu": "01012024", "source": "online", "programme": {"reunions": [{"hippodrome": {"libelleLong": "VICHY"}, "numExterneReunion": 3, "courses": [course, {"numOrdre": 5, "discipline": "TROT"}]}]}}
    offline = {"date_pmu": "01012024", "source": "offline", "programme": {"reunions": []}}
    today = {"date_pmu": "02012024", "source": "offline", "programme": {"reunions": [{"hippodrome": {"codeHippodrome": "DEA"}, "numOfficiel": 1, "courses": [{"numOrdre": 1, "discipline": "plat"}]}]}}
    (path / "p.json").write_text("\n".join(map(json.dumps, (offline, online, today))))
    past = [{"date": 1704103200000, "nomPrix": "prix du lac", "hippodrome": "VICHY", "discipline": "PLAT", "participants": [{"itsHim": False}, {"itsHim": True, "nomJockey": "K", "place": {}}]}, {"date": 0, "nomPrix": "nothing", "hippodrome": "NOWHERE", "discipline": "PLAT"}]
    horses = [{"nomCheval": "Abel", "numPmu": 1, "coursesCourues": past[1:]}, {"nomCheval": "", "numPmu": 2}, {"nomCheval": "Abel", "numPmu": 3, "coursesCourues": past}, {"nomCheval": "Cleo ", "numPmu": 4}]
    races = [{"date_pmu": "02012024", "num_reunion": 1, "num_course": n, "participants": horses} for n in (1, 2)]
    (path / "q.json").write_text("\n".join(map(json.dumps, races)))
    pages = spark.createDataFrame([("20240101", "VIC", 4, 0, "3 ABEL 00:25.10 00:49.30")], PAGES)
    return D.read_programmes(spark, str(path / "p.json")), D.read_performances(spark, str(path / "q.json")), pages, spark.createDataFrame([], WORDS)


def test_programme_and_history(spark, tmp_path):
    programmes, performances, pages, words = documents(spark, tmp_path)
    assert programmes.count() == 3
    race = {r["date_pmu"]: r for r in jobs.programme_job(programmes).collect()}
    assert len(race) == 2 and race["02012024"]["code_hippo"] == "DEA"
    race = race["01012024"]
    assert (race["num_reunion"], race["num_course"], race["code_hippo"], race["surface"], [p["nom"] for p in race["partants"]]) == (3, 4, "VIC", "PSF", ["A", "B"])
    got = {(r["card_course"], r["pos"], r["hist_rank"]): r for r in jobs.history_job(performances, programmes, pages, words).collect()}
    assert len(got) == 6
    one, two = got[1, 2, 1], got[1, 2, 2]
    assert (one["resolved"], one["num_course"], one["classement"], one["jockey"], one["resolution_strategy"], one["has_tracking_data"]) == (True, 4, "?", "K", "programme_pmu", True)
    assert [s["cumul"] for s in one["tracking"]["troncons"]] == ["00:25.10", "00:49.30"]
    assert (two["resolved"], two["num_course"], two["code_hippo"], two["has_tracking_data"]) == (False, None, None, False)


def test_results_are_written_read_and_looked_up(spark, tmp_path):
    programmes, performances, pages, words = documents(spark, tmp_path)
    results = jobs.race_results_job(performances, programmes, pages, words)
    rows = {r["num_course"]: r for r in results.collect()}
    assert sorted(rows) == [1, 2] and (rows[1]["date_galop"], rows[1]["code_hippo"], rows[2]["code_hippo"]) == ("20240102", "DEA", "")
    # The last of equal names counts; a horse without past races has an empty history.
    horses = rows[1]["horses"].asDict() if hasattr(rows[1]["horses"], "asDict") else rows[1]["horses"]
    assert sorted(horses) == ["Abel", "Cleo "] and len(horses["Abel"]["historique"]) == 2 and horses["Abel"]["nb_courses_trackers"] == 1 and horses["Cleo "]["historique"] == []
    D.write_race_results(results.where("num_course = 1"), str(tmp_path / "out"))
    cache = D.read_race_results(spark, str(tmp_path / "out"), results.schema)
    assert {(r["date_galop"], r["code_hippo"], r["num_course"], r["nom"], r["nb_courses_trackers"]) for r in cache.collect()} == {("20240102", "DEA", 1, "Abel", 1), ("20240102", "DEA", 1, "Cleo ", 0)}
    asked = spark.createDataFrame([("02012024", "20240102", "DEA", 1, 1, "Abel"), ("02012024", "20240102", "DEA", 1, 1, "cleo"), ("02012024", "20240102", "DEA", 1, 2, " abel "), ("02012024", "20240102", "DEA", 1, 2, "Nobody")], "date_pmu string, date_galop string, code_hippo string, num_reunion int, num_course int, nom string")
    got = {(r["num_course"], r["nom"]): (r["from_cache"], len(r["historique"]), r["nb_courses_trackers"]) for r in jobs.horse_lookup_job(asked, cache, performances, programmes, pages, words).collect()}
    assert got == {(1, "Abel"): (True, 2, 1), (1, "cleo"): (False, 0, 0), (2, " abel "): (False, 1, 0), (2, "Nobody"): (False, 0, 0)}


def test_card(spark, tmp_path):
    programmes, performances, _, _ = documents(spark, tmp_path)
    card = {"date_pmu": "02012024", "num_reunion": 1, "num_course": 1, "participants": [{"numPmu": 1, "driver": "old"}, {"numPmu": 1, "driver": "D", "handicapPoids": 585, "nombreCourses": 0, "nbCourses": 7}]}
    (tmp_path / "c.json").write_text(json.dumps(card))
    rows = jobs.card_job(performances, D.read_participants(spark, str(tmp_path / "c.json")), jobs.programme_job(programmes)).collect()
    one = next(r for r in rows if r["num_course"] == 1 and r["num"] == 1)
    assert (one["jockey"], one["poids"], one["nb_courses"], one["course_ref"]["code_hippo"]) == ("D", "58.5", None, "DEA")
    assert [(r["num_course"], r["num"], r["historique"], r["nb_courses_trackers"]) for r in rows] == [(c, n, [], 0) for c in (1, 2) for n in (1, 2, 3, 4)]
    assert next(r for r in rows if r["num_course"] == 2)["course_ref"] is None


def test_no_sections_no_values(spark):
    rows = spark.createDataFrame([(0, [1.0]), (2, [5.0])], "n int, v array<double>")
    assert [r[0] for r in rows.select(V.merge_sections(F.col("n"), F.col("v"), F.array(F.lit(7.0)))).collect()] == [[], [7.0, None]]


def test_sheet_values_beyond_ascii(spark):
    lines = ["3 CHEVAL 1’37\"42 68,4\u00a0km 1605,32 \u00a0", "3 CHEVAL 1'37\"42 68,4 km 1605,32\t", "n° 4 ٣٤ 1'07\"02", "TRÈS LOURD (4.1)", "lourd - [3.5] (.)", None]
    got = [tuple(r) for r in spark.createDataFrame([(x,) for x in lines], "l string").select(X.official_time(F.col("l"))[1], X.line_max_speed(F.col("l")), X.line_distance(F.col("l")), X.going(F.col("l"))["terrain"], X.going(F.col("l"))["penetrometre"]).collect()]
    assert got == [(97.42, 68.4, 1605.32, None, None), (97.42, 68.4, 1605.32, None, None), (67.02, None, None, None, None), (None, None, None, "TRÈS LOURD", 4.1), (None, None, None, "lourd", None), (None,) * 5]


def test_digits_of_any_script(spark):
    bold = "".join(chr(0x1D7CE + int(c)) for c in "37")
    lines = ["A ٠٠:٢٥.١٠ 1'٣7\"42 68,٤ km 1605,3٢", f"B 01:{bold}.05 12٣4,56 \u00a0", "C 00:1:02.3", ""]
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    got = [tuple(r) for r in T.line_values(T.head_values(df)).select(F.transform("times", X.seconds), "temps_officiel", "temps_officiel_sec", "vitesse_max_ligne", "distance_parcourue").collect()]
    assert got == [([25.1], "1'37\"42", 97.42, 68.4, 1605.32), ([97.05], None, None, None, 1234.56), ([], None, None, None, None), ([], None, None, None, None)]
    page = spark.createDataFrame([("Position en course\n٣ x 1٢\n",)], "text string").select(X.row_values(F.col("text"), X.POSITION_ROW)).first()[0]
    assert page == [3.0, 12.0]
    words = spark.createDataFrame([(1, 0, "Position", 1.0, 50.0), (1, 1, "٣", 3.0, 60.0), (1, 2, "7", 2.0, 60.0), (1, 3, "²", 1.0, 60.0)], "page int, word_no int, text string, x0 double, top double")
    assert T.geometry_positions(words, ["page"]).first()["positions"] == [7, 3]
    # The columns that search a text each by themselves agree with the steps.
    one = df.select(*(c.alias(n) for n, c in zip("abcd", (*X.official_time(F.col("line")), X.line_max_speed(F.col("line")), X.line_distance(F.col("line"))))))
    assert [tuple(r) for r in one.collect()] == [x[1:] for x in got]


def test_geometry_of_pages(spark):
    import random

    rng = random.Random(5)
    kinds = ["Position", "Vitesse", "7", "21", "٣", "55", "61,5", "41.2", "95", "x", "40", "90"]
    rows = [(p, i, rng.choice(kinds), rng.choice([float(rng.randrange(40)), None]) if i % 9 == 0 else float(rng.randrange(40)), float(rng.randrange(0, 25))) for p in range(60) for i in range(rng.randrange(2, 60))]
    words = spark.createDataFrame(rows, "page int, word_no int, text string, x0 double, top double")
    value = {"7": 7, "٣": 3, "21": 21, "55": 55, "40": 40, "90": 90, "95": 95, "61,5": 61.5, "41.2": 41.2}
    want = {}
    for p in range(60):
        mine = [r for r in rows if r[0] == p]
        y = next((r[4] for r in mine if r[2] == "Position"), 0)
        order = lambda r: (r[3] is not None, r[3] or 0, r[1])
        numbers = [value[r[2]] for r in sorted((r for r in mine if r[2] in ("7", "٣") and y and y - 150 < r[4] < y + 100), key=order)]
        speeds = [r for r in mine if 40 <= value.get(r[2], 0) <= 90]
        row = next((a[4] for a in mine if a[2] == "Vitesse" and sum(abs(s[4] - a[4]) < 3 for s in speeds) >= 4), None)
        fast = [float(value[r[2]]) for r in sorted((s for s in speeds if row is not None and abs(s[4] - row) < 5), key=order)]
        want[p] = (numbers or None, fast or None)
    got = {r["page"]: (r["positions"], r["vitesses"]) for r in T.page_series(words, ["page"]).collect()}
    assert {p: got.get(p, (None, None)) for p in want} == want and any(a and b for a, b in want.values())
    assert {r["page"]: r["positions"] for r in T.geometry_positions(words, ["page"]).collect()} == {p: a for p, (a, _) in want.items() if a}
    assert {r["page"]: r["vitesses"] for r in T.geometry_speeds(words, ["page"]).collect()} == {p: b for p, (_, b) in want.items() if b}


def formatted(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def exchanged(df):
    """Columns of each exchange of a plan, those used again once."""
    df.sparkSession.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return re.findall(r"\(\d+\) Exchange[^\n]*\nInput \[\d+\]: \[(.*)\]", formatted(df))
    finally:
        df.sparkSession.conf.unset("spark.sql.adaptive.enabled")


def test_a_sheet_is_gathered_once(spark, tmp_path):
    keys = ["date_galop", "code_hippo", "num_course"]
    for name, kind in (("pages", PAGES), ("words", WORDS)):
        spark.createDataFrame([], kind).write.parquet(str(tmp_path / name))
    pages, words = (spark.read.parquet(str(tmp_path / x)) for x in ("pages", "words"))
    horses = spark.range(5).selectExpr("'20240101' date_galop", "'CHA' code_hippo", "int(id) num_course", "string(id) nom")
    moved = exchanged(T.extract_tracking(horses, pages, words, keys))
    # Pages are gathered in one exchange, of partial lists of page and text; no other has text.
    assert sum("buf#" in x and "page_no#" not in x for x in moved) == 1, moved
    assert not any(x in c for c in moved for x in ("text#", "line#", "lines#", "timed#", "detail#"))
    # Names are scored beside the pages; numbers and scores are what is shuffled after that.
    assert sum("text#" in x for x in exchanged(T.match_pages(horses, pages, keys))) == 0


def test_scanned_sheets(spark, tmp_path):
    """The first of ten sheets of the day that has the horse; sheet 11 and other days don't count."""
    performances = {"date_pmu": "02012024", "num_reunion": 1, "num_course": 1, "participants": [{"nomCheval": n, "numPmu": i, "coursesCourues": [{"date": 1704103200000, "nomPrix": "zz", "hippodrome": "VICHY", "discipline": "PLAT"}]} for i, n in enumerate(("ABEL", "BRUNO", "CLEO"))]}
    (tmp_path / "q.json").write_text(json.dumps(performances))
    sheets = [("20240101", "VIC", 2, 0, "1 ABEL 00:20.00"), ("20240101", "VIC", 3, 0, "ABEL\n1 BRUNO 00:30.00"), ("20240101", "VIC", 5, 0, "1 ABEL 00:50.00\n2 BRUNO 00:51.00"), ("20240101", "VIC", 11, 0, "1 CLEO 00:55.00"), ("20240102", "VIC", 1, 0, "1 CLEO 00:55.00")]
    pages, words = spark.createDataFrame(sheets, PAGES), spark.createDataFrame([], WORDS)
    programmes = spark.createDataFrame([], D.PROGRAMME)
    got = {r["nom"]: (r["num_course"], r["resolved"], r["resolution_strategy"], r["tracking"] and r["tracking"]["troncons"][0]["temps_sec"], r["code_hippo"]) for r in jobs.history_job(D.read_performances(spark, str(tmp_path / "q.json")), programmes, pages, words).collect()}
    assert got == {"ABEL": (2, True, "scan_brute", 20.0, "VIC"), "BRUNO": (3, True, "scan_brute", 30.0, "VIC"), "CLEO": (None, False, None, None, "VIC")}


def test_busy_days_are_split(spark):
    from furlong.operators import races as R

    n = 100_000
    label = F.concat(F.lit("prix "), (F.col("id") % 977).cast("string"), F.lit(" du lac"))
    races = spark.range(n).select(F.lit(1).alias("day"), F.lit(0).alias("reunion_pos"), F.col("id").alias("course_pos"), F.lit("VIC").alias("code"), F.lit("VICHY").alias("long_name"), F.lit("-").alias("short_name"), label.alias("label"), F.lit("-").alias("short_label"))
    lookups = spark.createDataFrame([(1, f"PRIX {i} DU LAC", h) for i in (0, 5, 976, 2000) for h in ("vichy", "")], "day int, nom_prix string, hint string")
    rows = {k: sorted(tuple(r) for r in R.resolve_races(lookups, races, split=k).select("nom_prix", "hint", "course_pos", "score").collect()) for k in (500, 10**9)}
    assert rows[500] == rows[10**9] and (("PRIX 5 DU LAC", "", 5, 100) in rows[500])
    # Parts of the one meeting, dealt to tasks by their key: none has twice the mean.
    parts = races.withColumn("part", F.pmod(F.xxhash64("course_pos", "label"), F.lit(200)).cast("int")).repartition(8, "day", "reunion_pos", "part").groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in parts) < 2 * n / 8


def test_results_can_be_written_again(spark, tmp_path):
    path = str(tmp_path / "out")
    horse = lambda nb: {"Abel": {"historique": [], "nb_courses_trackers": nb}}
    make = lambda rows: spark.createDataFrame([(d, "02012024", c, 1, n, horse(nb)) for d, c, n, nb in rows], D.RESULTS.rsplit(", ", 1)[0])
    D.write_race_results(make([("20240102", "DEA", 1, 1), ("20240102", "DEA", 2, 2), ("20240102", "", 1, 3), ("20240103", "CHA", 1, 4)]), path)
    D.write_race_results(make([("20240102", "DEA", 2, 7), ("20240102", "", 2, 8)]), path)
    D.write_race_results(make([("20240102", "DEA", 2, 7), ("20240102", "", 2, 8)]), path)
    got = sorted((r["date_galop"], r["code_hippo"], r["num_course"], r["nb_courses_trackers"]) for r in D.read_race_results(spark, path).collect())
    assert got == [("20240102", "", 1, 3), ("20240102", "", 2, 8), ("20240102", "DEA", 1, 1), ("20240102", "DEA", 2, 7), ("20240103", "CHA", 1, 4)]
    asked = spark.createDataFrame([("20240102", "DEA", 2), ("20240103", "CHA", 9), ("20240102", "", 1)], "date_galop string, code_hippo string, num_course int")
    found = D.read_race_results(spark, path, requests=asked)
    assert [(r["num_course"], r["nb_courses_trackers"]) for r in found.collect()] == [(2, 7)]
    # Only the folders of the requests are read.
    assert "dynamicpruning" in formatted(found)


def test_lookup_names(spark, tmp_path):
    programmes, performances, pages, words = documents(spark, tmp_path)
    cache = spark.createDataFrame([("20240102", "DEA", 1, "Abel", 9), ("20240102", "", 2, "Abel", 8)], "date_galop string, code_hippo string, num_course int, nom string, nb_courses_trackers long")
    cache = cache.withColumn("historique", F.array().cast(f"array<struct<{D.HISTORY}>>"))
    asked = spark.createDataFrame([("02012024", "20240102", c, 1, n, x) for c, n, x in (("dea", 1, " Abel\t"), ("DEA", 1, "  "), ("DEA", 1, None), ("", 2, "Abel"), ("DEA", 1, "abel"))], "date_pmu string, date_galop string, code_hippo string, num_reunion int, num_course int, nom string")
    got = {(r["num_course"], r["nom"]): (r["from_cache"], r["nb_courses_trackers"], len(r["historique"])) for r in jobs.horse_lookup_job(asked, cache, performances, programmes, pages, words).collect()}
    assert got == {(1, " Abel\t"): (True, 9, 0), (2, "Abel"): (False, 0, 1), (1, "abel"): (False, 0, 1)}


def test_one_scan_of_documents(spark, tmp_path):
    programmes, *_ = documents(spark, tmp_path)
    assert jobs.programme_job(programmes)._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1


def test_crowded_sheets(spark):
    """Names meet the lines that have a word's first letters, and find the same lines as by looking at all pairs."""
    import random

    rng = random.Random(7)
    part = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 7)))
    names = [(s, " ".join(part() for _ in range(rng.randrange(1, 4)))) for s in (1, 2) for _ in range(300)] + [(1, "Été été ab"), (2, None), (3, "xyz")]
    lines = [(s, i, " ".join([*(rng.choice(names[:600])[1] for _ in range(2)), part().upper(), "01:02.03" if i % 9 else "x"])) for s in (1, 2, 4) for i in range(200)] + [(1, 200, "ÉTÉ 00:00.01"), (1, 201, "00:00.01")]
    horses, table = spark.createDataFrame(names, "s int, nom string"), spark.createDataFrame(lines, "s int, line_no int, line string")
    rows = {c: sorted(map(tuple, T.match_lines(horses, table, ["s"], crowded=c).collect()), key=repr) for c in (10, 10**9)}
    assert rows[10] == rows[10**9] and (1, "Été été ab", 200, "ÉTÉ 00:00.01", 2) in rows[10]
    timed = table.withColumn("__upper", F.upper("line"))
    pairs = T.posted_lines(T.asked_words(horses, ["s"], "nom"), timed, ["s"], "nom").select("s", "nom", "line_no").distinct().count()
    assert pairs < 0.05 * horses.distinct().join(table, "s").count()


def test_plans_have_no_python_and_no_cartesian_product(spark):
    from furlong.plans import queries as Q

    for name in ("resolve_races", "match_lines", "match_pages", "programme_flatten", "series_indicators"):
        plan = Q.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Arrow", "Cartesian", "BroadcastNestedLoop")), name


def test_all_lines_are_matched(spark, tmp_path):
    from furlong.plans import queries as Q

    texts = {1: "a short line\nGRAND PRIX DU LAC\nprix du lac", 100_001: "\n".join(["nothing"] * 120_000 + ["the lac is far", "no more", "lac far"]), 8: "none\n", 9: None}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: (r["line_no"], r["score"]) for r in Q.QUERIES["match_all_lines"](spark, str(tmp_path)).collect()}
    assert got == {1: (1, 2), 100_001: (120_000, 2)}


def registered(spark, folder, name, **tables):
    """Rows of a query and of its SQL over given tables, sorted."""
    import duckdb

    from furlong.plans.queries import ORACLES, QUERIES

    con = duckdb.connect()
    for table, rows in tables.items():
        rows.coalesce(1).write.mode("overwrite").parquet(f"{folder}/{table}.parquet")
        con.execute(f"create view {table} as select * from read_parquet('{folder}/{table}.parquet/*.parquet')")
    return [sorted(map(tuple, rows), key=str) for rows in (QUERIES[name](spark, str(folder)).collect(), con.execute(ORACLES[name]).fetchall())]


def test_busy_days_come_in_several_documents(spark, tmp_path, monkeypatch):
    from furlong.plans import queries

    orders = "id o_orderkey, id % 7 o_custkey, element_at(array('O', 'F', 'P'), cast(id % 3 + 1 as int)) o_orderstatus, element_at(array('5-LOW', '1-URGENT', '2-HIGH', 'x'), cast(id % 4 + 1 as int)) o_orderpriority, timestamp_ntz '2024-01-01' + make_dt_interval(cast(id % 4 as int)) o_orderdate"
    orders = spark.sql(f"select {orders} from range(900)")
    documents = []
    monkeypatch.setattr(queries.J, "programme_job", lambda docs, job=queries.J.programme_job: documents.append(docs) or job(docs))
    got, want = registered(spark, tmp_path, "programme_flatten", orders=orders)
    assert got == want and len(got) == 600
    assert documents[0].selectExpr("max(size(get(programme.reunions, 0).courses))").first()[0] == queries.DOCUMENT


def test_series_of_ties_and_near_ties(spark, tmp_path):
    # Sums of 11 lines give means beside a tie; 23 lines make a middle of 20, and lines of one number and price tie.
    rows = [(k, i // 3, 1.0 * (i % 3 // 2), float((k * 7 + i * i * (k % 5 + 1) + i * k) % 50 + 1), (k + i) % 9 / 100, "ARN"[(k + i) % 3], "FO"[(k * i) % 2]) for k in range(1500) for i in (range(23) if k % 2 else range(22, -1, -1))]
    lines = spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_extendedprice double, l_quantity double, l_tax double, l_returnflag string, l_linestatus string")
    assert lines.groupBy("l_orderkey", "l_linenumber", "l_extendedprice").count().where("count > 1").count()
    for name in ("series_indicators", "section_durations", "clean_times", "merge_sections", "sheet_header"):
        got, want = registered(spark, tmp_path, name, lineitem=lines)
        assert len(got) == len(want) and [pair for pair in zip(got, want, strict=True) if pair[0] != pair[1]][:3] == [], name


def test_a_searched_text_is_computed_once(spark):
    rows = spark.createDataFrame([("3 x 1'37\"42  68,4 km  1605,32 ",), ("3 é 1'37\"42  68,4 km  1605,32 ",)], "line string")
    got = T.line_values(rows)
    # The end of a line is stripped once, by one of two patterns, not wherever its search looks at it (20 places).
    assert got._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") <= 2
    assert [r["distance_parcourue"] for r in got.collect()] == [1605.32, 1605.32]


def test_a_sheets_text_is_searched_whole(spark):
    """The header found in a sheet's text is that of a search line by line, and no line is searched by itself."""
    filler = "\n".join(["x"] * 29)
    texts = [
        "000m 1200m\nPRIX 1600\nm 800 m Bon [x\n(3.4) Souple (2.5)\nDEP -\n400m\n400m-ARR\nDEP - 400m  400m – 800m", "Bon (1.0)\r\ntrès lourd (4.2)\r\nLéger 3\n 1 200m-400m 400m -\n800m",
        "١٢٣٤m LÉGER (٣.٤)\ndep – ٤m ٤m – arr\n00٠m", filler + "\n1000m Bon (3.0)", filler + "\nx\n1000m Bon (3.0) 400m-800m 800m-ARR", "", "0000m\n00000m\n\n",
    ]
    pages = spark.createDataFrame([(k, no, part) for k, text in enumerate(texts) for no, part in enumerate((text, "1 A 00:20.10\n1:20.10\n2 É ٠٠:٢٠.١٠ x\r\n"))], "k int, page_no int, text string")
    sheets = T.sheet_rows(pages, ["k"])
    got = {r["k"]: r for r in sheets.collect()}
    want = {r["k"]: r for r in T.sheet_header(T.sheet_lines(pages, ["k"]), ["k"]).collect()}
    for k in range(len(texts)):
        assert (got[k]["distance_m"], got[k]["terrain"], got[k]["penetrometre"], got[k]["labels"]) == (want[k]["distance_m"], want[k]["terrain"], want[k]["penetrometre"], want[k]["labels"] or []), k
        assert got[k]["timed"] == ["1 A 00:20.10", "2 É ٠٠:٢٠.١٠ x\r"] and got[k]["upper"].split("\n") == ["1 A 00:20.10", "2 É ٠٠:٢٠.١٠ X\r"]
    assert [got[k]["distance_m"] for k in range(7)] == [800, 200, 1234, 1000, None, None, None]
    assert "RLIKE" not in sheets._jdf.queryExecution().optimizedPlan().toString()


def test_times_are_folded_where_one_is_dropped(spark):
    cases = [([2010, 4930, 7320, 3500], 97.42), ([2010, 4930, 9742], 97.42), ([2010, 4930, 9738], 97.42), ([4930, 2010], None), ([2010, 4930], None), ([2010, 2010], 0.0), ([9752, 9760], 97.42), ([5], 97.42), ([9000, 9732], 97.42)]
    rows = spark.createDataFrame([(i, [(n, c) for n, c in enumerate(cs)], o) for i, (cs, o) in enumerate(cases)], f"i int, t array<{X.NUMBERED}>, o double")
    folds = rows.select(V.kept_times(F.col("t"), F.col("o"), X.NUMBERED).alias("a"), V.clean_times(F.col("t"), F.col("o"), X.NUMBERED, lambda t: t["cs"] / F.lit(100.0)).alias("b")).collect()
    assert all(r["a"] == r["b"] for r in folds)
    texts = spark.createDataFrame([(c,) for c in (0, 5, 5999, 6000, 599_999, 600_000, 603_999, -150)], "c int")
    texts = texts.select(V.clock_text(V.clock_digits(F.col("c")), F.col("c")).alias("a"), V.duration_text(F.col("c") / F.lit(100.0)).alias("b")).collect()
    assert all(r["a"] == r["b"] for r in texts) and texts[2]["a"] == "00:59.99"
