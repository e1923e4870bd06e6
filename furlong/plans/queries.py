"""Registered queries over the race operators, with the SQL that each must equal.

Races are not among the test tables, so columns of other tables stand in for
them; every query reads its tables whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from furlong.functions import scalars as S
from furlong.functions import series as V
from furlong.functions import sheets as X
from furlong.operators import races as R
from furlong.operators import sheets as T
from furlong.operators import tables as B
from furlong.plans import jobs as J
from furlong.sources import documents as D

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    """Register a query under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


ORDER = ["l_linenumber", "l_extendedprice", "l_quantity"]
"""Order of an order's lines in a series; rows that are equal in it have equal values."""
ORDERED = f"order by {', '.join(ORDER)}"


def half_even(x: str, digits: int = 1) -> str:
    """SQL that rounds a double half to even as ``bround`` does, by its shortest decimal; round_even multiplies doubles, by which a number beside a tie can become one, and a tie none."""
    d = f"cast(cast({x} as varchar) as decimal(36, 22))"
    return f"cast(case when abs({d} * {10**digits}) % 1 = 0.5 then round({d} * 0.5, {digits}) * 2 else round({d}, {digits}) end as double)"


SERIES_SQL = f"select l_orderkey, list(cast(l_quantity as int) % 20 + 1 {ORDERED}) p, list(40.0::double + l_quantity::double {ORDERED}) v from lineitem group by 1"


def order_series(spark: SparkSession, sf_dir: str, **values) -> DataFrame:
    return B.collect_series(table(spark, sf_dir, "lineitem"), ["l_orderkey"], ORDER, values)


@query(
    f"""with s as ({SERIES_SQL}), k as (select *, len(p) n, len(list_filter(p, lambda x: x <= 3)) t from s),
    m as (select *, list_sum(v) / n mean, list_sum(v[-3:]) / 3 fin, list_sum(v[2:n-2]) / (n - 3) mid, list_sum(v[-2:]) / 2 fin2 from k)
    select l_orderkey, case when n >= 2 then p[1] - p[n] end remontee_places, cast(case when n >= 2 then least(10, greatest(0, round_even((p[1] - p[n]) * 1.5::double, 0))) end as int) score_remontee,
    cast({half_even('(t::double / n * 100)', 0)} as int) pct_top3, cast({half_even('(t::double / n * 100)', 0)} as int) >= 60 profil_leader, case when n >= 4 then {half_even('(fin / mean - 1) * 100')} end score_finish,
    case when n >= 3 then {half_even('(list_max(v[2:]) - list_min(v[2:]))')} end regularite, case when n >= 4 then {half_even('(mid - fin2)')} end chute_finale from m"""
)
def series_indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = order_series(spark, sf_dir, p=(F.col("l_quantity").cast("int") % 20 + 1), v=(F.col("l_quantity") + 40))
    return got.select("l_orderkey", *V.indicators(F.col("p"), F.col("v")))


@query(
    f"""with c as (select *, sum(l_quantity) over (partition by l_orderkey {ORDERED} rows unbounded preceding) cum, row_number() over (partition by l_orderkey {ORDERED}) i from lineitem)
    select l_orderkey, cast(i as int) section, round_even(cum - coalesce(lag(cum) over (partition by l_orderkey order by i), 0), 2)::double duration from c"""
)
def section_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)
    cum = table(spark, sf_dir, "lineitem").withColumn("cum", F.sum("l_quantity").over(w))
    got = B.collect_series(cum, ["l_orderkey"], ORDER, {"cum": F.col("cum").cast("double")})
    return got.select("l_orderkey", F.posexplode(V.section_durations(F.col("cum"))).alias("i", "duration")).select("l_orderkey", (F.col("i") + 1).alias("section"), "duration")


@query(
    f"""with s as (select l_orderkey, list(l_quantity::double {ORDERED}) t, max(l_quantity)::double o from lineitem group by 1),
    f as (select l_orderkey, list_reduce(list_transform(t, lambda x: {{'kept': [x], 't600': null::double}}), lambda a, b:
      case when abs(b.kept[1] - o) < 0.1 then a
           when len(a.kept) > 0 and b.kept[1] < a.kept[-1] * 0.7 then {{'kept': a.kept, 't600': b.kept[1]}}
           else {{'kept': list_concat(a.kept, b.kept), 't600': a.t600}} end, {{'kept': []::double[], 't600': null::double}}) r from s)
    select l_orderkey, cast(len(r.kept) as int) n_kept, coalesce(list_sum(r.kept), 0)::double kept_sum, r.t600 t600 from f"""
)
def clean_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = order_series(spark, sf_dir, t=F.col("l_quantity").cast("double")).withColumn("r", V.clean_times(F.col("t"), F.array_max("t")))
    return got.select("l_orderkey", F.size("r.kept").alias("n_kept"), V.total(F.col("r.kept")).alias("kept_sum"), F.col("r.t600").alias("t600"))


DOCUMENT = 200
"""Races of a day in one document: a day with more, as large tables have, comes in parts."""


@query(
    """with d as (select *, row_number() over (partition by cast(o_orderdate as date) order by o_orderkey) - 1 pos from orders)
    select o_orderkey, case when o_orderpriority in ('5-LOW', '1-URGENT', '2-HIGH') then 'PSF' else 'GAZON' end surface,
    coalesce(case when o_orderstatus = 'O' then 'souple' end, case when o_custkey % 2 = 0 then 'bon' end, case when o_custkey % 3 = 0 then 'lourd' end, '') terrain,
    cast(pos as int) course_pos, strftime(o_orderdate, '%d%m%Y') date_pmu, case when day(o_orderdate) % 2 = 0 then 'VIC' else 'XYZ' end code_hippo, cast(case when day(o_orderdate) % 2 = 0 then 3 else 8 end as int) num_reunion,
    cast(o_custkey as int) as num_externe, o_orderstatus = 'F' course_trackee from d where o_orderstatus <> 'P'"""
)
def programme_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two documents a day, or for each part of a busy one, of which the first is empty on some days, through the programme job."""
    o = table(spark, sf_dir, "orders")
    flat, priority = F.col("o_orderstatus") != "P", F.col("o_orderpriority")
    course = F.struct(
        F.col("o_orderkey").cast("int").alias("numOrdre"), F.when(F.col("o_orderstatus") == "F", "Plat").otherwise("OBSTACLE").alias("specialite"), F.when(flat, "plat").otherwise("TROT_ATTELE").alias("discipline"),
        F.when(priority == "5-LOW", "piste en sable").when(priority == "1-URGENT", "piste Fibre").otherwise(priority).alias("parcours"), F.when(priority == "2-HIGH", "psf").alias("typePiste"), F.col("o_custkey").cast("int").alias("numExterne"),
        F.when(F.col("o_orderstatus") == "O", "souple").alias("etatTerrain"), F.when(F.col("o_custkey") % 2 == 0, "bon").alias("terrain"), F.struct(F.when(F.col("o_custkey") % 3 == 0, "lourd").alias("intitule")).alias("penetrometre"),
        F.when(F.col("o_orderstatus") == "F", True).alias("courseTrackee"),
    )
    even = F.dayofmonth("o_orderdate") % 2 == 0
    # A row that held all of a day's races would grow with the table.
    o = o.withColumn("date", F.date_format("o_orderdate", "ddMMyyyy"))
    o = o.withColumn("part", F.floor((F.row_number().over(Window.partitionBy("date").orderBy("o_orderkey")) - 1) / DOCUMENT))
    days = o.groupBy("date", "part", even.alias("even"), (F.dayofmonth("o_orderdate") % 3 == 0).alias("late")).agg(F.sort_array(F.collect_list(course)).alias("courses"))
    days = days.withColumn("date_pmu", F.concat(F.coalesce("date", F.lit("")), F.lit("/"), "part")).drop("date", "part")
    venue = F.when(F.col("even"), F.struct(F.lit(None).cast("string").alias("codeHippodrome"), F.lit("Vichy").alias("libelleLong"))).otherwise(F.struct(F.lit("XYZ").alias("codeHippodrome"), F.lit("Vichy").alias("libelleLong")))
    meeting = F.struct(venue.alias("hippodrome"), F.when(F.col("even"), 3).alias("numOfficiel"), F.lit(8).alias("numExterneReunion"), "courses")
    # The offline document of a day counts if it has meetings; the online one has nothing of interest then.
    source = F.explode(F.array(F.struct(F.lit("online").alias("source"), F.when(F.col("late"), F.array(meeting)).otherwise(F.array(meeting.dropFields("courses").withField("courses", F.slice("courses", 1, 1)))).alias("reunions")), F.struct(F.lit("offline").alias("source"), F.when(F.col("late"), F.array().cast(days.select(F.array(meeting).alias("m")).schema["m"].dataType)).otherwise(F.array(meeting)).alias("reunions"))))
    docs = days.select("date_pmu", source.alias("d")).select("date_pmu", "d.source", F.to_json(F.struct("d.reunions")).alias("json"))
    programme = StructType.fromDDL(D.PROGRAMME)["programme"].dataType
    races = J.programme_job(docs.select("date_pmu", "source", F.from_json("json", programme).alias("programme")))
    key = F.split("date_pmu", "/")
    place = (F.element_at(key, 2).cast("int") * DOCUMENT + F.col("course_pos")).alias("course_pos")
    return races.select(F.col("num_course").cast("long").alias("o_orderkey"), "surface", "terrain", place, F.nullif(F.element_at(key, 1), F.lit("")).alias("date_pmu"), "code_hippo", "num_reunion", "num_externe", "course_trackee")


@query(
    """select l_orderkey, l_partkey, cast(l_quantity as int) num, cast(row_number() over (partition by l_orderkey order by cast(l_quantity as int), l_linenumber, l_extendedprice) as int) place,
    case when l_returnflag = 'A' then l_returnflag else l_linestatus end jockey, coalesce(case when l_linenumber > 2 then l_linenumber end, cast(l_suppkey as int)) nb_courses from lineitem"""
)
def runner_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = {"numPmu": F.col("l_quantity").cast("int"), "nom": F.col("l_partkey").cast("string"), "driver": F.when(F.col("l_returnflag") == "A", F.col("l_returnflag")), "jockey": F.col("l_linestatus"), "nombreCourses": F.when(F.col("l_linenumber") > 2, F.col("l_linenumber")), "nbCourses": F.col("l_suppkey").cast("int")}
    item = F.struct(*(given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(D.RUNNER)))
    got = B.collect_series(table(spark, sf_dir, "lineitem"), ["l_orderkey"], ["l_linenumber", "l_extendedprice"], {"p": item})
    races = got.select("l_orderkey", R.runners_of(F.col("p")).alias("partants"))
    # Runners are told apart by the place that each has in the array.
    placed = races.select("l_orderkey", F.transform("partants", lambda p, i: p.withField("place", i + 1)).alias("partants"))
    return R.flatten_runners(placed, ["l_orderkey"]).select("l_orderkey", F.col("nom").cast("long").alias("l_partkey"), "num", "place", "jockey", "nb_courses")


ALIASES = (("CHINA", "CHN"), ("UNITED", "UNI"), ("INDIA", "IND"), ("IRAN", "IRN"), ("A", "AAA"), ("NATION_1", "N01"), ("NATION_2", "N02"))
ALIAS_SQL = ", ".join(f"({i}, '{k}', '{c}')" for i, (k, c) in enumerate(ALIASES))


@query(
    f"""with a(i, k, c) as (values {ALIAS_SQL}), n as (select distinct upper(trim(p_name)) n from part union select distinct upper(trim(n_name)) from nation),
    b as (select n, arg_min(c, case when k = n then i else 1000 + i end) code from n join a on contains(n, k) or contains(k, n) group by n) select n.n as name, coalesce(code, '') code from n left join b using (n)"""
)
def venue_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "part").select(F.upper(F.trim("p_name")).alias("name")).union(table(spark, sf_dir, "nation").select(F.upper(F.trim("n_name")))).distinct()
    return B.with_venue_code(names, "name", "code", ALIASES).select("name", "code")


@query(
    """select event_id, strftime(d, '%d%m%Y') date_pmu, strftime(d, '%Y%m%d') date_galop, strftime(d, '%d/%m/%Y') date_display from
    (select event_id, ts + to_seconds(case when user_id % 3 = 0 then 3600 else (user_id % 3) * 7200 end) d from events)"""
)
def local_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    ms = F.timestamp_diff("MILLISECOND", F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00")), F.col("ts"))
    offset = F.when(F.col("user_id") % 3 != 0, (F.col("user_id") % 3) * 7_200_000)
    day = S.local_date(ms, offset)
    return e.select("event_id", S.date_pmu(day).alias("date_pmu"), S.date_galop(day).alias("date_galop"), S.date_display(day).alias("date_display"))


@query(
    """select p_partkey, coalesce(nullif(p_size % 3, 0), nullif(p_size % 2, 0), p_size)::int first_number, coalesce(nullif(case when p_size % 2 = 0 then '' else p_brand end, ''), p_type) first_text,
    case when p_size % 5 <> 0 then printf('%.1f', (p_size % 5 * 100 + p_size) / 10.0) else '' end weight from part"""
)
def truthy_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    return table(spark, sf_dir, "part").select(
        "p_partkey", S.first_truthy(size % 3, size % 2, size, empty=0).alias("first_number"), S.first_truthy(F.when(size % 2 == 0, "").otherwise(F.col("p_brand")), F.col("p_type")).alias("first_text"),
        S.weight_text(F.when(size % 5 != 0, size % 5 * 100 + size).otherwise(0)).alias("weight"),
    )


@query("select doc_id, cast(len(list_filter(string_split_regex(upper(replace(text, 'ß', 'ss')), '[ \\t\\n\\r\\f\\v]+'), lambda x: length(x) > 3)) as int) n_words from documents")
def name_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.size(S.tokens(F.col("text"), 3)).alias("n_words"))


@query("select user_id, event_type, event_id, value from events qualify row_number() over (partition by user_id, event_type order by ts desc) = 1")
def dedupe_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.dedupe_last(table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value", "ts"), ["user_id", "event_type"], ["ts"]).drop("ts")


@query(
    """select l_orderkey, l_linenumber, l_extendedprice, coalesce(nullif(case when p_size % 2 = 0 then '' else p_brand end, ''), l_returnflag) jockey, coalesce(nullif(p_size % 4, 0), cast(l_quantity as int)) nb_courses, o_orderpriority libelle
    from lineitem left join part on l_partkey = p_partkey left join orders on l_orderkey = o_orderkey"""
)
def runner_card(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", F.col("l_partkey").alias("num"), F.col("l_returnflag").alias("jockey"), F.col("l_quantity").cast("int").alias("nb_courses"))
    info = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("num"), F.when(F.col("p_size") % 2 == 0, "").otherwise(F.col("p_brand")).alias("jockey"), (F.col("p_size") % 4).alias("nb_courses"))
    header = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderpriority").alias("libelle"), "o_orderdate")
    cards = R.runner_card(rows, info, ["num"], ("jockey", "nb_courses"))
    return R.with_race_header(cards, header, ["l_orderkey"], ["o_orderdate"]).select("l_orderkey", "l_linenumber", "l_extendedprice", "jockey", "nb_courses", "libelle")


@query(
    """with r as (select p_size as day, p_partkey as cp, p_type as long_name, p_name as label, p_brand as short_label from part),
    l as (select distinct p_size as day, case when p_partkey % 2 = 0 then p_name else split_part(p_name, ' ', 1) || ' cup' end nom_prix, p_type as hint from part),
    s as (select l.*, cp, label, case when upper(trim(nom_prix)) = upper(trim(label)) or upper(trim(nom_prix)) = upper(trim(short_label)) then 100
      when contains(upper(trim(label)), upper(trim(nom_prix))) or contains(upper(trim(nom_prix)), upper(trim(label))) then 80
      when contains(upper(trim(short_label)), upper(trim(nom_prix))) or contains(upper(trim(nom_prix)), upper(trim(short_label))) then 70
      else (select case when k > 0 then 40 + 10 * k else 0 end from (select len(list_filter(list_filter(string_split(upper(trim(nom_prix)), ' '), lambda a: length(a) > 3), lambda a: len(list_filter(list_filter(string_split(upper(trim(label)), ' '), lambda b: length(b) > 3), lambda b: contains(a, b) or contains(b, a))) > 0)) k)) end score
      from l join r on l.day = r.day and contains(upper(long_name), upper(hint)))
    select day, nom_prix, hint, cp as course_pos, label, cast(score as int) score from s where score >= 40 qualify row_number() over (partition by day, nom_prix, hint order by score desc, cp) = 1"""
)
def resolve_races(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    # A venue is a p_type of a day: all its races share a number, and the course's number orders them.
    races = part.select(
        F.col("p_size").alias("day"), F.lit(0).alias("reunion_pos"), F.col("p_partkey").alias("course_pos"), F.lit("").alias("code"), F.col("p_type").alias("long_name"), F.lit("-").alias("short_name"),
        F.col("p_name").alias("label"), F.col("p_brand").alias("short_label"),
    ).withColumn("reunion_pos", F.abs(F.xxhash64("long_name")))
    prize = F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).otherwise(F.concat(F.split_part("p_name", F.lit(" "), F.lit(1)), F.lit(" cup")))
    lookups = part.select(F.col("p_size").alias("day"), prize.alias("nom_prix"), F.col("p_type").alias("hint"))
    return R.resolve_races(lookups, races).select("day", "nom_prix", "hint", "course_pos", "label", "score")


@query(
    """select o_orderkey, n_sheets, l_linenumber as first_sheet from orders left join (select l_orderkey, count(*) n_sheets from lineitem group by 1) a on a.l_orderkey = o_orderkey
    left join (select l_orderkey, min(l_linenumber) l_linenumber from lineitem where l_linenumber between 2 and 10 group by 1) b on b.l_orderkey = o_orderkey"""
)
def scan_tracking(spark: SparkSession, sf_dir: str) -> DataFrame:
    sheets = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber")
    asked = table(spark, sf_dir, "orders").select("o_orderkey").join(sheets.groupBy("o_orderkey").agg(F.count("*").alias("n_sheets")), "o_orderkey", "left")
    return B.scan_tracking(asked, sheets, ["o_orderkey"], "l_linenumber", 2, 10).select("o_orderkey", "n_sheets", F.col("l_linenumber").alias("first_sheet"))


WORDS_SQL = "list_filter(string_split_regex(replace(upper(trim({})), 'ẞ', 'SS'), '[ \\t\\n\\r\\f\\v]+'), lambda x: length(x) > 2)"


@query(
    f"""with d as (select doc_id, string_split(text, chr(10)) ls from documents where text is not null),
    h as (select doc_id, {WORDS_SQL.format("ls[1]")} w from d), l as (select doc_id, unnest(range(0, len(ls))) i, unnest(ls) line from d),
    s as (select doc_id, i, len(list_filter(w, lambda x: contains(replace(upper(line), 'ẞ', 'SS'), x))) score from h join l using (doc_id) where length(line) % 2 = 0)
    select doc_id, cast(i as int) line_no, cast(score as int) score from s where score > 0 qualify row_number() over (partition by doc_id order by score desc, i) = 1"""
)
def match_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document is a sheet of one page a line, and its first line the name looked for; lines of odd length have no time."""
    split = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.split("text", "\n", -1).alias("ls"))
    pages = split.select("doc_id", F.posexplode("ls").alias("page_no", "line")).select("doc_id", "page_no", F.when(F.length("line") % 2 == 0, F.concat("line", F.lit(" 01:02.03"))).otherwise(F.translate("line", ":", ";")).alias("text"))
    lines = T.sheet_lines(pages, ["doc_id"])
    return T.match_lines(split.select("doc_id", F.element_at("ls", 1).alias("nom")), lines, ["doc_id"]).select("doc_id", "line_no", "score")


@query(
    f"""with d as (select doc_id, string_split(text, chr(10)) ls from documents where text is not null),
    h as (select doc_id, {WORDS_SQL.format("ls[1]")} w from d), l as (select doc_id, unnest(range(0, len(ls))) i, unnest(ls) line from d),
    s as (select doc_id, i, len(list_filter(w, lambda x: contains(replace(upper(line), 'ẞ', 'SS') || ' VITESSE MOYENNE POSITION', x))) score from h join l using (doc_id) where i > 0 and length(line) % 3 <> 0)
    select doc_id, cast(i as int) page_no, cast(score as int) score from s where score > 0 qualify row_number() over (partition by doc_id order by score desc, i) = 1"""
)
def match_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document is a sheet of one page a line; pages of a length divisible by 3 are no detail pages."""
    split = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.split("text", "\n", -1).alias("ls"))
    rest = F.when(F.length("line") % 3 == 0, " Vitesse moyenne").otherwise(" Vitesse moyenne Position")
    pages = split.select("doc_id", F.posexplode("ls").alias("page_no", "line")).select("doc_id", "page_no", F.concat("line", rest).alias("text"))
    return T.match_pages(split.select("doc_id", F.element_at("ls", 1).alias("nom")), pages, ["doc_id"]).select("doc_id", "page_no", "score")


@query(
    """with d as (select doc_id, string_split(text, chr(10)) ls from documents where text is not null),
    h as (select doc_id, list_filter(string_split_regex(replace(upper(trim(ls[-1])), 'ẞ', 'SS'), '[ \\t\\n\\r\\f\\v]+'), lambda x: length(x) > 2) w from d),
    l as (select doc_id, unnest(range(0, len(ls))) i, unnest(ls) line from d),
    s as (select doc_id, i, len(list_filter(w, lambda x: contains(replace(upper(line), 'ẞ', 'SS') || ' 01:02.03', x))) score from h join l using (doc_id))
    select doc_id, cast(i as int) line_no, cast(score as int) score from s where score > 0 qualify row_number() over (partition by doc_id order by score desc, i) = 1"""
)
def match_all_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of every document, each with a time; a document is a sheet, and its last line the name looked for."""
    split = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.split("text", "\n", -1).alias("ls"))
    lines = split.select("doc_id", F.posexplode("ls").alias("line_no", "line")).withColumn("line", F.concat("line", F.lit(" 01:02.03")))
    names = split.select("doc_id", F.element_at("ls", -1).alias("nom"))
    return T.match_lines(names, lines, ["doc_id"]).select("doc_id", "line_no", "score")


LINE = "format_string('PRIX %d - %dm  Souple (%d.%d) 400m - 800m %dm - ARR %d''%02d\"%02d %02d,%d km %02d:%02d.%02d %d,%02d', l_orderkey, 1000 + l_linenumber * 100, l_linenumber, l_linenumber, 800 + l_linenumber, l_linenumber, cast(l_quantity as int), cast(l_quantity as int), 40 + cast(l_quantity as int) % 50, l_linenumber % 10, l_linenumber % 60, cast(l_quantity as int), cast(l_quantity as int), 1000 + l_linenumber, cast(l_quantity as int))"
Q = "cast(l_quantity as int)"


@query(
    f"""select l_orderkey, l_linenumber, l_extendedprice, 1000 + l_linenumber * 100 as distance_m, 'Souple' terrain, (l_linenumber::varchar || '.' || l_linenumber::varchar)::double penetrometre,
    '400m-800m,' || (800 + l_linenumber)::varchar || 'm-ARR' labels, printf('%d''%02d"%02d', l_linenumber, {Q}, {Q}) official, (l_linenumber * 60 + {Q} + {Q} / 100.0)::decimal(18,2)::double official_sec,
    printf('%d.%d', 40 + {Q} % 50, l_linenumber % 10)::double max_speed, printf('%d.%02d', 1000 + l_linenumber, {Q})::double covered, ((l_linenumber % 60) * 60 + {Q} + {Q} / 100.0)::decimal(18,2)::double first_time from lineitem"""
)
def sheet_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A small file is one split, but each of its lines is much work: rows are spread before lines are made of them.
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity").repartition(spark.sparkContext.defaultParallelism)
    rows = rows.select("l_orderkey", "l_linenumber", "l_extendedprice", F.expr(LINE).alias("line"))
    return T.head_values(T.line_values(rows)).select(
        "l_orderkey", "l_linenumber", "l_extendedprice", "distance_m", "terrain", "penetrometre", F.array_join("labels", ",").alias("labels"), F.col("temps_officiel").alias("official"),
        F.col("temps_officiel_sec").alias("official_sec"), F.col("vitesse_max_ligne").alias("max_speed"), F.col("distance_parcourue").alias("covered"), X.seconds(F.get("times", F.lit(0))).alias("first_time"),
    )


HEAD = f"concat(case when l_linestatus = 'F' then '000m ' else format_string('%dm ', 1000 + l_linenumber * 100) end, case l_returnflag when 'A' then format_string('Bon (%d.%d)', l_linenumber, l_linenumber) when 'N' then format_string('très lourd [x] (%d.5)', l_linenumber) else 'Léger 3' end, case when l_linenumber % 2 = 0 then format_string(' DEP - %dm, %dm – ARR', {Q}, {Q}) else ' 400m-ARR' end)"


@query(
    f"""with l as (select *, row_number() over (partition by l_orderkey {ORDERED}, l_linestatus, l_returnflag) - 1 i, {Q} q from lineitem), t as (select * from l where i < 30)
    select l_orderkey, arg_min(1000 + l_linenumber * 100, case when l_linestatus <> 'F' then i end) filter (where l_linestatus <> 'F') distance_m,
    arg_max(case l_returnflag when 'A' then 'Bon' else 'très lourd' end, i) filter (where l_returnflag <> 'R') terrain,
    arg_max(case l_returnflag when 'A' then (l_linenumber::varchar || '.' || l_linenumber::varchar)::double else l_linenumber + 0.5::double end, i) filter (where l_returnflag <> 'R') penetrometre,
    arg_min('DEP-' || q::varchar || 'm,' || q::varchar || 'm-ARR', i) filter (where l_linenumber % 2 = 0) labels from t group by 1"""
)
def sheet_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sheet is an order, a line a lineitem, some of them without distance, going or labels."""
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*ORDER, "l_linestatus", "l_returnflag")) - 1
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", place.alias("line_no"), F.expr(HEAD).alias("line"))
    return T.sheet_header(lines, ["l_orderkey"]).select("l_orderkey", "distance_m", "terrain", "penetrometre", F.array_join("labels", ",").alias("labels"))


PAGE = f"concat(format_string('X\nredk : %d’%02d”%02d\nVitesse maximale %d,%d\n', l_linenumber, {Q}, {Q}, {Q} + 40, l_linenumber % 10), case when l_returnflag = 'A' then '' else format_string('Vitesse moyenne %d,5 \n', {Q}) end, format_string('Tronçon le plus rapide 00:%02d.10 (tronçon %dm-ARR )\nVitesse moyenne (km/h)\n', {Q}, l_linenumber * 100), format_string('%d,5 %d %d.2\nPosition en course\n%d 7 x 12\n', {Q}, {Q} + 1, {Q} + 2, l_linenumber))"


@query(
    f"""select l_orderkey, l_linenumber, l_extendedprice, printf('%d''%02d"%02d', l_linenumber, {Q}, {Q}) redk, (l_linenumber * 60 + {Q} + {Q} / 100.0)::decimal(18,2)::double redk_sec, printf('%d.%d', {Q} + 40, l_linenumber % 10)::double vitesse_max_kmh,
    case when l_returnflag <> 'A' then {Q} + 0.5::double end vitesse_moyenne_kmh, printf('00:%02d.10', {Q}) troncon_plus_rapide, printf('%dm-ARR', l_linenumber * 100) troncon_plus_rapide_label from lineitem"""
)
def detail_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", F.expr(PAGE).alias("page"))
    return T.detail_values(pages, "page").drop("page")


@query(
    f"""select l_orderkey, l_linenumber, l_extendedprice, printf('%d.5 %d.0 %d.2', {Q}, {Q} + 1, {Q} + 2) speeds, printf('%d 7 12', l_linenumber) positions, cast(0 as int) n_strides from lineitem"""
)
def row_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", F.expr(PAGE).alias("page"))
    text = lambda values, kind: F.array_join(F.transform(values, lambda x: x.cast(kind).cast("string")), " ")
    return pages.select(
        "l_orderkey", "l_linenumber", "l_extendedprice", text(X.row_values(F.col("page"), X.SPEED_ROW), "double").alias("speeds"), text(X.row_values(F.col("page"), X.POSITION_ROW), "int").alias("positions"),
        F.size(X.row_values(F.col("page"), X.STRIDE_ROW)).alias("n_strides"),
    )


SHEETS = f"""select l_orderkey, row_number() over (partition by l_orderkey {ORDERED}) i, cast(l_quantity as int) q, cast(l_linenumber as int) n from lineitem"""
RUN = {"t1": "2000 + q * 10", "t2": "4100 + q * 11 + n", "t3": "6500 + q * 12 + n", "official": "9000 + q"}
"""Hundredths of a second of a runner's cumulative times, and its official time."""


@query(
    f"""with r as (select *, {", ".join(f"{x} {k}" for k, x in RUN.items())} from ({SHEETS})),
    d as (select *, (t2 - t1) d2, (t3 - t2) d3, i % 2 = 0 detail, [1 + q % 9, 1 + n % 5, 1 + (q + n) % 4] p, [1 + q % 7, 1 + n % 3] g from r),
    e as (select *, case when not detail then null when i % 4 = 0 then g else p end pos from d)
    select l_orderkey, printf('Coursier%02dx', i) nom, cast(1000 + 100 * (l_orderkey % 20) as int) distance_m, 3 + (l_orderkey % 10) / 10.0::double penetrometre, (official / 100.0)::double temps_officiel_sec, 1600 + q / 100.0::double distance_parcourue,
    case when detail then 60 + q / 100.0::double else 60 + n / 10.0::double end vitesse_max_kmh, 'DEP-400m,400m-800m,800m-ARR' labels, printf('%02d:%05.2f,%02d:%05.2f,%02d:%05.2f', 0, t1 / 100.0::double, 0, d2 / 100.0::double, 0, d3 / 100.0::double) durations,
    printf('%02d:%02d.%02d', t3 // 6000, t3 % 6000 // 100, t3 % 100) last_time, case when detail then array_to_string(list_transform(range(1, 4), lambda k: coalesce(case when i % 4 = 0 then g[k] end, p[k])), ',') else '' end section_positions,
    cast(pos[1] - pos[-1] as int) remontee_places, cast(case when pos is not null then round_even(len(list_filter(pos, lambda x: x <= 3)) / len(pos)::double * 100, 0) end as int) pct_top3, case when detail then 55.5::double + q end first_speed from e"""
)
def extracted_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sheet is an order and its runners the lineitems: a page with their lines, a detail page for every other runner, words for every fourth."""
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*ORDER))
    # Columns are made of the placed rows, so that pages, words and horses read one shuffle of the table.
    r = table(spark, sf_dir, "lineitem").select("l_orderkey", *ORDER).withColumn("i", place)
    r = r.select("l_orderkey", "i", F.col("l_quantity").cast("int").alias("q"), F.col("l_linenumber").cast("int").alias("n"))
    joined = lambda *parts: F.concat(*(F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts))
    i, q, n = F.col("i"), F.col("q"), F.col("n")
    r = r.withColumns({k: F.expr(x) for k, x in RUN.items()}).withColumn("nom", joined("Coursier", F.when(i < 10, "0").otherwise(""), i, "x"))
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    clock = lambda t: ((F.col(t) / 6000).cast("int"), two((F.col(t) % 6000 / 100).cast("int")), two(F.col(t) % 100))
    time = lambda m, s, c: joined(two(m), ":", s, ".", c)
    minutes, seconds, hundredths = clock("official")
    line = joined(i, " ", F.upper("nom"), " ", time(*clock("t1")), " ", time(*clock("t2")), " ", time(*clock("t3")), " ", minutes, "'", seconds, '"', hundredths, " 6", (n / 10).cast("int"), ",", n % 10, " km 1600,", two(q))
    text = joined(
        F.upper("nom"), "\nVitesse maximale 60,", two(q), "\nVitesse moyenne 58,5\nVitesse moyenne (km/h)\n", 55 + q, ",5 ", 56 + q, " ", 57 + n, ".5\nPosition en course\n", 1 + q % 9, " ", 1 + n % 5, " ", 1 + (q + n) % 4, "\n"
    )
    key = F.col("l_orderkey")
    head = joined("PRIX ", key, " - ", 1000 + 100 * (key % 20), "m  Souple (3.", key % 10, ")\nDEP - 400m   400m – 800m   800m - ARR\n")
    runners = r.select("l_orderkey", "i", line.alias("line"), F.when(i % 2 == 0, text).alias("text")).groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("i", "line", "text"))).alias("r"))
    page = lambda no, text: F.struct(no.alias("page_no"), text.alias("text"))
    details = F.transform(F.filter("r", lambda x: x["text"].isNotNull()), lambda x: page(x["i"], x["text"]))
    first = page(F.lit(0), F.concat(head, F.array_join("r.line", "\n")))
    pages = runners.select("l_orderkey", F.explode(F.concat(F.array(first), details)).alias("page")).select("l_orderkey", "page.*")
    detail = r.where("i % 2 = 0")
    words = F.array(*(F.struct(F.lit(k).alias("word_no"), F.lit(t).cast("string").alias("text") if isinstance(t, str) else (1 + t).cast("string").alias("text"), F.lit(float(x)).alias("x0"), F.lit(float(y)).alias("top")) for k, (t, x, y) in enumerate((("Position", 0, 50), (F.col("n") % 3, 20, 60), (F.col("q") % 7, 10, 60), ("33", 5, 60)))))
    words = detail.where("i % 4 = 0").select("l_orderkey", F.col("i").alias("page_no"), F.explode(words).alias("w")).select("l_orderkey", "page_no", "w.*")
    got = T.tracking_values(r.select("l_orderkey", "nom"), pages, words, ["l_orderkey"])
    listed = lambda c: F.array_join(c, ",")
    return got.select(
        "l_orderkey", "nom", "distance_m", "penetrometre", "temps_officiel_sec", "distance_parcourue", "vitesse_max_kmh", listed("troncons.label").alias("labels"), listed("troncons.temps").alias("durations"),
        F.element_at("troncons", -1)["cumul"].alias("last_time"), listed(F.col("troncons.position").cast("array<string>")).alias("section_positions"), "remontee_places", "pct_top3", F.get("vitesses_troncons", F.lit(0)).alias("first_speed"),
    )


@query(
    """with w as (select user_id, event_id, event_type, value x0, extract(hour from ts) * 60 + extract(minute from ts) as top from events),
    a as (select user_id, arg_min(top, event_id) y from w where event_type = 'view' group by 1)
    select w.user_id, cast(count(*) as int) n, list(event_id % 21 order by x0, event_id)[1]::int first_position from w join a on w.user_id = a.user_id where event_type <> 'view' and y <> 0 and top > y - 150 and top < y + 100 group by 1"""
)
def geometry_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    words = e.select("user_id", F.col("event_id").alias("word_no"), F.when(F.col("event_type") == "view", "Position").otherwise((F.col("event_id") % 21).cast("string")).alias("text"), F.col("value").alias("x0"), (F.hour("ts") * 60 + F.minute("ts")).cast("double").alias("top"))
    return T.geometry_positions(words, ["user_id"]).select("user_id", F.size("positions").alias("n"), F.get("positions", F.lit(0)).alias("first_position"))


@query(
    """with w as (select user_id, event_id, event_type, value x0, floor(extract(hour from ts)) * 1.0 as top, 40 + event_id % 51 as v from events),
    r as (select a.user_id, a.event_id, a.top from w a join w b on a.user_id = b.user_id and a.event_type = 'click' and b.event_type <> 'click' and abs(a.top - b.top) < 3 group by all having count(*) >= 4),
    c as (select user_id, arg_min(top, event_id) y from r group by 1)
    select w.user_id, cast(count(*) as int) n, list(v order by x0, event_id)[1]::double first_speed from w join c on w.user_id = c.user_id where event_type <> 'click' and abs(top - y) < 5 group by 1"""
)
def geometry_speeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    words = e.select("user_id", F.col("event_id").alias("word_no"), F.when(F.col("event_type") == "click", "Vitesse").otherwise((F.col("event_id") % 51 + 40).cast("string")).alias("text"), F.col("value").alias("x0"), F.hour("ts").cast("double").alias("top"))
    return T.geometry_speeds(words, ["user_id"]).select("user_id", F.size("vitesses").alias("n"), F.get("vitesses", F.lit(0)).alias("first_speed"))


@query(
    f"""with s as (select l_orderkey, list(l_quantity::double {ORDERED}) t, list(l_tax::double * 100 {ORDERED}, l_tax)[1:2] g, count(*) n from lineitem group by 1)
    select l_orderkey, unnest(range(1, n + 1))::int section, unnest(list_transform(range(1, n + 1), lambda i: coalesce(g[i], t[i]))) as "value" from s"""
)
def merge_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = order_series(spark, sf_dir, t=F.col("l_quantity").cast("double"), g=(F.col("l_tax").cast("double") * 100))
    merged = V.merge_sections(F.size("t"), F.col("t"), F.slice("g", 1, 2))
    return got.select("l_orderkey", F.posexplode(merged).alias("i", "value")).select("l_orderkey", (F.col("i") + 1).alias("section"), "value")


@query(
    """with h as (select *, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) - 1 hist_pos from orders)
    select o_custkey, o_orderkey, cast(row_number() over (partition by o_custkey order by hist_pos) as int) hist_rank from h where hist_pos < 10 and o_orderstatus <> 'P' qualify row_number() over (partition by o_custkey order by hist_pos) <= 6"""
)
def history_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    pos = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")) - 1
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", pos.alias("hist_pos"), F.when(F.col("o_orderstatus") == "P", "monte").otherwise("PLAT").alias("discipline"))
    return B.cap_history(rows, ["o_custkey"], "hist_pos", "discipline", 6, 10).select("o_custkey", "o_orderkey", "hist_rank")


@query("select o_custkey, cast(count_if(o_orderstatus = 'F') as bigint) nb_courses_trackers, count(*) n_races, max(o_orderkey) last_race from orders group by 1")
def count_tracked(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").withColumn("has", F.col("o_orderstatus") == "F")
    counts = B.count_tracked(rows, ["o_custkey"], "has")
    series = B.collect_series(rows, ["o_custkey"], ["o_orderkey"], {"races": F.col("o_orderkey")})
    return counts.join(series, "o_custkey").select("o_custkey", "nb_courses_trackers", F.size("races").cast("long").alias("n_races"), F.element_at("races", -1).alias("last_race"))


@query(
    """with r as (select cast(o_orderdate as date) d, cast(o_custkey % 5 as int) num_course, o_orderpriority nom, o_orderkey pos, o_totalprice price, o_custkey nb from orders where o_orderpriority <> '5-LOW'),
    k as (select * from r qualify row_number() over (partition by d, num_course, nom order by pos desc) = 1)
    select strftime(d, '%Y%m%d') date_galop, strftime(d, '%d%m%Y') date_pmu, case when num_course = 4 then '' when day(d) % 2 = 0 then 'CHA' else 'DEA' end code_hippo, num_course, nom, cast(2 as int) n_past, price first_price, nb nb_courses_trackers from k"""
)
def race_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a day as horses of five races, named by their priority, of which the last counts; the map is taken apart again."""
    o = table(spark, sf_dir, "orders").select("*", F.date_format("o_orderdate", "ddMMyyyy").alias("date_pmu"), F.lit(1).alias("num_reunion"), (F.col("o_custkey") % 5).cast("int").alias("num_course"))
    runners = o.select(*R.RACE, F.col("o_orderkey").alias("pos"), F.when(F.col("o_orderpriority") == "5-LOW", "").otherwise(F.col("o_orderpriority")).alias("nom"), F.array(F.struct("o_totalprice"), F.struct("o_totalprice")).alias("historique"), F.col("o_custkey").alias("nb_courses_trackers"))
    code = F.when(F.dayofmonth("o_orderdate") % 2 == 0, "CHA").otherwise("DEA")
    races = o.where("num_course <> 4").select(*R.RACE, F.lit(0).alias("reunion_pos"), F.col("o_orderkey").alias("course_pos"), code.alias("code_hippo"))
    horses = J.assemble_results(runners, races).select("date_galop", "date_pmu", "code_hippo", "num_course", F.explode("horses").alias("nom", "h"))
    return horses.select("date_galop", "date_pmu", "code_hippo", "num_course", "nom", F.size("h.historique").alias("n_past"), F.col("h.historique")[0]["o_totalprice"].alias("first_price"), F.col("h.nb_courses_trackers").alias("nb_courses_trackers"))


@query(
    """with k as (select *, row_number() over (partition by o_custkey order by o_orderkey) i from orders where o_orderstatus = 'F')
    select c_custkey, case when o_orderkey is not null then coalesce(case when o_orderkey % 5 <> 0 then o_orderkey::varchar end, '?') end place, case when o_orderkey is not null then o_orderpriority end jockey from customer left join k on c_custkey = o_custkey and i = 1"""
)
def own_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a customer as participants of a past race, of which the first finished one is the horse itself."""
    place = F.struct(F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderkey").cast("string")).alias("place"))
    participant = F.struct((F.col("o_orderstatus") == "F").alias("itsHim"), place.alias("place"), F.col("o_orderpriority").alias("nomJockey"))
    races = B.collect_series(table(spark, sf_dir, "orders").withColumn("c_custkey", F.col("o_custkey")), ["c_custkey"], ["o_orderkey"], {"participants": participant})
    run = S.own_run(F.col("participants"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(races, "c_custkey", "left").select("c_custkey", run["place"].alias("place"), run["jockey"].alias("jockey"))


@query(
    """with f as (select l_orderkey, l_returnflag from lineitem qualify row_number() over (partition by l_orderkey order by l_linenumber, l_extendedprice) = 1)
    select o_orderkey, case when o_orderstatus = 'O' then 'souple' else coalesce(l_returnflag, '') end terrain from orders left join f on l_orderkey = o_orderkey"""
)
def fill_going(spark: SparkSession, sf_dir: str) -> DataFrame:
    races = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "O", "souple").otherwise("").alias("terrain"))
    runners = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.struct("l_linenumber", "l_extendedprice").alias("pos"), F.col("l_returnflag").alias("terrain"))
    return R.fill_going(races, runners, ["o_orderkey"]).select("o_orderkey", "terrain")


@query(
    """with f as (select * from lineitem qualify row_number() over (partition by l_orderkey order by l_linenumber, l_extendedprice) = 1)
    select o_orderkey, l_partkey, l_extendedprice from orders left join f on l_orderkey = o_orderkey"""
)
def race_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of several headers of a key."""
    header = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_extendedprice", "l_partkey")
    return R.with_race_header(table(spark, sf_dir, "orders").select("o_orderkey"), header, ["o_orderkey"], ["l_linenumber", "l_extendedprice"]).select("o_orderkey", "l_partkey", "l_extendedprice")


@query(
    """select o_orderkey, l_partkey, l_extendedprice from orders join lineitem on l_orderkey = o_orderkey and l_returnflag || '  ' || l_linestatus = (case when o_orderkey % 2 = 0 then 'N  O' else 'A  F' end)
    qualify row_number() over (partition by o_orderkey order by l_linenumber, l_extendedprice) = 1"""
)
def find_runner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first runner of an order with the name asked for, in other cases and with blanks around it."""
    runners = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.concat_ws("  ", F.lower("l_returnflag"), "l_linestatus").alias("nom"), F.struct("l_linenumber", "l_extendedprice").alias("pos"), "l_partkey", "l_extendedprice")
    names = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, "\tN  o ").otherwise(" a  f").alias("nom"))
    return R.find_runner(runners, names, ["o_orderkey"]).select("o_orderkey", "l_partkey", "l_extendedprice")


@query(
    """with s as (select user_id, case event_type when 'view' then 1 when 'click' then 2 else 3 end priority, count(*) n from events group by 1, 2)
    select user_id, cast(priority as int) priority, n from s where n > 1 qualify row_number() over (partition by user_id order by priority) = 1"""
)
def pick_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of events as sources of a user; one with a single event is not valid."""
    priority = F.when(F.col("event_type") == "view", 1).when(F.col("event_type") == "click", 2).otherwise(3)
    sources = table(spark, sf_dir, "events").groupBy("user_id", priority.alias("priority")).agg(F.count("*").alias("n"))
    return B.pick_source(sources, "user_id", "priority", F.col("n") > 1).select("user_id", "priority", "n")


@query("""select o_orderkey, l_linenumber, l_extendedprice, cast(o_orderstatus = 'F' and l_linenumber = 1 as boolean) found, case when o_orderstatus = 'F' and l_linenumber = 1 then o_totalprice end price from lineitem join orders on o_orderkey = l_orderkey""")
def tracking_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finished orders have a sheet, on which their first lines are."""
    o = table(spark, sf_dir, "orders")
    runs = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_extendedprice").join(o.select("o_orderkey"), "o_orderkey")
    sheets = o.where("o_orderstatus = 'F'").select("o_orderkey", F.lit(1).alias("l_linenumber"), F.col("o_totalprice").alias("price"))
    return J.join_tracking(runs, sheets, ["o_orderkey", "l_linenumber"]).select("o_orderkey", "l_linenumber", "l_extendedprice", F.col("price").isNotNull().alias("found"), "price")


@query(
    """select c_custkey, coalesce(n, 0) n, n is not null from_cache from customer left join (select o_custkey, count(*) n from orders group by 1) on c_custkey = o_custkey"""
)
def cache_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    cache = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return B.cache_first(table(spark, sf_dir, "customer").select("c_custkey"), cache, ["c_custkey"], lambda misses: misses.withColumn("n", F.lit(0).cast("long")))


@query("select c_custkey, exists (select 1 from orders where o_custkey = c_custkey) cached from customer")
def cache_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.with_cache_status(table(spark, sf_dir, "customer").select("c_custkey"), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


@query("select l_orderkey, l_extendedprice, strftime(l_shipdate, '%Y%m%d') date_galop, case when l_returnflag = 'A' then 'CHA' else 'DEA' end code_hippo, cast(l_linenumber as int) num_course, cast(floor(l_extendedprice / 1024) as bigint) size_kb from lineitem")
def file_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.when(F.col("l_returnflag") == "A", "CHA").otherwise("DEA")
    name = S.tracking_file_name(F.date_format("l_shipdate", "yyyyMMdd"), code, F.col("l_linenumber"))
    files = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("/sheets/"), F.col("l_orderkey").cast("string"), F.lit("_"), F.col("l_extendedprice").cast("string"), F.lit("/"), name).alias("path"), F.col("l_extendedprice").alias("length"), "l_orderkey", "l_extendedprice")
    return D.tracking_inventory(files).select("l_orderkey", "l_extendedprice", "date_galop", "code_hippo", "num_course", "size_kb")
