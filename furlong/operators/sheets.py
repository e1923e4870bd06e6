"""Timing sheets: lines, matches of horses to lines and pages, series from word geometry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furlong.functions import scalars as S
from furlong.functions import series as V
from furlong.functions import sheets as X


def sheet_pages(pages: DataFrame, keys: list[str]) -> DataFrame:
    """One row a sheet: keys, pages (structs page_no, text, in order).  This is where texts are shuffled."""
    page = F.struct("page_no", F.coalesce("text", F.lit("")).alias("text"))
    return pages.groupBy(*keys).agg(F.sort_array(F.collect_list(page)).alias("pages"))


def lines_of(pages: Column) -> Column:
    """Lines of a sheet from its pages."""
    return F.split(F.array_join(F.transform(pages, lambda p: p["text"]), "\n"), "\n", -1)


def sheet_lines(pages: DataFrame, keys: list[str]) -> DataFrame:
    """Lines of a sheet, numbered over its pages in order: keys, line_no, line."""
    return sheet_pages(pages, keys).select(*keys, F.posexplode(lines_of(F.col("pages"))).alias("line_no", "line"))


def hits(upper: Column, words: Column) -> Column:
    """Words that occur in a text, which is in upper case, with multiplicity."""
    return F.size(F.filter(words, lambda w: S.contains(upper, w)))


def is_detail(page_no: Column, text: Column) -> Column:
    return (page_no > 0) & text.contains("Vitesse moyenne") & text.contains("Position")


def has_time(line: Column) -> Column:
    return X.marked(line, X.TIME) & X.either(line, lambda start: line.rlike(start + X.TIME))


def sheet_rows(pages: DataFrame, keys: list[str]) -> DataFrame:
    """One row a sheet with what is looked up in it: keys, header, timed (lines with a time), upper (their text in upper case), detail (page_no, text, upper).

    A sheet's text is gathered once; everything else is read from this row.  Its
    lines are found in the text, which is quicker than a loop over them.
    """
    whole = sheet_pages(pages, keys).withColumn("__text", F.array_join("pages.text", "\n"))
    whole = in_steps(whole, [*X.header_steps(F.col("__text")), {"__ascii": X.is_ascii(F.col("__text"))}, {"timed": X.timed_lines(F.col("__text"), F.col("__ascii"))}])
    page = F.filter("pages", lambda p: is_detail(p["page_no"], p["text"]))
    return whole.select(
        *keys, "distance_m", "terrain", "penetrometre", F.coalesce("labels", F.array().cast("array<string>")).alias("labels"), "timed", F.upper(F.array_join("timed", "\n")).alias("upper"),
        F.transform(page, lambda p: F.struct(p["page_no"].alias("page_no"), p["text"].alias("text"), F.upper(p["text"]).alias("upper"))).alias("detail"),
    )


def best_at(scores: Column) -> Column:
    """Place, from 0, of the first of the greatest scores; null if none is above 0."""
    return F.when(F.array_max(scores) > 0, (F.array_position(scores, F.array_max(scores)) - 1).cast("int"))


def asked_words(horses: DataFrame, keys: list[str], name: str) -> DataFrame:
    return horses.select(*keys, name).distinct().withColumn("__words", S.tokens(F.col(name), 2))


def listed(horses: DataFrame, sheets: DataFrame, keys: list[str], name: str = "nom") -> DataFrame:
    """Which horses have a line on their sheet: keys, name.  sheets: of ``sheet_rows``."""
    return with_line(asked_words(horses, keys, name).join(sheets.select(*keys, "upper"), keys)).select(*keys, name)


def with_line(rows: DataFrame) -> DataFrame:
    """Rows of a name's words and its sheet's upper in which a line has one of the words, none of which has a line's end."""
    return rows.where(F.exists("__words", lambda w: S.contains(F.col("upper"), w)))


CROWDED = 200
"""Names of a sheet up to which each of its lines is searched for all of them."""


def match_lines(horses: DataFrame, lines: DataFrame, keys: list[str], name: str = "nom", crowded: int = CROWDED) -> DataFrame:
    """The line with a time that has most words of the horse's name, the first of equals: keys, name, line_no, line, score.

    A sheet of up to ``crowded`` names is searched line by line.  On one with
    more, which would make a pair of each name and line, words meet the lines
    that have their first three letters, by ``posted_lines``.
    """
    timed = lines.where(has_time(F.col("line"))).withColumn("__upper", F.upper("line"))
    asked = asked_words(horses, keys, name)
    sizes = asked.groupBy(*keys).agg(F.count("*").alias("__n"))
    few, many = (asked.join(sizes.where(ok).select(*keys), keys, "left_semi") for ok in (F.col("__n") <= crowded, F.col("__n") > crowded))
    columns = [*keys, name, "line_no", "line", "score"]
    scored = few.join(timed, keys).withColumn("score", hits(F.col("__upper"), F.col("__words"))).where("score > 0").select(*columns)
    scored = scored.unionByName(scored_posts(posted_lines(many, timed, keys, name), timed, keys, name).select(*columns))
    return scored.groupBy(*keys, name).agg(F.max_by(F.struct("line_no", "line", "score"), F.struct("score", -F.col("line_no"))).alias("b")).select(*keys, name, "b.*")


def posted_lines(asked: DataFrame, timed: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Lines that may have a word of a name, for they have its first three letters: keys, name, word, times, line_no.

    asked: names with their words, each longer than two letters; times: how often
    a name has the word.  Only grams and line numbers are shuffled.
    """
    gram = lambda text, at: F.substring(text, at, F.lit(3))
    words = asked.select(*keys, name, F.explode("__words").alias("word")).groupBy(*keys, name, "word").agg(F.count("*").alias("times")).withColumn("gram", gram(F.col("word"), F.lit(1)))
    upper = F.col("__upper")
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(upper) - 2, F.lit(1))), lambda i: gram(upper, i)))
    posts = timed.join(asked.select(*keys).distinct(), keys, "left_semi").select(*keys, "line_no", F.explode(grams).alias("gram"))
    return posts.join(words, [*keys, "gram"]).select(*keys, name, "word", "times", "line_no")


def scored_posts(posts: DataFrame, timed: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Lines with the number of a name's words they really have: keys, name, line_no, line, score."""
    found = posts.join(timed.select(*keys, "line_no", "line", "__upper"), [*keys, "line_no"]).where(S.contains(F.col("__upper"), F.col("word")))
    return found.groupBy(*keys, name, "line_no").agg(F.any_value("line").alias("line"), F.sum("times").cast("int").alias("score"))


def match_pages(horses: DataFrame, pages: DataFrame, keys: list[str], name: str = "nom") -> DataFrame:
    """The detail page, after the first page, that has most words of the horse's name: keys, name, page_no, score.

    The names of a sheet are one row, so a page is scored for all of them where
    it is met; only numbers and scores go on from there.
    """
    detail = pages.where(is_detail(F.col("page_no"), F.col("text"))).select(*keys, "page_no", F.upper("text").alias("__upper"))
    names = asked_words(horses, keys, name).groupBy(*keys).agg(F.collect_list(F.struct(F.col(name).alias("name"), F.col("__words").alias("words"))).alias("__names"))
    scores = F.filter(F.transform("__names", lambda x: F.struct(x["name"].alias("name"), hits(F.col("__upper"), x["words"]).alias("score"))), lambda x: x["score"] > 0)
    scored = detail.join(names, keys).select(*keys, "page_no", F.explode(scores).alias("s")).select(*keys, F.col("s.name").alias(name), "page_no", "s.score")
    return scored.groupBy(*keys, name).agg(F.max_by(F.struct("page_no", "score"), F.struct("score", -F.col("page_no"))).alias("b")).select(*keys, name, "b.*")


def sheet_header(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Distance (first), going and penetrometer (last) and labels (first) in the first 30 lines."""
    line = F.col("line")
    top = lines.where("line_no < 30").select(*keys, "line_no", X.integer(X.group(line, X.DISTANCE)).alias("d"), X.group(line, X.GOING, 0, "i").alias("g"), X.section_labels(line).alias("l"))
    first = lambda c, ok: F.min_by(F.when(ok, F.col(c)), F.when(ok, F.col("line_no")))
    found = top.groupBy(*keys).agg(first("d", F.col("d") > 0).alias("distance_m"), F.max_by("g", F.when(F.col("g").isNotNull(), F.col("line_no"))).alias("__going"), first("l", F.col("l").isNotNull()).alias("labels"))
    return found.select(*keys, "distance_m", X.going_of(F.col("__going")).alias("g"), "labels").select(*keys, "distance_m", "g.*", "labels")


def in_steps(df: DataFrame, steps: list[dict[str, Column]]) -> DataFrame:
    """Columns in steps that build on each other; those that begin with __ are dropped in the end."""
    for step in steps:
        df = df.withColumns(step)
    return df.drop(*(name for step in steps for name in step if name.startswith("__")))


def line_values(df: DataFrame, line: str = "line") -> DataFrame:
    """temps_officiel, temps_officiel_sec, vitesse_max_ligne and distance_parcourue beside the lines; each pattern is searched once."""
    return in_steps(df, X.line_steps(F.col(line)))


def head_values(df: DataFrame, line: str = "line") -> DataFrame:
    """distance_m, terrain, penetrometre, labels and times beside the lines; each pattern is searched once."""
    return in_steps(df, X.head_steps(F.col(line)))


def detail_values(df: DataFrame, page: str = "text") -> DataFrame:
    """The values of a detail page beside it; each pattern is searched once."""
    return in_steps(df, X.detail_steps(F.col(page)))


# Words that are positions and speeds.
WHOLE, SPEED = r"^\d{1,2}$", r"^\d{2,3}(?:[,.]\d)?$"
NEAR = 3
"""Height of the row of an anchor, to either side."""


def geometry_positions(words: DataFrame, page: list[str]) -> DataFrame:
    """Integers up to 20 around the first word "Position", from left to right: page, positions."""
    anchor = words.where("text = 'Position'").groupBy(*page).agg(F.min_by("top", "word_no").alias("__y")).where("__y <> 0")
    near = words.where(F.col("text").rlike("(?U)" + WHOLE)).join(anchor, page).where("top > __y - 150 and top < __y + 100")
    near = near.withColumn("__n", X.integer(F.col("text"))).where("__n <= 20")
    got = near.groupBy(*page).agg(F.sort_array(F.collect_list(F.struct("x0", "word_no", "__n"))).alias("w"))
    return got.select(*page, F.col("w.__n").alias("positions"))


def geometry_speeds(words: DataFrame, page: list[str]) -> DataFrame:
    """Speeds on the row of the first word "Vitesse" that has four of them: page, vitesses."""
    values = words.where(F.col("text").rlike("(?U)" + SPEED)).withColumn("__v", X.number(F.col("text"))).where("__v between 40 and 90")
    # An anchor meets the values of its band of the page and of the bands beside it, not all of them.
    band = F.floor(F.col("top") / NEAR)
    anchors = words.where("text = 'Vitesse'").select(*page, F.col("word_no").alias("__a"), F.col("top").alias("__y"), F.explode(F.array(band - 1, band, band + 1)).alias("__band"))
    rows = anchors.join(values.select(*page, "top", band.alias("__band")), [*page, "__band"]).where(F.abs(F.col("top") - F.col("__y")) < NEAR).groupBy(*page, "__a", "__y").agg(F.count("*").alias("n")).where("n >= 4")
    chosen = rows.groupBy(*page).agg(F.min_by("__y", "__a").alias("__y"))
    near = values.join(chosen, page).where(F.abs(F.col("top") - F.col("__y")) < 5)
    got = near.groupBy(*page).agg(F.sort_array(F.collect_list(F.struct("x0", "word_no", "__v"))).alias("w"))
    return got.select(*page, F.col("w.__v").alias("vitesses"))


def page_series(words: DataFrame, page: list[str]) -> DataFrame:
    """``geometry_positions`` and ``geometry_speeds`` of each page: page, positions, vitesses; null where there are none.

    The words of a page are one row, which is all that both need.
    """
    text = F.col("text")
    integer = F.when(X.either(text, lambda start: text.rlike(start + WHOLE)), X.integer(text))
    speed = F.when(X.either(text, lambda start: text.rlike(start + SPEED)), X.number(text))
    label = F.when(text.isin("Position", "Vitesse"), text)
    rows = words.select(*page, "word_no", "x0", "top", label.alias("label"), integer.alias("n"), speed.alias("v")).where("label is not null or n <= 20 or v between 40 and 90")
    whole = rows.groupBy(*page).agg(F.sort_array(F.collect_list(F.struct("word_no", "x0", "top", "label", "n", "v"))).alias("w"))
    pick = lambda fits: F.filter("w", fits)
    whole = whole.withColumns({"__speeds": pick(lambda x: x["v"].between(40, 90)), "__y": F.get(pick(lambda x: x["label"] == "Position"), F.lit(0))["top"], "__anchors": pick(lambda x: x["label"] == "Vitesse")})
    near = lambda y, reach: F.filter("__speeds", lambda x: F.abs(x["top"] - y) < reach)
    whole = whole.withColumn("__row", F.get(F.filter("__anchors", lambda a: F.size(near(a["top"], NEAR)) >= 4), F.lit(0))["top"])
    placed = lambda found, value: F.transform(F.sort_array(F.transform(found, lambda x: F.struct(x["x0"], x["word_no"], x[value].alias("value")))), lambda x: x["value"])
    around = pick(lambda x: (x["n"] <= 20) & (x["top"] > F.col("__y") - 150) & (x["top"] < F.col("__y") + 100))
    none = lambda a: F.when(F.size(a) > 0, a)
    found = whole.select(*page, F.when(F.col("__y") != 0, placed(around, "n")).alias("positions"), F.when(F.col("__row").isNotNull(), placed(near(F.col("__row"), 5), "v")).alias("vitesses"))
    return found.select(*page, none(F.col("positions")).alias("positions"), none(F.col("vitesses")).alias("vitesses"))


def extract_tracking(horses: DataFrame, pages: DataFrame, words: DataFrame, keys: list[str], name: str = "nom", sheets: DataFrame | None = None) -> DataFrame:
    """Sections, series and indicators of each (sheet, horse) that is found on its sheet, as one column tracking; see ``tracking_values``."""
    return tracking_values(horses, pages, words, keys, name, sheets).select(*keys, name, F.struct(*TRACKING).alias("tracking"))


def tracking_values(horses: DataFrame, pages: DataFrame, words: DataFrame, keys: list[str], name: str = "nom", sheets: DataFrame | None = None) -> DataFrame:
    """Sections, series and indicators of each (sheet, horse) that is found on its sheet, each a column.

    sheets: ``sheet_rows`` of the pages, if they are at hand.  The horses of a
    sheet meet its row; all that is read from text is read there, and only values
    go on to meet the series from the words of their pages.
    """
    sheets = sheet_rows(pages, keys) if sheets is None else sheets
    rows = with_line(asked_words(horses, keys, name).join(sheets, keys))
    score = lambda upper: hits(upper, F.col("__words"))
    rows = rows.withColumns({"__lines": F.transform(F.split("upper", "\n", -1), score), "__pages": F.transform("detail.upper", score)})
    rows = rows.withColumns({"line": F.get("timed", best_at(F.col("__lines"))), "__d": F.get("detail", best_at(F.col("__pages")))}).drop("timed", "upper", "detail", "__words", "__lines", "__pages")
    rows = rows.withColumns({"page_no": F.col("__d.page_no"), "text": F.col("__d.text")}).drop("__d")
    numbers = {"__v": X.SPEED_ROW, "__p": X.POSITION_ROW, "__f": X.STRIDE_ROW}
    none, no_ints = F.array().cast("array<double>"), F.array().cast("array<int>")
    rows = detail_values(line_values(rows)).withColumn("__plain", X.is_ascii(F.col("line")))
    rows = rows.withColumns({"__times": X.found_all(F.col("line"), F.col("__plain"), X.TIME, 0), **{f"__row{n}": X.label_row(F.col("text"), p) for n, p in numbers.items()}})
    rows = rows.withColumns({"__digits": X.time_digits(F.col("__times")), **{n: F.coalesce(X.row_numbers(F.col(f"__row{n}")), none) for n in numbers}})
    rows = rows.withColumns({"__p": F.col("__p").cast("array<int>"), "__f": F.col("__f").cast("array<int>"), "__raw": X.numbered_times(F.col("__digits"))})
    rows = rows.withColumn("__fold", V.kept_times(F.col("__raw"), F.col("temps_officiel_sec"), X.NUMBERED))
    rows = rows.drop("line", "text", "__plain", "__digits", "__raw", *(f"__row{n}" for n in numbers))
    page = [*keys, "page_no"]
    asked = words.join(horses.select(*keys).distinct(), keys, "left_semi")
    rows = rows.join(page_series(asked, page), page, "left")
    # Differences of hundredths are exact, and quicker than rounded differences of seconds.
    durations = F.transform("__fold.kept", lambda t, i: F.when(i == 0, t["cs"]).otherwise(t["cs"] - F.get(F.col("__fold.kept"), i - 1)["cs"]))
    rows = rows.withColumns({"__dur": durations, "__gp": F.coalesce("positions", no_ints), "__gv": F.coalesce("vitesses", none)})
    rows = rows.withColumn("__digits", F.transform("__dur", V.clock_digits))
    sections = F.transform(
        "__fold.kept",
        lambda t, i: F.struct(
            (i + 1).alias("index"), F.coalesce(F.get("labels", t["at"]), F.concat(F.lit("T"), (t["at"] + 1).cast("string"))).alias("label"), V.clock_text(F.get("__digits", i), F.get("__dur", i)).alias("temps"),
            (F.get("__dur", i) / F.lit(100.0)).alias("temps_sec"), F.get("__times", t["at"]).alias("cumul"), (t["cs"] / F.lit(100.0)).alias("cumul_sec"),
            F.coalesce(F.get("__gv", i), F.get("__v", i)).alias("vitesse_kmh"), F.coalesce(F.get("__gp", i), F.get("__p", i)).alias("position"), F.get("__f", i).alias("foulees"),
        ),
    )
    rows = rows.withColumns({"troncons": sections, "positions_troncons": V.merged_series(F.col("__p"), F.col("__gp")), "vitesses_troncons": V.merged_series(F.col("__v"), F.col("__gv"))})
    rows = rows.select("*", *V.indicators(F.col("positions_troncons"), F.col("vitesses_troncons")))
    last = F.col("__fold.t600")
    rows = rows.withColumns({"vitesse_max_kmh": F.coalesce("vitesse_max_kmh", "vitesse_max_ligne"), "temps_600m": F.get("__times", last["at"]), "temps_600m_sec": last["cs"] / F.lit(100.0)})
    return rows.select(*keys, name, *TRACKING)


TRACKING = (
    "distance_m", "terrain", "penetrometre", "temps_officiel", "temps_officiel_sec", "distance_parcourue", "troncons", "positions_troncons", "vitesses_troncons", "redk", "redk_sec", "vitesse_max_kmh", "vitesse_moyenne_kmh",
    "troncon_plus_rapide", "troncon_plus_rapide_label", "remontee_places", "score_remontee", "pct_top3", "profil_leader", "score_finish", "regularite", "chute_finale", "temps_600m", "temps_600m_sec",
)
"""Fields of what is read for a horse from its sheet."""
