"""What is stored and shown of an opportunity: labels, columns of the moment of detection, settled bets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..domain import BOOKS
from ..functions.scalars import half_up, line_text, lookup, market_line, market_scope, market_type, prague_hour, prague_weekday

# Labels of market types, scopes, selections, and of the unit in which a sport scores.
TYPE_LABEL = {
    "1X2": "1X2",
    "ML": "Vítěz",
    "DNB": "Bez remízy",
    "BTTS": "Oba skórují",
    "OE": "Lichý/sudý",
    "DC": "Dvojtip",
    "H_DA": "1 vs. X2",
    "A_HD": "2 vs. 1X",
    "D_HA": "X vs. 12",
}
LINE_LABEL = {
    "OU": "Počet {unit}",
    "AH": "Handicap",
    "OU_HOME": "Domácí {unit}",
    "OU_AWAY": "Hosté {unit}",
    "OU_SETS": "Počet setů",
    "AH_SETS": "Handicap setů",
}
SCOPE_LABEL = {
    "REG": "zákl. doba",
    "MATCH": "zápas",
    "H1": "1. poločas",
    "H2": "2. poločas",
    "P1": "1. třetina",
    "P2": "2. třetina",
    "P3": "3. třetina",
    "Q1": "1. čtvrtina",
    "Q2": "2. čtvrtina",
    "Q3": "3. čtvrtina",
    "Q4": "4. čtvrtina",
    "S1": "1. set",
    "S2": "2. set",
    "S3": "3. set",
    "S4": "4. set",
    "S5": "5. set",
}
SCORE_UNIT = {
    "football": "gólů",
    "hockey": "gólů",
    "handball": "gólů",
    "basketball": "bodů",
    "volleyball": "bodů",
    "american_football": "bodů",
    "table_tennis": "bodů",
    "tennis": "gemů",
    "baseball": "běhů",
    "darts": "legů",
    "snooker": "framů",
    "mma": "kol",
    "boxing": "kol",
}
SELECTION_LABEL = {
    "HOME": "Domácí",
    "DRAW": "X",
    "AWAY": "Hosté",
    "HOME_DRAW": "1X",
    "HOME_AWAY": "12",
    "DRAW_AWAY": "X2",
    "OVER": "Více",
    "UNDER": "Méně",
    "YES": "Ano",
    "NO": "Ne",
    "ODD": "Lichý",
    "EVEN": "Sudý",
}


def market_label(key: Column, sport: Column) -> Column:
    """Name of a market for people: type (with the sport's unit and the line), then scope."""
    kind, line = market_type(key), market_line(key)
    shown = F.concat(F.when((line > 0) & kind.startswith("AH"), "+").otherwise(""), line_text(line))
    unit = lookup(sport, SCORE_UNIT, F.lit(SCORE_UNIT["football"]))
    lined = F.concat(F.replace(lookup(kind, LINE_LABEL), F.lit("{unit}"), unit), F.lit(" "), shown)
    return F.concat_ws(" · ", F.coalesce(lookup(kind, TYPE_LABEL), lined), lookup(market_scope(key), SCOPE_LABEL))


def selection_label(sel: Column, mtype: Column) -> Column:
    """Name of an outcome; sides are numbers where the market has a draw."""
    return F.when((sel == "HOME") & mtype.isin("1X2", "H_DA"), "1").when((sel == "AWAY") & mtype.isin("1X2", "A_HD"), "2").otherwise(lookup(sel, SELECTION_LABEL))


def book_names(books: Column) -> Column:
    """Sorted distinct names of an array of places in the order of books."""
    names = F.array(*[F.lit(b) for b in BOOKS])
    return F.array_sort(F.array_distinct(F.transform(books, lambda b: F.element_at(names, b.cast("int") + 1))))


def detection_columns(arbs: DataFrame) -> DataFrame:
    """Columns stored at detection, from ``mode, first_seen, start_time, pause_started, home, away, clock_s, market, books,
    margin``: score text, full minutes, seconds of the pause so far and to the start (before the match only), local hour
    and weekday, books and their pair key, market parts, margin to 3 digits. What is not known stays null."""
    seconds = lambda ms: half_up(ms / 1000).cast("long")
    return arbs.withColumns({
        "score": F.when(F.col("home").isNotNull() & F.col("away").isNotNull(), F.concat_ws(":", F.col("home").cast("string"), F.col("away").cast("string"))),
        "minute": F.floor(F.col("clock_s") / 60).cast("long"),
        "pause_elapsed_s": seconds(F.col("first_seen") - F.col("pause_started")),
        "time_to_start_s": F.when(F.col("mode") == "PREMATCH", seconds(F.col("start_time") - F.col("first_seen"))),
        "hour": prague_hour(F.col("first_seen")).cast("long"),
        "weekday": prague_weekday(F.col("first_seen")).cast("long"),
        "bookmakers": book_names(F.col("books")),
        "pair_key": F.array_join(book_names(F.col("books")), "|"),
        "market_type": market_type(F.col("market")),
        "market_scope": market_scope(F.col("market")),
        "market_line": market_line(F.col("market")),
        "margin_shown": half_up(F.col("margin"), 3),
    })


def payouts(legs: Column) -> Column:
    """Legs with what each pays: stake times effective price, to 2 digits."""
    return F.transform(legs, lambda x: x.withField("payout", half_up(x["stake"] * x["eff"], 2)))


def leg_profits(legs: Column, total: Column) -> Column:
    """What is left if each leg wins; null for a leg without stake or price."""
    return F.transform(legs, lambda x: half_up(x["stake"] * x["odds"] - total, 2))


def bet_outcomes(bets: DataFrame) -> DataFrame:
    """Expected and settled profit of bets with ``legs array<struct<stake, odds>>``, ``stake`` (null: the legs' sum), ``margin``,
    ``result`` (won, void, manual or null), ``winning_leg`` (from 0), ``manual_profit``.

    Expected is the worst leg's profit where at least two legs are complete, else what stake and margin say."""
    own = F.coalesce("stake", F.aggregate("legs", F.lit(0.0), lambda s, x: s + F.coalesce(x["stake"], F.lit(0.0))))
    out = bets.withColumn("total", own).withColumn("_per", leg_profits(F.col("legs"), F.col("total")))
    complete = (F.size("_per") >= 2) & F.forall("_per", lambda p: p.isNotNull())
    by_margin = F.when(F.col("total") != 0, half_up(F.col("total") * F.col("margin") / (F.lit(100.0) + F.col("margin")), 2))
    profit = F.when(F.col("result") == "won", F.try_element_at("_per", F.col("winning_leg").cast("int") + 1)).when(F.col("result") == "void", 0.0).when(F.col("result") == "manual", F.col("manual_profit"))
    return out.withColumn("expected", F.when(complete, F.array_min("_per")).otherwise(by_margin)).withColumn("profit", profit).drop("_per")
