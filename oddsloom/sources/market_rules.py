"""Markets of feeds by rules: which market a feed's code and name mean, which outcome a label means, and when a market is left out.

Rules and readers are tables. A rule says for (feed, sport, code) what a market is; a reader says for (feed, family of types) what an
outcome is, by a pattern over one of its fields. Of several the first in order counts, so a reader may also name what must not be
read (selection ``BAD``). All patterns are data: the engine makes one expression of them and knows no reader.

An outcome that can't be read spoils its whole market: markets are dropped as a whole, never thinned out.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import fold, market_key

# Sport, code, type and scope of each feed's markets. A scope P, Q or S takes its number from the market's name;
# ``?X`` is read from the name too (with or without extra time) and is X if it says nothing, ``?`` alone then leaves the market out.
FORTUNA = """
football 00-00 1X2 REG
football 00-03 DNB REG
football 00-0u OU REG
football 00-0b AH REG
football 00-1c BTTS REG
football 00-10 OU_HOME REG
football 00-13 OU_AWAY REG
football 00-2d 1X2 H1
football 00-2g DNB H1
football 00-2i OU H1
football 00-2h AH H1
football 00-2n BTTS H1
football 00-2m OE H1
football 00-2w 1X2 H2
football 00-3b OU H2
football 00-01 DC REG
football 00-2f DC H1
football 00-2y DC H2
hockey 0w-00 1X2 REG
hockey 0w-02 DNB REG
hockey 0w-04 AH REG
hockey 0w-05 OU REG
hockey 0w-0b BTTS REG
hockey 0w-0d ML MATCH
hockey 0w-0e AH MATCH
hockey 0w-0f OU MATCH
hockey 0w-0j 1X2 P
hockey 0w-0l OU P
hockey 0w-0r AH P
hockey 0w-01 DC REG
hockey 0w-0t DC P
basketball 0i-00 1X2 REG
basketball 0i-04 ML MATCH
basketball 0i-06 AH MATCH
basketball 0i-07 OU MATCH
basketball 0i-0a OE MATCH
basketball 0i-0b 1X2 Q
basketball 0i-0c OU Q
basketball 0i-1b AH Q
tennis 0x-01 ML MATCH
tennis 0x-02 AH MATCH
tennis 0x-03 AH_SETS MATCH
tennis 0x-04 OU MATCH
tennis 0x-0i OU_SETS MATCH
tennis 0x-0e ML S
tennis 0x-0f AH S
tennis 0x-0g OU S
"""
SAZKA = """
football MATCH_RESULT 1X2 REG
football NO_BET_DRAW DNB REG
football TOTAL_GOALS_OVER/UNDER OU REG
football ASIAN_HANDICAP AH REG
football BOTH_TEAMS_TO_SCORE BTTS REG
football MATCH_RESULT_1ST_HALF 1X2 H1
football TOTAL_GOALS_OVER/UNDER_1ST_HALF OU H1
football DOUBLE_CHANCE DC REG
football DOUBLE_CHANCE_1ST_HALF DC H1
hockey MATCH_RESULT_NO_OVERTIME 1X2 REG
hockey MATCH_RESULT 1X2 REG
hockey MONEY_LINE ML ?MATCH
hockey TOTAL_GOALS_OVER/UNDER OU ?
hockey HANDICAP_2_WAY AH ?
hockey PERIOD_WINNER_NTH_PERIOD 1X2 P
hockey DRAW_NO_BET_NTH_PERIOD DNB P
hockey DOUBLE_CHANCE DC REG
basketball MONEY_LINE ML ?MATCH
basketball MATCH_RESULT 1X2 REG
basketball HANDICAP_2_WAY AH ?
basketball TOTAL_POINTS_OVER/UNDER OU ?
tennis MATCH_WINNER ML MATCH
tennis TOTAL_GAMES_OVER/UNDER OU MATCH
tennis GAME_HANDICAP AH MATCH
tennis SET_HANDICAP AH_SETS MATCH
handball TOTAL_GOALS_OVER/UNDER OU ?REG
handball HANDICAP_2_WAY AH ?REG
volleyball SET_WINNER_NTH ML S
"""
BETANO = """
football MRES 1X2 REG
hockey MRES 1X2 REG
handball MRES 1X2 REG
football DBLC DC REG
hockey DBLC DC REG
handball DBLC DC REG
football DNOB DNB REG
football BTSC BTTS REG
football HCTG OU REG
hockey HCTG OU REG
handball HCTG OU REG
football OUH1 OU H1
tennis HTOH ML MATCH
tennis H2HT ML MATCH
volleyball HTOH ML MATCH
basketball HTOH ML MATCH
tennis TGHC AH MATCH
tennis FTGO OU MATCH
tennis TGOU OU MATCH
volleyball FOUT OU MATCH
"""
SYNOT = """
baseball 2 1X2 REG ^Zápas$
baseball 293 ML MATCH ^Vítěz \\(včetně extra směn\\)$
baseball 294 AH MATCH ^Handicap \\(včetně extra směn\\)$
baseball 295 OU MATCH ^Počet bodů \\(včetně extra směn\\)$
baseball 298 OE MATCH ^Lichá/Sudá - Počet bodů \\(včetně extra směn\\)$
volleyball 249 ML S ^[1-5]\\. set$
volleyball 270 AH S ^[1-5]\\. set - Body handicap$
volleyball 271 OU S ^[1-5]\\. set - Počet bodů$
american_football 252 AH MATCH ^Handicap \\(včetně prodloužení\\)$
american_football 253 OU MATCH ^Počet bodů \\(včetně prodloužení\\)$
american_football 257 1X2 Q ^[123]\\. čtvrtina$
american_football 12 1X2 H1 ^1\\. poločas$
snooker 178 ML MATCH ^Vítěz zápasu$
snooker 1276 AH MATCH ^Framy - Handicap$
snooker 1277 OU MATCH ^Počet framů$
darts 210 AH_SETS MATCH ^Sety - Handicap$
"""
RULES = {"fortuna": FORTUNA, "sazka": SAZKA, "betano": BETANO, "synot": SYNOT}

_NUMBER = r"\d+(?:[.,]\d+)?"
_PLAIN = {"RESULT": [("^1$", "HOME"), ("^[0x]$", "DRAW"), ("^2$", "AWAY")], "SIDES": [("^1$", "HOME"), ("^2$", "AWAY")], "DC": [("^(10|1x)$", "HOME_DRAW"), ("^12$", "HOME_AWAY"), ("^(02|x2)$", "DRAW_AWAY")]}
_SIDES = [("sub", "^h$", "HOME", 0), ("sub", "^a$", "AWAY", 0), ("sub", "^d$", "DRAW", 0), ("plain", "^{home}$", "HOME", 0), ("plain", "^{away}$", "AWAY", 0), ("plain", "^(remiza|x|0)$", "DRAW", 0), ("plain", "^1$", "HOME", 0), ("plain", "^2$", "AWAY", 0)]
#: By feed and family: field, pattern, selection, and the pattern's group that holds the line (0: the line is stated by itself).
READERS = {
    "fortuna": {
        **{k: [("label", p, s, 0) for p, s in v] for k, v in _PLAIN.items()},
        "BTTS": [("label", "^(ano|yes)$", "YES", 0), ("label", "^(ne|no)$", "NO", 0)],
        "OE": [("label", "^(lichý|odd)$", "ODD", 0), ("label", "^(sudý|even)$", "EVEN", 0)],
        "TOTAL": [("label", rf"^[+]\s*({_NUMBER})$", "OVER", 1), ("label", rf"^-\s*({_NUMBER})$", "UNDER", 1)],
        "HANDICAP": [("label", rf"^(?:{who})\s*{line}$", s, 1) for who, s in (("1|{home}", "HOME"), ("2|{away}", "AWAY")) for line in (rf"\(\s*([+-]?\s*{_NUMBER})\s*\)", rf"([+-]\s*{_NUMBER})", r" (0)")],
    },
    "sazka": {
        "RESULT": _SIDES,
        "SIDES": _SIDES,
        "HANDICAP": _SIDES,
        "TOTAL": [("sub", "^h$", "OVER", 0), ("sub", "^l$", "UNDER", 0), ("plain", "^(nad|vice)", "OVER", 0), ("plain", "^(pod|mene)", "UNDER", 0)],
        "BTTS": [("plain", "^ano$", "YES", 0), ("plain", "^ne$", "NO", 0)],
        "OE": [("plain", "^lichy$", "ODD", 0), ("plain", "^sudy$", "EVEN", 0)],
        "DC": [("both", "^[13]:remiza nebo ", "BAD", 0), ("both", "^[23]:.* nebo remiza$", "BAD", 0), ("both", "^1:.* nebo remiza$", "HOME_DRAW", 0), ("both", "^2:remiza nebo ", "DRAW_AWAY", 0), ("both", "^3:.* nebo ", "HOME_AWAY", 0)],
    },
    "betano": {
        "RESULT": [("label", "^1$", "HOME", 0), ("label", "^x$", "DRAW", 0), ("label", "^2$", "AWAY", 0), ("place", "^0$", "HOME", 0), ("place", "^1$", "DRAW", 0), ("place", "^2$", "AWAY", 0)],
        "DC": [("label", p, s, 0) for p, s in _PLAIN["DC"]],
        "SIDES": [("place", "^0$", "HOME", 0), ("place", "^1$", "AWAY", 0)],
        "HANDICAP": [("place", "^0$", "HOME", 0), ("place", "^1$", "AWAY", 0)],
        "TOTAL": [("label", "^(více|over)", "OVER", 0), ("label", "^(méně|under)", "UNDER", 0)],
        "BTTS": [("label", "^(ano|yes)", "YES", 0), ("label", "^(ne|no)$", "NO", 0)],
    },
    "synot": {
        **{k: [("label", p, s, 0) for p, s in v] for k, v in {"RESULT": [("^1$", "HOME"), ("^0$", "DRAW"), ("^2$", "AWAY")], "SIDES": _PLAIN["SIDES"], "DC": [("^10$", "HOME_DRAW"), ("^12$", "HOME_AWAY"), ("^02$", "DRAW_AWAY")]}.items()},
        "BTTS": [("label", "^ano$", "YES", 0), ("label", "^ne$", "NO", 0)],
        "OE": [("label", "^lichá$", "ODD", 0), ("label", "^sudá$", "EVEN", 0)],
        "TOTAL": [("label", rf"^nad \(([+-]?{_NUMBER})\)$", "OVER", 1), ("label", rf"^pod \(([+-]?{_NUMBER})\)$", "UNDER", 1)],
        "HANDICAP": [("label", rf"^tým 1 \(([+-]?{_NUMBER})\)$", "HOME", 1), ("label", rf"^tým 2 \(([+-]?{_NUMBER})\)$", "AWAY", 1)],
    },
}
FAMILY = {"1X2": "RESULT", "ML": "SIDES", "DNB": "SIDES", "OU": "TOTAL", "OU_HOME": "TOTAL", "OU_AWAY": "TOTAL", "OU_SETS": "TOTAL", "AH": "HANDICAP", "AH_SETS": "HANDICAP", "BTTS": "BTTS", "OE": "OE", "DC": "DC"}
WHOLE = {"RESULT": 3, "DC": 3}


@dataclass(frozen=True)
class Policy:
    """What a feed's markets have in common."""

    counted: bool = True  # a market needs all its outcomes
    partial_dc: bool = False  # but double chance, whose outcomes are bets of their own
    bad_odds: str = "drop"  # an outcome without a price: drop the market, or skip the outcome
    home_line: bool = False  # a handicap's line is the home side's; the other's is not looked at
    half_lines: bool = True  # quarter lines are left out
    own_state: bool = False  # a market is open as it says itself, whatever its outcomes say
    foreign: str = "^$"  # names never read (the empty name is no name)
    extra_time: str = r"(?i)prodl|nájezd|extra směn|including ot"


# Names that are never mapped.
_REST = r"(?i)zbyt(?:ek|ku|kem)|zbývající|po \d+\s*minut|mega kurz|\bako\b|\d+\.\s*gól|další gól|postup|s remízou|rozstřel|přesný|první dosáhne|kdo dá|prvních \d+ směn|\d+\.\s*směn|zlat\S* set|golden set"
POLICIES = {
    "fortuna": Policy(counted=False, bad_odds="skip", half_lines=False),
    "sazka": Policy(partial_dc=True, bad_odds="skip", own_state=True, foreign=_REST),
    "betano": Policy(home_line=True, half_lines=False),
    "synot": Policy(partial_dc=True),
}
PERIODS = {"P": ("třetin|period", 3), "Q": ("čtvrtin|quarter", 4), "S": ("set", 5), "H": ("poločas|half", 2)}


def rule_rows(feed: str) -> list[tuple]:
    """(feed, rank, sport, code, type, scope, name pattern)."""
    lines = [line.split(None, 4) for line in RULES[feed].strip().splitlines()]
    return [(feed, i, sport, code, kind, scope, *(rest or [""])) for i, (sport, code, kind, scope, *rest) in enumerate(lines)]


def reader_rows(feed: str) -> list[tuple]:
    """(feed, family, rank, field, pattern, selection, line's group)."""
    return [(feed, family, i, *r) for family, readers in READERS[feed].items() for i, r in enumerate(readers)]


RULE_SCHEMA = "feed string, rank int, rule_sport string, rule_code string, type string, rule_scope string, name_pattern string"
READER_SCHEMA = "feed string, family string, reader int, field string, pattern string, sel string, line_group int"
MARKET = ["feed", "event_id", "market_id", "unit"]


def _by_feed(name: str) -> Column:
    return reduce(lambda c, f: c.when(F.col("feed") == f, F.lit(getattr(POLICIES[f], name))), POLICIES, F.when(F.lit(False), F.lit(getattr(Policy(), name))))


def _scope() -> Column:
    """The scope that rule and name give; null: none."""
    name, rule = F.col("name"), F.col("rule_scope")
    number = lambda words: F.regexp_extract(name, rf"(?i)(?:(\d)\.\s*(?:{words})|\b(?:{words})\w*\s*(\d)\b)", 0)
    digit = lambda words: F.regexp_extract(number(words), r"(\d)", 1)
    out = F.when(rule.startswith("?"), F.when(name.rlike(r"(?i)do rozhodnut|včetně prodl|vč\. prodl|including ot"), "MATCH").when(name.rlike(r"(?i)60 minut|základní hrací dob|bez prodl"), "REG").otherwise(F.nullif(F.substring(rule, 2, 9), F.lit(""))))
    for prefix, (words, most) in PERIODS.items():
        n = digit(words)
        out = out.when(rule == prefix, F.when(n.between("1", str(most)), F.concat(F.lit(prefix), n)))
        # a fixed period must not be another one by name
        out = out.when((F.length(rule) == 2) & rule.startswith(prefix), F.when((n == "") | (F.concat(F.lit(prefix), n) == rule), rule))
    return out.otherwise(rule)


def _forms(pattern: str) -> list[tuple[str | None, str]]:
    """(side, pattern) to try in order: a side's name at the start of a value is replaced by a mark there and here, so that patterns stay
    constants and are compiled once. A pattern that can't be put so comes back whole, with side ``*``."""
    if "{home}" not in pattern and "{away}" not in pattern:
        return [(None, pattern)]
    at = re.fullmatch(r"\^(?:\(\?:([^(){}]*)\|)?\{(home|away)\}(\))?((?:(?!\\b|\(\?<|\{home|\{away).)*)", pattern)
    if not at or bool(at[3]) != (at[1] is not None):
        return [("*", pattern)]
    plain = [(None, f"^(?:{at[1]}){at[4]}")] if at[1] is not None else []
    return [*plain, (at[2], f"^{_MARK}{at[4]}")]


_MARK = "\x01"


def _readings(readers: list) -> tuple[Column, Column, Column, Column]:
    """The first reader of an outcome's feed and family that fits, by number (column ``_fit``); of it: selection, text of the line, and
    whether it takes the line from the text."""
    quoted = lambda x: F.concat(F.lit(r"\Q"), x, F.lit(r"\E"))
    first, sels, lines = {}, {}, {}
    for r in sorted(readers, key=lambda r: (r.feed, r.family, r.reader)):
        value, kind = F.col(f"_{r.field}"), "plain" if r.field == "plain" else "label"
        for side, pattern in _forms(r.pattern):
            where, by = value, F.lit(pattern)
            if side == "*":
                for who in ("home", "away"):
                    by = F.replace(by, F.lit(f"{{{who}}}"), quoted(F.col(f"_{kind}_{who}")))
            elif side:
                name = F.col(f"_{kind}_{side}")
                where = F.when(F.startswith(value, name), F.concat(F.lit(_MARK), F.substring(value, F.length(name) + 1, F.length(value))))
            n = len(sels)
            sels[n] = r.sel
            if r.line_group > 0:
                lines[n] = F.call_function("regexp_extract", where, by, F.lit(1))
            first.setdefault(r.feed, {}).setdefault(r.family, []).append((F.rlike(where, by), n))
    chain = lambda cases: reduce(lambda c, x: c.when(*x), cases, F.when(F.lit(False), F.lit(None)))
    fit = chain([(F.col("feed") == f, chain([(F.col("family") == k, chain([(c, F.lit(n)) for c, n in own])) for k, own in of.items()])) for f, of in first.items()])
    by_sel: dict = {}
    for n, sel in sels.items():
        by_sel.setdefault(sel, []).append(n)
    return fit, chain([(F.col("_fit").isin(*ns), F.lit(sel)) for sel, ns in by_sel.items()]), chain([(F.col("_fit") == n, c) for n, c in lines.items()]), F.col("_fit").isin(*lines)


def mapped(outcomes: DataFrame, rules: DataFrame, readers: DataFrame) -> DataFrame:
    """(feed, event_id, market, market_open, sel, odds, is_open, market_id): the markets that the rules understand.

    ``outcomes``, one row each: ``feed, event_id, sport, home, away, market_id, unit`` (a line of a market that has several), ``at`` (order of
    markets), ``code, name, market_open, place`` (of the outcome, from 0), ``label, sub, stated, odds, is_open``. Hidden markets and outcomes,
    alternatives and variants are no rows. Two markets of one key: the first stands.

    ``rules`` and ``readers`` are hundreds of rows: rules are broadcast, readers become one expression whose patterns are constants (a
    pattern that is a column would be compiled for every row). All windows share one shuffle by event.
    """
    patterns = [r[0] for r in rules.select("name_pattern").distinct().collect()]
    named = outcomes.join(F.broadcast(rules.withColumnsRenamed({"rule_sport": "sport", "rule_code": "code"})), ["feed", "sport", "code"])
    of_name = reduce(lambda c, p: c.when(F.col("name_pattern") == p, F.rlike("name", F.lit(p))), [p for p in patterns if p], F.when(F.col("name_pattern") == "", F.lit(True)))
    foreign = reduce(lambda c, f: c.when(F.col("feed") == f, F.rlike("name", F.lit(POLICIES[f].foreign))), POLICIES, F.when(F.lit(False), F.lit(False))).otherwise(F.rlike("name", F.lit(Policy.foreign)))
    named = named.where(of_name).where(~foreign).withColumn("scope", _scope())
    # double chance and what ends in regular time say nothing of extra time
    level = (F.col("type") == "DC") | ((F.col("feed") == "synot") & (F.col("scope") != "MATCH"))
    beyond = reduce(lambda c, f: c.when(F.col("feed") == f, F.rlike("name", F.lit(POLICIES[f].extra_time))), POLICIES, F.when(F.lit(False), F.lit(False))).otherwise(F.rlike("name", F.lit(Policy.extra_time)))
    counts = F.coalesce(F.col("scope").isNotNull() & ~(level & beyond), F.lit(False))
    family = reduce(lambda c, kv: c.when(F.col("type") == kv[0], kv[1]), FAMILY.items(), F.when(F.lit(False), "")).alias("family")
    label = F.trim(F.lower("label"))
    fields = {"label": label, "sub": F.lower("sub"), "plain": fold(F.col("label")), "place": F.col("place").cast("string")}
    keys = [*MARKET, "at", "rank", "type", "scope", "market_open", "odds", "is_open"]
    own = named.select(*keys, "stated", counts.alias("counts"), family, "home", "away", *[c.alias(f"_{n}") for n, c in fields.items()])
    own = own.withColumn("_both", F.concat_ws(":", "_sub", "_plain"))
    own = own.withColumns({f"_{n}_{side}": c(F.col(side)) for side in ("home", "away") for n, c in (("label", lambda x: F.trim(F.lower(x))), ("plain", fold))})
    fit, sel, text, in_text = _readings(readers.collect())
    # without the names of both sides nothing is read
    tried = own.withColumn("_fit", F.when(F.col("home").isNotNull() & F.col("away").isNotNull(), fit))
    line = F.when(in_text, F.regexp_replace(F.translate(text, ",", "."), r"\s", "").cast("double")).when(F.col("_fit").isNotNull(), F.col("stated"))
    lined, mirrored = F.col("family").isin("TOTAL", "HANDICAP"), F.col("family") == "HANDICAP"
    got = tried.select(*keys, "counts", "family", sel.alias("sel"), F.when(lined, line).alias("line"), F.coalesce(F.col("odds").between(1.01, 1000), F.lit(False)).alias("priced"))

    market = Window.partitionBy(*MARKET)
    dealt = got.repartition("feed", "event_id").withColumn("_first", F.min("rank").over(market)).where("rank = _first AND counts")
    # what spoils a market
    from_home = F.when(F.col("sel") == "HOME", F.col("line")).when(F.col("sel") == "AWAY", -F.col("line")).otherwise(F.col("line"))
    looked_at = ~(_by_feed("home_line") & mirrored & (F.col("sel") != "HOME"))
    one = dealt.withColumns({"own_line": F.when(looked_at, F.when(mirrored, from_home).otherwise(F.col("line"))), "lacking": lined & looked_at & F.col("line").isNull()})
    whole = reduce(lambda c, kv: c.when(F.col("family") == kv[0], kv[1]), WHOLE.items(), F.when(F.lit(False), 0)).otherwise(2)
    per = {
        "unread": F.bool_or(F.col("sel").isNull() | (F.col("sel") == "BAD") | F.col("lacking")), "n": F.count(F.lit(1)), "sels": F.collect_set("sel"),
        "unpriced": F.bool_or(~F.col("priced")), "prices": F.count(F.when(F.col("priced"), 1)), "low": F.min("own_line"), "high": F.max("own_line"), "any_open": F.bool_or(F.when(F.col("priced"), F.col("is_open")))}
    seen = one.withColumns({n: c.over(market) for n, c in per.items()})
    partial = (F.col("family") == "DC") & _by_feed("partial_dc")
    spoilt = F.col("unread") | (F.size("sels") < F.col("n")) | (F.coalesce(F.col("low") != F.col("high"), F.lit(False))) | (F.col("prices") == 0)
    spoilt = spoilt | (_by_feed("counted") & ~partial & (F.col("n") != whole)) | ((_by_feed("bad_odds") == "drop") & ~partial & F.col("unpriced"))
    # a handicap needs both sides, to be seen from home
    spoilt = spoilt | ((F.col("family") == "HANDICAP") & (F.size("sels") < 2)) | ((F.col("family") == "TOTAL") & (F.col("low") < 0)) | (_by_feed("half_lines") & F.coalesce((F.col("low") * 2) != F.floor(F.col("low") * 2), F.lit(False)))
    kept = seen.where("priced").where(~F.coalesce(spoilt, F.lit(False))).withColumn("market", market_key(F.col("type"), F.col("scope"), F.col("low")))
    kept = kept.withColumn("market_open", F.col("market_open") & (_by_feed("own_state") | F.col("any_open")))
    place = F.min(F.struct("at", "market_id", "unit")).over(Window.partitionBy("feed", "event_id", "market"))
    kept = kept.withColumn("_stands", place).where("_stands.at = at AND _stands.market_id = market_id AND _stands.unit = unit")
    return kept.select("feed", "event_id", "market", "market_open", "sel", "odds", "is_open", "market_id")


def tables(spark: SparkSession, feeds: tuple[str, ...] = tuple(RULES)) -> tuple[DataFrame, DataFrame]:
    """Rules and readers of the feeds."""
    return spark.createDataFrame([r for f in feeds for r in rule_rows(f)], RULE_SCHEMA), spark.createDataFrame([r for f in feeds for r in reader_rows(f)], READER_SCHEMA)
