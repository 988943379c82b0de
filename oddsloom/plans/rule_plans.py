"""Markets of four feeds by rules, over ``lineitem``: a row is a market, its outcomes are made from its numbers.

Each shape states its code, name and outcomes, when it is spoilt, and which market it is; the SQL gives what must come out and knows no rules.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import functions as F

from ..sources import market_rules
from . import bindings as B

_LINE = "CAST(p % 5 AS VARCHAR(9)) || '.5'"
_STATED = "(p % 5 + 0.5)"
_BAD = "s % 7 = 0"


@dataclass(frozen=True)
class Shape:
    sport: str
    code: str
    name: str
    labels: tuple[str, ...]
    sels: tuple[str, ...]
    key: str
    good: str = f"NOT ({_BAD})"
    subs: tuple[str, ...] = ()
    stated: tuple[str, ...] = ()


def _of(*labels: str) -> tuple[str, ...]:
    return tuple(f"'{x}'" for x in labels)


def _or(bad: str, good: str) -> str:
    return f"CASE WHEN {_BAD} THEN {bad} ELSE {good} END"


_X, _SIDES, _TOTAL = ("HOME", "DRAW", "AWAY"), ("HOME", "AWAY"), ("OVER", "UNDER")
_DC = ("HOME_DRAW", "HOME_AWAY", "DRAW_AWAY")
SHAPES = {
    "fortuna": [
        Shape("football", "00-00", "'Výsledek zápasu'", ("'1'", "'0'", _or("'nikdo'", "'2'")), _X, "'1X2|REG'"),
        Shape("football", "00-0u", "'Počet gólů'", (f"'+ ' || {_LINE}", f"'- ' || {_or(repr('7.5'), _LINE)}"), _TOTAL, f"'OU|REG|' || {_LINE}"),
        Shape("football", "00-0b", "'Handicap'", (f"'Slavia (A) (-' || {_LINE} || ')'", f"{_or(repr('2 (-'), repr('2 (+'))} || {_LINE} || ')'"), _SIDES, f"'AH|REG|-' || {_LINE}"),
        Shape("hockey", "0w-0l", "CAST(s % 5 AS VARCHAR(9)) || '. třetina - Počet gólů'", (f"'+ ' || {_LINE}", f"'- ' || {_LINE}"), _TOTAL, f"'OU|P' || CAST(s % 5 AS VARCHAR(9)) || '|' || {_LINE}", "s % 5 BETWEEN 1 AND 3"),
        Shape("football", "00-2d", f"CAST(s % 2 + 1 AS VARCHAR(9)) || '. poločas'", _of("1", "x", "2"), _X, "'1X2|H1'", "s % 2 = 0"),
        Shape("football", "00-01", "'Dvojtip'", _of("10", "12", "02"), _DC, "'DC|REG'", "true"),
    ],
    "sazka": [
        Shape("football", "MATCH_RESULT", _or("'Výsledek zbytku zápasu'", "'Výsledek'"), _of("Slavia (A)", "Remíza", "Sparta"), _X, "'1X2|REG'"),
        Shape("hockey", "MONEY_LINE", _or("'Vítěz (60 minut)'", "'Vítěz'"), _of("a", "b"), _SIDES, "CASE WHEN s % 7 = 0 THEN 'ML|REG' ELSE 'ML|MATCH' END", "true", subs=_of("H", "A")),
        Shape("hockey", "TOTAL_GOALS_OVER/UNDER", _or("'Počet gólů'", "'Počet gólů do rozhodnutí'"), _of("Nad", "Pod"), _TOTAL, f"'OU|MATCH|' || {_LINE}", stated=(_STATED, _STATED)),
        Shape("hockey", "HANDICAP_2_WAY", "'Handicap bez prodloužení'", _of("1", "2"), _SIDES, f"'AH|REG|' || {_LINE}", stated=(_STATED, f"({_or('p % 5 + 0.5', '-(p % 5) - 0.5')})")),
        Shape("football", "DOUBLE_CHANCE", "'Dvojtip'", (f"{_or(repr('Remíza nebo Slavia'), repr('Slavia nebo Remíza'))}", "'Slavia nebo Sparta'"), _DC[:2], "'DC|REG'", subs=_of("1", "3")),
        Shape("basketball", "MATCH_RESULT", "'Výsledek'", ("'1'", "'X'", _or("'X'", "'2'")), _X, "'1X2|REG'"),
    ],
    "betano": [
        Shape("football", "MRES", "'Výsledek'", ("'Slavia'", "'Remíza'", _or("'x'", "'Sparta'")), _X, "'1X2|REG'"),
        Shape("football", "HCTG", "'Počet gólů'", _of("Více než", "Méně než"), _TOTAL, f"'OU|REG|' || {_LINE}", stated=(_STATED, f"({_or('p % 5 + 1.5', 'p % 5 + 0.5')})")),
        Shape("tennis", "TGHC", "'Handicap'", _of("Hráč A", "Hráč B"), _SIDES, f"'AH|MATCH|' || {_LINE}", "true", stated=(_STATED, "99.5")),
        Shape("football", "BTSC", "'Oba'", ("'Ano'", _or("'Možná'", "'Ne'")), ("YES", "NO"), "'BTTS|REG'"),
        Shape("hockey", "DBLC", "'Dvojitá šance'", ("'1X'", "'12'", _or("'3X'", "'X2'")), _DC, "'DC|REG'"),
        Shape("hockey", "BTSC", "'Oba'", _of("Ano", "Ne"), ("YES", "NO"), "'BTTS|REG'", "false"),
    ],
    "synot": [
        Shape("baseball", "294", "'Handicap (včetně extra směn)'", (f"'Tým 1 (-' || {_LINE} || ')'", f"'Tým 2 (+' || {_or(repr('8.5'), _LINE)} || ')'"), _SIDES, f"'AH|MATCH|-' || {_LINE}"),
        Shape("baseball", "295", _or("'Počet bodů'", "'Počet bodů (včetně extra směn)'"), (f"'Nad (' || {_LINE} || ')'", f"'Pod (' || {_LINE} || ')'"), _TOTAL, f"'OU|MATCH|' || {_LINE}"),
        Shape("volleyball", "249", "CAST(s % 7 AS VARCHAR(9)) || '. set'", _of("1", "2"), _SIDES, "'ML|S' || CAST(s % 7 AS VARCHAR(9))", "s % 7 BETWEEN 1 AND 5"),
        Shape("baseball", "298", "'Lichá/Sudá - Počet bodů (včetně extra směn)'", ("'Lichá'", _or("'Lichá'", "'Sudá'")), ("ODD", "EVEN"), "'OE|MATCH'"),
        Shape("snooker", "1277", "'Počet framů'", (f"'Nad (' || {_or(repr('2.25'), _LINE)} || ')'", f"'Pod (' || {_or(repr('2.25'), _LINE)} || ')'"), _TOTAL, f"'OU|MATCH|' || {_LINE}"),
        Shape("darts", "178", "'Vítěz zápasu'", _of("1", "2"), _SIDES, "'ML|MATCH'", "false"),
    ],
}
_MARKETS = ("lineitem", {"event_id": "l_orderkey", "number": "(l_partkey * 100000 + l_suppkey) * 10 + l_linenumber", "p": "l_partkey", "s": "l_suppkey", "kind": "l_partkey % 6", "price": "CAST(floor(l_extendedprice) AS BIGINT) % 240", "half": "CAST(floor(l_quantity) AS BIGINT) % 10"})


def _pick(feed: str, of) -> str:
    return "CASE kind " + " ".join(f"WHEN {i} THEN {of(s)}" for i, s in enumerate(SHAPES[feed])) + " END"


def _nth(values: tuple[str, ...], n: int, none: str) -> str:
    return values[n] if n < len(values) else none


def _outcomes(feed: str) -> str:
    """An outcome a row, in either dialect, over relation ``m``."""
    one = "SELECT event_id, number, kind, price, half, {sport} AS sport, {code} AS code, {name} AS name, {n} AS place, {label} AS label, {sub} AS sub, {stated} AS stated, {key} AS wanted, {sel} AS wanted_sel, {good} AS good, (101 + price + {n} * 10) / 100.0 AS odds, half <> {n} AS is_open FROM m WHERE {n} < {size}"
    text = lambda x: f"'{x}'"
    return " UNION ALL ".join(one.format(
        n=n, sport=_pick(feed, lambda s: text(s.sport)), code=_pick(feed, lambda s: text(s.code)), name=_pick(feed, lambda s: s.name), label=_pick(feed, lambda s: _nth(s.labels, n, "NULL")), sub=_pick(feed, lambda s: _nth(s.subs, n, "CAST(NULL AS VARCHAR(9))")),
        stated=_pick(feed, lambda s: f"CAST({_nth(s.stated, n, 'NULL')} AS DOUBLE)"), key=_pick(feed, lambda s: s.key), sel=_pick(feed, lambda s: text(_nth(s.sels, n, ""))), good=_pick(feed, lambda s: s.good), size=_pick(feed, lambda s: len(s.sels))) for n in range(3))


def _query(feed: str):
    def run(spark, sf_dir):
        B.relation(spark, sf_dir, _MARKETS).createOrReplaceTempView(view := f"markets_of_{feed}")
        rows = spark.sql(_outcomes(feed).replace(" FROM m ", f" FROM {view} "))
        rows = rows.select(
            F.lit(feed).alias("feed"), "event_id", "sport", F.lit("Slavia (A)").alias("home"), F.lit("Sparta").alias("away"), F.col("number").cast("string").alias("market_id"), F.lit("").alias("unit"), F.col("number").alias("at"), "code", "name",
            (F.col("half") < 9).alias("market_open"), F.col("place").cast("int").alias("place"), "label", "sub", "stated", F.col("odds").cast("double").alias("odds"), "is_open")
        return market_rules.mapped(rows, *market_rules.tables(spark, (feed,))).select("event_id", "market", "market_open", "sel", "odds", "is_open", "market_id")

    return run


def _sql(feed: str) -> str:
    own = market_rules.POLICIES[feed].own_state
    return f"""WITH m AS ({B.sql(_MARKETS)}), o AS ({_outcomes(feed)}),
k AS (SELECT *, min(number) OVER (PARTITION BY event_id, wanted) AS first, bool_or(is_open) OVER (PARTITION BY event_id, number) AS any_open FROM o WHERE good)
SELECT event_id, wanted AS market, half < 9 AND ({own} OR any_open) AS market_open, wanted_sel AS sel, CAST(odds AS DOUBLE) AS odds, is_open, CAST(number AS VARCHAR) AS market_id FROM k WHERE number = first"""


QUERIES = {f"markets_{feed}": (_query(feed), _sql(feed)) for feed in SHAPES}
