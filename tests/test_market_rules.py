"""Markets of feeds: what is understood, and what is left out as a whole."""

import pytest

from oddsloom.plans import catalog
from oddsloom.sources import market_rules

SCHEMA = "feed string, event_id long, sport string, home string, away string, market_id string, unit string, at long, code string, name string, market_open boolean, place int, label string, sub string, stated double, odds double, is_open boolean"


def market(feed, sport, code, name, *outcomes, unit="", number=1, market_open=True, home="Slavia Praha", away="Sparta (B)"):
    """Outcomes: (label, odds) and, if stated, sub, line, open."""
    out = []
    for i, (label, odds, *more) in enumerate(outcomes):
        sub, line, is_open = (*more, *(None, None, True)[len(more) :])
        out.append((feed, 1, sport, home, away, f"m{number}", unit, number, code, name, market_open, i, label, sub, line, odds, is_open))
    return out


def read(spark, *markets):
    rows = [r for m in markets for r in m]
    got = market_rules.mapped(spark.createDataFrame(rows, SCHEMA), *market_rules.tables(spark)).collect()
    out = {}
    for r in sorted(got, key=lambda r: (r.market, r.sel)):
        out.setdefault((r.market, r.market_open), {})[r.sel] = r.odds if r.is_open else None
    return out


def test_fortuna(spark):
    f = lambda *a, **k: market("fortuna", *a, **k)
    got = read(
        spark, f("football", "00-00", "Výsledek zápasu", ("1", 1.8), ("0", 3.4), ("2", 5.1)), f("football", "00-0u", "Počet gólů", ("+ 2.5", 1.9), ("- 2,5", 1.95), number=2),
        f("football", "00-0b", "Handicap", ("Slavia Praha (-1)", 1.9), ("2 (+1)", 1.9), number=3), f("football", "00-01", "Dvojtip", ("10", 1.2), ("12", 1.3), ("02", 2.0, None, None, False), number=4),
        f("hockey", "0w-0l", "2. třetina - Počet gólů", ("+ 1.5", 1.8), ("- 1.5", 2.0), number=5), f("tennis", "0x-0e", "Vítěz 3.setu", ("1", 1.7), ("2", 0.5), number=6))
    assert got == {
        ("1X2|REG", True): {"HOME": 1.8, "DRAW": 3.4, "AWAY": 5.1}, ("OU|REG|2.5", True): {"OVER": 1.9, "UNDER": 1.95}, ("AH|REG|-1", True): {"HOME": 1.9, "AWAY": 1.9},
        ("DC|REG", True): {"HOME_DRAW": 1.2, "HOME_AWAY": 1.3, "DRAW_AWAY": None}, ("OU|P2|1.5", True): {"OVER": 1.8, "UNDER": 2.0}, ("ML|S3", True): {"HOME": 1.7}}


@pytest.mark.parametrize("spoilt", [
    ("football", "00-00", "Výsledek", ("1", 1.8), ("nikdo", 3.4), ("2", 5.1)),  # an outcome that is not known
    ("football", "00-00", "Výsledek", ("1", 1.8), ("1", 3.4)),  # one twice
    ("football", "00-0u", "Počet gólů", ("+ 2.5", 1.9), ("- 3.5", 1.9)),  # two lines
    ("football", "00-0b", "Handicap", ("1 (-1)", 1.9), ("2 (-1)", 1.9)),  # no mirror
    ("football", "00-0b", "Handicap", ("Slavia (-1)", 1.9), ("2 (+1)", 1.9)),  # another name
    ("football", "00-2d", "Výsledek 2. poločasu", ("1", 1.8), ("0", 2.0), ("2", 5.1)),  # the first half by code
    ("hockey", "0w-0l", "4. třetina", ("+ 1.5", 1.9), ("- 1.5", 1.9)),  # there is none
    ("hockey", "00-00", "Výsledek", ("1", 1.8), ("0", 3.4), ("2", 5.1))])  # a code of another sport
def test_fortuna_leaves_whole_markets_out(spark, spoilt):
    assert read(spark, market("fortuna", *spoilt), market("fortuna", "football", "00-1c", "Oba dají gól", ("Ano", 1.7), ("Ne", 2.1), number=9)) == {("BTTS|REG", True): {"YES": 1.7, "NO": 2.1}}


def test_sazka(spark):
    s = lambda *a, **k: market("sazka", *a, **k)
    got = read(
        spark, s("football", "MATCH_RESULT", "Výsledek", ("Slavia Praha", 1.8), ("Remíza", 3.4), ("x", 5.1, "A")), s("hockey", "MONEY_LINE", "Vítěz", ("a", 1.5, "H"), ("b", 2.5, "A"), number=2),
        s("hockey", "TOTAL_GOALS_OVER/UNDER", "Počet gólů do rozhodnutí", ("Nad", 1.9, None, 5.5), ("Pod", 1.9, None, 5.5), number=3), s("hockey", "HANDICAP_2_WAY", "Handicap (60 minut)", ("a", 1.9, "H", 1.5), ("b", 1.9, "A", -1.5), number=4),
        s("football", "DOUBLE_CHANCE", "Dvojtip", ("Slavia Praha nebo Remíza", 1.2, "1"), number=5, market_open=False), s("hockey", "PERIOD_WINNER_NTH_PERIOD", "2. třetina: vítěz", ("1", 2.0), ("X", 3.0), ("2", 4.0), number=6))
    assert got == {
        ("1X2|REG", True): {"HOME": 1.8, "DRAW": 3.4, "AWAY": 5.1}, ("ML|MATCH", True): {"HOME": 1.5, "AWAY": 2.5}, ("OU|MATCH|5.5", True): {"OVER": 1.9, "UNDER": 1.9}, ("AH|REG|1.5", True): {"HOME": 1.9, "AWAY": 1.9},
        ("DC|REG", False): {"HOME_DRAW": 1.2}, ("1X2|P2", True): {"HOME": 2.0, "DRAW": 3.0, "AWAY": 4.0}}
    nothing = [
        s("hockey", "TOTAL_GOALS_OVER/UNDER", "Počet gólů", ("Nad", 1.9, None, 5.5), ("Pod", 1.9, None, 5.5)), s("football", "MATCH_RESULT", "Výsledek zbytku zápasu", ("1", 1.8), ("X", 3.4), ("2", 5.1), number=2),
        s("football", "DOUBLE_CHANCE", "Dvojtip", ("Remíza nebo Sparta", 1.2, "1"), number=3), s("football", "MATCH_RESULT_1ST_HALF", "Výsledek", ("1", 1.8), ("2", 5.1), number=4), s("football", "ASIAN_HANDICAP", "Handicap", ("1", 1.9, "H", -0.25), ("2", 1.9, "A", 0.25), number=5)]
    assert read(spark, *nothing) == {}


def test_betano_and_synot(spark):
    b, s = (lambda *a, feed=feed, **k: market(feed, *a, **k) for feed in ("betano", "synot"))
    got = read(
        spark, b("tennis", "TGHC", "Handicap", ("Hráč A", 1.8, None, -3.5), ("Hráč B", 2.0, None, 3.5)), b("football", "HCTG", "Počet gólů", ("Více než", 1.8, None, 2.5), ("Méně než", 2.0, None, 2.5), number=2),
        b("football", "HCTG", "Počet gólů", ("Více než", 7.0, None, 2.5), ("Méně než", 7.0, None, 2.5), number=3), b("football", "MRES", "Výsledek", ("Slavia", 1.8), ("Remíza", 3.0), ("Sparta", 2.0), number=4),
        s("baseball", "294", "Handicap (včetně extra směn)", ("Tým 1 (-1.5)", 2.1), ("Tým 2 (+1.5)", 1.7), number=5, unit="a"), s("baseball", "294", "Handicap (včetně extra směn)", ("Tým 1 (-2.5)", 2.9), ("Tým 2 (+1.5)", 1.3), number=5, unit="b"),
        s("volleyball", "249", "4. set", ("1", 1.5), ("2", 2.4), number=6), s("volleyball", "249", "Zlatý set", ("1", 1.5), ("2", 2.4), number=7), s("snooker", "1277", "Počet framů", ("Nad (8.5)", 1.9), ("Pod (8.5)", 0.0), number=8))
    assert got == {
        ("AH|MATCH|-3.5", True): {"HOME": 1.8, "AWAY": 2.0}, ("OU|REG|2.5", True): {"OVER": 1.8, "UNDER": 2.0}, ("1X2|REG", True): {"HOME": 1.8, "DRAW": 3.0, "AWAY": 2.0}, ("AH|MATCH|-1.5", True): {"HOME": 2.1, "AWAY": 1.7}, ("ML|S4", True): {"HOME": 1.5, "AWAY": 2.4}}


def test_patterns_are_constants_and_markets_are_shuffled_once(spark, sf):
    plan = catalog.queries()["markets_sazka"](spark, sf)._jdf.queryExecution()
    assert "lambda" not in plan.optimizedPlan().toString() and plan.executedPlan().toString().count("Exchange hashpartitioning") <= 1


@pytest.mark.parametrize("name", ["Slavia (A)", "1", "S.K. [B]*"])
def test_names_are_no_patterns(spark, name):
    outcomes = (f"{name} (-1)", 1.9), ("2 (+1)", 1.9)
    assert read(spark, market("fortuna", "football", "00-0b", "Handicap", *outcomes, home=name)) == {("AH|REG|-1", True): {"HOME": 1.9, "AWAY": 1.9}}
    assert not read(spark, market("fortuna", "football", "00-0b", "Handicap", *outcomes, home=name + "x", away=None))
