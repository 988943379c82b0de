"""Equivalence groups of bets: which quotes, across market types, may serve as a leg."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..domain import DRAW_SPORTS, LINE_TYPES, OUTCOMES, OVERLAPPING_TYPES, OVERTIME_SPORTS, SPORTS, SYNTHETIC_TYPES

SCHEMA = "sport string, group_key string, legs int, leg int, leg_sel string, src int, market string, sel string"


def is_three_way(sport: str, scope: str) -> bool:
    """Play that can end level: regular time or a period of a sport with draws."""
    return sport in DRAW_SPORTS and scope != "MATCH" and not scope.startswith("S")


def group_legs(sport: str, key: str) -> list[tuple[str, list[tuple[str, str]]]]:
    """Legs of a group with their sources, best source first; empty if the key makes no group."""
    kind, scope, *line = key.split("|")
    own = lambda sel: (f"{kind}|{scope}" + "".join(f"|{x}" for x in line), sel)
    at = lambda market, sel: (f"{market.split(':')[0]}|{scope}" + (f"|{market.split(':')[1]}" if ":" in market else ""), sel)
    if is_three_way(sport, scope):
        home = [at("1X2", "HOME"), at("AH:-0.5", "HOME")]
        away = [at("1X2", "AWAY"), at("AH:0.5", "AWAY")]
        crossed = {
            "1X2": [("HOME", home), ("DRAW", [at("1X2", "DRAW")]), ("AWAY", away)],
            "H_DA": [("HOME", home), ("DRAW_AWAY", [at("DC", "DRAW_AWAY"), at("AH:-0.5", "AWAY")])],
            "A_HD": [("AWAY", away), ("HOME_DRAW", [at("DC", "HOME_DRAW"), at("AH:0.5", "HOME")])],
            "D_HA": [("DRAW", [at("1X2", "DRAW")]), ("HOME_AWAY", [at("DC", "HOME_AWAY")])],
            "DNB": [(s, [at("DNB", s), at("AH:0", s)]) for s in ("HOME", "AWAY")],
        }
        if kind in crossed:
            return crossed[kind]
    if kind == "ML" and scope == "MATCH" and sport in OVERTIME_SPORTS:
        return [(s, [at("ML", s), at("AH:-0.5", s), at("AH:0.5", s)]) for s in ("HOME", "AWAY")]
    if kind in OVERLAPPING_TYPES or kind in SYNTHETIC_TYPES:
        return []
    return [(s, [own(s)]) for s in OUTCOMES[kind]]


def candidate_groups(sport: str, market: str) -> list[str]:
    """Groups to look at again when a market changes; a market that serves as a source only makes no group of its own."""
    kind, scope, *line = market.split("|")
    if is_three_way(sport, scope):
        split = {
            ("1X2", ""): ["1X2", "H_DA", "A_HD", "D_HA"],
            ("DC", ""): ["H_DA", "A_HD", "D_HA"],
            ("AH", "-0.5"): ["1X2", "H_DA"],
            ("AH", "0.5"): ["1X2", "A_HD"],
            ("AH", "0"): ["DNB"],
        }
        if (found := split.get((kind, "".join(line)))) is not None:
            return [f"{g}|{scope}" for g in found]
    if kind == "AH" and scope == "MATCH" and sport in OVERTIME_SPORTS and "".join(line) in ("-0.5", "0.5"):
        return ["ML|MATCH"]
    if kind in OVERLAPPING_TYPES:
        return []
    return [market]


def group_rows(sports: list[str], markets: list[str]) -> list[tuple]:
    """Rows of the group dimension for the markets present."""
    out = []
    for sport in sports:
        keys = sorted({g for m in markets for g in candidate_groups(sport, m)})
        for key in keys:
            legs = group_legs(sport, key)
            out += [(sport, key, len(legs), n, sel, k, *source) for n, (sel, sources) in enumerate(legs) for k, source in enumerate(sources)]
    return out


def group_dimension(spark: SparkSession, markets: list[str], sports: tuple[str, ...] = SPORTS) -> DataFrame:
    """The dimension as a table: sports times the distinct market keys (types, scopes and half lines: thousands at most)."""
    return spark.createDataFrame(group_rows(list(sports), markets), SCHEMA)


def affected_rows(sports: list[str], markets: list[str]) -> list[tuple]:
    return [(s, m, g) for s in sports for m in markets for g in candidate_groups(s, m)]


def line_types() -> tuple[str, ...]:
    return LINE_TYPES
