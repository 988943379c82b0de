"""The domain's relations derived from the test tables, as DataFrames and as the same text for the SQL oracles.

Expressions are written once; ``{ms:...}`` is the one thing the dialects spell differently.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import millis

EVENTS = 4000
MARKETS = ("1X2|REG", "DC|REG", "AH|REG|-0.5", "AH|REG|0.5", "DNB|REG", "OU|REG|2.5", "ML|MATCH", "AH|MATCH|-0.5")

_SPORT = "CASE {e} % 4 WHEN 0 THEN 'football' WHEN 1 THEN 'hockey' WHEN 2 THEN 'basketball' ELSE 'tennis' END"
_MODE = "CASE {e} % 3 WHEN 0 THEN 'PREMATCH' WHEN 1 THEN 'PAUSED' ELSE 'LIVE' END"

QUOTES = ("lineitem", {
    "event_id": f"l_orderkey % {EVENTS}",
    "sport": _SPORT.format(e="l_orderkey"),
    "mode": _MODE.format(e=f"(l_orderkey % {EVENTS})"),
    "bk": "CAST(l_suppkey % 9 AS INT)",
    "market": "CASE l_linenumber WHEN 1 THEN '1X2|REG' WHEN 2 THEN '1X2|REG' WHEN 3 THEN 'DC|REG' WHEN 4 THEN 'AH|REG|-0.5' WHEN 5 THEN 'AH|REG|0.5' WHEN 6 THEN 'DNB|REG' ELSE 'OU|REG|2.5' END",
    "sel": "CASE WHEN l_linenumber <= 2 THEN CASE l_partkey % 3 WHEN 0 THEN 'HOME' WHEN 1 THEN 'DRAW' ELSE 'AWAY' END "
           "WHEN l_linenumber = 3 THEN CASE l_partkey % 3 WHEN 0 THEN 'HOME_DRAW' WHEN 1 THEN 'HOME_AWAY' ELSE 'DRAW_AWAY' END "
           "WHEN l_linenumber = 7 THEN CASE l_partkey % 2 WHEN 0 THEN 'OVER' ELSE 'UNDER' END "
           "ELSE CASE l_partkey % 2 WHEN 0 THEN 'HOME' ELSE 'AWAY' END END",
    "odds": "CAST(101 + CAST(floor(l_extendedprice) AS BIGINT) % 240 AS DOUBLE) / 100",
    "is_open": "CAST(floor(l_quantity) AS BIGINT) % 10 <> 0",
    "changed_at": "{ms:l_shipdate}",
    "seen_at": "{ms:l_shipdate} + (l_partkey % 40) * 86400000",
    "u1": "l_orderkey",
    "u2": "l_linenumber",
    "u3": "l_partkey",
    "u4": "l_suppkey",
})

ARBS = ("orders", {
    "arb_id": "o_orderkey",
    "first_seen": "{ms:o_orderdate} + (o_custkey % 86400) * 1000",
    "last_seen": "{ms:o_orderdate} + (o_custkey % 86400) * 1000 + CAST(floor(o_totalprice) AS BIGINT) % 900000",
    "duration_ms": "CAST(floor(o_totalprice) AS BIGINT) % 900000",
    "end_reason": "CASE WHEN o_orderkey % 17 = 0 THEN NULL WHEN o_orderkey % 5 = 0 THEN 'suspended' WHEN o_orderkey % 5 = 1 THEN 'leg_odds_changed:' || CASE o_custkey % 3 WHEN 0 THEN 'fortuna' WHEN 1 THEN 'sazka' ELSE 'betx' END WHEN o_orderkey % 5 = 2 THEN 'stale:synot' WHEN o_orderkey % 5 = 3 THEN 'event_started' ELSE 'leg_odds_changed:chance' END",
    "sport": _SPORT.format(e="o_custkey"),
    "mode": _MODE.format(e="o_orderkey"),
    "mtype": "CASE o_orderpriority WHEN '1-URGENT' THEN '1X2' WHEN '2-HIGH' THEN 'OU' WHEN '3-MEDIUM' THEN 'H_DA' ELSE 'DNB' END",
    "pair": "CASE o_custkey % 5 WHEN 0 THEN 'betx|chance' WHEN 1 THEN 'fortuna|sazka' WHEN 2 THEN 'sazka|synot' WHEN 3 THEN 'betx|fortuna' ELSE 'chance|kingsbet' END",
    "margin": "CAST(50 + CAST(floor(o_totalprice) AS BIGINT) % 700 AS DOUBLE) / 100",
    "reaction_ms": "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(floor(o_totalprice) AS BIGINT) % 20000 END",
    "muted": "o_orderpriority = '5-LOW'",
})

LEGS = ("lineitem", {
    "arb_id": "l_orderkey",
    "leg": "l_linenumber",
    "bk": "CAST(l_suppkey % 9 AS INT)",
    "odds": "CAST(101 + CAST(floor(l_extendedprice) AS BIGINT) % 240 AS DOUBLE) / 100",
    "partkey": "l_partkey",
})

ACTIONS = ("lineitem", {
    "arb_id": "l_orderkey",
    "action": "CASE l_returnflag WHEN 'A' THEN 'rejected' WHEN 'R' THEN 'placed' ELSE 'expired' END",
    "ts": "{ms:l_shipdate}",
    "bk": "CAST(l_suppkey % 9 AS INT)",
    "stake": "CAST(floor(l_quantity) AS DOUBLE) * 10",
    "actual": "CAST(101 + CAST(floor(l_extendedprice) AS BIGINT) % 237 AS DOUBLE) / 100",
    "click_margin": "CASE WHEN l_linenumber = 1 THEN NULL ELSE CAST(CAST(floor(l_extendedprice) AS BIGINT) % 500 AS DOUBLE) / 100 END",
    "reaction_ms": "CAST(floor(l_extendedprice) AS BIGINT) % 15000",
    "settled": "CASE l_linestatus WHEN 'F' THEN CASE l_linenumber % 3 WHEN 0 THEN 'won' WHEN 1 THEN 'void' ELSE 'lost' END ELSE NULL END",
    "uid": "l_orderkey * 1000003 + l_partkey * 1009 + l_suppkey * 11 + l_linenumber",
})

FEED = ("events", {
    "event_id": "user_id",
    "bk": "CAST(event_id % 9 AS INT)",
    "market": "event_type",
    "odds": "CAST(101 + CAST(floor(value * 10) AS BIGINT) % 300 AS DOUBLE) / 100",
    "fetched_at": "{ms:ts}",
    "uid": "event_id",
    "live": "event_id % 4 = 0",
    "finished": "event_id % 11 = 0",
    "has_break": "event_id % 3 = 0",
})

REPORTS = FEED


def sql(relation: tuple[str, dict[str, str]]) -> str:
    """The relation as a DuckDB query."""
    table, columns = relation
    return "SELECT " + ", ".join(f"{re.sub(r'{ms:(\w+)}', r'(epoch_us(\1) // 1000)', e)} AS {n}" for n, e in columns.items()) + f" FROM {table}"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def relation(spark: SparkSession, sf_dir: str, which: tuple[str, dict[str, str]]) -> DataFrame:
    table, columns = which
    df = read(spark, sf_dir, table)
    times = sorted({m for e in columns.values() for m in re.findall(r"{ms:(\w+)}", e)})
    df = df.withColumns({f"_ms_{t}": millis(F.col(t)) for t in times})
    return df.selectExpr(*[f"{re.sub(r'{ms:(\w+)}', r'_ms_\1', e)} AS {n}" for n, e in columns.items()])


def group_values(rows: list[tuple]) -> str:
    """The group dimension as VALUES for an oracle."""
    quoted = ["(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows]
    return "VALUES " + ", ".join(quoted)
