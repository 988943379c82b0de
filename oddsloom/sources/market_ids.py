"""Market and outcome numbers that several feeds share, as a dimension table.

A definition is (sport, number) -> type, scope, needed specifiers, and a word the market's name must hold, if any. The
dimension joins feeds by broadcast; what it lacks is dropped with the whole market.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import lookup, market_key

SCHEMA = "sport string, number int, mtype string, scope string, line_spec string, name_pattern string"

# Market numbers by sport and scope, each with its type, the specifier of its line, and a word its name must hold.
MARKETS = {
    "football": {
        "REG": [
            (1, "1X2", None, None),
            (10, "DC", None, None),
            (11, "DNB", None, None),
            (16, "AH", "hcp", None),
            (18, "OU", "total", None),
            (19, "OU_HOME", "total", None),
            (20, "OU_AWAY", "total", None),
            (26, "OE", None, None),
            (29, "BTTS", None, None),
        ],
        "H1": [
            (60, "1X2", None, None),
            (63, "DC", None, None),
            (64, "DNB", None, None),
            (66, "AH", "hcp", None),
            (68, "OU", "total", None),
            (69, "OU_HOME", "total", None),
            (70, "OU_AWAY", "total", None),
            (74, "OE", None, None),
            (75, "BTTS", None, None),
        ],
        "H2": [
            (83, "1X2", None, None),
            (85, "DC", None, None),
            (86, "DNB", None, None),
            (88, "AH", "hcp", None),
            (90, "OU", "total", None),
            (91, "OU_HOME", "total", None),
            (92, "OU_AWAY", "total", None),
            (94, "OE", None, None),
            (95, "BTTS", None, None),
        ],
    },
    "hockey": {
        "REG": [
            (1, "1X2", None, None),
            (10, "DC", None, None),
            (11, "DNB", None, None),
            (16, "AH", "hcp", None),
            (18, "OU", "total", None),
            (19, "OU_HOME", "total", None),
            (20, "OU_AWAY", "total", None),
            (26, "OE", None, None),
            (29, "BTTS", None, None),
        ],
        "MATCH": [
            (406, "ML", None, None),
            (410, "AH", "hcp", None),
            (412, "OU", "total", None),
        ],
        "P": [
            (443, "1X2", None, None),
            (446, "OU", "total", None),
            (452, "BTTS", None, None),
            (459, "DNB", None, None),
            (460, "AH", "hcp", None),
            (462, "OE", None, None),
            (529, "DC", None, None),
        ],
    },
    "basketball": {
        "REG": [
            (1, "1X2", None, None),
            (10, "DC", None, None),
            (11, "DNB", None, None),
            (16, "AH", "hcp", None),
            (18, "OU", "total", None),
            (19, "OU_HOME", "total", None),
            (20, "OU_AWAY", "total", None),
            (26, "OE", None, None),
            (29, "BTTS", None, None),
        ],
        "MATCH": [
            (219, "ML", None, None),
            (223, "AH", "hcp", None),
            (225, "OU", "total", None),
            (227, "OU_HOME", "total", None),
            (228, "OU_AWAY", "total", None),
            (229, "OE", None, None),
        ],
        "H1": [
            (60, "1X2", None, None),
            (63, "DC", None, None),
            (64, "DNB", None, None),
            (66, "AH", "hcp", None),
            (68, "OU", "total", None),
            (69, "OU_HOME", "total", None),
            (70, "OU_AWAY", "total", None),
        ],
        "Q": [
            (235, "1X2", None, None),
            (236, "OU", "total", None),
            (302, "DNB", None, None),
            (303, "AH", "hcp", None),
            (304, "OE", None, None),
        ],
    },
    "handball": {
        "REG": [
            (1, "1X2", None, None),
            (10, "DC", None, None),
            (11, "DNB", None, None),
            (16, "AH", "hcp", None),
            (18, "OU", "total", None),
            (19, "OU_HOME", "total", None),
            (20, "OU_AWAY", "total", None),
            (26, "OE", None, None),
        ],
        "H1": [
            (60, "1X2", None, None),
            (63, "DC", None, None),
            (64, "DNB", None, None),
            (66, "AH", "hcp", None),
            (68, "OU", "total", None),
            (69, "OU_HOME", "total", None),
            (70, "OU_AWAY", "total", None),
        ],
        "H2": [
            (83, "1X2", None, None),
            (85, "DC", None, None),
            (86, "DNB", None, None),
            (88, "AH", "hcp", None),
            (90, "OU", "total", None),
            (91, "OU_HOME", "total", None),
            (92, "OU_AWAY", "total", None),
        ],
    },
    "american_football": {
        "REG": [
            (1, "1X2", None, None),
        ],
        "MATCH": [
            (223, "AH", "hcp", None),
            (225, "OU", "total", None),
            (227, "OU_HOME", "total", None),
            (228, "OU_AWAY", "total", None),
            (229, "OE", None, None),
        ],
        "H1": [
            (60, "1X2", None, None),
            (63, "DC", None, None),
            (64, "DNB", None, None),
            (66, "AH", "hcp", None),
            (68, "OU", "total", None),
            (69, "OU_HOME", "total", None),
            (70, "OU_AWAY", "total", None),
        ],
        "H2": [
            (83, "1X2", None, None),
            (85, "DC", None, None),
        ],
        "Q": [
            (235, "1X2", None, None),
            (236, "OU", "total", None),
            (302, "DNB", None, None),
            (303, "AH", "hcp", None),
        ],
    },
    "tennis": {
        "MATCH": [
            (186, "ML", None, None),
            (187, "AH", "hcp", None),
            (188, "AH_SETS", "hcp", None),
            (189, "OU", "total", None),
            (190, "OU_HOME", "total", None),
            (191, "OU_AWAY", "total", None),
            (198, "OE", None, None),
        ],
        "S": [
            (202, "ML", None, None),
            (203, "AH", "hcp", None),
            (204, "OU", "total", None),
        ],
    },
    "volleyball": {
        "MATCH": [
            (186, "ML", None, None),
            (188, "AH_SETS", "hcp", "set"),
            (237, "AH", "hcp", "bod"),
            (238, "OU", "total", "bod"),
        ],
        "S": [
            (202, "ML", None, None),
            (310, "OU", "total", "bod"),
        ],
    },
    "baseball": {
        "MATCH": [
            (251, "ML", None, None),
            (256, "AH", "hcp", None),
            (258, "OU", "total", None),
            (260, "OU_HOME", "total", None),
            (261, "OU_AWAY", "total", None),
        ],
    },
    "mma": {
        "REG": [
            (1, "1X2", None, None),
        ],
    },
    "boxing": {
        "REG": [
            (1, "1X2", None, None),
        ],
    },
    "darts": {
        "MATCH": [
            (186, "ML", None, None),
            (188, "AH_SETS", "hcp", "set"),
            (314, "OU_SETS", "total", "set"),
            (366, "AH", "hcp", "leg"),
            (367, "OU", "total", "leg"),
        ],
    },
    "snooker": {
        "MATCH": [
            (186, "ML", None, None),
            (493, "AH", "hcp", "fram"),
            (494, "OU", "total", "fram"),
        ],
    },
    "table_tennis": {
        "MATCH": [
            (186, "ML", None, None),
            (187, "AH_SETS", "hcp", "set"),
            (237, "AH", "hcp", "bod"),
            (238, "OU", "total", "bod"),
        ],
    },
}
PART_COUNT = {"P": 3, "Q": 4, "S": 5}
# Outcome numbers by type.
OUTCOME_IDS = {
    "1X2": {1: "HOME", 2: "DRAW", 3: "AWAY"},
    "ML": {1: "HOME", 3: "AWAY", 4: "HOME", 5: "AWAY"},
    "DNB": {1: "HOME", 3: "AWAY", 4: "HOME", 5: "AWAY"},
    "AH": {1714: "HOME", 1715: "AWAY"},
    "AH_SETS": {1714: "HOME", 1715: "AWAY"},
    "OU": {12: "OVER", 13: "UNDER"},
    "OU_HOME": {12: "OVER", 13: "UNDER"},
    "OU_AWAY": {12: "OVER", 13: "UNDER"},
    "OU_SETS": {12: "OVER", 13: "UNDER"},
    "BTTS": {74: "YES", 76: "NO"},
    "OE": {70: "ODD", 72: "EVEN"},
    "DC": {9: "HOME_DRAW", 10: "HOME_AWAY", 11: "DRAW_AWAY"},
}


def definitions() -> list[tuple]:
    return [(sport, number, kind, scope, spec, name) for sport, scopes in MARKETS.items() for scope, own in scopes.items() for number, kind, spec, name in own]


def market_dimension(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(definitions(), SCHEMA)


def outcome_dimension(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(t, i, s) for t, own in OUTCOME_IDS.items() for i, s in own.items()], "mtype string, outcome int, sel string")


def key_of(mtype: Column, scope: Column, line_spec: Column, specs: Column) -> Column:
    """Canonical key from a definition and the specifiers stated; null if one is missing or makes no sense."""
    part = F.coalesce(specs["periodnr"], specs["quarternr"], specs["setnr"]).try_cast("int")
    whole = F.when(scope.isin(*PART_COUNT), F.when(part.between(1, lookup(scope, PART_COUNT)), F.concat(scope, part.cast("string")))).otherwise(scope)
    stated = F.trim(F.when(line_spec == "hcp", specs["hcp"]).otherwise(specs["total"]))
    line = F.when(stated.rlike(r"^[+-]?\d+(\.\d+)?$"), stated.cast("double"))
    sane = line_spec.isNull() | (line.isNotNull() & ((line_spec == "hcp") | (line >= 0)))
    return F.when(sane & whole.isNotNull(), market_key(mtype, whole, line))


def parse_uri(uri: Column) -> dict[str, Column]:
    """``uof:provider/sr:sport:S/MARKET/OUTCOME?a=b&c=d`` as columns."""
    rx = r"^uof:[^/]+/sr:sport:(\d+)/(\d+)/(\d+)(?:\?(.*))?$"
    part = lambda i: F.when(uri.rlike(rx), F.regexp_extract(uri, rx, i))
    return {"sport_no": part(1).cast("int"), "number": part(2).cast("int"), "outcome": part(3).cast("int"), "specs": F.str_to_map(F.coalesce(part(4), F.lit("")), F.lit("&"), F.lit("="))}


def mapped(selections: DataFrame) -> DataFrame:
    """Selections (``event_id, sport, market_id, number, name, specs, outcome, odds``) as canonical quotes.

    A market with an outcome that is not known is dropped as a whole; so is one whose name does not fit its definition.
    """
    spark = selections.sparkSession
    own = selections.join(F.broadcast(market_dimension(spark)), ["sport", "number"])
    own = own.where(F.col("name_pattern").isNull() | F.lower(F.coalesce("name", F.lit(""))).contains(F.col("name_pattern")))
    own = own.withColumn("market", key_of(F.col("mtype"), F.col("scope"), F.col("line_spec"), F.col("specs"))).where("market IS NOT NULL")
    own = own.join(F.broadcast(outcome_dimension(spark)), ["mtype", "outcome"], "left")
    bad = own.where("sel IS NULL").select("event_id", "market_id").distinct()
    return own.join(bad, ["event_id", "market_id"], "left_anti").select("event_id", "sport", "market", "sel", "odds", "market_id")
