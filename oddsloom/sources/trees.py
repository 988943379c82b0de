"""Feeds that nest their objects: every object of a JSON tree of unknown shape, and quotes of what looks like an event.

A payload is VARIANT: it is parsed once and walked by depth, all payloads together. Each step goes from the objects of one level to those
below, in fields or in lists of fields, and is stored, so a level is read once; the walk ends with the first level that holds nothing. What a value
is is told by its first bytes (an empty struct, a first element), never by the schema of all below it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..stored import stored

#: A tree of more steps than this is refused: no feed nests so far.
MOST_LEVELS = 64
#: The lists that make an object an event.
EVENT_LISTS = ("oppRows", "eventTables")

# one step: fields of an object, elements of a list; a list in a field is entered in the same step, and no element carries its list along
_STEP = """WITH c AS (SELECT n.key, n.path || CASE WHEN t.key IS NULL THEN '[' || t.pos || ']' ELSE '.' || t.key END AS path, t.value, t.key IS NOT NULL AND try_variant_get(t.value, '$[0]', 'variant') IS NOT NULL AS is_list FROM {nodes} n, LATERAL variant_explode(n.value) AS t),
s AS (SELECT key, path, CASE WHEN NOT is_list THEN value END AS own, CASE WHEN is_list THEN value END AS list FROM c)
SELECT s.key, CASE WHEN e.pos IS NULL THEN s.path ELSE s.path || '[' || e.pos || ']' END AS path, coalesce(e.value, s.own) AS value FROM s, LATERAL variant_explode_outer(s.list) AS e"""


def _kept(level: DataFrame) -> DataFrame:
    """``level`` stored. A value is written as a list of one: a plain VARIANT column is shredded, for which the schema of all below it is worked out."""
    return stored(level.select("key", "path", F.array("value").alias("value")), "tree-level").select("key", "path", F.get("value", F.lit(0)).alias("value"))


def _is_object() -> Column:
    return F.try_variant_get("value", "$", "struct<>").isNotNull()


def objects(payloads: DataFrame, key: str, text: str) -> DataFrame:
    """(key, path, value): every object in the JSON texts, with its path. A text that is null or no JSON has none."""
    spark = payloads.sparkSession
    # exploded, for conditions on a plain column would be moved below it and parse the text once for each
    level = payloads.select(F.col(key).alias("key"), F.lit("$").alias("path"), F.explode(F.array(F.try_parse_json(F.col(text)))).alias("value"))
    wanted = _is_object() | F.try_variant_get("value", "$[0]", "variant").isNotNull()
    held = []
    for _ in range(MOST_LEVELS):
        level = _kept(level.where(wanted))
        if level.isEmpty():
            break
        held.append(level)
        level = spark.sql(_STEP, nodes=level)
    else:
        raise ValueError(f"a tree of more than {MOST_LEVELS} levels")
    if not held:
        return level.where("false")
    out = held[0]
    for more in held[1:]:
        out = out.unionByName(more)
    return out.where(_is_object())


def _text(*paths: str) -> Column:
    return F.coalesce(*[F.try_variant_get("value", p, "string") for p in paths])


def nested_quotes(found: DataFrame) -> DataFrame:
    """(key, event_id, name, label, odds, is_open) of the objects that carry rows of prices, wherever they stand.

    An event is an object with a list ``oppRows`` (lists of cells under ``oppsTab``) or ``eventTables`` (``boxes`` of ``cells``); its id goes by one of
    three names. Cells without a number as price are left out.
    """
    spark = found.sparkSession
    a, b = [F.try_variant_get("value", f"$.{x}", "variant") for x in EVENT_LISTS]
    lists = [F.try_variant_get("value", f"$.{x}", "array<variant>").isNotNull() for x in EVENT_LISTS]
    events = found.where(lists[0] | lists[1]).select("key", _text("$.id", "$.idMatch", "$.matchId").alias("event_id"), _text("$.name", "$.nameFull").alias("name"), F.array(a, b).alias("lists")).where("event_id IS NOT NULL")
    # rows of the first list hold cells, tables of the second hold boxes of cells
    cells = """SELECT e.key, e.event_id, e.name, c.value FROM {events} e, LATERAL posexplode(e.lists) AS l(n, list), LATERAL variant_explode(l.list) AS r,
      LATERAL variant_explode_outer(CASE WHEN l.n = 1 THEN try_variant_get(r.value, '$.boxes', 'variant') END) AS x,
      LATERAL variant_explode(CASE WHEN l.n = 0 THEN try_variant_get(r.value, '$.oppsTab', 'variant') ELSE try_variant_get(x.value, '$.cells', 'variant') END) AS c"""
    out = spark.sql(cells, events=events).select("key", "event_id", "name", _text("$.label", "$.name").alias("label"), F.try_variant_get("value", "$.odd", "double").alias("odds"), F.coalesce(F.try_variant_get("value", "$.bettingEnabled", "boolean"), F.lit(True)).alias("is_open"))
    return out.where("odds IS NOT NULL")


def joined_quotes(payloads: DataFrame, key: str, entities: str, odds: str) -> DataFrame:
    """The same from two lists that name one another: ``entities`` (``matches``: id, name) and ``odds`` (``groups``: matchId, cells)."""
    spark = payloads.sparkSession
    both = payloads.select(F.col(key).alias("key"), F.try_parse_json(F.col(entities)).alias("e"), F.try_parse_json(F.col(odds)).alias("o"))
    matches = spark.sql("SELECT p.key, try_variant_get(m.value, '$.id', 'string') AS event_id, try_variant_get(m.value, '$.name', 'string') AS name FROM {p} p, LATERAL variant_explode(try_variant_get(p.e, '$.matches', 'variant')) AS m", p=both)
    cells = spark.sql("SELECT p.key, try_variant_get(g.value, '$.matchId', 'string') AS event_id, c.value AS value FROM {p} p, LATERAL variant_explode(try_variant_get(p.o, '$.groups', 'variant')) AS g, LATERAL variant_explode(try_variant_get(g.value, '$.cells', 'variant')) AS c", p=both)
    own = cells.select("key", "event_id", _text("$.label", "$.name").alias("label"), F.try_variant_get("value", "$.odd", "double").alias("odds"), F.coalesce(F.try_variant_get("value", "$.bettingEnabled", "boolean"), F.lit(True)).alias("is_open"))
    return own.where("odds IS NOT NULL").join(matches, ["key", "event_id"]).select("key", "event_id", "name", "label", "odds", "is_open")
