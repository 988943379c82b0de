"""Quotes out of nested and of normalised payloads made from ``orders`` and ``lineitem``: what comes out must equal the rows that went in."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import trees
from . import bindings as B

_ROWS = """SELECT o_custkey AS key, o_orderkey AS event_id, 'Match ' || o_orderkey AS name, l_linenumber || '/' || l_partkey AS label, (101 + CAST(floor(l_extendedprice) AS BIGINT) % 240) / 100.0D AS odds, CAST(floor(l_quantity) AS BIGINT) % 10 <> 0 AS is_open
  FROM {orders} JOIN {lineitem} ON l_orderkey = o_orderkey"""


def _events(spark, d):
    """An event a row, as the JSON of its cells, at a depth of its own."""
    rows = spark.sql(_ROWS, orders=B.read(spark, d, "orders"), lineitem=B.read(spark, d, "lineitem"))
    cells = F.to_json(F.collect_list(F.struct("label", F.col("odds").alias("odd"), F.col("is_open").alias("bettingEnabled"))))
    return rows.groupBy("key", "event_id", "name").agg(cells.alias("cells"))


def _nested(spark, d):
    e = _events(spark, d)
    # two names of the id, two shapes of the rows, up to three more levels
    own = F.concat(
        F.when(F.col("event_id") % 2 == 0, '{"id":').otherwise('{"idMatch":'), F.col("event_id"), F.lit(',"name":"'), F.col("name"), F.lit('",'),
        F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('"eventTables":[{"boxes":[{"cells":'), "cells", F.lit("}]}]}"))).otherwise(F.concat(F.lit('"oppRows":[{"oppsTab":'), "cells", F.lit("}]}"))))
    deep = F.col("event_id") % 4
    tree = F.concat(F.repeat(F.lit('{"groups":[{"n":1},'), deep), own, F.repeat(F.lit("]}"), deep))
    return e.groupBy("key").agg(F.concat(F.lit('{"sport":"x","items":['), F.array_join(F.collect_list(tree), ","), F.lit("]}")).alias("text"))


def nested_feed(spark, d):
    """Every event of every tree, wherever it stands."""
    return trees.nested_quotes(trees.objects(_nested(spark, d), "key", "text"))


def normalised_feed(spark, d):
    """The same rows from two lists that name one another."""
    e = _events(spark, d)
    lists = e.groupBy("key").agg(
        F.concat(F.lit('{"matches":'), F.to_json(F.collect_list(F.struct(F.col("event_id").cast("string").alias("id"), "name"))), F.lit("}")).alias("entities"),
        F.concat(F.lit('{"groups":['), F.array_join(F.collect_list(F.concat(F.lit('{"matchId":"'), "event_id", F.lit('","cells":'), "cells", F.lit("}"))), ","), F.lit("]}")).alias("odds"))
    return trees.joined_quotes(lists, "key", "entities", "odds")


ROWS = "SELECT key, CAST(event_id AS VARCHAR) AS event_id, name, label, odds, is_open FROM (" + _ROWS.replace("{orders}", "orders").replace("{lineitem}", "lineitem").replace("100.0D", "CAST(100 AS DOUBLE)") + ")"
QUERIES = {"nested_feed": (nested_feed, ROWS), "normalised_feed": (normalised_feed, ROWS)}
