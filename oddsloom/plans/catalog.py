"""All queries by name, and the SQL that each must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import event_plans, feed_plans, fetch_plans, match_plans, model_plans, output_plans, past_plans, quote_plans, read_plans, rule_plans, sink_plans, stat_plans, tree_plans

_ALL = [quote_plans.QUERIES, stat_plans.QUERIES, model_plans.QUERIES, match_plans.QUERIES, feed_plans.QUERIES, event_plans.QUERIES, output_plans.QUERIES, read_plans.QUERIES, past_plans.QUERIES, rule_plans.QUERIES, tree_plans.QUERIES, fetch_plans.QUERIES, sink_plans.QUERIES]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: fn for part in _ALL for name, (fn, _) in part.items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for part in _ALL for name, (_, text) in part.items() if text}
