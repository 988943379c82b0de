"""Structure of whole fetches: every field of a payload against its rule, the first issues by place, all or nothing.

A rule is a function from a VARIANT column (null where the field is missing) to the issues below it, in order of place. Rules of objects and lists
are made of the rules of their fields, so that a payload is one expression over its row: no shuffle, no UDF, and a list of issues
that never grows past ``FIRST`` at any level.

Most elements have no issue, and that is told cheaply: a rule also knows its type, the schema of a good value and a condition on the typed value. An
element of a list of large objects is walked for its issues only if its schema or this condition does not hold.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..domain import BOOKS, SELECTIONS, SPORTS
from ..functions.scalars import is_market_key

FIRST = 5

NUMBER = r"(?:BIGINT|DECIMAL\(\d+,\d+\)|DOUBLE)"


@dataclass(frozen=True)
class Rule:
    """``issues(value, typed)`` of a VARIANT and of the same value read as ``ddl``; ``shape`` (an expression for the schema of a good value) and
    ``good`` (a condition on the typed value, which is not null) decide what needs no walk. A null as typed value is always walked."""

    issues: Callable[[Column, Column], Column]
    ddl: str
    shape: str
    good: Callable[[Column], Column] = lambda _: F.lit(True)
    may_miss: bool = False

    def __call__(self, v: Column, t: Column | None = None) -> Column:
        return self.issues(v, F.lit(None).cast(self.ddl) if t is None else t)

    def plain(self, v: Column, t: Column) -> Column:
        """True only for values without an issue, if they hold no JSON null; values with fields that are not named are not plain."""
        return F.coalesce(t.isNotNull() & self.good(t) & F.schema_of_variant(v).rlike(f"^{self.shape}$"), F.lit(False))

    def held(self, t: Column) -> Column:
        """The condition on a typed field, which is null only if it is missing."""
        return (t.isNull() | self.good(t)) if self.may_miss else (t.isNotNull() & self.good(t))


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with the value computed once, however often it is named."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _none() -> Column:
    return F.expr("CAST(array() AS array<struct<at: string, message: string>>)")


def _issue(message: Column) -> Column:
    return _let(message, lambda m: F.when(m.isNotNull(), F.array(F.struct(F.lit("").alias("at"), m.alias("message")))).otherwise(_none()))


def _under(place: Column, issues: Column) -> Column:
    return F.transform(issues, lambda x: F.struct(F.concat_ws(".", place, F.nullif(x["at"], F.lit(""))).alias("at"), x["message"].alias("message")))


def _first(issues: Column) -> Column:
    return F.slice(issues, 1, FIRST)


def _kind(v: Column) -> Column:
    """What a value is, by the names of JSON; ``undefined`` where it is missing."""
    named = lambda s: F.when(s.isNull(), "undefined").when(s == "VOID", "null").when(s == "STRING", "string").when(s == "BOOLEAN", "boolean").when(s.startswith("OBJECT"), "object").when(s.startswith("ARRAY"), "array").otherwise("number")
    return _let(F.schema_of_variant(v), named)


def _not_a(kind: str, v: Column) -> Column:
    return F.concat(F.lit(f"Invalid input: expected {kind}, received "), _kind(v))


def _leaf(kind: str, further: Callable[[Column], Column], **typed) -> Rule:
    """A value of one kind; ``further`` gives what else is wrong with it, or null."""
    return Rule(lambda v, _: _issue(_let(_kind(v), lambda k: F.when(k == kind, further(v)).otherwise(F.concat(F.lit(f"Invalid input: expected {kind}, received "), k)))), **typed)


def text(least: int = 0, known: Callable[[Column], Column] | None = None, message: str = "") -> Rule:
    """A string of ``least`` letters or more; ``known`` may judge it further."""

    def further(own: Column) -> Column:
        short = F.when(F.length(own) < least, f"Too small: expected string to have >={least} characters") if least else F.lit(None).cast("string")
        bad = F.when(~F.coalesce(known(own), F.lit(False)), message) if known else F.lit(None).cast("string")
        return F.coalesce(short, bad)

    judged_further = bool(least or known)
    return _leaf("string", lambda v: _let(F.try_variant_get(v, "$", "string"), further) if judged_further else F.lit(None).cast("string"), ddl="string", shape="STRING", good=lambda t: further(t).isNull() if judged_further else F.lit(True))


def one_of(values: tuple[str, ...]) -> Rule:
    message = "Invalid option: expected one of " + "|".join(f'"{x}"' for x in values)

    def issues(v: Column, _: Column) -> Column:
        good = (_kind(v) == "string") & F.try_variant_get(v, "$", "string").isin(*values)
        return _issue(F.when(~F.coalesce(good, F.lit(False)), message))

    return Rule(issues, "string", "STRING", lambda t: t.isin(*values))


flag = _leaf("boolean", lambda _: F.lit(None).cast("string"), ddl="boolean", shape="BOOLEAN")


def number(whole: bool = False, above: float | None = None, least: float | None = None, most: float | None = None) -> Rule:
    def further(x: Column) -> Column:
        bad = [F.when(x != F.floor(x), "Invalid input: expected int, received number")] if whole else []
        bad += [F.when(x <= above, f"Too small: expected number to be >{above:g}")] if above is not None else []
        bad += [F.when(x < least, f"Too small: expected number to be >={least:g}")] if least is not None else []
        bad += [F.when(x > most, f"Too big: expected number to be <={most:g}")] if most is not None else []
        return F.coalesce(*bad, F.lit(None).cast("string"))

    return _leaf("number", lambda v: _let(F.try_variant_get(v, "$", "double"), further), ddl="double", shape=NUMBER, good=lambda t: further(t).isNull())


def optional(rule: Rule) -> Rule:
    """A field that may be missing; a JSON null is no missing field."""
    return Rule(lambda v, t: F.when(v.isNull(), _none()).otherwise(rule(v, t)), rule.ddl, rule.shape, rule.good, may_miss=True)


def items(of: Rule, least: int = 0, exactly: int | None = None, large: bool = False) -> Rule:
    """A list; ``exactly`` so many make a tuple. Elements that are ``large`` are walked only if they are not plain."""
    low, high = (least, None) if exactly is None else (exactly, exactly)

    def listed(own: Column, v: Column, t: Column) -> Column:
        each = (lambda x, y: F.when(of.plain(x, y), _none()).otherwise(of(x, y))) if large else of
        below = _first(F.flatten(F.transform(own, lambda x, i: _under(i.cast("string"), each(x, F.get(t, i))))))
        size = F.when(own.isNull(), _not_a("array" if exactly is None else "tuple", v)).when(F.size(own) < low, f"Too small: expected array to have >={low} items")
        size = size if high is None else size.when(F.size(own) > high, f"Too big: expected array to have <={high} items")
        return _let(size, lambda m: F.when(m.isNull(), below).otherwise(_issue(m)))

    def good(t: Column) -> Column:
        each = F.forall(t, lambda x: x.isNotNull() & of.good(x)) & (F.size(t) >= low)
        return each if high is None else each & (F.size(t) <= high)

    return Rule(lambda v, t: _let(F.try_variant_get(v, "$", "array<variant>"), lambda own: listed(own, v, t)), f"array<{of.ddl}>", f"ARRAY<(?:VOID|{of.shape})>", good)


def record(fields: dict[str, Rule], strict: bool = False) -> Rule:
    """An object; ``strict`` refuses other fields, named in alphabetical order, after all else."""

    def fields_of(own: Column, v: Column, t: Column) -> Column:
        parts = [_under(F.lit(name), _let(F.try_element_at(own, F.lit(name)), lambda x: of(x, t[name]))) for name, of in fields.items()]
        if strict:
            other = F.array_sort(F.array_except(F.map_keys(own), F.array(*[F.lit(x) for x in fields])))
            told = lambda o: F.when(F.size(o) > 0, F.concat(F.when(F.size(o) > 1, 'Unrecognized keys: "').otherwise('Unrecognized key: "'), F.array_join(o, '", "'), F.lit('"')))
            parts.append(_issue(_let(other, told)))
        return F.when(own.isNull(), _issue(_not_a("object", v))).otherwise(_first(F.concat(*parts)))

    def good(t: Column) -> Column:
        held = [of.held(t[name]) for name, of in fields.items()]
        return reduce(lambda a, b: a & b, held)

    # a schema names fields in alphabetical order
    shape = "OBJECT<" + "".join(f"(?:{re.escape(name)}: {fields[name].shape}(?:, )?)?" for name in sorted(fields)) + ">"
    ddl = "struct<" + ", ".join(f"`{name}`: {of.ddl}" for name, of in fields.items()) + ">"
    return Rule(lambda v, t: _let(F.try_variant_get(v, "$", "map<string, variant>"), lambda own: fields_of(own, v, t)), ddl, shape, good)


def event_rule() -> Rule:
    """An event with its state of play, markets and selections, in the order in which issues are told."""
    score = items(number(whole=True, least=0), exactly=2)
    state = record({
        "statusText": optional(text()),
        "period": optional(number(whole=True, least=0, most=20)),
        "breakFlag": optional(flag),
        "clockSec": optional(number(least=0, most=14_400)),
        "periodRemainingSec": optional(number(least=0, most=3_600)),
        "clockRunning": optional(flag),
        "score": optional(score),
        "periodScores": optional(items(score)),
        "games": optional(score),
        "points": optional(text()),
        "finished": optional(flag),
    }, strict=True)
    selection = record({"key": one_of(SELECTIONS), "odds": number(), "open": optional(flag), "rawName": optional(text())})
    market = record({
        "key": text(known=is_market_key, message="invalid canonical market key"), "open": flag, "selections": items(selection, least=1),
        "sourceId": optional(text()), "rawName": optional(text()),
    })
    return record({
        "sourceId": text(1), "sport": one_of(SPORTS), "competition": text(), "country": optional(text()), "home": text(1), "away": text(1),
        "startTime": number(whole=True, above=0), "live": flag, "state": optional(state), "markets": items(market, large=True), "url": optional(text()),
    })


def fetch_rule() -> Rule:
    """A fetch of one book with its events."""
    event = event_rule()
    return record({"bookmaker": one_of(BOOKS), "strategy": text(), "scope": one_of(("prematch", "live")), "fetchedAt": number(whole=True, above=0), "events": items(event, large=True)})


def judged(fetches: DataFrame, payload: str) -> DataFrame:
    """Adds ``issues`` (the first five, each with its path), ``ok`` and ``error`` (null for a good fetch).

    A null text and a text that is no JSON have one issue with an empty path. Repeated rows are judged one by one; an empty table stays empty.
    Columns named ``issues``, ``ok`` or ``error`` are replaced.
    """
    rule = fetch_rule()
    text = F.col(payload)
    # a JSON null may hide in the schema of a list, so no value of such a payload is taken as plain
    read = F.struct(F.try_parse_json(text).alias("v"), F.when(~text.contains("null"), F.from_json(text, rule.ddl)).alias("t"))
    issues = _let(read, lambda r: F.when(r["v"].isNull(), _issue(F.lit("no JSON"))).otherwise(rule(r["v"], r["t"])))
    told = lambda i: F.when(F.size(i) > 0, F.concat(F.lit("schema: "), F.array_join(F.transform(i, lambda x: F.concat_ws(": ", x["at"], x["message"])), "; ")))
    out = fetches.withColumn("issues", issues)
    return out.withColumns({"ok": F.size("issues") == 0, "error": told(F.col("issues"))})


def whole(fetches: DataFrame, payload: str, schema: str) -> DataFrame:
    """``fetch``: the payloads without an issue, read by ``schema``; one issue rejects the whole fetch."""
    good = judged(fetches, payload).where("ok").drop("issues", "ok", "error")
    return good.withColumn("fetch", F.from_json(payload, schema))
