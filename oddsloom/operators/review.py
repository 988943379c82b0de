"""The whole way from feed entries to linked events, and the queue of those a person must decide.

An entry keeps a link that still holds; else known aliases decide; else names and times do (``operators.matching``); what is
neither clear nor foreign is queued. Aliases are frozen for a round, so books can be matched side by side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..domain import Settings
from ..functions.names import Vocabulary
from ..stored import stored
from . import matching

HOUR = 3_600_000
#: How far a stored link may be off, and after how long a queued entry is given up and an event forgotten.
LINK_MS, EXPIRE_MS, FORGET_MS = 6 * HOUR, 4 * HOUR, 8 * HOUR


def valid_links(entries: DataFrame, links: DataFrame, events: DataFrame, settings: Settings, known: DataFrame) -> DataFrame:
    """Stored links (``bk, entry_id, event_id, swapped``) whose event is still there, of the entry's sport, within six hours,
    with names at most 0.1 below the review limit in the same orientation."""
    own = links.withColumnRenamed("swapped", "_was").join(entries, ["bk", "entry_id"]).join(matching.as_candidates(events), ["event_id", "sport"])
    found = matching.scored(own.where(F.abs(F.col("start") - F.col("ev_start")) <= LINK_MS), settings, known)
    return found.where((F.col("swapped") == F.col("_was")) & (F.col("score") >= settings.review - 0.1)).select("bk", "entry_id", "event_id", "swapped")


def by_alias(entries: DataFrame, events: DataFrame, links: DataFrame, aliases: DataFrame, rejected: DataFrame, settings: Settings) -> DataFrame:
    """Entries whose both names are known aliases (``bk, sport, raw_name, participant_id``) of an event's participants
    (``home_id``, ``away_id``), in either order, within the matching window.

    Events the book is linked to already, and pairs a reviewer has rejected, are left out. Of the entries of a book that
    find one event, the one nearest in time gets it.
    """
    known = lambda side: aliases.select("bk", "sport", F.col("raw_name").alias(side), F.col("participant_id").alias(f"{side}_pid"))
    named = entries.join(known("home"), ["bk", "sport", "home"]).join(known("away"), ["bk", "sport", "away"])
    named = named.withColumn("_lo", F.least("home_pid", "away_pid")).withColumn("_hi", F.greatest("home_pid", "away_pid"))
    e = events.select("event_id", "sport", F.col("start").alias("ev_start"), "home_id", F.least("home_id", "away_id").alias("_lo"), F.greatest("home_id", "away_id").alias("_hi"))
    found = matching.near_in_time(named, e, ["sport", "_lo", "_hi"], "start", "ev_start", settings.match_minutes * matching.MINUTE)
    found = found.join(links.select("bk", "event_id"), ["bk", "event_id"], "left_anti").join(rejected.select("entry_id", "event_id"), ["entry_id", "event_id"], "left_anti")
    found = found.withColumn("_off", F.abs(F.col("start") - F.col("ev_start")))
    nearest = F.row_number().over(Window.partitionBy("entry_id").orderBy("_off", "event_id"))
    first = F.row_number().over(Window.partitionBy("bk", "event_id").orderBy("_off", "entry_id"))
    best = found.withColumn("_r", nearest).where("_r = 1").withColumn("_r", first).where("_r = 1")
    return best.select("entry_id", "bk", "event_id", (F.col("home_pid") != F.col("home_id")).alias("swapped"))


def resolve(entries: DataFrame, events: DataFrame, links: DataFrame, aliases: DataFrame, rejected: DataFrame, settings: Settings, vocabulary: Vocabulary | None = None) -> DataFrame:
    """``entry_id, status, event_id, swapped, method`` of every entry: ``link``, ``alias``, ``auto``, ``review`` or ``create``.

    Names are scored once for all steps. The narrow window's pairs are scored where they are made; the wide one, which links only names that
    are almost equal, is searched by name.
    """
    known = matching.compared(entries, matching.as_candidates(events), LINK_MS, vocabulary)
    kept = stored(valid_links(entries, links, events, settings, known).select("entry_id", "event_id", "swapped", F.lit("link").alias("method")), "links")
    rest = entries.join(kept.select("entry_id"), "entry_id", "left_anti")
    named = stored(by_alias(rest, events, links, aliases, rejected, settings), "aliases")
    alias = named.select("entry_id", "event_id", "swapped", F.lit("alias").alias("method"))
    taken = links.select("bk", "event_id").unionByName(named.select("bk", "event_id"))
    rest = stored(matching.asking(rest.join(alias.select("entry_id"), "entry_id", "left_anti"), rejected), "unnamed")
    offer = stored(matching.offered(events, taken), "offered")
    reach = F.when(F.col("sport").isin(*matching.INDIVIDUAL_SPORTS), 6 * HOUR).otherwise(3 * HOUR)
    narrow = matching.near_pool(rest, offer, settings, known)
    wide = matching.equal_pool(rest, offer, settings, known, 6 * HOUR, reach)
    decided = matching.one_event_a_book(matching.decide(narrow, wide, rest.select("entry_id", "bk"), settings))
    fuzzy = decided.select("entry_id", F.when(F.col("status") != "create", F.col("event_id")).alias("event_id"), "swapped", F.col("status").alias("method"))
    out = kept.unionByName(alias).unionByName(fuzzy)
    return out.withColumn("status", F.when(F.col("method").isin("link", "alias", "auto"), "linked").otherwise(F.col("method")))


def expired(queue: DataFrame, now: Column) -> DataFrame:
    """The queue with entries still pending four hours after their start given up."""
    return queue.withColumn("status", F.when((F.col("status") == "pending") & (F.col("start") < now - EXPIRE_MS), "expired").otherwise(F.col("status")))


def listed(queue: DataFrame, status: str = "pending", limit: int = 200) -> DataFrame:
    """What a reviewer is shown: the entries that start first."""
    return queue.where(F.col("status") == status).orderBy("start", "entry_id").limit(limit)


def waiting(queue: DataFrame) -> DataFrame:
    """How many entries are pending."""
    return queue.where("status = 'pending'").agg(F.count(F.lit(1)).alias("n"))


def decided(queue: DataFrame, answers: DataFrame) -> DataFrame:
    """The queue after a reviewer's answers (``entry_id, answer, event_id, swapped``): ``confirm`` takes the event named, else the
    candidate; ``reject`` closes the entry; a confirmation without any event leaves it pending."""
    a = answers.select("entry_id", "answer", F.col("event_id").alias("_event"), F.col("swapped").alias("_swapped"))
    event = F.coalesce(F.col("_event"), F.col("candidate_event_id"))
    status = F.when((F.col("answer") == "confirm") & event.isNotNull(), "confirmed").when(F.col("answer") == "reject", "rejected").otherwise(F.col("status"))
    out = queue.join(a, "entry_id", "left").withColumn("status", status)
    done = F.col("status") == "confirmed"
    return out.withColumn("candidate_event_id", F.when(done, event).otherwise(F.col("candidate_event_id"))).withColumn("swapped", F.when(done, F.coalesce("_swapped", "swapped")).otherwise(F.col("swapped"))).drop("_event", "_swapped", "answer")


def merged_aliases(aliases: DataFrame) -> DataFrame:
    """One participant for each (book, sport, raw name): what a person set stays, else the newest (``source, at, participant_id``)."""
    rank = F.struct((F.col("source") == "manual").alias("m"), "at", "participant_id")
    return aliases.groupBy("bk", "sport", "raw_name").agg(F.max_by(F.struct("participant_id", "source"), rank).alias("x")).select("bk", "sport", "raw_name", "x.*")


def remembered(events: DataFrame, now: Column) -> DataFrame:
    """Events that started at most eight hours ago."""
    return events.where(F.col("start") >= now - FORGET_MS)
