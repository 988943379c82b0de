"""Entity resolution: which feed entries of different books are the same match.

Entries have ``entry_id, sport, bk, home, away, start`` (ms), events ``event_id, sport, home, away, start``. The pool of
an entry is found by an equi-join on sport and time bucket (the neighbouring buckets exploded) with the exact time
difference as residual; names are compared once for each distinct pair, before entries meet events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..domain import INDIVIDUAL_SPORTS, Settings
from ..functions.names import Vocabulary, similarity_column
from ..stored import stored
from .series import running

MINUTE = 60_000
#: Names that a wide window may link.
EQUAL = 0.95


def near_in_time(left: DataFrame, right: DataFrame, keys: list[str], left_at: str, right_at: str, tolerance_ms: int) -> DataFrame:
    """All pairs with equal keys and times at most ``tolerance_ms`` apart, without comparing every pair of a key."""
    bucket = lambda c: F.floor(F.col(c) / tolerance_ms)
    a = left.withColumn("_bucket", F.explode(F.array(*[bucket(left_at) + d for d in (-1, 0, 1)])))
    b = right.withColumn("_bucket", bucket(right_at))
    return a.join(b, ["_bucket", *keys]).where(F.abs(F.col(left_at) - F.col(right_at)) <= tolerance_ms).drop("_bucket")


def nearest(left: DataFrame, right: DataFrame, keys: list[str], left_id: str, left_at: str, right_at: str, right_id: str, tolerance_ms: int, limit: int) -> DataFrame:
    """The candidates nearest in time of each row, up to ``limit`` (what a reviewer is shown); times and keys that are null meet nothing.

    The right side is numbered along time, once forwards and once backwards, and put in overlapping blocks of twice ``limit`` rows. A left
    row knows how many rows come before it, so it meets one block in either direction, however many rows lie within the tolerance. What it
    meets stays in its own row; pairs are made where nothing is shuffled any more.
    """
    none = lambda df: F.lit(None).cast(df.select(F.struct(*df.columns).alias("r")).schema["r"].dataType)
    rest = [c for c in right.columns if c not in (*keys, right_at, right_id)]
    own = F.struct(right_id, right_at, *rest)
    asked, blocks = left.where(F.col(left_at).isNotNull()), []
    for way, sign, left_side, right_side in (("_ahead", 1, 0, 1), ("_behind", -1, 1, 0)):  # backwards, rows of the same time come before the left row
        a = asked.select(*keys, (F.col(left_at) * sign).alias("_at"), F.lit(left_side).alias("_side"), F.lit(None).cast(right.schema[right_id].dataType).alias("_id"), F.struct(*asked.columns).alias("_l"), none(right.select(own.alias("r")).select("r.*")).alias("_r"))
        b = right.where(F.col(right_at).isNotNull()).select(*keys, (F.col(right_at) * sign).alias("_at"), F.lit(right_side).alias("_side"), F.col(right_id).alias("_id"), none(asked).alias("_l"), own.alias("_r"))
        both = running(a.unionByName(b), keys, "_at", ["_side", "_id"], tolerance_ms, total={"_n": F.col("_r").isNotNull().cast("long")})
        block = F.floor((F.col("_n") - 1) / limit)
        blocks.append(both.where("_r IS NOT NULL").select(*keys, F.explode(F.array(block - 1, block)).alias(f"{way}_block"), "_n", "_r").groupBy(*keys, f"{way}_block").agg(F.collect_list(F.struct("_n", "_r")).alias("_own")))
        asked = both.where("_l IS NOT NULL").select("_l.*", F.col("_n").alias(f"{way}_n"), F.floor(F.col("_n") / limit).alias(f"{way}_block"))
    for way, of_way in zip(("_ahead", "_behind"), blocks):
        n = F.col(f"{way}_n")
        near = F.filter("_own", lambda o: (o._n > n) & (o._n <= n + limit) & (F.abs(F.col(left_at) - o._r[right_at]) <= tolerance_ms))
        met = F.transform(near, lambda o: F.struct(F.abs(F.col(left_at) - o._r[right_at]).alias("gap"), *[o._r[c].alias(c) for c in (right_id, right_at, *rest)]))
        asked = asked.join(of_way, [*keys, f"{way}_block"], "left").withColumn(f"{way}_met", met).drop("_own", f"{way}_n", f"{way}_block")
    nobody = F.slice(F.coalesce("_ahead_met", "_behind_met"), F.lit(1), F.lit(0))
    best = F.slice(F.array_sort(F.concat(F.coalesce("_ahead_met", nobody), F.coalesce("_behind_met", nobody))), 1, limit)
    pairs = asked.select(*left.columns, F.posexplode(best).alias("_place", "_o"))
    return pairs.select(*left.columns, *[F.col(f"_o.{c}").alias(c) for c in right.columns if c not in keys], F.col("_o.gap").alias("gap"), (F.col("_place") + 1).alias("rank"))


def exact_pairs(entries: DataFrame, events: DataFrame, home: str, away: str) -> DataFrame:
    """Entries and events of the same two participants (by key), in either order."""
    ordered = lambda df, p: df.withColumn("_lo", F.least(f"{p}{home}", f"{p}{away}")).withColumn("_hi", F.greatest(f"{p}{home}", f"{p}{away}"))
    e = events.select([F.col(c).alias(f"ev_{c}") for c in events.columns])
    joined = ordered(entries, "").join(ordered(e, "ev_"), ["_lo", "_hi"]).drop("_lo", "_hi")
    return joined.withColumn("swapped", F.col(home) != F.col(f"ev_{home}"))


def exact_counts(entries: DataFrame, events: DataFrame, entry_id: str, home: str, away: str) -> DataFrame:
    """How many pairs of :func:`exact_pairs` an entry is in, ``n``, and how many of them are ``swapped``. Events of the same sides are
    counted before they are joined, so no pair is made."""
    of_sides = events.groupBy(F.col(home).alias("_h"), F.col(away).alias("_a")).agg(F.count(F.lit(1)).alias("_n"))
    # both orders of the sides; of equal sides there is one
    either = of_sides.select(F.explode(F.array_distinct(F.array(F.struct("_h", "_a"), F.struct(F.col("_a").alias("_h"), F.col("_h").alias("_a"))))).alias("_s"), "_h", "_n")
    sides = either.groupBy(F.col("_s._h").alias(home), F.col("_s._a").alias(away)).agg(F.sum("_n").alias("_n"), F.sum(F.when(F.col("_h") != F.col("_s._h"), F.col("_n")).otherwise(0)).alias("_swapped"))
    return entries.join(sides, [home, away]).groupBy(entry_id).agg(F.sum("_n").alias("n"), F.sum("_swapped").alias("swapped"))


def combined(home: Column, away: Column) -> Column:
    return F.when((home > 0) & (away > 0), 0.7 * F.least(home, away) + 0.15 * (home + away)).otherwise(0.0)


#: Names of entries are compared with all names of events of their sport where that makes at most so many pairs for each entry.
COMPARED = 10


def compared(entries: DataFrame, events: DataFrame, tolerance_ms: int, vocabulary: Vocabulary | None = None) -> DataFrame:
    """(sport, a, b, score): names of entries with names of events (as of :func:`as_candidates`), each distinct pair once, stored.

    Where a sport has few names, all of them meet; else those of entries and events that are near in time, each name once in a stretch of time.
    """
    named = lambda df, names, out, *more: df.select("sport", F.explode(F.array(*names)).alias(out), *more).where(f"{out} IS NOT NULL").distinct()
    mine, theirs = (entries.where("start IS NOT NULL"), ["home", "away"], "a"), (events.where("ev_start IS NOT NULL"), ["ev_home", "ev_away"], "b")
    own, other = stored(named(*mine), "entry-names"), stored(named(*theirs), "event-names")
    sizes = own.groupBy("sport").agg(F.count(F.lit(1)).alias("n")).join(other.groupBy("sport").agg(F.count(F.lit(1)).alias("m")), "sport")
    if (sizes.agg(F.sum(F.col("n").cast("double") * F.col("m"))).first()[0] or 0) <= COMPARED * entries.count():
        pairs = own.join(other, "sport")
    else:
        bucket = lambda c: F.floor(F.col(c) / tolerance_ms).alias("_bucket")
        near = named(*mine, bucket("start")).withColumn("_bucket", F.explode(F.array(*[F.col("_bucket") + d for d in (-1, 0, 1)])))
        pairs = near.join(named(*theirs, bucket("ev_start")), ["sport", "_bucket"]).select("sport", "a", "b").distinct()
    pairs = pairs.repartition("sport", "a")  # few sports, many names
    return stored(pairs.withColumn("score", similarity_column(F.col("a"), F.col("b"), F.col("sport"), vocabulary)), "names")


def scored(pairs: DataFrame, settings: Settings, known: DataFrame) -> DataFrame:
    """Pairs (``sport, home, away, start`` and ``ev_home, ev_away, ev_start``) with their similarity in the better orientation.

    ``known``: scores of names, as :func:`compared` gives them. Being stored, a small one is broadcast, so that pairs are not shuffled.
    """
    for i, (a, b) in enumerate([("home", "ev_home"), ("away", "ev_away"), ("home", "ev_away"), ("away", "ev_home")]):
        own = known.select("sport", F.col("a").alias(a), F.col("b").alias(b), F.col("score").alias(f"_s{i}"))
        pairs = pairs.join(own, ["sport", a, b])
    # each value is made once, by a generator: as plain columns they are written out in each other, too long a method for the JVM to compile
    def made(df: DataFrame, **values: Column) -> DataFrame:
        return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in values.items()]))))

    pairs = made(pairs, _straight=combined(F.col("_s0"), F.col("_s1")), _crossed=combined(F.col("_s2"), F.col("_s3")))
    pairs = made(pairs, swapped=F.col("_crossed") > F.col("_straight") + 0.05)
    of = lambda turned, plain: F.when(F.col("swapped"), F.col(turned)).otherwise(F.col(plain))
    pairs = made(pairs, home_score=of("_s2", "_s0"), away_score=of("_s3", "_s1"), _score=of("_crossed", "_straight"))
    close = (F.abs(F.col("start") - F.col("ev_start")) <= 5 * MINUTE) & (F.greatest("home_score", "away_score") >= 0.9)
    least = F.when(~F.col("swapped"), F.lit(settings.review + 0.02)).when(F.col("sport").isin(*INDIVIDUAL_SPORTS), F.lit(settings.review + 0.01))
    out = made(pairs, score=F.greatest("_score", F.when(close, least)))
    return out.drop("_s0", "_s1", "_s2", "_s3", "_straight", "_crossed", "_score").where("score > 0.3")


def as_candidates(events: DataFrame) -> DataFrame:
    return events.select("event_id", "sport", F.col("home").alias("ev_home"), F.col("away").alias("ev_away"), F.col("start").alias("ev_start"))


def offered(events: DataFrame, links: DataFrame) -> DataFrame:
    """Candidates, each with the books that are linked to it already (``taken``)."""
    taken = links.groupBy("event_id").agg(F.collect_set("bk").alias("taken"))
    return as_candidates(events).join(taken, "event_id", "left")


def asking(entries: DataFrame, rejected: DataFrame) -> DataFrame:
    """Entries, each with the events that a reviewer has rejected for it (``refused``)."""
    return entries.join(rejected.groupBy("entry_id").agg(F.collect_set("event_id").alias("refused")), "entry_id", "left")


def _open(pool: DataFrame) -> DataFrame:
    """Without events the book is linked to already, and pairs a reviewer has rejected. Both are known where a pair is made, so no pair is shuffled for it."""
    is_in = lambda events, x: F.coalesce(F.array_contains(events, F.col(x)), F.lit(False))
    return pool.where(~is_in("taken", "bk") & ~is_in("refused", "event_id")).drop("taken", "refused")


def near_pool(asked: DataFrame, offer: DataFrame, settings: Settings, known: DataFrame) -> DataFrame:
    """Candidates (of :func:`offered`) of each entry (of :func:`asking`) within the matching window, with their similarity."""
    return scored(_open(near_in_time(asked, offer, ["sport"], "start", "ev_start", settings.match_minutes * MINUTE)), settings, known)


def scored_pool(entries: DataFrame, events: DataFrame, links: DataFrame, rejected: DataFrame, settings: Settings, known: DataFrame) -> DataFrame:
    """:func:`near_pool` of entries and events."""
    return near_pool(asking(entries, rejected), offered(events, links), settings, known)


def equal_pool(asked: DataFrame, offer: DataFrame, settings: Settings, known: DataFrame, tolerance_ms: int, reach: Column | None = None) -> DataFrame:
    """Candidates within a wide window whose names are almost equal on both sides; ``reach`` may narrow the window by row.

    Names go first: an entry meets the events of the few names that are like its own, in either order, and no other event of its time.
    """
    like = known.where(F.col("score") >= EQUAL)
    of = lambda side, ev: like.select("sport", F.col("a").alias(side), F.col("b").alias(ev))
    ways = [asked.join(of("home", h), ["sport", "home"]).join(of("away", a), ["sport", "away"]) for h, a in (("ev_home", "ev_away"), ("ev_away", "ev_home"))]
    named = ways[0].unionByName(ways[1]).dropDuplicates(["entry_id", "ev_home", "ev_away"])
    pool = near_in_time(named, offer, ["sport", "ev_home", "ev_away"], "start", "ev_start", tolerance_ms)
    if reach is not None:
        pool = pool.where(F.abs(F.col("start") - F.col("ev_start")) <= reach)
    return scored(_open(pool), settings, known).where(F.least("home_score", "away_score") >= EQUAL)


def decide(pool: DataFrame, wide: DataFrame, entries: DataFrame, settings: Settings) -> DataFrame:
    """``auto`` link, ``review``, or ``create`` for each entry.

    A link needs a score above the limit, a clear lead over the runner-up, and, where sides are swapped, an individual
    sport or near equality. If the narrow pool gives none, the wide pool may link names that are almost equal.
    """
    order = Window.partitionBy("entry_id").orderBy(F.col("score").desc(), "event_id")

    def best(df: DataFrame) -> DataFrame:
        ranked = df.withColumn("_r", F.row_number().over(order)).where("_r <= 2")
        second = F.coalesce(F.max(F.when(F.col("_r") == 2, F.col("score"))), F.lit(0.0))
        first = lambda c: F.max(F.when(F.col("_r") == 1, F.col(c))).alias(c)
        return ranked.groupBy("entry_id", "sport").agg(first("event_id"), first("score"), first("swapped"), first("home_score"), first("away_score"), second.alias("second"))

    individual = F.col("sport").isin(*INDIVIDUAL_SPORTS)
    clear = (F.col("second") < F.col("score") - 0.05) & (~F.col("swapped") | individual | (F.col("score") >= 0.95))
    narrow = best(pool).withColumn("auto", (F.col("score") >= settings.auto_accept) & clear)
    far = best(wide.where(F.least("home_score", "away_score") >= EQUAL)).where(clear).select("entry_id", F.col("event_id").alias("wide_event"), F.col("swapped").alias("wide_swapped"), F.col("score").alias("wide_score"))
    out = entries.join(narrow.drop("sport"), "entry_id", "left").join(far, "entry_id", "left")
    auto = F.coalesce(F.col("auto"), F.lit(False))
    status = F.when(auto | F.col("wide_event").isNotNull(), "auto").when(F.col("score") >= settings.review, "review").otherwise("create")
    out = out.withColumn("status", status)
    linked = F.when(auto, F.col("event_id")).otherwise(F.coalesce(F.col("wide_event"), F.when(F.col("status") == "review", F.col("event_id"))))
    return out.select("entry_id", *[c for c in ("bk",) if c in entries.columns], "status", linked.alias("event_id"), F.when(auto | F.col("wide_event").isNull(), F.col("swapped")).otherwise(F.col("wide_swapped")).alias("swapped"), F.when(auto | F.col("wide_event").isNull(), F.col("score")).otherwise(F.col("wide_score")).alias("score"))


def one_event_a_book(decided: DataFrame) -> DataFrame:
    """Of the entries of a book (``bk``) linked to one event, the best stays linked; the others go to review."""
    alone = F.when(F.col("event_id").isNull(), F.col("entry_id"))  # entries without an event are no group
    rank = F.row_number().over(Window.partitionBy("bk", "event_id", alone).orderBy(F.col("score").desc(), "entry_id"))
    return decided.withColumn("_r", rank).withColumn("status", F.when((F.col("status") == "auto") & (F.col("_r") > 1), "review").otherwise(F.col("status"))).drop("_r")
