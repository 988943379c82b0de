"""Recorded feeds as DataFrames: readers of files and the shapes in which books state quotes.

Readers take paths and a schema or options; payloads are exploded and joined, never walked on the driver. Nested payloads of
unknown shape are read as text and taken apart with JSON functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import comma_price, fractional_price, lookup, market_key

#: One fetch of one book: events with markets with selections.
FETCH = """bookmaker string, strategy string, scope string, fetchedAt bigint, events array<struct<
  sourceId:string, sport:string, competition:string, home:string, away:string, startTime:bigint, live:boolean,
  state:struct<statusText:string, period:int, clockSec:double, periodRemainingSec:double, breakFlag:boolean, clockRunning:boolean, finished:boolean, score:array<int>, games:array<int>, points:array<string>>,
  markets:array<struct<key:string, open:boolean, selections:array<struct<key:string, odds:double, open:boolean, rawName:string>>>>>>, _corrupt_record string"""


def read_fetches(spark: SparkSession, path: str) -> DataFrame:
    """Fetches from JSON files; broken ones keep their text in ``_corrupt_record``."""
    return spark.read.schema(FETCH).option("multiLine", True).option("mode", "PERMISSIVE").json(path).withColumn("file", F.input_file_name())


def stream_fetches(spark: SparkSession, path: str, files: int = 100) -> DataFrame:
    return spark.readStream.schema(FETCH.replace(", _corrupt_record string", "")).option("maxFilesPerTrigger", files).json(path)


def flat_quotes(fetches: DataFrame) -> DataFrame:
    """One row a selection, with its place in the fetch (which decides between duplicates)."""
    keys = ["bookmaker", "strategy", "scope", "fetchedAt"]
    e = fetches.select(*keys, F.posexplode("events").alias("event_pos", "e"))
    m = e.select(*keys, "event_pos", "e.sourceId", "e.sport", "e.competition", "e.home", "e.away", "e.startTime", "e.live", F.posexplode("e.markets").alias("market_pos", "m"))
    s = m.select(*[c for c in m.columns if c != "m"], F.col("m.key").alias("market"), F.col("m.open").alias("market_open"), F.posexplode("m.selections").alias("sel_pos", "s"))
    return s.select(*[c for c in s.columns if c != "s"], F.col("s.key").alias("sel"), F.col("s.odds").alias("odds"), (F.col("market_open") & F.col("s.open")).alias("is_open"))


def event_states(fetches: DataFrame) -> DataFrame:
    e = fetches.select("bookmaker", "scope", "fetchedAt", F.explode("events").alias("e"))
    return e.select("bookmaker", "scope", "fetchedAt", "e.sourceId", "e.sport", "e.competition", "e.live", "e.state.*")


def normalised_listing(events: DataFrame, markets: DataFrame, odds: DataFrame, competitors: DataFrame, champs: DataFrame, categories: DataFrame) -> DataFrame:
    """A feed of entity lists that refer to each other by id, as one row a selection with names.

    ``events(id, name, sportId, catId, champId, competitorIds, startDate, marketIds)``, ``markets(id, typeId, name, oddIds)``,
    ``odds(id, typeId, price, oddStatus)``; entities are joined by id, sides by place.
    """
    side = lambda i: F.element_at("competitorIds", i)
    names = competitors.select(F.col("id").alias("_cid"), F.col("name").alias("_cname"))
    e = events.withColumn("_h", side(1)).withColumn("_a", side(2))
    e = e.join(names.toDF("_h", "home"), "_h", "left").join(names.toDF("_a", "away"), "_a", "left")
    e = e.join(champs.select(F.col("id").alias("champId"), F.col("name").alias("champ")), "champId", "left").join(categories.select(F.col("id").alias("catId"), F.col("name").alias("category")), "catId", "left")
    m = e.select(F.col("id").alias("event_id"), "sportId", "home", "away", "champ", "category", "startDate", F.explode("marketIds").alias("market_id"))
    m = m.join(markets.select(F.col("id").alias("market_id"), F.col("typeId").alias("number"), F.col("name").alias("market_name"), "oddIds"), "market_id")
    o = m.withColumn("odd_id", F.explode("oddIds")).drop("oddIds")
    return o.join(odds.select(F.col("id").alias("odd_id"), F.col("typeId").alias("outcome"), "price", (F.col("oddStatus") == 0).alias("is_open")), "odd_id")


def _ties(df: DataFrame, known: list[str], ties: list[str] | None) -> list[str]:
    """Columns that decide between rows of one time: those given, else all that are not ``known``."""
    return [c for c in df.columns if c not in known] if ties is None else ties


def freshest(messages: DataFrame, keys: list[str], at: str, ties: list[str] | None = None) -> DataFrame:
    """The last message of each key over all connections that are healthy; of messages of one time the greatest by ``ties`` (else by all other columns)."""
    kept = messages.where("healthy") if "healthy" in messages.columns else messages
    row = F.max_by(F.struct(*[c for c in kept.columns if c not in keys]), F.struct(at, *_ties(kept, [*keys, at], ties)))
    return kept.groupBy(*keys).agg(row.alias("m")).select(*keys, "m.*")


def push_frames(lines: DataFrame, text: str = "value") -> DataFrame:
    """Fixed-width text frames: M, channel (6 letters, 16 fill, 10 id), message id (10), user (G, or U and 10), subject (6 and
    10), size (12), JSON. Lines that are no frames are dropped."""
    t = F.col(text)
    user = F.when(F.substr(t, F.lit(44), F.lit(1)) == "U", 10).otherwise(0)
    cut = lambda a, n: F.substr(t, F.lit(a) + user, F.lit(n))
    body = cut(73, 1 << 30)
    frame = F.struct(
        F.substr(t, F.lit(2), F.lit(6)).alias("channel"), F.regexp_replace(F.substr(t, F.lit(24), F.lit(10)), "^0+(?=.)", "").alias("channel_id"), F.substr(t, F.lit(34), F.lit(10)).alias("message_id"),
        cut(45, 6).alias("subject"), F.regexp_replace(cut(51, 10), "^0+(?=.)", "").alias("subject_id"), body.alias("body"))
    good = (F.substr(t, F.lit(1), F.lit(1)) == "M") & (F.length(t) >= 73) & F.try_parse_json(body).isNotNull()
    # exploded, for conditions on plain columns would be moved below the lines, whose text is then made once for each
    return lines.select(F.explode(F.when(good, F.array(frame))).alias("f")).select("f.*")


def price_messages(frames: DataFrame, known: DataFrame) -> DataFrame:
    """Price messages as quotes; ``market`` is null where the outcome is not known."""
    price = frames.where("subject = 'sPRICE'").select("message_id", "subject_id", F.from_json("body", "payout double, lp_num double, lp_den double, active boolean").alias("b"))
    odds = fractional_price(F.col("b.payout"), F.col("b.lp_num"), F.col("b.lp_den"))
    quoted = price.select("message_id", F.col("subject_id").alias("outcome_id"), odds.alias("odds"), F.coalesce("b.active", F.lit(True)).alias("is_open"))
    return quoted.join(known, "outcome_id", "left")


def apply_deltas(frames: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Price messages as quotes of known outcomes, and those that need a fresh snapshot (outcome not known). Each is a pass of its own
    over the frames; who needs both at once takes :func:`price_messages`."""
    joined = price_messages(frames, known)
    return joined.where("market IS NOT NULL"), joined.where("market IS NULL").select("outcome_id").distinct()


def replay_journal(snapshot: DataFrame, journal: DataFrame, keys: list[str], margin_ms: int = 2_000, ties: list[str] | None = None) -> DataFrame:
    """State after a snapshot and the messages since it was made (less a margin): the last one of each key counts, a message
    before the snapshot at equal time, then the greatest by ``ties`` (else by all other columns). Removals are messages with ``removed``."""
    made = snapshot.agg(F.max("at").alias("_made"))
    later = journal.join(F.broadcast(made)).where(F.col("_made").isNull() | (F.col("at") >= F.col("_made") - margin_ms)).drop("_made").withColumn("_side", F.lit(1))
    both = snapshot.withColumn("removed", F.lit(False)).withColumn("_side", F.lit(0)).unionByName(later)
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("at").desc(), F.col("_side").desc(), *[F.col(c).desc() for c in _ties(snapshot, [*keys, "at"], ties)]))
    return both.withColumn("_rn", rn).where("_rn = 1 AND NOT removed").drop("_rn", "_side", "removed")


def silent_details(overview: DataFrame, detail: DataFrame, now: Column, lag_ms: int = 1_000, hold_ms: int = 3_000) -> DataFrame:
    """Events whose detail has fallen silent: the overview is newer by over a second, for three seconds at least."""
    j = overview.select("event_id", F.col("at").alias("_o")).join(detail.select("event_id", F.col("at").alias("_d")), "event_id")
    return j.where((F.col("_o") - F.col("_d") > lag_ms) & (now - F.col("_d") >= hold_ms)).select("event_id")


def scoreboards(boards: DataFrame) -> DataFrame:
    """Scoreboard columns: score, minute from the clock text, sets."""
    text = F.col("overview.gameTime")
    return boards.select("fixtureId", "type", F.col("columns.TotalScore.Home").try_cast("int").alias("home"), F.col("columns.TotalScore.Away").try_cast("int").alias("away"), F.regexp_extract(text, r"(\d+)m", 1).try_cast("int").alias("minute"), F.regexp_extract(text, r"^(\d)\.", 1).try_cast("int").alias("period"), text.alias("status"))


def main_market(labels: Column) -> Column:
    """Type of an unnamed market by the labels of its outcomes; null if they do not decide."""
    have = F.array_join(F.array_sort(F.array_distinct(F.transform(labels, lambda x: F.upper(F.trim(x))))), " ")
    return lookup(have, {"0 1 2": "1X2", "1 2 X": "1X2", "1 2": "ML", "02 10 12": "DC", "12 1X X2": "DC", "12 1X 2X": "DC"})


def main_selection(mtype: Column, label: Column) -> Column:
    code = F.concat_ws(":", mtype, F.upper(F.trim(label)))
    return lookup(code, {
        "1X2:1": "HOME", "1X2:0": "DRAW", "1X2:X": "DRAW", "1X2:2": "AWAY", "ML:1": "HOME", "ML:2": "AWAY",
        "DC:10": "HOME_DRAW", "DC:1X": "HOME_DRAW", "DC:12": "HOME_AWAY", "DC:02": "DRAW_AWAY", "DC:X2": "DRAW_AWAY", "DC:2X": "DRAW_AWAY"})


def label_markets(rows: DataFrame) -> DataFrame:
    """Offers with plain outcome labels (``event_id, market_id, label, price``) as quotes of the main markets."""
    w = Window.partitionBy("event_id", "market_id")
    kind = main_market(F.collect_set("label").over(w))
    own = rows.withColumn("mtype", kind).where("mtype IS NOT NULL").withColumn("sel", main_selection(F.col("mtype"), F.col("label")))
    return own.select("event_id", market_key(F.col("mtype"), F.when(F.col("mtype") == "ML", "MATCH").otherwise("REG"), F.lit(None).cast("double")).alias("market"), "sel", comma_price(F.col("price")).alias("odds"))


def audit_push_types(listing: DataFrame, push: DataFrame) -> DataFrame:
    """Push types whose mapping disagrees with the listing anywhere (``offer_id, market`` and ``offer_id, push_type, market``)."""
    j = push.join(listing.select("offer_id", F.col("market").alias("listed")), "offer_id")
    return j.groupBy("push_type").agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.col("market") == F.col("listed")).alias("agrees"))


def any_time(text: Column) -> Column:
    """Epoch in milliseconds of a date as feeds state it: ``/Date(ms+zone)/``, seconds or milliseconds, ISO."""
    digits = F.regexp_extract(text, r"^(?:/Date\()?(-?\d+)", 1).try_cast("long")
    plain = text.rlike(r"^-?\d+$") | text.startswith("/Date(")
    iso = F.unix_millis(F.try_to_timestamp(text))
    return F.when(plain, F.when(text.startswith("/Date(") | (F.abs(digits) >= 100_000_000_000), digits).otherwise(digits * 1000)).otherwise(iso)


def is_virtual(name: Column) -> Column:
    """Simulated and electronic matches."""
    return F.coalesce(F.lower(name).rlike(r"(^|\W)(e-?(sports?|football|hockey|soccer|basketball)|srl|virtual|simul|cyber|esport)"), F.lit(False))


def upsert(table: DataFrame, changes: DataFrame, keys: list[str], at: str, ties: list[str] | None = None) -> DataFrame:
    """The table after an upsert: of each key the newest row, then the greatest by ``ties`` (else by all other columns)."""
    both = table.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)))
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("_new").desc(), F.col(at).desc(), *[F.col(c).desc() for c in _ties(table, [*keys, at], ties)]))
    return both.withColumn("_rn", rn).where("_rn = 1").drop("_rn", "_new")
