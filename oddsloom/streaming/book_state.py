"""Quote state of each (book, event), from fetches to changes, over a stream or over recorded fetches.

A fetch is a row ``bk, event_id, scope, fetched_at, seq, source_id, quotes`` with ``quotes`` an array of (market, sel,
odds, is_open). Rules: a fetch older than the state's last one of the same scope is dropped (late data is compared with
state, there is no watermark); prematch fetches are ignored for a minute after a live one; of two source events on one
event the first one known stays; what a newer fetch does not list is removed. Fetches without quotes confirm removal.

A stream folds fetches through ``apply_fetch``. Recorded fetches need no fold, since every rule asks for something that can
be told from the fetches before, whatever became of them; there a fetch without a time is dropped.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LIVE_FOR_MS = 60_000
#: How long a stream keeps the state of a book's event of which nothing comes any more.
KEPT_MS = 7 * 86_400_000
CHANGES = "bk int, event_id long, market string, sel string, kind string, odds double, is_open boolean, previous_odds double, at long"
_STATE = "state string"
_KEYS = ["bk", "event_id"]


def apply_fetch(state: dict | None, fetch: dict) -> tuple[dict, list[dict]]:
    """The next state and the changes one fetch makes."""
    state = state or {"scope": None, "seen": {}, "source": None, "quotes": {}}
    scope, at = fetch["scope"], int(fetch["fetched_at"])
    live_at = state["seen"].get("live")
    if at < state["seen"].get(scope, at) or (scope == "prematch" and live_at is not None and at - live_at < LIVE_FOR_MS):
        return state, []
    if state["source"] is not None and fetch["source_id"] != state["source"] and at == state["seen"].get(scope):
        return state, []
    now = {f"{q['market']}\t{q['sel']}": [float(q["odds"]), bool(q["is_open"])] for q in fetch["quotes"]}
    changes = []
    for key, (odds, is_open) in now.items():
        before = state["quotes"].get(key)
        if before is None or before[:2] != [odds, is_open]:
            changes.append((key, "added" if before is None else "changed", odds, is_open, before and before[0]))
    changes += [(key, "removed", None, None, before[0]) for key, before in state["quotes"].items() if key not in now]
    kept = {k: [*v, at if k not in state["quotes"] or state["quotes"][k][:2] != v else state["quotes"][k][2]] for k, v in now.items()}
    after = {"scope": scope, "seen": state["seen"] | {scope: at}, "source": fetch["source_id"], "quotes": kept}
    rows = [dict(zip(("market", "sel"), k.split("\t"), strict=True), kind=kind, odds=o, is_open=p, previous_odds=b, at=at) for k, kind, o, p, b in changes]
    return after, rows


def _frame(key: tuple, rows: list[dict]) -> pd.DataFrame:
    columns = ["bk", "event_id", "market", "sel", "kind", "odds", "is_open", "previous_odds", "at"]
    return pd.DataFrame([{"bk": key[0], "event_id": key[1], **r} for r in rows], columns=columns).astype({"odds": "float64", "previous_odds": "float64"})


def _kept(fetches: DataFrame) -> DataFrame:
    """Fetches that become the state, numbered within their key, with the time of the next one.

    A dropped fetch is never newer than the last one of its scope, so running maxima over all fetches give the times. The source
    is the first one known since the last fetch that was newer than its scope.
    """
    told = Window.partitionBy(*_KEYS).orderBy("seq", "fetched_at", "scope", "source_id", "quotes")
    live_at = F.max(F.when(F.col("scope") == "live", F.col("fetched_at"))).over(told.rowsBetween(Window.unboundedPreceding, -1))
    f = fetches.where("fetched_at IS NOT NULL").withColumns({"_i": F.row_number().over(told), "_live_at": live_at})
    f = f.where(~F.coalesce((F.col("scope") == "prematch") & (F.col("fetched_at") - F.col("_live_at") < LIVE_FOR_MS), F.lit(False)))

    in_scope = Window.partitionBy(*_KEYS, "scope").orderBy("_i").rowsBetween(Window.unboundedPreceding, -1)
    f = f.withColumn("_last", F.max("fetched_at").over(in_scope)).where("_last IS NULL OR fetched_at >= _last")

    along = Window.partitionBy(*_KEYS).orderBy("_i")
    newer = F.col("_last").isNull() | (F.col("fetched_at") > F.col("_last"))
    f = f.withColumn("_run", F.sum(newer.cast("int")).over(along.rowsBetween(Window.unboundedPreceding, 0)))
    source = F.max(F.when(F.col("source_id").isNotNull(), F.struct("_run", -F.col("_i"), "source_id"))).over(along.rowsBetween(Window.unboundedPreceding, -1))
    f = f.withColumn("_source", F.when(source["_run"] == F.col("_run"), source["source_id"])).where("_source IS NULL OR _source <=> source_id")
    return f.select(*_KEYS, F.row_number().over(along).alias("_n"), "fetched_at", F.lead("fetched_at").over(along).alias("_next_at"), "quotes")


def recorded_changes(fetches: DataFrame) -> DataFrame:
    """Changes of recorded fetches, each key's in order of ``seq``: a quote is compared with the same one of the fetch before."""
    q = _kept(fetches).select("*", F.posexplode("quotes").alias("_pos", "_q")).select(*_KEYS, "_n", "fetched_at", "_next_at", "_pos", "_q.market", "_q.sel", "_q.odds", F.coalesce("_q.is_open", F.lit(False)).alias("is_open"))
    same = Window.partitionBy(*_KEYS, "market", "sel").orderBy("_n", "_pos")
    q = q.withColumn("_later", F.lead("_n").over(same)).where("_later IS NULL OR _later > _n")  # of a fetch's repeated quotes the last one counts
    q = q.withColumns({"_listed": F.coalesce(F.lag("_n").over(same) == F.col("_n") - 1, F.lit(False)), "_odds": F.lag("odds").over(same), "_open": F.lag("is_open").over(same)})

    changed = ~(F.col("odds").eqNullSafe(F.col("_odds")) & F.col("is_open").eqNullSafe(F.col("_open")))
    set_kind = F.when(~F.col("_listed"), "added").when(changed, "changed")
    removed = F.col("_next_at").isNotNull() & F.coalesce(F.col("_later") > F.col("_n") + 1, F.lit(True))
    row = lambda **c: F.struct(*[v.alias(n) for n, v in c.items()])
    both = F.array(
        row(kind=set_kind, odds=F.col("odds"), is_open=F.col("is_open"), previous_odds=F.when(F.col("_listed"), F.col("_odds")), at=F.col("fetched_at")),
        row(kind=F.when(removed, "removed"), odds=F.lit(None).cast("double"), is_open=F.lit(None).cast("boolean"), previous_odds=F.col("odds"), at=F.col("_next_at")))
    out = q.select(*_KEYS, "market", "sel", F.inline(both)).where("kind IS NOT NULL")
    return out.select(*[F.col(f.name).cast(f.dataType) for f in T.StructType.fromDDL(CHANGES)])


def stream_changes(fetches: DataFrame, expire: bool = False) -> DataFrame:
    """The same over a stream; state is kept by key between micro-batches, with ``expire`` until a key sends nothing for ``KEPT_MS``
    (for streams that run on: a trigger that should end never does with such timers)."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held, out = json.loads(state.get[0]) if state.exists else None, []
        fetched = pd.concat(list(frames))
        for fetch in fetched.sort_values("seq").to_dict("records"):
            held, rows = apply_fetch(held, fetch)
            out += rows
        state.update((json.dumps(held),))
        if expire:
            state.setTimeoutDuration(KEPT_MS)
        yield _frame(key, out)

    return fetches.groupBy(*_KEYS).applyInPandasWithState(run, CHANGES, _STATE, "append", GroupStateTimeout.ProcessingTimeTimeout if expire else GroupStateTimeout.NoTimeout)
