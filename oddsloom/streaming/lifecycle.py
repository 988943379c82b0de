"""Opportunities as keyed state: one machine an event, over a stream or over recorded messages.

Messages are rows ``event_id, at, seq, kind, body`` (JSON), handled in order of ``seq``; ``at`` is detection time, in which
lifetimes are measured. Kinds: ``event`` (sport, mode, start, finished), ``quotes`` (bk, seen_at, quotes: [market, sel, odds,
is_open, changed_at]), ``seen`` (bk, seen_at), ``removed`` (bk), ``sweep`` (nothing). Processing-time timers would not be
reproducible, so sweeps are messages.

Rules kept per group of equivalent bets: the best quote of each leg among enabled books confirmed recently, outliers left
out; at least two books; in play all legs confirmed after the last change; the same combination for the mode's confirmation
time before it shows, though its life counts from first sight; at most three opportunities at once, none within 0.05 of one
that runs. An opportunity ends when a leg is suspended or stale, its margin falls (the leg whose inverse price rose most is
named), or its event changes mode.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from statistics import median

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..domain import BOOKS, Settings
from ..operators.groups import candidate_groups, group_legs
from ..operators.series import fold

OUTPUT = "event_id long, group_key string, combo string, change string, at long, first_seen long, margin double, max_margin double, end_reason string"
MOST_AT_ONCE = 3
TICK_MS = 200
#: How long a stream keeps the state of an event that sends nothing, and of one that has finished.
KEPT_MS = 7 * 86_400_000
FINISHED_KEPT_MS = 86_400_000


def _reason(before: dict, after: dict) -> str | None:
    if after["finished"] and not before["finished"]:
        return "event_finished"
    moves = {("PAUSED", "LIVE"): "pause_ended", ("LIVE", "PAUSED"): "pause_started"}
    if before["mode"] == after["mode"]:
        return None
    return "event_started" if before["mode"] == "PREMATCH" else moves.get((before["mode"], after["mode"]), "event_finished")


class EventMachine:
    """State of one event; ``handle`` takes a message and gives what changed."""

    def __init__(self, settings: Settings, state: str | None = None):
        self.settings = settings
        held = json.loads(state) if state else {}
        self.event: dict | None = held.get("event")
        self.books: dict[str, dict] = held.get("books", {})
        self.alive: list[dict] = held.get("alive", [])
        self.pending: dict[str, list] = held.get("pending", {})
        self.waiting: list[str] = held.get("waiting", [])

    def dump(self) -> str:
        return json.dumps({"event": self.event, "books": self.books, "alive": self.alive, "pending": self.pending, "waiting": self.waiting})

    def handle(self, kind: str, body: dict, now: int) -> list[dict]:
        self.out: list[dict] = []
        touched = getattr(self, f"_on_{kind}")(body, now)
        for group in dict.fromkeys(touched):
            self._evaluate(group, now)
        return self.out

    # messages: each returns the groups to evaluate

    def _on_event(self, body: dict, now: int) -> list[str]:
        before, self.event = self.event, body
        if before and (reason := _reason(before, body)):
            for arb in list(self.alive):
                self._end(arb, reason, now)
        if before and before["mode"] != body["mode"]:
            self.pending.clear()
        return self._groups(self._markets()) if not before or before["mode"] != body["mode"] else []

    def _on_quotes(self, body: dict, now: int) -> list[str]:
        bk = str(body["bk"])
        before = self.books.get(bk, {"quotes": {}})["quotes"]
        quotes = {f"{m}\t{s}": [o, p, c] for m, s, o, p, c in body["quotes"]}
        self.books[bk] = {"seen_at": body["seen_at"], "quotes": quotes}
        changed = {k.split("\t")[0] for k in quotes.keys() | before.keys() if quotes.get(k, [None])[:2] != before.get(k, [None])[:2]}
        return self._groups(changed) + self._unblocked()

    def _on_seen(self, body: dict, now: int) -> list[str]:
        book = self.books.get(str(body["bk"]))
        if not book:
            return []
        stale = body["seen_at"] - book["seen_at"] > self._mode().max_leg_age_ms
        book["seen_at"] = max(book["seen_at"], body["seen_at"])
        own = {k.split("\t")[0] for k in book["quotes"]} if stale else set()
        return self._groups(own) + self._unblocked()

    def _on_removed(self, body: dict, now: int) -> list[str]:
        gone = self.books.pop(str(body["bk"]), {"quotes": {}})
        return self._groups({k.split("\t")[0] for k in gone["quotes"]})

    def _on_sweep(self, body: dict, now: int) -> list[str]:
        for arb in list(self.alive):
            if self.event["mode"] == "PREMATCH" and self.event["start"] <= now:
                self._end(arb, "event_started", now)
                continue
            old = [leg["bk"] for leg in arb["legs"] if now - self.books.get(leg["bk"], leg)["seen_at"] > self._mode().max_leg_age_ms]
            if old:  # the last one names the reason
                self._end(arb, f"stale:{BOOKS[int(old[-1])]}", now)
        return [g for g, (_, since) in self.pending.items() if now - since >= self._mode().confirm_ms]

    # evaluation

    def _mode(self):
        return self.settings.modes[self.event["mode"] if self.event else "PREMATCH"]

    def _markets(self) -> set[str]:
        return {k.split("\t")[0] for b in self.books.values() for k in b["quotes"]}

    def _groups(self, markets: set[str]) -> list[str]:
        if not self.event:
            return []
        found = [g for m in sorted(markets) for g in candidate_groups(self.event["sport"], m)]
        return found + [a["group"] for a in self.alive if any(leg["market"] in markets for leg in a["legs"])]

    def _unblocked(self) -> list[str]:
        groups, self.waiting = self.waiting, []
        return groups

    def _price(self, bk: str, odds: float) -> float:
        fee = self.settings.fee.get(bk, 0.0)
        return odds * (1 - fee / 100) if fee > 0 else odds

    def _outlier(self, bk: str, key: str, odds: float) -> bool:
        others = [1 / b["quotes"][key][0] for k, b in self.books.items() if k != bk and key in b["quotes"] and b["quotes"][key][1]]
        return len(others) >= self.settings.consensus_books and abs(1 / odds - median(others)) / median(others) > self.settings.consensus_deviation

    def _best(self, group: str, now: int) -> list[dict] | None:
        running = {(leg["leg"], leg["bk"], leg["market"]) for a in self.alive if a["group"] == group for leg in a["legs"]}
        age, legs = self._mode().max_leg_age_ms * self.settings.leg_age_share, []
        for sel, sources in group_legs(self.event["sport"], group):
            best = None
            for bk in sorted(self.books, key=int):
                book = self.books[bk]
                if int(bk) in self.settings.disabled or now - book["seen_at"] > age:
                    continue
                for market, source in sources:
                    odds, is_open, changed = book["quotes"].get(f"{market}\t{source}", (0, False, 0))
                    if not is_open or self._outlier(bk, f"{market}\t{source}", odds):
                        continue
                    price = self._price(bk, odds)
                    if best is None or price > best["price"] or (price == best["price"] and (sel, bk, market) in running):
                        best = {"leg": sel, "bk": bk, "market": market, "sel": source, "odds": odds, "price": price, "changed_at": changed, "seen_at": book["seen_at"]}
            if best is None:
                return None
            legs.append(best)
        return legs or None

    def _candidate(self, group: str, now: int) -> tuple[str, float, list[dict]] | None:
        ev = self.event
        if not ev or ev["finished"] or (ev["mode"] == "PREMATCH" and ev["start"] <= now):
            return None
        legs = self._best(group, now)
        if not legs or len({leg["bk"] for leg in legs}) < 2:
            return None
        margin = _margin(legs)
        if margin < self._mode().min_margin:
            return None
        if ev["mode"] != "PREMATCH" and min(leg["seen_at"] for leg in legs) < max(leg["changed_at"] for leg in legs):
            self.waiting.append(group)
            return None
        combo = ",".join(f"{leg['leg']}:{leg['bk']}:{leg['market']}" for leg in legs)
        own = [a for a in self.alive if a["group"] == group]
        if len(own) >= MOST_AT_ONCE or any(a["combo"] == combo or a["margin"] >= margin - 0.05 for a in own):
            return None
        return combo, margin, legs

    def _evaluate(self, group: str, now: int) -> None:
        for arb in [a for a in self.alive if a["group"] == group]:
            self._recheck(arb, now)
        found = self._candidate(group, now)
        if found is None:
            self.pending.pop(group, None)
            return
        combo, margin, legs = found
        since = now
        if wait := self._mode().confirm_ms:
            seen = self.pending.get(group)
            if not seen or seen[0] != combo:
                self.pending[group] = [combo, now]
                return
            if now - seen[1] < wait:
                return
            since = seen[1]
        self.pending.pop(group, None)
        arb = {"group": group, "combo": combo, "legs": legs, "margin": margin, "max_margin": margin, "first_seen": since, "tick": now}
        self.alive.append(arb)
        self._tell(arb, "new", now)

    def _recheck(self, arb: dict, now: int) -> None:
        worst, fresh = None, []
        for leg in arb["legs"]:
            book = self.books.get(leg["bk"])
            quote = book and book["quotes"].get(f"{leg['market']}\t{leg['sel']}")
            if not quote or not quote[1]:
                return self._end(arb, "suspended", now)
            if now - book["seen_at"] > self._mode().max_leg_age_ms:
                return self._end(arb, f"stale:{BOOKS[int(leg['bk'])]}", now)
            rise = 1 / quote[0] - 1 / leg["odds"]
            if quote[0] != leg["odds"] and (worst is None or rise > worst[0]):
                worst = (rise, leg["bk"])
            fresh.append(leg | {"odds": quote[0], "price": self._price(leg["bk"], quote[0]), "changed_at": quote[2], "seen_at": book["seen_at"]})
        margin = _margin(fresh)
        if margin < self._mode().min_margin:
            return self._end(arb, f"leg_odds_changed:{BOOKS[int(worst[1])]}" if worst else "threshold_changed", now)
        if worst:
            arb.update(legs=fresh, margin=margin, max_margin=max(arb["max_margin"], margin))
            if now - arb["tick"] >= TICK_MS:
                arb["tick"] = now
                self._tell(arb, "update", now)
        return None

    def _end(self, arb: dict, reason: str, now: int) -> None:
        self.alive.remove(arb)
        self._tell(arb, "end", max(now, arb["first_seen"]), reason)

    def _tell(self, arb: dict, change: str, at: int, reason: str | None = None) -> None:
        self.out.append({"group_key": arb["group"], "combo": arb["combo"], "change": change, "at": at, "first_seen": arb["first_seen"], "margin": arb["margin"], "max_margin": arb["max_margin"], "end_reason": reason})


def _margin(legs: list[dict]) -> float:
    return (1 / sum(1 / leg["price"] for leg in legs) - 1) * 100


def _frame(event_id: int, rows: list[dict]) -> pd.DataFrame:
    columns = [c.split()[0] for c in OUTPUT.split(", ")]
    return pd.DataFrame([{"event_id": event_id, **r} for r in rows], columns=columns).astype({"margin": "float64", "max_margin": "float64"})


def recorded_opportunities(messages: DataFrame, settings: Settings | None = None) -> DataFrame:
    """Changes of opportunities over recorded messages, each event's in order of ``seq``."""
    own = settings or Settings()

    def step(machine: EventMachine, m: dict) -> tuple[EventMachine, list[dict]]:
        return machine, machine.handle(m["kind"], json.loads(m["body"]), int(m["at"]))

    return fold(messages, ["event_id"], ["seq"], lambda: EventMachine(own), step, OUTPUT)


def stream_opportunities(messages: DataFrame, settings: Settings | None = None, expire: bool = False) -> DataFrame:
    """The same over a stream; the machine is kept as JSON by event between micro-batches.

    With ``expire`` the state of an event without messages goes after ``KEPT_MS``, that of a finished one after
    ``FINISHED_KEPT_MS``: for streams that run on. A trigger that should end (``availableNow``) never does with such timers.
    """
    own = settings or Settings()

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        machine, out = EventMachine(own, state.get[0] if state.exists else None), []
        for m in pd.concat(list(frames)).sort_values("seq").itertuples():
            out += machine.handle(m.kind, json.loads(m.body), int(m.at))
        state.update((machine.dump(),))
        if expire:
            state.setTimeoutDuration(FINISHED_KEPT_MS if machine.event and machine.event["finished"] else KEPT_MS)
        yield _frame(key[0], out)

    return messages.groupBy("event_id").applyInPandasWithState(run, OUTPUT, "machine string", "append", GroupStateTimeout.ProcessingTimeTimeout if expire else GroupStateTimeout.NoTimeout)
