"""Detection with its past over all quotes of ``lineitem``: an event is a run of order keys, its quotes come within ten minutes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..domain import BOOKS
from ..operators import past
from ..operators.groups import group_rows
from . import bindings as B
from .quote_plans import LIMIT, SETTINGS, SPORTS, _groups

_EVENT = "CAST(l_orderkey DIV 400 AS BIGINT)"
_AT = "(l_partkey * 7919 + l_orderkey * 613 + l_linenumber * 104729) % 600000"
_HISTORY = {
    "event_id": _EVENT,
    "sport": "CASE l_orderkey DIV 400 % 4 WHEN 0 THEN 'football' WHEN 1 THEN 'hockey' WHEN 2 THEN 'basketball' ELSE 'tennis' END",
    **{c: B.QUOTES[1][c] for c in ("bk", "market", "sel", "odds", "is_open")},
    "changed_at": _AT,
    "seen_at": f"{_AT} + l_partkey % 60 * 300",
}
#: An event is in one mode for five minutes, then in the next.
_MODES = {0: ("PREMATCH", "LIVE", "event_started"), 1: ("PAUSED", "LIVE", "pause_ended"), 2: ("LIVE", "PAUSED", "pause_started")}
HALF = 300_000
_pick = lambda n: "CASE event_id % 3 " + " ".join(f"WHEN {k} THEN '{v[n]}'" for k, v in _MODES.items()) + " END"


def opportunities_with_past(spark, sf_dir):
    rows = B.relation(spark, sf_dir, ("lineitem", _HISTORY))
    history = rows.groupBy("event_id", "sport", "bk", "market", "sel", "changed_at").agg(F.min("odds").alias("odds"), F.bool_and("is_open").alias("is_open"))
    events = rows.select("event_id", "sport").distinct()
    stages = events.selectExpr("event_id", "0 AS stage", "sport", f"{_pick(0)} AS mode", "CAST(0 AS BIGINT) AS begins", f"CAST({HALF} AS BIGINT) AS ends", f"{_pick(2)} AS end_reason").unionByName(
        events.selectExpr("event_id", "1 AS stage", "sport", f"{_pick(1)} AS mode", f"CAST({HALF} AS BIGINT) AS begins", "CAST(NULL AS BIGINT) AS ends", "CAST(NULL AS STRING) AS end_reason"))
    out = past.opportunities(history, rows.select("event_id", "bk", "seen_at"), stages, _groups(spark), SETTINGS)
    return out.select("event_id", F.col("stage").cast("long").alias("stage"), "group_key", "combo", "first_seen", "shown_at", "ended_at", "end_reason", F.round("margin", 6).alias("margin"), F.round("max_margin", 6).alias("max_margin"))


def _by_mode(name: str, share: float = 1.0) -> str:
    return "CASE mode " + " ".join(f"WHEN '{m}' THEN {int(getattr(v, name) * share)}" for m, v in SETTINGS.modes.items()) + " END"


_FAR = 600_000 + 60 * 300 + 300_002
_NAMED = "CASE {b} " + " ".join(f"WHEN {i} THEN '{b}'" for i, b in enumerate(BOOKS)) + " END"


def _fresh(share: float) -> str:
    return f"""SELECT event_id, stage, sport, mode, ends, end_reason, bk, greatest(h.lo, begins) AS lo, least(h.hi, coalesce(ends, {_FAR}), h.lo + {_by_mode('max_leg_age_ms', share)} + 1) AS hi FROM heard h JOIN stages USING (event_id)
  WHERE greatest(h.lo, begins) < least(h.hi, coalesce(ends, {_FAR}), h.lo + {_by_mode('max_leg_age_ms', share)} + 1)"""


#: The same rules, every interval joined with every other of its event, and the fold as a recursion over the instants of a group.
PAST = f"""
WITH RECURSIVE r AS ({B.sql(("lineitem", {k: v.replace(" DIV ", " // ") for k, v in _HISTORY.items()}))}),
history AS (SELECT event_id, sport, bk, market, sel, changed_at, min(odds) AS odds, bool_and(is_open) AS is_open FROM r GROUP BY ALL),
stages AS (SELECT event_id, sport, 0 AS stage, {_pick(0)} AS mode, 0 AS begins, {HALF} AS ends, {_pick(2)} AS end_reason FROM (SELECT DISTINCT event_id, sport FROM r)
  UNION ALL SELECT event_id, sport, 1, {_pick(1)}, {HALF}, NULL::BIGINT, NULL::VARCHAR FROM (SELECT DISTINCT event_id, sport FROM r)),
dim(sport, group_key, legs, leg, leg_sel, src, market, sel) AS ({B.group_values(group_rows(list(SPORTS), list(B.MARKETS)))}),
heard AS (SELECT event_id, bk, t AS lo, coalesce(lead(t) OVER (PARTITION BY event_id, bk ORDER BY t), {_FAR}) AS hi FROM (SELECT event_id, bk, seen_at AS t FROM r UNION SELECT event_id, bk, changed_at FROM r)),
lately AS ({_fresh(SETTINGS.leg_age_share)}), alive AS ({_fresh(1.0)}),
versions AS (SELECT *, changed_at AS lo, coalesce(lead(changed_at) OVER w, {_FAR}) AS hi, lead(is_open) OVER w AS reopens FROM history WINDOW w AS (PARTITION BY event_id, bk, market, sel ORDER BY changed_at)),
moments AS (SELECT event_id, market, sel, t, coalesce(lead(t) OVER (PARTITION BY event_id, market, sel ORDER BY t), {_FAR}) AS until FROM (SELECT DISTINCT event_id, market, sel, changed_at AS t FROM history)),
held AS (SELECT event_id, market, sel, t, until, bk, odds, changed_at FROM moments JOIN versions v USING (event_id, market, sel) WHERE is_open AND v.lo <= t AND t < v.hi),
others AS (SELECT a.event_id, a.market, a.sel, a.t, a.bk, count(*) AS n, percentile_cont(0.5) WITHIN GROUP (ORDER BY 1.0 / b.odds) AS middle FROM held a JOIN held b USING (event_id, market, sel, t) WHERE a.bk <> b.bk GROUP BY ALL),
open AS (SELECT held.* FROM held LEFT JOIN others USING (event_id, market, sel, t, bk) WHERE coalesce(n, 0) < {SETTINGS.consensus_books} OR abs(1.0 / odds - middle) / middle <= {SETTINGS.consensus_deviation}),
usable AS (SELECT o.event_id, stage, sport, mode, o.bk, market, sel, odds, changed_at, greatest(t, lo) AS lo, least(until, hi) AS hi FROM open o JOIN lately l ON o.event_id = l.event_id AND o.bk = l.bk AND greatest(t, lo) < least(until, hi)),
served AS (SELECT u.*, group_key, legs, leg, src FROM usable u JOIN dim USING (sport, market, sel)),
instants AS (SELECT *, lead(t) OVER (PARTITION BY event_id, stage, group_key ORDER BY t) AS next FROM (SELECT event_id, stage, group_key, lo AS t FROM served UNION SELECT event_id, stage, group_key, hi FROM served)),
best AS (SELECT event_id, stage, group_key, t, next, mode, legs, leg, min({{'p': -odds, 'bk': bk, 'src': src, 'changed': changed_at}}) AS b FROM instants JOIN served s USING (event_id, stage, group_key) WHERE s.lo <= t AND t < s.hi GROUP BY ALL),
combined AS (SELECT event_id, stage, group_key, t, next, mode, string_agg(leg || ':' || b.bk || ':' || b.src, ',' ORDER BY leg) AS combo, (1 / sum(-1.0 / b.p ORDER BY leg) - 1) * 100 AS margin, max(b.changed) AS last, list(b.bk) AS books
  FROM best GROUP BY event_id, stage, group_key, t, next, mode, legs HAVING count(*) = legs AND count(DISTINCT b.bk) >= 2),
asked AS (SELECT event_id, stage, group_key, t, last, unnest(books) AS bk FROM combined WHERE mode <> 'PREMATCH' AND margin >= {LIMIT}),
known AS (SELECT a.event_id, stage, group_key, t, a.bk, min(h.lo) AS sure FROM asked a LEFT JOIN heard h ON a.event_id = h.event_id AND a.bk = h.bk AND h.lo >= last GROUP BY ALL),
ready AS (SELECT event_id, stage, group_key, t, CASE WHEN count(sure) = count(*) THEN max(sure) END AS sure FROM known GROUP BY ALL),
found AS (SELECT event_id, stage, group_key, combo, margin, mode, lo, hi FROM (SELECT c.*, CASE WHEN mode = 'PREMATCH' THEN t WHEN sure IS NOT NULL THEN greatest(t, sure) END AS lo, next AS hi FROM combined c LEFT JOIN ready USING (event_id, stage, group_key, t) WHERE margin >= {LIMIT}) WHERE lo < hi),
legs AS (SELECT event_id, stage, mode, group_key, combo, unnest(string_split(combo, ',')) AS x FROM (SELECT DISTINCT event_id, stage, mode, group_key, combo FROM found)),
parted AS (SELECT event_id, stage, mode, group_key, combo, CAST(split_part(x, ':', 1) AS INT) AS leg, CAST(split_part(x, ':', 2) AS INT) AS bk, CAST(split_part(x, ':', 3) AS INT) AS src FROM legs),
sided AS (SELECT p.*, market, sel FROM parted p JOIN (SELECT DISTINCT event_id, sport FROM r) USING (event_id) JOIN dim USING (sport, group_key, leg, src)),
pieces AS (SELECT v.event_id, stage, v.bk, market, sel, odds, greatest(v.lo, a.lo) AS lo, least(v.hi, a.hi) AS hi, CASE WHEN least(v.hi, a.hi) = ends THEN end_reason WHEN least(v.hi, a.hi) = v.hi AND reopens = false THEN 'suspended' ELSE 'stale' END AS reason
  FROM versions v JOIN alive a ON v.event_id = a.event_id AND v.bk = a.bk AND greatest(v.lo, a.lo) < least(v.hi, a.hi) WHERE is_open),
changes AS (SELECT event_id, stage, bk, market, sel, lo AS t, odds, NULL::VARCHAR AS reason FROM pieces UNION ALL SELECT event_id, stage, bk, market, sel, hi, NULL::DOUBLE, reason FROM pieces ANTI JOIN (SELECT event_id, stage, bk, market, sel, lo AS hi FROM pieces) USING (event_id, stage, bk, market, sel, hi)),
of_leg AS (SELECT event_id, stage, mode, group_key, combo, leg, bk, t, coalesce(lead(t) OVER (PARTITION BY event_id, stage, group_key, combo, leg ORDER BY t), {_FAR + 1}) AS until, odds, lag(odds) OVER (PARTITION BY event_id, stage, group_key, combo, leg ORDER BY t) AS old, reason FROM sided JOIN changes USING (event_id, stage, bk, market, sel)),
points AS (SELECT DISTINCT event_id, stage, group_key, combo, t FROM of_leg),
state AS (SELECT a.event_id, a.stage, a.group_key, a.combo, a.t, any_value(mode) AS mode, count(*) FILTER (odds IS NOT NULL) AS sound, len(string_split(a.combo, ',')) AS legs, (1 / sum(1.0 / odds ORDER BY leg) - 1) * 100 AS margin,
  min({{'leg': leg, 'why': CASE reason WHEN 'stale' THEN 'stale:' || {_NAMED.format(b='bk')} ELSE reason END}}) FILTER (odds IS NULL) AS dead, arg_max(bk, {{'rise': 1.0 / odds - 1.0 / old, 'leg': -leg}}) FILTER (o.t = a.t AND odds <> old) AS worst
  FROM points a JOIN of_leg o ON a.event_id = o.event_id AND a.stage = o.stage AND a.group_key = o.group_key AND a.combo = o.combo AND o.t <= a.t AND a.t < o.until GROUP BY ALL),
lives AS (SELECT event_id, stage, group_key, combo, t, CASE WHEN sound = legs AND margin >= {LIMIT} THEN margin END AS margin, CASE WHEN sound < legs THEN dead.why WHEN margin < {LIMIT} THEN 'leg_odds_changed:' || {_NAMED.format(b='worst')} END AS reason FROM state),
times AS (SELECT event_id, stage, group_key, t FROM lives UNION SELECT event_id, stage, group_key, lo FROM found UNION SELECT event_id, stage, group_key, hi FROM found),
steps AS (SELECT event_id, stage, group_key, t, row_number() OVER (PARTITION BY event_id, stage, group_key ORDER BY t) AS n, (SELECT {_by_mode('confirm_ms')} FROM stages s WHERE s.event_id = x.event_id AND s.stage = x.stage) AS wait FROM times x),
told AS (SELECT event_id, stage, group_key, t, list({{'combo': combo, 'margin': margin, 'reason': reason}}) AS news FROM lives GROUP BY ALL),
full_steps AS MATERIALIZED (SELECT s.*, coalesce(news, []) AS news, f.combo AS fc, f.margin AS fm FROM steps s LEFT JOIN told USING (event_id, stage, group_key, t) LEFT JOIN found f ON f.event_id = s.event_id AND f.stage = s.stage AND f.group_key = s.group_key AND f.lo <= s.t AND s.t < f.hi),
run AS (SELECT DISTINCT event_id, stage, group_key, 0::BIGINT AS n, CAST([] AS STRUCT(combo VARCHAR, first_seen BIGINT, shown_at BIGINT, margin DOUBLE, max_margin DOUBLE, now DOUBLE)[]) AS held, NULL::VARCHAR AS pc, NULL::BIGINT AS ps, NULL::VARCHAR AS fc, NULL::DOUBLE AS fm,
    CAST([] AS STRUCT(combo VARCHAR, first_seen BIGINT, shown_at BIGINT, ended_at BIGINT, end_reason VARCHAR, margin DOUBLE, max_margin DOUBLE)[]) AS done FROM full_steps
  UNION ALL SELECT event_id, stage, group_key, n, CASE WHEN made THEN list_append(held2, {{'combo': nfc, 'first_seen': CASE WHEN wait = 0 THEN t ELSE ps1 END, 'shown_at': t, 'margin': nfm, 'max_margin': nfm, 'now': nfm}}) ELSE held2 END,
    CASE WHEN free AND NOT made THEN nfc END, CASE WHEN free AND NOT made THEN CASE WHEN pc1 = nfc THEN ps1 ELSE t END END, nfc, nfm, done FROM (
    SELECT *, free AND (wait = 0 OR coalesce(pc1 = nfc AND t - ps1 >= wait, false)) AS made FROM (
    SELECT *, nfc IS NOT NULL AND len(held2) < {past.MOST_AT_ONCE} AND len(list_filter(held2, lambda a: a.combo = nfc OR a.now >= nfm - {past.CLOSE})) = 0 AS free FROM (
    SELECT *, list_transform(list_filter(held1, lambda a: len(list_filter(news, lambda e: e.combo = a.combo AND e.margin IS NULL)) > 0), lambda a: {{'combo': a.combo, 'first_seen': a.first_seen, 'shown_at': a.shown_at, 'ended_at': t, 'end_reason': list_filter(news, lambda e: e.combo = a.combo)[1].reason, 'margin': a.margin, 'max_margin': a.max_margin}}) AS done,
      list_transform(list_filter(held1, lambda a: len(list_filter(news, lambda e: e.combo = a.combo AND e.margin IS NULL)) = 0), lambda a: {{'combo': a.combo, 'first_seen': a.first_seen, 'shown_at': a.shown_at, 'margin': a.margin,
        'max_margin': greatest(a.max_margin, coalesce(list_filter(news, lambda e: e.combo = a.combo)[1].margin, a.now)), 'now': coalesce(list_filter(news, lambda e: e.combo = a.combo)[1].margin, a.now)}}) AS held2 FROM (
    SELECT s.event_id, s.stage, s.group_key, s.n, s.t, s.wait, s.news, s.fc AS nfc, s.fm AS nfm, CASE WHEN ps + wait < s.t THEN NULL ELSE pc END AS pc1, ps AS ps1,
      CASE WHEN pc IS NOT NULL AND ps + wait < s.t THEN list_append(held, {{'combo': q.fc, 'first_seen': ps, 'shown_at': ps + wait, 'margin': q.fm, 'max_margin': q.fm, 'now': q.fm}}) ELSE held END AS held1
      FROM run q JOIN full_steps s ON s.event_id = q.event_id AND s.stage = q.stage AND s.group_key = q.group_key AND s.n = q.n + 1))))),
ended AS (SELECT event_id, stage, group_key, unnest(done) AS x FROM run)
SELECT event_id, CAST(stage AS BIGINT) AS stage, group_key, x.combo AS combo, x.first_seen AS first_seen, x.shown_at AS shown_at, x.ended_at AS ended_at, x.end_reason AS end_reason, round(x.margin, 6) AS margin, round(x.max_margin, 6) AS max_margin FROM ended
"""

QUERIES = {"opportunities_with_past": (opportunities_with_past, PAST)}
