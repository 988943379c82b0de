"""Operators on small inputs with results worked out by hand or by brute force."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from oddsloom import stored
from oddsloom.domain import Settings
from oddsloom.functions import names
from oddsloom.functions import scalars as S
from oddsloom.operators import cdc, cox, detect, groups, ladder, matching, output, review, series, stakes, states, survival, validate
from oddsloom.plans.bindings import MARKETS
from oddsloom.sources import feeds, market_ids, pricing


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_keys(spark):
    key = lambda t, s, x: S.market_key(F.lit(t), F.lit(s), F.lit(x).cast("double"))
    r = one(spark, a=key("OU", "REG", 2.5), b=key("AH", "REG", -0.0), c=key("AH", "H1", -0.5), d=key("OU", "REG", None), e=key("1X2", "REG", None), f=S.swap_market_key(F.lit("AH|REG|-1.5")), g=S.swap_market_key(F.lit("OU_HOME|REG|1.5")), h=S.swap_market_key(F.lit("H_DA|P1")))
    assert tuple(r) == ("OU|REG|2.5", "AH|REG|0", "AH|H1|-0.5", None, "1X2|REG", "AH|REG|1.5", "OU_AWAY|REG|1.5", "A_HD|P1")
    r = one(spark, **{f"k{i}": S.is_market_key(F.lit(k)) for i, k in enumerate(("1X2|REG", "OU|REG", "OU|REG|2.5", "1X2|REG|1", "XX|REG", "DNB|ZZ", "OU|REG|x"))})
    assert tuple(r) == (True, False, True, False, False, False, False)


def test_rounding(spark):
    assert tuple(one(spark, a=S.half_up(F.lit(-2.5)), b=S.half_up(F.lit(1.005), 2), c=S.site_price(F.lit(1.999)), d=S.site_price(F.lit(1.999), floor=True), e=S.site_price(F.lit(1.0)), f=S.comma_price(F.lit("1 2,35")))) == (-2.0, 1.0, 2.0, 1.99, None, 12.35)


def test_groups():
    legs = dict(groups.group_legs("football", "1X2|REG"))
    assert legs["HOME"] == [("1X2|REG", "HOME"), ("AH|REG|-0.5", "HOME")] and legs["DRAW"] == [("1X2|REG", "DRAW")]
    assert groups.group_legs("tennis", "H_DA|REG") == [] and groups.group_legs("football", "DC|REG") == []
    assert groups.candidate_groups("hockey", "AH|MATCH|0.5") == ["ML|MATCH"]
    assert groups.candidate_groups("football", "AH|REG|-0.5") == ["1X2|REG", "H_DA|REG"]


def quotes(spark, rows):
    full = [(1, "football", "PREMATCH", bk, m, s, o, True, 0, 0) for bk, m, s, o in rows]
    return spark.createDataFrame(full, "event_id long, sport string, mode string, bk int, market string, sel string, odds double, is_open boolean, changed_at long, seen_at long")


def found(spark, rows):
    dim = spark.createDataFrame(groups.group_rows(["football"], list(MARKETS)), groups.SCHEMA)
    return {r.group_key: r for r in detect.arbs(quotes(spark, rows), dim, Settings(), check_consensus=False).collect()}


def test_detection(spark):
    assert found(spark, [(0, "DNB|REG", "HOME", 2.1), (1, "DNB|REG", "AWAY", 2.1)])["DNB|REG"].margin == pytest.approx(5)
    assert not found(spark, [(0, "DNB|REG", "HOME", 2.1), (0, "DNB|REG", "AWAY", 2.1)])  # one book
    across = found(spark, [(0, "1X2|REG", "HOME", 2.6), (1, "DC|REG", "DRAW_AWAY", 1.75)])
    assert across["H_DA|REG"].margin == pytest.approx((1 / (1 / 2.6 + 1 / 1.75) - 1) * 100)
    tie = found(spark, [(0, "DNB|REG", "HOME", 2.2), (2, "DNB|REG", "AWAY", 2.2), (1, "DNB|REG", "AWAY", 2.2)])["DNB|REG"]
    assert [leg.bk for leg in tie.leg_list] == [0, 1]


def brute_plan(odds, bank, unit):
    inverse = sum(1 / o for o in odds)

    def best(total):
        out = None
        for mask in range(2 ** len(odds)):
            own = [(math.floor(total / o / inverse / unit) + (mask >> i & 1)) * unit for i, o in enumerate(odds)]
            if min(own) <= 0:
                continue
            least = min(math.floor((s * o - sum(own)) * 100 + 0.5) / 100 for s, o in zip(own, odds))
            rank = (least > 0, least, -abs(sum(own) - bank), -mask)
            if out is None or rank > out[0]:
                out = (rank, own)
        return out

    first = best(bank)
    if first and not first[0][0]:
        for k in range(1, min(400, int(bank / unit / 2)) + 1):
            for total in (bank - k * unit, bank + k * unit):
                if 0 < total <= bank * 1.05 and (b := best(total)) and b[0][0]:
                    return b[1]
    return first and first[1]


def test_stakes_equal_brute_force(spark):
    rng, rows = random.Random(4), []
    while len(rows) < 40:
        odds = [round(rng.uniform(1.2, 9), 2) for _ in range(rng.choice([2, 3]))]
        if 0 < 1 / sum(1 / o for o in odds) - 1 < 0.08:
            rows.append((len(rows), odds))
    for bank, unit in ((1000.0, 1.0), (200.0, 10.0)):
        got = {r.id: r for r in stakes.allocate(spark.createDataFrame(rows, "id int, odds array<double>"), ["id"], "odds", bank, unit).collect()}
        for i, odds in rows:
            assert (got[i].stakes if i in got else None) == brute_plan(odds, bank, unit), odds
            assert not got.get(i) or got[i].positive == (got[i].min_profit > 0)


def test_kaplan_meier_of_the_textbook(spark):
    obs = spark.createDataFrame([(0, 1, True), (0, 2, True), (0, 2, False), (0, 3, True), (0, 4, False), (0, 5, True)], "k int, duration_ms long, event boolean")
    curve = {r.t: r.s for r in survival.kaplan_meier(obs, ["k"]).collect()}
    assert curve[1] == pytest.approx(5 / 6) and curve[2] == pytest.approx(4 / 6) and curve[3] == pytest.approx(4 / 9) and curve[5] == 0
    asked = spark.createDataFrame([(7, 0, 0), (8, 0, 2), (9, 0, 4), (10, 0, 99)], "id long, k int, t long")
    at = {r.id: r.s for r in survival.survival_at(survival.kaplan_meier(obs, ["k"]), asked, ["k"], "t", 2).collect()}
    assert [at[7], at[8], at[9], at[10]] == pytest.approx([1, 4 / 6, 4 / 9, 0])


def test_cox(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 2))
    t = np.ceil(rng.exponential(np.exp(-x @ [0.8, -0.5])) * 20)
    e = rng.random(400) < 0.8
    beta = cox.fit(x, t, e, penalty=0.0)
    assert beta == pytest.approx([0.8, -0.5], abs=0.2)
    assert 0.6 < cox.concordance(t, e, x @ beta) < 0.9
    model = cox.CoxModel({"mode": ("LIVE", "other")}, {"margin": (2.0, 1.0)}, {"mode=other": 0.5, "margin": 0.1}, ((1000.0, 0.1), (3000.0, 0.4)))
    assert [model.hazard(v) for v in (0, 500, 2000, 9000)] == pytest.approx([0, 0.05, 0.25, 0.4])
    row = model.predict(spark.createDataFrame([("PREMATCH", 3.0)], "mode string, margin double"), F.lit(2000.0)).first()
    assert row.lp == pytest.approx(0.6) and row.p_needed == pytest.approx(math.exp(-0.25 * math.exp(0.6)))


def test_cox_trains_on_all_rows(spark):
    rng = np.random.default_rng(2)
    n = 1500
    mode, margin = rng.choice(["A", "B", "C"], n, p=[0.5, 0.3, 0.2]), rng.integers(0, 20, n) / 4
    t = np.ceil(rng.exponential(np.exp(-0.7 * (mode == "B") - 0.1 * margin)) * 20) * 1000
    e, seen = rng.random(n) < 0.8, rng.integers(0, 40, n)
    rows = [(int(i), int(seen[i]), int(t[i]), bool(e[i]), str(mode[i]), float(margin[i])) for i in range(n)]
    obs = spark.createDataFrame(rows, "arb_id long, first_seen long, duration_ms long, event boolean, mode string, margin double").repartition(3)
    model = cox.train(obs, {"mode": 5}, ["margin"])
    order = np.lexsort((np.arange(n), seen))
    a, b = order[: int(n * 0.8)], order[int(n * 0.8) :]
    mean, std = margin[a].mean(), margin[a].std()
    x = np.stack([mode == "B", mode == "C", (margin - mean) / std], 1).astype(float)
    beta = cox.fit(x[a], t[a], e[a])
    assert model.categorical == {"mode": ("A", "B", "C")} and model.n_train == len(a)
    assert [model.coef[k] for k in ("mode=B", "mode=C", "margin")] == pytest.approx(beta.tolist(), abs=1e-7)
    assert np.array(model.baseline) == pytest.approx(np.array(cox.baseline(x[a], t[a], e[a], beta)), rel=1e-6)
    risk = np.round(x @ beta, 12)
    assert model.c_index == pytest.approx(cox.concordance(t[b], e[b], risk[b]), abs=1e-9)
    assert model.metrics["c_index_train"] == pytest.approx(cox.concordance(t[a], e[a], risk[a]), abs=1e-9)
    assert sum(g["n"] for g in model.metrics["calibration"]) == len(b)
    assert not hasattr(cox, "MOST_OBSERVATIONS")


@pytest.mark.parametrize(("a", "b", "sport", "same"), [
    ("FC Bayern München", "Bayern Munich", "football", True),
    ("Slavia Praha", "SK Slavia Prague", "football", True),
    ("Man United", "Manchester Utd", "football", True),
    ("Sparta Praha", "Slavia Praha", "football", False),
    ("Chelsea U21", "Chelsea", "football", False),
    ("Real Madrid", "Atletico Madrid", "football", False),
    ("N. Djokovic", "Novak Djokovic", "tennis", True),
    ("Djokovic Novak", "Novak Djokovic", "tennis", True),
    ("Serena Williams", "Venus Williams", "tennis", False),
])
def test_names(a, b, sport, same):
    score = names.similarity(a, b, sport)
    assert (score >= Settings().auto_accept) == same, score
    assert score == pytest.approx(names.similarity(b, a, sport))


def test_similarity_parts():
    assert names.dice("night", "nacht") == 0.5 and names.dice("aa", "aa") == 1  # 3 of 6 padded pairs
    assert names.jaro_winkler("martha", "marhta") == pytest.approx(0.9611, abs=1e-3)
    assert names.fold("Łódź F.C. / Århus’s") == "lodz fc / arhuss"


def entry(i, bk, home, away, start, sport="football"):
    return (i, sport, bk, home, away, start)


def test_resolution(spark):
    kinds = "entry_id long, sport string, bk int, home string, away string, start long"
    events = spark.createDataFrame([(1, "football", "Slavia Praha", "Sparta Praha", 0, 11, 12), (2, "football", "Arsenal", "Chelsea", 0, 21, 22), (3, "tennis", "Novak Djokovic", "Carlos Alcaraz", 0, 31, 32)], "event_id long, sport string, home string, away string, start long, home_id long, away_id long")
    minute = 60_000
    entries = spark.createDataFrame([
        entry(1, 0, "SK Slavia Prague", "AC Sparta Prague", 5 * minute), entry(2, 1, "Gunners", "Blues", 0), entry(3, 0, "C. Alcaraz", "N. Djokovic", 2 * minute, "tennis"),
        entry(4, 2, "Boca Juniors", "River Plate", 0), entry(5, 3, "Arsenal", "Chelsea", 9 * minute), entry(6, 4, "Arsenal", "Chelsea", 100 * minute), entry(7, 5, "Arsenal FC", "Chelsea FC", 0)], kinds)
    links = spark.createDataFrame([(3, 5, 2, False), (5, 99, 2, False)], "bk int, entry_id long, event_id long, swapped boolean")
    aliases = spark.createDataFrame([(1, "football", "Gunners", 21), (1, "football", "Blues", 22)], "bk int, sport string, raw_name string, participant_id long")
    rejected = spark.createDataFrame([], "entry_id long, event_id long")
    got = {r.entry_id: (r.status, r.method, r.event_id, r.swapped) for r in review.resolve(entries, events, links, aliases, rejected, Settings()).collect()}
    assert got[1] == ("linked", "auto", 1, False) and got[2] == ("linked", "alias", 2, False)
    assert got[3] == ("linked", "auto", 3, True) and got[5] == ("linked", "link", 2, False)
    assert got[6] == ("linked", "auto", 2, False)  # almost equal names, in the wide window
    assert got[4][0] == "create" and got[7][0] == "create"  # book 5 has the event already
    assert len(got) == 7


def test_aliases_respect_links_rejections_and_one_event_a_book(spark):
    events = spark.createDataFrame([(2, "football", "Arsenal", "Chelsea", 0, 21, 22)], "event_id long, sport string, home string, away string, start long, home_id long, away_id long")
    entries = spark.createDataFrame(
        [entry(1, 1, "Gunners", "Blues", 60_000), entry(2, 1, "Gunners", "Blues", 0), entry(3, 2, "Gunners", "Blues", 0), entry(4, 3, "Blues", "Gunners", 0), entry(5, 4, "Gunners", "Blues", 0)],
        "entry_id long, sport string, bk int, home string, away string, start long")
    aliases = spark.createDataFrame([(b, "football", n, i) for b in (1, 2, 3, 4) for n, i in (("Gunners", 21), ("Blues", 22))], "bk int, sport string, raw_name string, participant_id long")
    links = spark.createDataFrame([(2, 99, 2, False)], "bk int, entry_id long, event_id long, swapped boolean")
    rejected = spark.createDataFrame([(5, 2)], "entry_id long, event_id long")
    got = {r.entry_id: (r.method, r.event_id, r.swapped) for r in review.resolve(entries, events, links, aliases, rejected, Settings()).collect()}
    assert got[2] == ("alias", 2, False) and got[4] == ("alias", 2, True)
    assert {got[i][0] for i in (1, 3, 5)} == {"create"}  # a second entry of the book, a book that has the event, a rejected pair


def test_resolution_by_all_names_and_by_names_near_in_time(spark, monkeypatch, capsys):
    rng, minute = random.Random(5), 60_000
    known = ["red ring", "red bolt", "FC Red Ring", "blue gear", "bolt blue", "red bolts", "gear", None]
    events = spark.createDataFrame([(i, rng.choice(["football", "tennis"]), rng.choice(known), rng.choice(known), rng.randrange(800) * minute, 100 + i, 200 + i) for i in range(120)], "event_id long, sport string, home string, away string, start long, home_id long, away_id long")
    rows = spark.createDataFrame([entry(i, rng.randrange(4), rng.choice(known), rng.choice(known), rng.randrange(800) * minute, rng.choice(["football", "tennis"])) for i in range(120)], "entry_id long, sport string, bk int, home string, away string, start long")
    links = spark.createDataFrame([(i % 4, i, i + 1, False) for i in range(0, 120, 9)], "bk int, entry_id long, event_id long, swapped boolean").join(rows.select("bk", "entry_id"), ["bk", "entry_id"], "left_semi")
    aliases = spark.createDataFrame([(1, "football", "red ring", 101)], "bk int, sport string, raw_name string, participant_id long")
    rejected = spark.createDataFrame([(i, i + 2) for i in range(120)], "entry_id long, event_id long")
    results = []
    for most in (0, 10**9):
        monkeypatch.setattr(matching, "COMPARED", most)
        results.append(sorted(tuple(r) for r in review.resolve(rows, events, links, aliases, rejected, Settings()).select("entry_id", "method", "event_id", "swapped").na.fill(-1, ["event_id"]).collect()))
    assert results[0] == results[1] and len(results[0]) == 120 and {"auto", "review", "create"} <= {r[1] for r in results[0]}
    names_ = matching.compared(rows, matching.as_candidates(events), 360 * minute)
    assert names_.groupBy("sport", "a", "b").count().where("count > 1").count() == 0
    matching.scored_pool(rows, events, links, rejected, Settings(), names_).explain()
    plan = capsys.readouterr().out
    assert plan.count("BroadcastHashJoin [sport") >= 4  # pairs are not shuffled to meet the scores of names


def test_taken_and_rejected_events_are_known_where_pairs_are_made(spark, capsys):
    minute = 60_000
    events = spark.createDataFrame([(i, "football", "red ring", "blue gear", i * minute) for i in range(6)], "event_id long, sport string, home string, away string, start long")
    rows = spark.createDataFrame([entry(i, i % 3, "red ring", "blue gear", i * minute) for i in range(6)], "entry_id long, sport string, bk int, home string, away string, start long")
    links, rejected = [(0, 7, 2, False), (1, 8, 2, False), (2, 9, 5, False)], [(4, 4), (4, 1), (0, 3)]
    names_ = matching.compared(rows, matching.as_candidates(events), 360 * minute)
    pool = matching.scored_pool(rows, events, spark.createDataFrame(links, "bk int, entry_id long, event_id long, swapped boolean"), spark.createDataFrame(rejected, "entry_id long, event_id long"), Settings(), names_)
    taken = {(bk, event) for bk, _, event, _ in links}
    assert {(r.entry_id, r.event_id) for r in pool.collect()} == {(i, e) for i in range(6) for e in range(6) if (i % 3, e) not in taken and (i, e) not in rejected}
    pool.explain()
    assert "LeftAnti" not in capsys.readouterr().out


def test_pairs_near_in_time_equal_brute_force(spark):
    rng = random.Random(2)
    a, b = ([(i, rng.choice("xy"), rng.randrange(-5000, 5000)) for i in range(60)] for _ in range(2))
    left, right = spark.createDataFrame(a, "i int, k string, t long"), spark.createDataFrame(b, "j int, k string, u long")
    got = {(r.i, r.j) for r in matching.near_in_time(left, right, ["k"], "t", "u", 300).collect()}
    assert got == {(x[0], y[0]) for x, y in itertools.product(a, b) if x[1] == y[1] and abs(x[2] - y[2]) <= 300}


def test_running_equals_brute_force(spark):
    rng = random.Random(3)
    rows = [(rng.choice([None, "a", "b"]), rng.randrange(50), i, rng.choice([None, *range(9)])) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, t long, i long, v long")
    out = series.running(df, ["k"], "t", ["i"], 7, total={"sum": F.col("v")}, most={"top": F.col("v")}, before={"last": F.col("v")}, latest={"known": F.col("v")}, number="rn", size="n")
    got = {r.i: r for r in out.collect()}
    for k in (None, "a", "b"):
        own = sorted((t, i, v) for kk, t, i, v in rows if kk == k)
        total, top, last, known = 0, None, None, None
        for rn, (_, i, v) in enumerate(own, 1):
            total, top, known = total + (v or 0), v if top is None else top if v is None else max(top, v), known if v is None else v
            r = got[i]
            assert (r.sum, r.top, r.last, r.known, r.rn, r.n) == (total, top, last, known, rn, len(own))
            last = v


def test_failure_runs_and_ticks(spark):
    log = spark.createDataFrame([(1, t, t, ok) for t, ok in enumerate([False, False, True, False, False, False, False, True])], "s int, at long, uid long, ok boolean")
    rows = sorted(ladder.failure_runs(log, ["s"], "at", ["uid"], 3).collect(), key=lambda r: r.at)
    assert [r.run for r in rows] == [1, 2, 0, 1, 2, 3, 4, 0] and [r.trips for r in rows].index(True) == 5
    ticks = spark.createDataFrame([("a", t) for t in (0, 100, 199, 200, 350, 401)] + [("b", 5)], "k string, at long")
    assert sorted(map(tuple, ladder.throttled(ticks, ["k"], "at").collect())) == [("a", 0), ("a", 200), ("a", 401), ("b", 5)]


def test_validation(spark):
    feed = spark.createDataFrame([
        (0, 1, 1, "OU", 2.25, "OVER", 2.0, 0), (0, 1, 1, "OU", 2.5, "OVER", 2.0, 1), (0, 1, 1, "OU", 2.5, "OVER", 2.1, 2), (0, 1, 1, "1X2", None, "OVER", 2.0, 3), (0, 1, 1, "1X2", None, "HOME", 1.001, 4)],
        "bk int, fetch int, event_id int, mtype string, line double, sel string, odds double, pos int")
    assert [r.verdict for r in validate.judge_selections(feed).orderBy("pos").collect()] == ["quarter_line", "ok", "duplicate", "foreign_selection", "price"]


def test_changes(spark):
    rows = [(1, 0, 2.0), (1, 1, 2.0), (1, 2, 2.1), (1, 3, 2.1)]
    out = cdc.changes(spark.createDataFrame(rows, "k int, at long, odds double"), ["k"], "at", ["odds"], []).orderBy("at").collect()
    assert [(r.kind, r.changed_at) for r in out] == [("added", 0), ("seen", 0), ("changed", 2), ("seen", 2)]


def test_labels_and_bets(spark):
    r = one(spark, a=output.market_label(F.lit("AH|H1|1.5"), F.lit("football")), b=output.market_label(F.lit("OU|MATCH|180.5"), F.lit("basketball")), c=output.selection_label(F.lit("HOME"), F.lit("1X2")), d=output.selection_label(F.lit("HOME"), F.lit("ML")))
    assert tuple(r) == ("Handicap +1.5 · 1. poločas", "Počet bodů 180.5 · zápas", "1", "Domácí")
    bets = spark.createDataFrame([(1, None, [(50.0, 2.2), (50.0, 2.1)], 3.0, "won", 0, None), (2, 100.0, [(50.0, None), (50.0, 2.1)], 25.0, "void", None, None), (3, None, [(50.0, 2.0)], None, "manual", None, 7.5)], "id int, stake double, legs array<struct<stake: double, odds: double>>, margin double, result string, winning_leg int, manual_profit double")
    got = {r.id: (r.total, r.expected, r.profit) for r in output.bet_outcomes(bets).collect()}
    assert got == {1: (100.0, 5.0, 10.0), 2: (100.0, 20.0, 0.0), 3: (50.0, None, 7.5)}


def test_states(spark):
    r = one(spark, a=states.set_complete(F.lit(6), F.lit(4)), b=states.set_complete(F.lit(6), F.lit(5)), c=states.set_complete(F.lit(7), F.lit(6)), d=states.text_period(F.lit("Druhá přestávka")), e=states.period_number(F.lit("INNINGS_7"), F.lit(1)), f=S.says_break(F.lit("Halftime")), g=S.says_break(F.lit("2nd half")))
    assert tuple(r) == (True, False, True, 2, 7, True, False)


def test_fair_models(spark):
    r = pricing.goal_outcomes(spark.range(1), F.lit(1.4), F.lit(1.1)).first()
    pmf = lambda lam: [math.exp(-lam) * lam**k / math.factorial(k) for k in range(13)]
    joint = [(h, a, x * y) for (h, x), (a, y) in itertools.product(enumerate(pmf(1.4)), enumerate(pmf(1.1)))]
    whole = sum(p for *_, p in joint)
    assert r.p_home == pytest.approx(sum(p for h, a, p in joint if h > a) / whole, abs=1e-9)
    assert one(spark, p=pricing.normal_cdf(F.lit(1.0))).p == pytest.approx(0.8413447, abs=1e-6)


def test_market_numbers(spark):
    keys = [(s, n) for s, n, *_ in market_ids.definitions()]
    assert len(keys) == len(set(keys)) > 100
    r = one(spark, **{n: c for n, c in market_ids.parse_uri(F.lit("uof:3/sr:sport:1/18/12?total=2.5&x=y")).items()})
    assert (r.sport_no, r.number, r.outcome, r.specs["total"]) == (1, 18, 12, "2.5")


def test_times(spark):
    r = one(spark, a=feeds.any_time(F.lit("/Date(1700000000123+0100)/")), b=feeds.any_time(F.lit("1700000000")), c=feeds.any_time(F.lit("2023-11-14T22:13:20.5Z")), d=feeds.any_time(F.lit("soon")))
    assert tuple(r) == (1700000000123, 1700000000000, 1700000000500, None)


def test_settings():
    own = Settings().merged({"modes": {"LIVE": {"min_margin": 2.0}}, "bankroll": 500})
    assert own.modes["LIVE"].min_margin == 2.0 and own.modes["PREMATCH"].min_margin == 0.5 and own.bankroll == 500
    for bad in ({"bankroll": -1}, {"modes": {"XX": {}}}, {"nothing": 1}, {"bankroll": "much"}):
        assert Settings().merged(bad) == Settings()


def test_core_stands_without_the_llm_folder():
    import re
    from pathlib import Path

    import oddsloom

    root = Path(oddsloom.__file__).parent
    own = [p for p in root.rglob("*.py") if "llm" not in p.relative_to(root).parts]
    assert own and not any(re.search(r"\bllm\b", p.read_text()) for p in own)


def test_local_sessions_get_one_shared_folder(spark):
    """A session without the setting: ``spark.checkpoint.dir`` can't be set at run time, so the folder is kept beside it."""

    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        conf, sparkContext = Conf(), spark.sparkContext

    where = stored.shared_dir(Session())
    assert where.startswith("file:///") and stored.shared_dir(Session()) == where
    assert stored.stored(spark.range(3), "three").count() == 3


def test_initials_after_an_accented_letter(spark):
    # "ó" is no letter of a word edge here, as in the SQL
    r = one(spark, a=S.fold(F.lit("ción. Y. ni")), b=S.fold(F.lit("xA. C. Y. ní")), c=S.fold(F.lit("A. C. Milán's")), d=S.fold(F.lit("a.\x0bb. ’c")))
    assert tuple(r) == ("ciony ni", "xa cy ni", "ac milans", "a b c")


def test_counts_of_pairs_without_the_pairs(spark):
    rows = [(i, i * 7 % 3 if i % 9 else None, i * 5 % 4) for i in range(60)]
    o = spark.createDataFrame(rows, "id long, home long, away long")
    a, b = o.where("id % 2 = 0"), o.where("id % 2 = 1")
    pairs = matching.exact_pairs(a, b, "home", "away").groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("swapped").cast("long")).alias("swapped"))
    found = matching.exact_counts(a, b, "id", "home", "away")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, pairs.collect()))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") > 1  # events are counted before the join


def test_nearest_shuffles_no_pairs(spark):
    random.seed(5)
    left = [(i, random.choice("ab"), random.choice([None, *range(0, 40, 4)])) for i in range(50)]
    right = [(i, random.choice("ab"), random.choice([None, *range(0, 40, 4)])) for i in range(90)]
    found = matching.nearest(spark.createDataFrame(left, "l long, k string, t long"), spark.createDataFrame(right, "r long, k string, u long"), ["k"], "l", "t", "u", "r", 9, 3)
    wanted = [(i, r, rank) for i, k, t in left if t is not None for rank, (gap, r) in enumerate(sorted((abs(t - u), r) for r, q, u in right if q == k and u is not None and abs(t - u) <= 9)[:3], 1)]
    assert sorted((x.l, x.r, x["rank"]) for x in found.collect()) == sorted(wanted)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.index("posexplode") < plan.index("Exchange")
