"""Detection batch by batch: any split, order or repetition of batches ends where one full run does."""

import random

import pytest
from pyspark.sql import functions as F

from oddsloom.domain import Settings
from oddsloom.operators import detect
from oddsloom.operators.groups import SCHEMA, group_rows
from oddsloom.streaming import incremental

MARKETS = {"1X2|REG": ("HOME", "DRAW", "AWAY"), "DC|REG": ("HOME_DRAW", "HOME_AWAY", "DRAW_AWAY"), "AH|REG|0.5": ("HOME", "AWAY"), "OU|REG|2.5": ("OVER", "UNDER")}
QUOTE = "event_id long, sport string, mode string, bk int, market string, sel string, odds double, is_open boolean, changed_at long, seen_at long, u long"


@pytest.fixture(scope="module")
def groups(spark):
    return spark.createDataFrame(group_rows(["football"], list(MARKETS)), SCHEMA).coalesce(1)


def full(rows, groups):
    """One run over all rows, an event in the mode of its last quote."""
    modes = rows.groupBy("event_id").agg(F.max_by("mode", F.struct("changed_at", "u")).alias("m"))
    last = detect.latest(rows, [F.col("u").desc()]).join(modes, "event_id").withColumn("mode", F.col("m")).drop("m")
    return detect.arbs(last, groups, Settings(), check_consensus=False)


def plain(df):
    return sorted((r.event_id, r.group_key, r.mode, round(r.margin, 9), r.books) for r in df.collect())


def test_batches_end_where_a_full_run_does(spark, tmp_path, groups):
    draw, rows = random.Random(3), []
    for u in range(700):
        market = draw.choice(list(MARKETS))
        rows.append((draw.choice([None, *range(12)]), "football", draw.choice(["PREMATCH", "LIVE"]) if u % 9 == 0 else "LIVE", draw.randrange(4), market, draw.choice(MARKETS[market]), 1.5 + draw.randrange(200) / 50, draw.random() < 0.9, draw.randrange(40), 0, u))
    batch_of = [draw.randrange(3) for _ in rows]
    cut = [spark.createDataFrame([r for r, b in zip(rows, batch_of, strict=True) if b == n], QUOTE) for n in range(3)]
    path = str(tmp_path / "state")
    for n in (0, 0, 1, 2, 1):
        incremental.evaluate(cut[n], n, path, groups, Settings(), ["u"])
    known = [r for r, b in zip(rows, batch_of, strict=True) if r[0] is not None]
    upto = [spark.createDataFrame([r for r, b in zip(rows, batch_of, strict=True) if b <= n and r[0] is not None], QUOTE) for n in (0, 2)]
    assert known and plain(incremental.current(spark, path, 0)) == plain(full(upto[0], groups))
    got = plain(incremental.current(spark, path))
    assert got and got == plain(full(upto[1], groups)) and {m for _, _, m, _, _ in got} == {"LIVE", "PREMATCH"}


def test_only_touched_groups_are_looked_at(spark, tmp_path, groups):
    quote = lambda e, sel, odds, at, market="OU|REG|2.5", bk=0, mode="LIVE": (e, "football", mode, bk, market, sel, odds, True, at, 0, at)
    path = str(tmp_path / "state")

    def batch(n, *rows):
        incremental.evaluate(spark.createDataFrame(list(rows), QUOTE), n, path, groups, Settings(), ["u"])
        return sorted((r.event_id, r.group_key, r.holds) for r in spark.read.parquet(f"{path}/found").where(f"batch = {n}").collect())

    goals = "OU|REG|2.5"
    sides = [(1, f"{g}|REG", False) for g in ("1X2", "A_HD", "D_HA", "H_DA")]
    assert batch(0, quote(1, "OVER", 2.5, 1), quote(1, "UNDER", 2.5, 1, bk=1), quote(2, "OVER", 2.5, 1)) == [(1, goals, True), (2, goals, False)]
    assert batch(1, quote(1, "HOME", 2.0, 2, "1X2|REG")) == sides
    assert batch(2) == []
    assert batch(3, quote(1, "HOME", 2.0, 3, "1X2|REG", mode="PREMATCH")) == [*sides, (1, goals, True)]
    assert batch(4, quote(1, "OVER", 1.2, 4, mode="PREMATCH")) == [(1, goals, False)]
    assert [tuple(r)[:2] for r in incremental.current(spark, path).collect()] == []
    assert [r.mode for r in incremental.current(spark, path, 3).collect()] == ["PREMATCH"]


def test_a_batch_is_logged_by_its_last_quotes(spark, tmp_path, groups):
    rows = [(1, "football", "LIVE", bk, "OU|REG|2.5", sel, 1.5 + u / 100, True, u, 0, u) for bk in (0, 1) for sel in ("OVER", "UNDER") for u in range(50)]
    path = str(tmp_path / "state")
    incremental.evaluate(spark.createDataFrame(rows, QUOTE), 0, path, groups, Settings(), ["u"])
    assert [r.u for r in spark.read.parquet(f"{path}/quotes").collect()] == [49] * 4
    assert plain(incremental.current(spark, path)) == plain(full(spark.createDataFrame(rows, QUOTE), groups))
