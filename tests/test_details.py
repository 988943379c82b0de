"""Which matches are fetched in detail: horizons by sport, quotas by class."""

from oddsloom.operators import reads

HOUR = reads.HOUR


def test_horizons_and_quotas(spark):
    rows = [(1, "football", 12 * HOUR), (2, "football", 12 * HOUR - 1), (3, "hockey", 24 * HOUR - 1), (4, "hockey", 24 * HOUR), (5, "football", 0), (6, "darts", 23 * HOUR), (7, "darts", 24 * HOUR), (8, "boxing", 1), (9, None, 1), (10, "tennis", None)]
    rows += [(100 + n, "tennis", HOUR) for n in range(149)] + [(300 + n, "snooker", 2 * HOUR) for n in range(39)]
    df = spark.createDataFrame(rows, "id long, sport string, start long")
    got = reads.detail_targets(df, "start", "id", 0).orderBy("place").collect()
    assert [r.place for r in got] == list(range(1, 191))
    assert [r.id for r in got] == [*range(100, 249), 2, *range(300, 339), 6]
    assert reads.detail_targets(df.limit(0), "start", "id", 0).count() == 0
    near = reads.nearest_details(df, "start", "id", 0, hours=12, most=3).collect()
    assert [r.id for r in near] == [5, 8, 9] and reads.nearest_details(df, "start", "id", -HOUR, hours=1).count() == 1
