"""Text frames: what is read from a line, and that a line is made once."""

from pyspark.sql import functions as F

from oddsloom.sources import feeds


def line(subject="sPRICE", user="G", body='{"lp_num": 1, "lp_den": 2}'):
    return "MsEVENT" + "0" * 16 + "0000000007" + "0000000003" + user + subject + "0000000012" + "000000000100" + body


LINES = [line(), line(user="U0000000042"), line("sOTHER", body="[]"), line(body="{"), line()[1:], line()[:72], "", None]


def test_frames_of_lines(spark):
    got = feeds.push_frames(spark.createDataFrame([(x,) for x in LINES], "value string")).collect()
    own = ("sEVENT", "7", "0000000003", "sPRICE", "12", '{"lp_num": 1, "lp_den": 2}')
    assert [tuple(r) for r in got] == [own, own, (*own[:3], "sOTHER", "12", "[]")]


def test_a_line_is_made_once(spark):
    made = spark.range(10).select(F.format_string("MsEVENT%s", F.col("id")).alias("value"))
    frames = feeds.push_frames(made).where("subject = 'sPRICE' AND channel_id = '7'")
    assert frames._jdf.queryExecution().optimizedPlan().toString().count("format_string(") == 1
