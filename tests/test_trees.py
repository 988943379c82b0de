"""Trees of unknown shape: what is found where, and what is not."""

import pytest

from oddsloom.sources import trees


def objects(spark, *texts):
    return trees.objects(spark.createDataFrame(list(enumerate(texts)), "key long, text string"), "key", "text")


def test_every_object_with_its_path(spark):
    got = sorted((r.key, r.path) for r in objects(spark, '{"a":[{"b":{}},1,"x"],"c":null}', "[[{}]]", "no json", None, "3", "").collect())
    assert got == [(0, "$"), (0, "$.a[0]"), (0, "$.a[0].b"), (1, "$[0][0]")]
    assert objects(spark, "nothing", None).count() == 0


def test_events_wherever_they_stand(spark):
    cells = '{"label":"1","odd":1.9},{"label":"2","odd":"2.1","bettingEnabled":false},{"label":"3"},{}'
    text = '{"x":[{"id":7,"name":"A - B","oppRows":[{"oppsTab":[%s]},{}]},{"y":{"matchId":"m8","eventTables":[{"boxes":[{"cells":[{"name":"1","odd":3}]}]}],"z":[{"idMatch":9,"oppRows":[]}]}}],"oppRows":[{"oppsTab":[{"label":"no id","odd":2}]}]}' % cells
    got = sorted(tuple(r) for r in trees.nested_quotes(objects(spark, text)).collect())
    assert got == [(0, "7", "A - B", "1", 1.9, True), (0, "7", "A - B", "2", 2.1, False), (0, "m8", None, "1", 3.0, True)]


def test_texts_are_parsed_once_and_values_not_shredded(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(trees, "stored", lambda df, name: plans.append(df) or df.localCheckpoint())
    assert objects(spark, '{"a":[{"n":1},[{"b":[{"oppRows":[{"oppsTab":[{}]}]}]},{}]],"c":{"d":{}}}').count() == 9
    assert plans[0]._jdf.queryExecution().optimizedPlan().toString().lower().count("parsejson") == 1
    assert {dict(p.dtypes)["value"] for p in plans} == {"array<variant>"}


def test_a_list_is_entered_in_the_step_of_its_field(spark, monkeypatch):
    monkeypatch.setattr(trees, "MOST_LEVELS", 4)
    assert sorted(r.path for r in objects(spark, '{"a":[{"b":[{}]},null,[]],"e":[],"n":null}').collect()) == ["$", "$.a[0]", "$.a[0].b[0]"]


def test_two_lists(spark):
    lists = [(1, '{"matches":[{"id":7,"name":"A - B"},{"id":8}]}', '{"groups":[{"matchId":7,"cells":[{"label":"1","odd":1.5},{"label":"2"}]},{"matchId":99,"cells":[{"label":"1","odd":1.5}]}]}'), (2, None, '{"groups":[]}'), (3, "{", "{}")]
    got = trees.joined_quotes(spark.createDataFrame(lists, "key long, e string, o string"), "key", "e", "o").collect()
    assert [tuple(r) for r in got] == [(1, "7", "A - B", "1", 1.5, True)]


def test_a_tree_without_end_is_refused(spark, monkeypatch):
    monkeypatch.setattr(trees, "MOST_LEVELS", 3)
    with pytest.raises(ValueError, match="levels"):
        objects(spark, "[[[[[]]]]]")
