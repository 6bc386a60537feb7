"""Spans that hold others, without their pairs."""

import random

from wardline.operators import entities


def test_holding_equals_the_pairs(spark):
    rng = random.Random(3)
    span = lambda far: (lambda s: (rng.choice("pq"), s, s + rng.randrange(far)))(rng.randrange(900))
    inner = [(i, *span(9)) for i in range(60)] + [(90, "p", None, 3), (91, "q", 5, None), (92, None, 1, 2)]
    outer = [(i, *span(60)) for i in range(200)] + [(300, "p", None, 900), (301, "q", 0, None), (302, "r", 0, 900), (303, inner[0][1], inner[0][2], inner[0][3])]
    i, o = spark.createDataFrame(inner, "iid int, path string, start int, end int"), spark.createDataFrame(outer, "oid int, path string, start int, end int")
    want = {r.oid for r in entities.contained(i, o.where("start IS NOT NULL AND end IS NOT NULL"), "path", "iid", "oid").collect()}
    out = entities.holding(i, o, "path")
    assert sorted(r.oid for r in out.collect()) == sorted(want) and 0 < len(want) < len(outer)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Generate explode" not in plan and "Window" in plan


def test_entities_meet_no_pairs_of_spans(spark, monkeypatch):
    """Every condition of a path in every function of it: a quadratic list."""
    monkeypatch.setattr(entities, "contained", None)
    pairs = spark.createDataFrame([("s", "a", "b")], "scope string, left string, right string")
    relations = spark.createDataFrame([(1, "s", "a", "users", "role")], "id int, scope string, expression string, table string, field string")
    conditions = spark.createDataFrame([(1, "p", "s", 5, 6, ["b"], True), (2, "p", "s", 50, 51, [], True)], "id int, path string, scope string, start int, end int, expressions array<string>, denies boolean")
    functions = spark.createDataFrame([(1, "f", "p", 4, 6), (2, "g", "p", 49, 60), (3, "h", "p", 70, 80)], "id int, name string, path string, start int, end int")
    calls = spark.createDataFrame([(1, "g", "f", "p", 52), (2, "h", "f", "p", 71)], "id int, caller string, callee string, path string, line int")
    fields = spark.createDataFrame(entities.field_rules(["users.role"]), "mode string, ctable string, cfield string")
    out = entities.validate(pairs, relations, conditions, functions, calls, fields)
    assert sorted((r.name, r.depth) for r in out["functions"].collect()) == [("f", 0), ("g", 1)]
