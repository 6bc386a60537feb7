"""Repair rules, variables and source scans on literals."""

import pytest
from pyspark.sql import functions as F
from wardline.functions import html, names, urls
from wardline.operators import graph, repair
from wardline.sources import artifacts, extract


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_variables_in_any_order_and_in_a_circle():
    asked = []

    def scalar(sql):
        asked.append(sql)
        return 7

    got = repair.resolved({"b": "{a}-{n}", "a": "x{token}", "n": {"query": "SELECT '{a}'"}}, {"token": "t"}, scalar)
    assert got == {"token": "t", "a": "xt", "n": "7", "b": "xt-7"} and asked == ["SELECT 'xt'"]
    for bad in ({"a": "{b}", "b": "{a}"}, {"a": "{nowhere}"}):
        with pytest.raises(ValueError):
            repair.resolved(bad, {})


@pytest.mark.parametrize("base, value, want", [("http://h/a/b.php?x=1", "c.php", "http://h/a/c.php"), ("http://h/a/b", "../c?d=1", "http://h/c?d=1"), ("http://h/a/b", "/x/./y/..", "http://h/x/"), ("http://h", "login", "http://h/login"), ("http://h/a?b=1", "?c=2", "http://h/a?c=2"), ("http://h/a", "//o/z", "http://o/z"), ("http://h/a/", "https://o/", "https://o/")])
def test_joined(spark, base, value, want):
    assert one(spark, urls.joined(F.lit(base), F.lit(value))) == want


def test_redirects_of_every_form(spark):
    of = lambda body: one(spark, html.redirect_target(F.expr("CAST(map() AS map<string,string>)"), F.lit(body), F.lit("http://h/a/b")))
    assert of("<meta http-equiv=refresh content=0;url=login.php>") == "http://h/a/login.php"
    assert of("<body onload='location.replace(\"x\")'>") == "http://h/a/x"
    assert of("<script>location.assign('y'); window.location = '/z'</script>") == "http://h/z"
    assert of("<p>location = 'no'</p>") is None


def test_login_markers_and_traces(spark):
    form = "<form action='/portal'><input name=password></form>"
    assert one(spark, html.has_login_form(F.lit(form), F.lit("http://h/"))) is False
    assert one(spark, html.has_login_form(F.lit(form), F.lit("http://h/"), ("Portal",))) is True
    trace = lambda t: one(spark, html.has_exception_trace(F.lit(t)))
    assert trace("jakarta.servlet.ServletException") and trace("x\n\tat org.a.B(C)\n\tat com.a.B(C)")
    assert not trace("org.example.MyException") and not trace("x\n at app.a.B(C)\n at app.c.D(E)")


def test_denial_literals_in_both_quotes(spark):
    code = "<?php die('Access denied'); die(\"You don't have permission\"); $x = 'forbidden area'; echo 'hello there'; ?>"
    got = {r.marker for r in artifacts.denial_markers(spark.createDataFrame([("a.php", code)], "path string, code string")).collect()}
    assert got == {"Access denied", "You don't have permission", "forbidden area"}


def test_configured_terminations(spark):
    kind = lambda lang, code, context: one(spark, names.termination_kind(F.lit(lang), F.lit(code), ("no_admin",), F.lit(context)))
    assert kind("php", "exit;", "if (no_admin())") == "configured_denial" and kind("php", "$x = 1;", "if (no_admin())") is None
    assert kind("go", "return", "no_admin") == "configured_denial" and kind("python", "return x", "other") is None


def test_flags_deny_backwards(spark):
    rows = [("s", 1, 1, "a", "z", False), ("s", 2, 2, "b", "a", False), ("s", 3, 3, "c", "b", True), ("s", 4, 4, "a", "q", False), ("t", 5, 1, "b", "a", False), ("s", 6, 0, "b", None, False)]
    got = {r.id: r.denies_by for r in graph.chain_of_flags(spark.createDataFrame(rows, "scope string, id int, start int, sets string, tests string, denies boolean")).collect()}
    assert got == {1: 2, 2: 1, 3: 0, 4: None, 5: None, 6: 1}


def test_nested_python_is_left_out(spark):
    deep = "x = " + "(" * 5000 + ")" * 5000
    files = spark.createDataFrame([("a.py", deep), ("b.py", "import os.path")], "path string, code string")
    assert {r.path for r in extract.python_facts(files).collect()} == {"b.py"}
