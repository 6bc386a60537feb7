"""Column expressions on literals."""

import pytest
from pyspark.sql import functions as F
from wardline.functions import html, names, urls


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "url, want",
    [
        ("http://localhost/app/user.php?id=17&action=edit", "user.php?action=edit&id=p1"), ("http://localhost/app/", "./"), ("/app/a//b.php?x=&y", "a//b.php?x=p1&y=p1"), ("http://localhost/other?b=1&a=2&tok=3", "other?a=p1&b=p1"),
        ("http://localhost/app/post/99/x?id=%C3%A9+1&action=a*~+b", "post/p1/x?action=a%2A~+b&id=p1"),
    ],
)
def test_canonical_page(spark, url, want):
    assert one(spark, urls.canonical_page(F.lit(url), F.lit("/app/"), preserve=["action"], drop=["tok"], path_patterns=[(r"(?<=post/)\d+", "p1")])) == want


@pytest.mark.parametrize("url, want", [("http://h/app/x", True), ("http://h/apple", True), ("https://h/app", True), ("ftp://h/app", False), ("http://h:80/app", False), ("http://other/app", False), ("mailto:a@h", False), ("", False)])
def test_in_scope_is_a_string_prefix(spark, url, want):
    assert one(spark, urls.in_scope(F.lit(url), F.lit("http://h/app"))) is want


@pytest.mark.parametrize("value, want", [("x.php", "http://h/app/x.php"), ("/x", "http://h/x"), ("http://o/y", "http://o/y"), ("//o/y", "http://o/y"), ("./a/b", "http://h/app/a/b"), ("../c", "http://h/c"), ("?q=1", "http://h/app/?q=1")])
def test_absolute(spark, value, want):
    assert one(spark, urls.absolute(F.lit("http://h/app"), F.lit(value))) == want


def test_pages(spark):
    assert one(spark, urls.base_page(F.lit("//a/b?c=d"))) == "a/b"
    assert one(spark, urls.vulnerability_page(F.lit("/p.php?b=1&a=2&b=3"))) == "p.php?a=%2A&b=%2A"
    assert one(spark, urls.with_overrides(F.lit("p?id=1&x=2"), F.create_map(F.lit("id"), F.lit("9"), F.lit("no"), F.lit("1")))) == "p?id=9&x=2"
    assert one(spark, urls.with_overrides(F.lit("p?x=a b"), F.create_map(F.lit("id"), F.lit("9")))) == "p?x=a b"
    assert one(spark, urls.spellings(F.lit("/user/12/edit?x=1"))) == ["/user/12/edit?x=1", "user/12/edit?x=1", "user/12/edit", "/user/12/edit", "user/p1/edit", "/user/p1/edit"]
    assert one(spark, urls.request_params(F.lit("p?a=1&b=2&a=3"), F.lit("b=4&c="))) == {"a": "3", "b": "4", "c": ""}


def test_parameters_of_a_request_are_decoded_once(spark):
    """A column in a lambda is made anew for each element, one named often for each name."""
    df = spark.createDataFrame([("p?a=1&b=%20&a=3", "b=4&c="), ("p?action=%20&do=x", None), (None, "a=1"), ("p", "")], "u string, b string")
    params = urls.request_params(F.col("u"), F.col("b"))
    laid = urls.effective_page(F.col("u"), F.create_map(F.lit("a"), F.lit("9"), F.lit("z"), F.lit("0")))
    out = df.select(params.alias("p"), urls.operation(params, F.lit("put")).alias("o"), laid.alias("l"))
    assert [(r.p, r.o, r.l) for r in out.collect()] == [({"a": "3", "b": "4", "c": ""}, "PUT", "p?a=9&b=+&a=9&z=0"), ({"action": " ", "do": "x"}, "x", "p?action=+&do=x&a=9&z=0"), (None, "PUT", None), ({}, "PUT", "p?a=9&z=0")]
    decoded = lambda c: df.select(c)._jdf.queryExecution().analyzed().toString().count("&")
    assert decoded(params) == decoded(urls.operation(params, F.lit("put"))) == 2 * decoded(urls.pairs(F.col("u")))


def test_equal_requests_are_read_as_one(spark, tmp_path):
    from wardline.queries import web

    spark.createDataFrame([(t,) for t in ["click", "purchase", "purchase", "view", None]], "event_type string").write.parquet(str(tmp_path / "events.parquet"))
    out = web.request_labels(spark, str(tmp_path))
    assert {tuple(r) for r in out.collect()} == {("click", "buy", 0, 1), ("purchase", "POST", 2, 2), ("view", "POST", 0, 1), (None, "POST", 0, 1)}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" in plan and "lambda" not in plan[plan.rindex("Aggregate") :].split("\n", 1)[1]


@pytest.mark.parametrize("value, want", [("x.php?a=1", "admin/x.php"), ("/y.php#z", "y.php"), ("../up.php", "admin/../up.php"), ("a.css", None), ("#top", None), ("javascript:x", None), ("<?php echo $x ?>", None), ("./", "admin/./"), ("", None), ("?a=1", None)])
def test_link_target(spark, value, want):
    assert one(spark, urls.link_target(F.lit(value), F.lit("admin/index.php"))) == want


def test_html(spark):
    body = '<form action="/do/login.php"><input type=hidden name="t" value="1"><input name="t" type="hidden" value="2"><input type="password" name="p"></form><a href="x?a=1">l</a><iframe src=\'f.html\'></iframe>'
    assert one(spark, html.hidden_fields(F.lit(body))) == {"t": "2"}
    assert one(spark, html.links(F.lit(body))) == ["x?a=1", "f.html"]
    assert one(spark, html.form_params(F.lit(body), F.lit("login.php"))) == ["t", "p"]
    assert one(spark, html.has_login_form(F.lit(body), F.lit("http://h/x"))) is True
    assert one(spark, html.has_login_form(F.lit(body.replace("login", "check")), F.lit("http://h/x"))) is False
    assert one(spark, html.meta_refresh_target(F.lit('<meta http-equiv="refresh" content="5;url=a"><META http-equiv=refresh content="0; url=b.php">'))) == "b.php"
    assert one(spark, html.script_target(F.lit("<script>if(1){window.location.href = 'c.php';}</script>"))) == "c.php"
    assert one(spark, html.script_target(F.lit("<p>location = 'no'</p>"))) is None
    assert one(spark, html.body_length(F.lit(" <script>a</script><!-- b --><style>c</style> de "))) == 2
    assert [one(spark, html.denial_message(F.lit(x))) for x in ("<b>Access</b>  denied\\'s", "no", "not $allowed")] == ["Access denied's", None, None]
    assert one(spark, html.has_exception_trace(F.lit("x java.lang.NullPointerException y"))) is True


def test_names(spark):
    assert one(spark, names.normalized_code(F.lit("\r\n a \r\nb\t\n"))) == "a\nb"
    assert one(spark, names.name_variants(F.lit("self.User"))) == ["self.user", "user"]
    assert one(spark, names.name_variants(F.lit('$_SESSION["a.b"]'))) == ["_session['a.b']"]
    assert [one(spark, names.semantic_key(F.lit(x))) for x in ("a.b.Role", "request.user.id", "$o->role", "$x")] == ["role", "request.user.id", "o->role", "x"]
    assert one(spark, names.simple_function_name(F.lit("A::b->c.d"))) == "d"
    gates = [one(spark, names.state_gate(F.lit(x))) for x in ("$ok", "!$ok", "$ok == false", "$ok !== true", "$a > 1")]
    assert [g and (g.name, g.value) for g in gates] == [("$ok", True), ("$ok", False), ("$ok", False), ("$ok", False), None]
    assert one(spark, names.if_framework(F.lit("php"), F.lit("!$admin"), F.array(F.lit(" exit; ")))) == "if (!$admin) {\n    exit;\n}"
    assert one(spark, names.json_of_answer(F.lit('```json\n{"a": 1}\n```'))) == '{"a": 1}'
    assert one(spark, names.json_of_answer(F.lit('Sure: {"a": 1} there'))) == '{"a": 1}'
    assert one(spark, names.json_of_answer(F.lit("none"))) is None
    assert one(spark, names.rendered(F.lit("{{a}}-{{b}}"), F.create_map(F.lit("a"), F.lit("1")))) == "1-{{b}}"
    assert one(spark, names.synthetic_value(F.lit("Email"), F.lit("text"))).endswith("@example.com")


def test_servlet_routes_by_annotation(spark):
    """Attributes other than the patterns give no route; files without code or of another language have none."""
    from wardline.sources import extract

    code = (
        '@WebServlet("/one/{id}")\npublic final class A {}\n'
        '@WebServlet(value="/two", loadOnStartup = 1, initParams = {@WebInitParam(name="k", value="/no")})\n@MultipartConfig\npublic class B {}\n'
        '@WebServlet(name = "x", urlPatterns = {"/three", "/four"}) class C {}'
    )
    files = spark.createDataFrame([("a.java", code), ("b.java", None), ("c.php", '@WebServlet("/no") class D')], "path string, code string")
    found = {tuple(r) for r in extract.routes(files).collect()}
    assert found == {("a.java", "one/p1", "A"), ("a.java", "two", "B"), ("a.java", "three", "C"), ("a.java", "four", "C")}
    assert extract.routes(files.limit(0)).count() == 0
