"""Test cases, fan-out, cascade, graphs and evaluation on literals."""

import random

from pyspark.sql import functions as F
from wardline import schemas
from wardline.operators import access, entities, evaluate, graph, reporting, snippets
from wardline.plans import cascade, static_graph, vectors
from wardline.sources import artifacts
from wardline.streaming import access as streaming

CRAWLS = [
    ("admin", "admin", ["index.php", "admin.php", "profile.php?id=p1", "admin/nav.php"], [("index.php", "admin.php")], {"admin.php": ("POST", {"x": "1"}, None), "profile.php?id=p1": ("GET", {"id": "1"}, "index.php")}),
    ("user1", "user", ["index.php", "profile.php?id=p1"], [("index.php", "profile.php?id=p1")], {"profile.php?id=p1": ("get", {"id": "2"}, None)}),
    ("visitor", "visitor", ["index.php"], [], {}),
]


def matrix(spark):
    schema = schemas.ROLE_CRAWL + ", role_ord int"
    df = spark.createDataFrame([(*c, i) for i, c in enumerate(CRAWLS)], schema)
    return access.access_matrix(artifacts.crawl_nodes(df), artifacts.crawl_requests(df)), artifacts.crawl_edges(df)


def test_access_matrix(spark):
    got = {r.page: r for r in matrix(spark)[0].collect()}
    assert got["index.php"].kinds == ["admin", "user", "visitor"] and got["index.php"].requests == []
    assert [(r.role, r.method, r.params) for r in got["profile.php?id=p1"].requests] == [("admin", "GET", {"id": "1"}), ("user1", "GET", {"id": "2"})]
    assert matrix(spark)[1].count() == 2


def cases(spark, rules, pages=()):
    detection = spark.createDataFrame([(p,) for p in pages], "page string")
    return {(r.category, r.page): r for r in vectors.enumerate_vectors(matrix(spark)[0], detection, rules).collect()}


def test_enumeration(spark):
    got = cases(spark, vectors.Rules(identity=["id"]), ["hidden.php", "header.php", "inc/functions.php", "config.php"])
    assert set(got) == {("admin_only", "admin.php"), ("authenticated_only", "profile.php?id=p1"), ("horizontal", "profile.php?id=p1"), ("static_only", "hidden.php")}
    assert got["admin_only", "admin.php"].authorized_roles == ["admin"] and got["admin_only", "admin.php"].request.method == "POST"
    assert got["authenticated_only", "profile.php?id=p1"].request.params == {"id": "2"}


def test_rules(spark):
    got = cases(spark, vectors.Rules(identity=["id"], admin_excludes=["^admin"], open_get=["admin"], force_vertical=["profile.php"], vertical_overrides={"id": ["7", "8"]}, horizontal_excludes=["profile"], force_static=["index.php"]))
    assert ("admin_only", "admin.php") not in got and got["authenticated_only", "admin.php"].authorized_roles == ["admin"]
    assert ("horizontal", "profile.php?id=p1") not in got
    assert got["vertical", "profile.php?id=7"].request.params == {"id": "7"}
    twins = vectors.enumerate_vectors(matrix(spark)[0], spark.createDataFrame([], "page string"), vectors.Rules(open_get=["admin"])).where("page = 'admin.php'").collect()
    assert sorted(r.request.method for r in twins) == ["GET", "POST"]
    assert set(cases(spark, vectors.Rules(identity=["id"], vertical_only=["php"]))) == set()
    over = cases(spark, vectors.Rules(horizontal_pages=[{"pattern": "profile", "pages": ["/a.php", "b.php"]}]))
    assert over["horizontal", "profile.php?id=p1"].page_overrides == ["a.php", "b.php"]


def test_isolated_static_pages(spark):
    edges = spark.createDataFrame([("linked.php", "x.php", "dependency")], "`from` string, `to` string, kind string")
    found = vectors.enumerate_vectors(matrix(spark)[0].limit(0), spark.createDataFrame([("linked.php",), ("alone.php",), ("install/x.php",)], "page string"), vectors.Rules(), edges)
    assert {r.page for r in found.collect()} == {"alone.php", "install/x.php"}


def test_fan_out(spark):
    got = vectors.fan_out(vectors.enumerate_vectors(matrix(spark)[0], spark.createDataFrame([("hidden.php",)], "page string"), vectors.Rules(identity=["id"])), [("admin", "admin"), ("user1", "user"), ("user2", "user")], overrides={"id": ["5", "6"]}).collect()
    by = {c: sorted((str(r.actor), r.override.get("id", "")) for r in got if r.category == c) for c in ("admin_only", "authenticated_only", "horizontal", "static_only")}
    assert by == {"admin_only": [("None", ""), ("user1", ""), ("user2", "")], "authenticated_only": [("None", "")], "horizontal": [("user1", "5"), ("user1", "6")], "static_only": [("None", "")]}
    idle = vectors.fan_out(vectors.enumerate_vectors(matrix(spark)[0], spark.createDataFrame([], "page string"), vectors.Rules(identity=["id"])), [("admin", "admin")]).where("category = 'horizontal'").collect()
    assert [(r.actor, r.status) for r in idle] == [("user", "not_vulnerable")]


LONG = "<p>" + "content " * 30 + "</p>"
RESPONSES = [
    ("admin_only", "a.php", "GET", None, 200, LONG, {}, "vulnerable", "normal response"), ("admin_only", "a.php", "GET", None, 200, "short", {}, "not_vulnerable", "nearly empty body"), ("admin_only", "a.php", "GET", None, 403, LONG, {}, "not_vulnerable", "denied"),
    ("admin_only", "a.php", "GET", None, 200, LONG + "Permission DENIED", {}, "not_vulnerable", "denied"), ("admin_only", "a.php", "GET", None, 302, "", {"Location": "/login.php"}, "not_vulnerable", "denied"), ("admin_only", "a.php", "POST", None, 302, "x", {"location": "/list"}, "vulnerable", "write accepted with redirect"),
    ("admin_only", "a.php", "GET", None, 302, "x", {"location": "/list"}, "not_vulnerable", "redirected"), ("static_only", "s.php", "GET", None, 200, "few words", {}, "vulnerable", "normal response"), ("static_only", "s.php", "GET", None, 500, "x", {}, "not_vulnerable", "no normal response"),
    ("admin_only", "pub.php", "GET", None, 200, LONG, {}, "not_vulnerable", "public page"), ("admin_only", "a.php", "GET", None, None, None, None, "not_vulnerable", "request failed"), ("horizontal", "a.php", "GET", "u", 200, LONG + "specified thread does not exist", {}, "not_vulnerable", "resource does not exist"),
    ("vertical", "secret.php", "GET", "u", 200, LONG, {}, "not_vulnerable", "protected content absent"), ("admin_only", "a.php", "GET", None, 200, "<script>x</script>", {}, "not_vulnerable", "denied"),
]


def test_cascade(spark):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(RESPONSES)], "i int, category string, page string, method string, actor string, status_code int, text string, headers map<string,string>, want string, why string").withColumn("url", F.lit("http://h/x"))
    out = cascade.classify(df, cascade.Oracle(deny_markers=["permission denied"], public_pages=["^pub"], protected=[("^secret", "TOKEN")]))
    assert [(r.i, r.status, r.reason) for r in out.orderBy("i").collect()] == [(i, r[-2], r[-1]) for i, r in enumerate(RESPONSES)]


def test_closure_ends_on_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y")], "`from` string, `to` string")
    assert {(r.node, r.depth) for r in graph.closure(edges, spark.createDataFrame([("a",)], "node string")).collect()} == {("a", 0), ("b", 1), ("c", 2)}


def test_components_of_a_long_chain(spark):
    pairs = spark.createDataFrame([(f"n{i:03}", f"n{i + 1:03}") for i in range(60)] + [("z", "z")], "a string, b string")
    got = {r.node: r.component for r in graph.components(pairs).collect()}
    assert got == {**{f"n{i:03}": "n000" for i in range(61)}, "z": "z"}


def test_fusion_without_classifications(spark):
    up = spark.createDataFrame([(p, p) for p in ("index.php", "install.php", "functions.php")], "url string, source string")
    out = static_graph.fuse(spark.createDataFrame([("index.php",)], "page string"), up, spark.createDataFrame([], "label string, member string"))
    assert {r.node: r.origins for r in out["nodes"].collect()} == {"index.php": ["dynamic", "static"], "install.php": ["static"], "functions.php": ["static"]}
    assert {r.page for r in out["static_only"].collect()} == {"install.php", "functions.php"}


def test_validation(spark):
    df = spark.createDataFrame
    out = entities.validate(
        df([("s", "$u", "$v"), ("s", "$x", "$y")], "scope string, left string, right string"),
        df([(1, "s", "$v", "app_users", "Role"), (2, "s", "$x", "posts", "title")], "id long, scope string, expression string, table string, field string"),
        df([(10, "a.php", "s", 5, 7, ["$u"], True), (11, "a.php", "s", 30, 31, ["$x"], True), (12, "a.php", "s", 50, 52, ["$q"], True)], "id long, path string, scope string, start long, end long, expressions array<string>, denies boolean"),
        df([(1, "guard", "a.php", 1, 9), (2, "outer", "a.php", 45, 60), (3, "free", "a.php", 70, 80)], "id long, name string, path string, start long, end long"),
        df([(1, "outer", "$this->guard", "a.php", 47), (2, "free", "guard", "a.php", 71)], "id long, caller string, callee string, path string, line long"),
        df(entities.field_rules(["users.role"]), "mode string, ctable string, cfield string"),
    )
    assert [(r.cluster, r.aliases) for r in out["parameters"].collect()] == [("$u", ["$u", "$v"])]
    assert {(r.name, r.depth) for r in out["functions"].collect()} == {("guard", 0), ("outer", 1)}
    assert {(r.kind, r.line) for r in out["snippets"].collect()} == {("conditional", 5), ("guard_call", 47), ("guard_call", 71), ("validation_function", 1), ("validation_function", 45)}


def test_snippet_compaction(spark):
    rows = [(0, "a.php", "x", "if (1) {\r\n  die;  \r\n}\n", None), (1, "a.php", "x", "if (1) {\n  die;\n}", None), (2, "b.php", "x", "if (1) {\n  die;\n}", None), (3, "a\\c.php", "guard_call", "c", "frame"), (4, None, "x", "c", None), (5, "a.php", "x", " \n", None)]
    df = spark.createDataFrame(rows, "ord int, path string, kind string, code string, if_framework string")
    got = snippets.compact(df, prefixes=[("^b", "die", "# p")])
    assert {(r.path, r.field, r.code) for r in got.collect()} == {("a.php", "code", "if (1) {\n  die;\n}"), ("b.php", "code", "# p\nif (1) {\n  die;\n}"), ("a/c.php", "if_framework", "frame")}
    assert tuple(snippets.compaction_counts(df, got).first()) == (6, 3, 3)
    assert snippets.compact(df, require_framework=True).count() == 1


def test_greedy_matching(spark):
    rng = random.Random(1)
    want, have = [], []
    for g in range(4):
        want += [(g, f"e{i}.n{rng.randrange(6)}", i) for i in range(8)]
        have += [(g, rng.choice([f"e{i}.n{rng.randrange(6)}", f"n{rng.randrange(6)}"]), i) for i in range(8)]
    e = evaluate.unique_expected(spark.createDataFrame(want, "app int, name string, ord int"), ["app"])
    p = evaluate.unique_expected(spark.createDataFrame(have, "app int, name string, ord int"), ["app"]).select("app", "name", "ord", "variants")
    got = {(r.app, r.name): r.prediction for r in evaluate.greedy_match(e, p, ["app"]).collect()}
    expected = {}
    for g in range(4):
        unique = lambda rows: list({n: (n, n.rsplit(".", 1)[-1]) for a, n, _ in rows if a == g}.values())  # noqa: B023, E731
        left = list(enumerate(unique(have)))
        for name, last in unique(want):
            ranked = [(0 if h[0] == name else 1 if name in h else 2 if {name, last} & set(h) else 3, i) for i, h in left]
            best = min(ranked, default=(3, 0))
            expected[g, name] = None
            if best[0] < 3:
                expected[g, name] = dict(left)[best[1]][0]
                left = [x for x in left if x[0] != best[1]]
    assert got == expected


def test_scores_without_predictions(spark):
    got = evaluate.scores(spark.createDataFrame([("a", 0, 0, 0)], "app string, tp int, fp int, fn int"), "app").collect()
    assert {(r.app, r.precision, r.recall) for r in got} == {("a", 0.0, 0.0), ("TOTAL", 0.0, 0.0)}


def test_report_lines(spark):
    f = spark.createDataFrame([("admin_only", "p", "visitor", "vulnerable", "high", ["e"], 1), ("admin_only", "p", "u", "vulnerable", "high", ["d"], 0), ("static_only", "q", "visitor", "not_vulnerable", "high", [], 2)], "category string, page string, actor string, status string, confidence string, evidence array<string>, ord int")
    lines = reporting.report_lines(reporting.findings_report(f)).collect()
    assert len(lines) == 1 and "Actors: u, visitor" in lines[0].markdown


def test_sources(spark, tmp_path):
    (tmp_path / "vendor").mkdir()
    for name, code in {"a.php": "<?php die(\"Access denied here\"); echo \"hello world\"; ?>", "vendor/b.php": "die(\"Access denied\")", "c.txt": "x", "d.php": "die(\"ACCESS   denied here\")"}.items():
        (tmp_path / name).write_text(code)
    files = artifacts.read_sources(spark, str(tmp_path), "php")
    assert {r.path for r in files.collect()} == {"a.php", "d.php"}
    assert [(r.folded, r.marker) for r in artifacts.denial_markers(files).collect()] == [("access denied here", "Access denied here")]
    xml = "<servlet><servlet-name>s</servlet-name><servlet-class>a.B</servlet-class></servlet><servlet-mapping><servlet-name>s</servlet-name><url-pattern>/x</url-pattern></servlet-mapping>"
    assert [tuple(r) for r in artifacts.servlet_routes(spark.createDataFrame([("w", xml)], "path string, code string")).collect()] == [("w", "x", "a.B")]
    log = '{"message": {"method": "Network.requestWillBeSent", "params": {"type": "XHR", "request": {"url": "http://h/a", "method": "post"}}}}'
    assert [(r.url, r.method) for r in artifacts.network_requests(spark.createDataFrame([(log,), ("{}",)], "message string"), "http://h/").collect()] == [("http://h/a", "POST")]
    assert artifacts.scalar(spark, "SELECT 1 WHERE false") == "" and artifacts.scalar(spark, "SELECT 7") == "7"


def test_crawl_files(spark, tmp_path):
    (tmp_path / "admin.json").write_text('{"role": "admin", "kind": "admin", "nodes": ["a"], "edges": [{"from": "a", "to": "b"}], "requests": {"a": {"method": "post", "params": {"k": "v"}}}}')
    (tmp_path / "admin.partial.json").write_text('{"role": "half"}')
    crawls = artifacts.read_crawls(spark, str(tmp_path), [artifacts.Role("admin", "admin")])
    assert [tuple(r) for r in artifacts.crawl_requests(crawls).collect()] == [("admin", "a", "POST", {"k": "v"}, None)]
    assert artifacts.crawl_edges(crawls).count() == 1


def test_streamed_matrix(spark, tmp_path):
    rows = [(f"p{i % 3}", ["admin", "user", "visitor"][i % 2]) for i in range(20)]
    spark.createDataFrame(rows, "page string, kind string").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("page string, kind string").parquet(f"{tmp_path}/in")
    q = streaming.page_kinds(stream).writeStream.outputMode("complete").format("memory").queryName("kinds").start()
    q.processAllAvailable()
    q.stop()
    assert {(r.page, r.admin, r.user, r.visitor) for r in spark.table("kinds").collect()} == {(f"p{i}", 1, 1, 0) for i in range(3)}


def test_roles_flow_by_name_and_arity(spark):
    methods = spark.createDataFrame(
        [("Check", ["role"]), ("check", ["role", "page"]), ("need", ["page", "who"]), ("main", []), (None, ["x"]), ("check", ["role"])],
        "name string, parameters array<string>",
    )
    calls = spark.createDataFrame(
        [
            ("main", 0, "need", ["p", " 'admin' "]),
            ("need", 2, "CHECK", ["who"]),
            ("need", 2, "check", ["page", "who", "more"]),
            ("main", 0, "check", ['"editor"', "p"]),
            ("main", 0, "check", None),
            (None, 0, "check", ["''"]),
        ],
        "caller string, caller_arity int, callee string, arguments array<string>",
    )
    literals, arguments = entities.call_flow(calls, methods)
    assert sorted(map(tuple, arguments.collect())) == [("need/2", 1, "check/1", 0)]
    got = sorted(map(tuple, entities.role_flow(literals, arguments).collect()))
    assert got == [("check/1", 0, "admin"), ("check/2", 0, "editor"), ("need/2", 1, "admin")]
    assert entities.role_flow(*entities.call_flow(calls.limit(0), methods)).count() == 0


def test_pages_match_with_their_parameters(spark):
    schema = "category string, page string, method string, actor string, status_code int, url string, text string, headers map<string,string>, params map<string,string>"
    rows = [("admin_only", "a.php?x=1", "GET", None, 200, "", LONG, {}, {"mode": "open"}), ("admin_only", "a.php?x=1", "GET", None, 200, "", LONG, {}, {"mode": "shut"}), ("vertical", "a.php", "GET", "u", 200, "", LONG, {}, {"mode": "team"}), ("vertical", "a.php", "GET", None, 200, "", LONG, {}, None)]
    out = cascade.classify(spark.createDataFrame(rows, schema), cascade.Oracle(public_pages=["mode=open$"], authenticated_pages=["mode=team"]))
    assert [r.reason for r in out.collect()] == ["public page", "normal response", "page of all signed-in users", "normal response"]


def test_redirect_spellings(spark):
    urls_ = ["http://h/app/list?done=1#x", "/app/list?done=1", "list", "http://other/x", "/", None]
    df = spark.createDataFrame([(u,) for u in urls_], "u string")
    got = [r.s for r in df.select(cascade.redirect_spellings(F.col("u"), "http://h/app/").alias("s")).collect()]
    assert got == [["http://h/app/list?done=1#x", "list?done=1#x", "list?done=1"], ["/app/list?done=1", "list?done=1"], ["list"], ["http://other/x", "x"], ["/"], []]
    rows = [("admin_only", "a.php", "POST", None, 302, "http://h/app/a.php", "", {"Location": "/app/list?saved=1"})]
    oracle = cascade.Oracle(base_url="http://h/app", write_redirects=[r"^list\?saved"], login_form_denies=False)
    out = cascade.classify(spark.createDataFrame(rows, "category string, page string, method string, actor string, status_code int, url string, text string, headers map<string,string>"), oracle)
    assert [r.reason for r in out.collect()] == ["write accepted with configured redirect"]
