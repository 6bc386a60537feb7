"""Files that answer the routes of a small tree."""

from wardline.sources import extract

TREE = {
    "shop/urls.py": "from . import views\nfrom .api.v2 import orders as o, Cart\nimport admin.panel\nfrom ..lib import tools\nurlpatterns = [path('a', views.first), path('b', o), path('c/<int:x>', Cart.as_view()), path('d', admin.panel.show), path('e', tools.go), path('f', wrap(views.first)), path('g', 'shop.views.old'), url(r'^h/(?P<n>[0-9]+)$', views.first)]\nold = patterns('', (r'^i/$', views.first), (r'^j/$', nobody), ('key', views.first), (r'^a$', o))\n",
    "shop/views.py": "@bp.route('/own')\ndef f(): pass\n", "shop/api/v2/orders.py": "", "shop/api/v2/__init__.py": "", "admin/panel.py": "", "lib/tools.py": "", "broken.py": "def (", "none.py": None,
}


def test_view_sources(spark):
    df = spark.createDataFrame(list(TREE.items()), "path string, code string")
    got = {(r.path, r.url): r.source for r in extract.view_sources(extract.python_facts(df), df).collect()}
    urls = {"a": "shop/api/v2/orders.py", "b": "shop/api/v2/orders.py", "c/p1": "shop/api/v2/__init__.py", "d": "admin/panel.py", "e": "lib/tools.py", "f": "shop/urls.py", "g": "shop/urls.py", "h/p1": "shop/views.py", "i/": "shop/views.py"}
    assert got == {("shop/urls.py", u): s for u, s in urls.items()} | {("shop/views.py", "own"): "shop/views.py"}


def test_no_sources(spark):
    df = spark.createDataFrame([], "path string, code string")
    assert extract.view_sources(extract.python_facts(df), df).count() == 0


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_views_are_not_sent_to_all_tasks_and_files_are_parsed_once(spark):
    """A table of short files is estimated at few bytes, however many rows it has."""
    df = spark.createDataFrame(list(TREE.items()), "path string, code string").coalesce(1)
    facts = extract.python_facts(df)
    assert facts.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    for out in (extract.view_sources(facts, df), extract.python_edges(facts, df), extract.resolved_edges(extract.php_includes(df), df)):
        assert "BroadcastHashJoin" not in plan(out)
    assert "MapInArrow" not in plan(extract.view_sources(facts, df))


def test_folder_of_many_files_is_joined_without_a_comparison_of_its_edges(spark):
    n = 40
    df = spark.createDataFrame([(f"d{i % 2}/f{i}.go", f'import (\n"fmt"\nx "e.com/app/d{1 - i % 2}"\ny "app/d{1 - i % 2}"\n)') for i in range(n)], "path string, code string")
    out = extract.package_edges(extract.go_imports(df), df)
    assert sorted((r["from"], r["to"]) for r in out.collect()) == sorted((f"d{i % 2}/f{i}.go", f"d{j % 2}/f{j}.go") for i in range(n) for j in range(n) if i % 2 != j % 2)
    above = plan(out).split("SortMergeJoin")[0]
    assert "BroadcastHashJoin" not in plan(out) and "SortMergeJoin" in plan(out) and "Aggregate" not in above


def test_routes_are_parsed_in_as_many_tasks_as_shuffles_have(spark):
    df = spark.createDataFrame([(f"f{i}.py", "@app.route('/a')\ndef f(): pass\n") for i in range(40)], "path string, code string").coalesce(1)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for out in (extract.python_routes(extract.python_facts(df)), extract.nested_routes(df)):
        assert out.rdd.getNumPartitions() == n
    assert extract.python_routes(extract.python_facts(df)).count() == 40


def test_facts_are_read_without_a_visit_of_plain_nodes(monkeypatch):
    """Names, constants and operators are most of a tree and hold nothing: the general walk takes longer than the parser."""
    import ast

    code = "import a.b as c\nfrom . import d\ndef f(x: U['p', q] = path('u', g), *, y=('r', s)) -> V['t', w]:\n    global z\n    return not -url('k', lambda: h) < (1 + re_path('m', n.o))\nclass K[T: ('b', e)](M):\n    @r.get('/i/')\n    async def j(self): match x:\n            case {'l': A(b=('no', 1))} if path('v', c.d): pass\n"
    code = code.replace("async def j(self): match", "async def j(self):\n        match")
    walked = []
    with monkeypatch.context() as m:  # pytest walks trees itself
        m.setattr(ast, "walk", lambda node: walked.append(node) or [])
        got = [r[1:] for r in extract._python_facts("p/f.py", code)]
    assert walked == []
    assert got[:3] == [("import", "c", "a/b"), ("import", "d", "p/d"), ("import", "d", "p")]
    assert sorted(got[3:]) == sorted([("path", "u", "g"), ("tuple", "p", "q"), ("tuple", "r", "s"), ("tuple", "t", "w"), ("tuple", "b", "e"), ("url", "k", "lambda: h"), ("re_path", "m", "n.o"), ("route", "/i/", "j"), ("path", "v", "c.d")])
