"""Source texts made from the driver's tables: includes, imports, routes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import extract
from .adapters import table
from .registry import query


def part_files(spark, sf_dir, pattern: str, suffix: str):
    """Files d<k % 5>/f<k>.<suffix> whose code names the next part's file."""
    k = F.col("p_partkey")
    at = lambda n: F.concat(F.lit("d"), n % 5, F.lit("/f"), n)
    code = F.replace(F.replace(F.lit(pattern), F.lit("@next"), at(k + 1)), F.lit("@self"), k.cast("string"))
    return table(spark, sf_dir, "part").select(F.concat(at(k), F.lit(suffix)).alias("path"), code.alias("code"))


EDGES = "SELECT 'd' || (p_partkey % 5) || '/f' || p_partkey || '{0}' AS \"from\", 'd' || ((p_partkey + 1) % 5) || '/f' || (p_partkey + 1) || '{0}' AS \"to\" FROM part WHERE p_partkey + 1 IN (SELECT p_partkey FROM part)"


@query(EDGES.format(".php"))
def php_edges(spark, sf_dir):
    files = part_files(spark, sf_dir, "<?php require_once(__DIR__ . '/../@next.php'); include $x; include 'missing/@self.php'; ?>", ".php")
    return extract.resolved_edges(extract.php_includes(files), files)


@query(EDGES.format(".py"))
def python_edges(spark, sf_dir):
    files = part_files(spark, sf_dir, "from ..@next import thing\nimport os\n", ".py")
    dotted = files.withColumn("code", F.regexp_replace("code", r"(d\d)/(f\d+)", "$1.$2"))
    return extract.python_edges(extract.python_facts(dotted), files)


@query("SELECT 'd' || (p_partkey % 5) || '/f' || p_partkey || '.py' AS path, 'item/p1/' || p_partkey AS url, 'show' AS handler FROM part UNION ALL SELECT 'd' || (p_partkey % 5) || '/f' || p_partkey || '.py', 'post/p1', 'views.post' FROM part")
def python_routes(spark, sf_dir):
    files = part_files(spark, sf_dir, "@app.route('/item/<int:n>/@self')\ndef show(n):\n    return n\nurlpatterns = [re_path(r'^post/(?P<y>[0-9]+)$', views.post)]\n", ".py")
    return extract.python_routes(extract.python_facts(files))


@query("SELECT 'd' || (p_partkey % 5) || '/f' || p_partkey || '.go' AS path, 'api/p1/x' || p_partkey AS url, 'h.Get' AS handler FROM part UNION ALL SELECT 'd' || (p_partkey % 5) || '/f' || p_partkey || '.go', 'top', 'home' FROM part")
def nested_routes(spark, sf_dir):
    return extract.nested_routes(part_files(spark, sf_dir, 'r.Route("/api", func(r R) { r.Route("/{id}", func(r R) { r.Get("/x@self", h.Get) }) })\nr.Post("/top", home) // r.Get("/no", x)\n', ".go"))


@query("SELECT 'd' || (a.p_partkey - a.p_partkey % 20) || '/f' || a.p_partkey || '.go' AS \"from\", 'd' || (b.p_partkey - b.p_partkey % 20) || '/f' || b.p_partkey || '.go' AS \"to\" FROM part a JOIN part b ON b.p_partkey - b.p_partkey % 20 = a.p_partkey - a.p_partkey % 20 + 20")
def go_edges(spark, sf_dir):
    """Folders of twenty files, each of which imports the next folder."""
    k = F.col("p_partkey")
    folder = lambda n: F.concat(F.lit("d"), n - n % 20)
    code = F.concat(F.lit('import (\n\t"fmt"\n\tx "example.com/app/'), folder(k + 20), F.lit('"\n)\n'))
    files = table(spark, sf_dir, "part").select(F.concat(folder(k), F.lit("/f"), k, F.lit(".go")).alias("path"), code.alias("code"))
    return extract.package_edges(extract.go_imports(files), files)


@query("SELECT 'd' || (p_partkey % 5) || '/f' || p_partkey || '.java' AS path, 'app/d' || ((p_partkey + 1) % 5) || '/f' || (p_partkey + 1) || '.java' AS target FROM part UNION ALL SELECT 'd' || (p_partkey % 5) || '/f' || p_partkey || '.java', '/head.jsp' FROM part")
def java_imports(spark, sf_dir):
    files = part_files(spark, sf_dir, 'import app.@next;\n<%@ include file="/head.jsp" %>', ".java")
    return extract.java_imports(files.withColumn("code", F.regexp_replace("code", r"(d\d)/(f\d+)", "$1.$2")))


@query("SELECT p_partkey AS id, CAST(unnest([0, 1]) AS INT) AS pos, 'users' AS \"table\", unnest(['role', 'owner_id']) AS field FROM part")
def sql_predicates(spark, sf_dir):
    sql = "SELECT * FROM `users` u WHERE u.role = ? AND x = 3 AND owner_id = %s"
    return extract.sql_predicates(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.lit(sql).alias("sql")))


@query("SELECT 'd' || (p_partkey % 5) || '/f' || p_partkey || e.x AS path, e.url || p_partkey AS url, e.handler AS handler FROM part, (VALUES ('.py', 'item/p1/', 'show'), ('.go', 'api/x', 'h.Get'), ('.java', 'shop/', 'Shop'), ('.java', 'store/', 'Shop')) e(x, url, handler)")
def source_routes(spark, sf_dir):
    """Routes of files in three languages, and of PHP files, which have none."""
    python = part_files(spark, sf_dir, "@app.route('/item/<int:n>/@self')\ndef show(n):\n    return n\n", ".py")
    go = part_files(spark, sf_dir, 'r.Route("/api", func(r R) { r.GET("/x@self", h.Get) })\n', ".go")
    java = part_files(spark, sf_dir, '@WebServlet(name = "s", urlPatterns = {"/shop/@self", "/store/@self"})\npublic class Shop extends HttpServlet {}', ".java")
    php = part_files(spark, sf_dir, "<?php // @app.route('/no')", ".php")
    return extract.routes(python.union(go).union(java).union(php))


@query("""WITH p AS (SELECT p_partkey AS k, 'd' || (p_partkey % 5) || '/f' || p_partkey || '.py' AS path, 'd' || ((p_partkey + 1) % 5) || '/f' || (p_partkey + 1) || '.py' AS next, p_partkey + 1 IN (SELECT p_partkey FROM part) AS there FROM part)
 SELECT path, 'own/' || k AS url, path AS source FROM p UNION ALL SELECT path, 'view/p1', CASE WHEN there THEN next ELSE path END FROM p
 UNION ALL SELECT path, 'made/', CASE WHEN there THEN next ELSE path END FROM p UNION ALL SELECT path, 'old/p1', next FROM p WHERE there UNION ALL SELECT path, 'far', path FROM p""")
def view_sources(spark, sf_dir):
    """Routes of each file to views of the next one, imported under its own and another name, as calls and as tuples."""
    code = "from ..@next import show as s, Shop\nimport os.path\n@app.route('/own/@self')\ndef here():\n    pass\nurlpatterns = [path('view/<int:n>', s), re_path(r'^made/$', Shop.as_view()), path('far', os.path.join), (r'^old/(\\d+)$', s), ('none', s), (r'^lost/$', other)]\n"
    files = part_files(spark, sf_dir, code, ".py")
    dotted = files.withColumn("code", F.regexp_replace("code", r"(d\d)/(f\d+)", "$1.$2"))
    return extract.view_sources(extract.python_facts(dotted), files)
