"""Access matrix, graph algebra, fusion, test cases and fan-out."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import urls
from ..operators import access, entities, graph, reporting
from ..plans import static_graph, vectors
from .adapters import CRAWL, DEPENDENCY, MATRIX, crawl, dependency, matrix, table
from .registry import query

joined = lambda c: F.array_join(c, ",").alias(c)
EDGES = "ed AS (SELECT * FROM (SELECT lag(page) OVER (PARTITION BY role ORDER BY ts, event_id) AS a, page AS b FROM c) WHERE a IS NOT NULL)"


def walks(spark, sf_dir):
    from pyspark.sql import Window as W

    before = F.lag("page").over(W.partitionBy("role").orderBy("ts", "event_id"))
    return crawl(spark, sf_dir).select(before.alias("from"), F.col("page").alias("to"), "kind").where(F.col("from").isNotNull())


@query(f"WITH {MATRIX} SELECT page, array_to_string(roles, ',') AS roles, array_to_string(kinds, ',') AS kinds, (SELECT count(*) FROM v WHERE v.page = m.page) AS n_requests FROM m")
def access_matrix(spark, sf_dir):
    return matrix(spark, sf_dir).select("page", joined("roles"), joined("kinds"), F.size("requests").cast("long").alias("n_requests"))


@query(f"WITH {CRAWL} SELECT kind, count(DISTINCT role) AS roles, count(*) AS visits FROM c GROUP BY kind")
def role_kinds(spark, sf_dir):
    return crawl(spark, sf_dir).groupBy("kind").agg(F.count_distinct("role").alias("roles"), F.count("*").alias("visits"))


# cases whose pages differ in parameter values alone are one, the first page in order
CASES = """av AS (SELECT CASE WHEN kinds = ['admin'] THEN 'admin_only' ELSE 'authenticated_only' END AS category, page, CASE WHEN kinds = ['admin'] THEN admins ELSE coalesce(users, roles) END AS who, method
   FROM m WHERE NOT list_contains(kinds, 'visitor') QUALIFY row_number() OVER (PARTITION BY split_part(page, '?', 1), who, method, category ORDER BY page) = 1),
 hv AS (SELECT 'horizontal' AS category, page, coalesce(users, []) AS who, method FROM m WHERE NOT list_contains(kinds, 'visitor') QUALIFY row_number() OVER (PARTITION BY split_part(page, '?', 1), who, method ORDER BY page) = 1)"""
ADMIN = "SELECT category, page, array_to_string(who, ',') AS roles, method FROM av WHERE category = 'admin_only'"
SIGNED = "SELECT category, page, array_to_string(who, ',') AS roles, method FROM av WHERE category = 'authenticated_only'"


def cases(spark, sf_dir, categories, rules=None):
    none = spark.createDataFrame([], "page string")
    out = vectors.enumerate_vectors(matrix(spark, sf_dir), none, rules or vectors.Rules())
    return out.where(F.col("category").isin(categories)).select("category", "page", F.array_join("authorized_roles", ",").alias("roles"), F.col("request.method").alias("method"))


@query(f"WITH {MATRIX}, {CASES} {ADMIN}")
def admin_only(spark, sf_dir):
    return cases(spark, sf_dir, ["admin_only"])


@query(f"WITH {MATRIX}, {CASES} {SIGNED}")
def authenticated_only(spark, sf_dir):
    return cases(spark, sf_dir, ["authenticated_only"])


@query(f"WITH {MATRIX}, {CASES} {ADMIN} UNION ALL {SIGNED}")
def access_vectors(spark, sf_dir):
    return cases(spark, sf_dir, ["admin_only", "authenticated_only"])


@query(f"WITH {MATRIX}, {CASES} SELECT category, page, array_to_string(who, ',') AS roles, method FROM hv")
def horizontal_identity(spark, sf_dir):
    return cases(spark, sf_dir, ["horizontal"], vectors.Rules(identity=["d", "id"]))


@query(f"""WITH {MATRIX}, o AS (SELECT page, roles, admins, unnest(['2024-02-01', '2024-02-02']) AS d, unnest(['7', '7']) AS id FROM m WHERE split_part(page, '?', 1) IN ('view/1', 'view/2')
  UNION ALL SELECT page, roles, admins, unnest(['2024-02-01', '2024-02-02']), unnest(['8', '8']) FROM m WHERE split_part(page, '?', 1) IN ('view/1', 'view/2')),
 x AS (SELECT split_part(page, '?', 1) || '?d=' || d AS page, array_to_string(coalesce(admins, roles), ',') AS roles, page AS origin, id, d, 'GET' AS method FROM o)
SELECT 'vertical' AS category, min(page) AS page, roles, id, d FROM x GROUP BY split_part(page, '?', 1), roles, id, d""")
def vertical_overrides(spark, sf_dir):
    rules = vectors.Rules(identity=["d", "id"], force_vertical=["view/1", "view/2"], vertical_overrides={"d": ["2024-02-01", "2024-02-02"], "id": ["7", "8"]})
    m = matrix(spark, sf_dir).withColumn("requests", F.concat("requests", F.array(F.struct(F.lit(None).cast("string").alias("role"), F.lit("user").alias("kind"), F.lit("GET").alias("method"), F.create_map(F.lit("id"), F.lit("1")).alias("params"), F.lit(None).cast("string").alias("referer")))))
    out = vectors.enumerate_vectors(m, spark.createDataFrame([], "page string"), rules).where("category = 'vertical'")
    p = F.col("request.params")
    rows = out.select("category", "page", F.array_join("authorized_roles", ",").alias("roles"), p["id"].alias("id"), p["d"].alias("d"))
    return rows.groupBy("category", urls.base_page(F.col("page")).alias("b"), "roles", "id", "d").agg(F.min("page").alias("page")).drop("b")


@query(f"""WITH {MATRIX}, x AS (SELECT CASE WHEN kinds = ['admin'] THEN 'admin_only' ELSE 'authenticated_only' END AS category, split_part(page, '?', 1) AS base,
   CASE WHEN kinds = ['admin'] THEN admins ELSE coalesce(users, roles) END AS who, method FROM m WHERE NOT list_contains(kinds, 'visitor'))
 SELECT category, base || '?d=%2A' AS page, count(*) AS n FROM (SELECT DISTINCT category, base, who, method FROM x) GROUP BY 1, 2""")
def vector_dedupe(spark, sf_dir):
    plain = matrix(spark, sf_dir).withColumn("requests", F.transform("requests", lambda r: r.withField("params", F.expr("CAST(map() AS map<string,string>)"))))
    out = vectors.enumerate_vectors(plain, spark.createDataFrame([], "page string"), vectors.Rules())
    return out.groupBy("category", urls.vulnerability_page(F.col("page")).alias("page")).agg(F.count("*").alias("n"))


@query(f"""WITH RECURSIVE {CRAWL}, o AS (SELECT role, split_part(page, '/', 1) AS page, method, CASE WHEN value > 20 THEN 1 ELSE 0 END AS p, row_number() OVER (PARTITION BY role, split_part(page, '/', 1) ORDER BY ts, event_id) AS i FROM
   (SELECT role, page, CASE WHEN event_id % 5 = 0 THEN 'POST' ELSE 'GET' END AS method, value, ts, event_id FROM c)),
 f AS (SELECT role, page, method, p, i FROM o WHERE i = 1 UNION ALL
   SELECT o.role, o.page, CASE WHEN (f.method = 'GET' AND o.method <> 'GET') OR (f.p = 0 AND o.p > 0) THEN o.method ELSE f.method END,
          CASE WHEN (f.method = 'GET' AND o.method <> 'GET') OR (f.p = 0 AND o.p > 0) THEN o.p ELSE f.p END, o.i FROM f JOIN o ON o.role = f.role AND o.page = f.page AND o.i = f.i + 1)
 SELECT role, page, method, CAST(p AS BIGINT) AS n_params, CAST(i AS BIGINT) AS seen FROM f QUALIFY row_number() OVER (PARTITION BY role, page ORDER BY i DESC) = 1""")
def request_upgrade(spark, sf_dir):
    r = crawl(spark, sf_dir).select("role", F.substring_index("page", "/", 1).alias("page"), F.when(F.col("event_id") % 5 == 0, "POST").otherwise("GET").alias("method"), F.when(F.col("value") > 20, 1).otherwise(0).alias("n_params"), "ts", "event_id")
    return access.request_upgrade(r, ["role", "page"], ["ts", "event_id"])


@query(f"WITH {CRAWL}, {EDGES} SELECT a AS \"from\", b AS \"to\" FROM (SELECT DISTINCT a, b FROM ed)")
def edge_union(spark, sf_dir):
    return access.edge_union(walks(spark, sf_dir))


HTTP = "h AS (SELECT 'o' || l_orderkey AS a, 'p' || l_partkey AS b FROM lineitem UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey FROM orders WHERE o_orderkey % 3 = 0)"


def http(spark, sf_dir):
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    both = li.select(F.concat(F.lit("o"), "l_orderkey").alias("from"), F.concat(F.lit("p"), "l_partkey").alias("to"))
    return both.union(o.where("o_orderkey % 3 = 0").select(F.concat(F.lit("o"), "o_orderkey"), F.concat(F.lit("c"), "o_custkey")))


@query(f"WITH {DEPENDENCY}, {HTTP} SELECT kind, count(*) AS n, count(DISTINCT a) AS sources FROM (SELECT a, b, min(kind) AS kind FROM (SELECT a, b, 'dependency' AS kind FROM dep UNION ALL SELECT a, b, 'http' FROM h) GROUP BY a, b) GROUP BY kind")
def edge_kinds(spark, sf_dir):
    by = graph.edge_kinds(dependency(spark, sf_dir), http(spark, sf_dir)).groupBy("from", "kind").agg(F.count("*").alias("n"))
    return by.groupBy("kind").agg(F.sum("n").alias("n"), F.count("from").alias("sources"))


@query(f"WITH {DEPENDENCY}, x AS (SELECT a AS node, 0 AS i, 1 AS o FROM dep UNION ALL SELECT b, 1, 0 FROM dep) SELECT node, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o) AS BIGINT) AS out_degree FROM x GROUP BY node")
def degrees(spark, sf_dir):
    return graph.degrees(dependency(spark, sf_dir))


@query("SELECT 'c' || c_custkey AS node FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def isolated_nodes(spark, sf_dir):
    edges = dependency(spark, sf_dir).where(F.startswith("from", F.lit("o")))
    nodes = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("node"))
    return nodes.join(graph.degrees(edges), "node", "left").where(F.coalesce("in_degree", F.lit(0)) + F.coalesce("out_degree", F.lit(0)) == 0).select("node")


OBSERVED = "ob AS (SELECT DISTINCT split_part(page, '?', 1) AS base FROM c WHERE event_id % 2 = 0), st AS (SELECT DISTINCT event_type || '/' || k AS url, event_type || '.php' AS source FROM c)"


def observed(spark, sf_dir):
    return crawl(spark, sf_dir).where("event_id % 2 = 0").select("page").distinct()


def static_urls(spark, sf_dir):
    return crawl(spark, sf_dir).select(F.concat("event_type", F.lit("/"), "k").alias("url"), F.concat("event_type", F.lit(".php")).alias("source")).distinct()


@query(f"WITH {CRAWL}, {OBSERVED} SELECT url FROM st WHERE url IN (SELECT base FROM ob)")
def semi_observed(spark, sf_dir):
    base = observed(spark, sf_dir).select(urls.base_page(F.col("page")).alias("url")).distinct()
    return static_urls(spark, sf_dir).join(base, "url", "left_semi").select("url")


@query(f"WITH {CRAWL}, {OBSERVED} SELECT url FROM st WHERE url NOT IN (SELECT base FROM ob)")
def anti_unobserved(spark, sf_dir):
    base = observed(spark, sf_dir).select(urls.base_page(F.col("page")).alias("url")).distinct()
    return static_urls(spark, sf_dir).join(base, "url", "left_anti").select("url")


CLOSURE = f"WITH RECURSIVE {DEPENDENCY}, s(node, depth) AS (SELECT 'o' || o_orderkey, 0 FROM orders WHERE o_orderstatus = 'F' UNION SELECT dep.b, s.depth + 1 FROM s JOIN dep ON dep.a = s.node)"


@query(f"{CLOSURE} SELECT node, CAST(min(depth) AS INT) AS depth FROM s GROUP BY node")
def closure(spark, sf_dir):
    starts = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.concat(F.lit("o"), "o_orderkey").alias("node"))
    return graph.closure(dependency(spark, sf_dir), starts)


@query(f"""WITH RECURSIVE p AS (SELECT DISTINCT 'c' || o_custkey AS a, 'o' || o_orderkey AS b FROM orders),
 e AS (SELECT a, b FROM p UNION SELECT b, a FROM p), r(x, y) AS (SELECT a, a FROM e UNION SELECT r.x, e.b FROM r JOIN e ON r.y = e.a) SELECT x AS node, min(y) AS component FROM r GROUP BY x""")
def components(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return graph.components(o.select(F.concat(F.lit("c"), "o_custkey").alias("a"), F.concat(F.lit("o"), "o_orderkey").alias("b")).distinct())


LABELS = f"""{DEPENDENCY}, {HTTP},
 up AS (SELECT 'page' || o_orderkey AS url, 'o' || o_orderkey AS source FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT 'install/' || s_suppkey, 's' || s_suppkey FROM supplier UNION ALL SELECT 'x' || s_suppkey, 's' || s_suppkey FROM supplier),
 src AS (SELECT 'o' || o_orderkey AS path FROM orders UNION ALL SELECT 'c' || c_custkey FROM customer UNION ALL SELECT 's' || s_suppkey FROM supplier),
 ob AS (SELECT DISTINCT 'page' || o_orderkey AS url FROM orders WHERE o_orderkey % 5 = 0), seen AS (SELECT * FROM up WHERE url IN (SELECT url FROM ob)), rest AS (SELECT * FROM up WHERE url NOT IN (SELECT url FROM ob)),
 t AS (SELECT a AS n FROM dep UNION SELECT b FROM dep UNION SELECT a FROM h UNION SELECT b FROM h),
 s(node) AS (SELECT source FROM seen UNION SELECT dep.b FROM s JOIN dep ON dep.a = s.node),
 l AS (SELECT 'UP' AS label, url AS member FROM up UNION ALL SELECT 'CP', path FROM src WHERE path NOT IN (SELECT source FROM up) UNION ALL SELECT 'UP_prime0', url FROM seen
   UNION ALL SELECT 'UPdiff1', url FROM rest WHERE source IN (SELECT n FROM t) AND url NOT LIKE 'install/%' UNION ALL SELECT 'UPdiff2', url FROM rest WHERE NOT (source IN (SELECT n FROM t) AND url NOT LIKE 'install/%')
   UNION ALL SELECT 'UPdiff', url FROM rest UNION ALL SELECT 'public_unobserved', url FROM rest UNION ALL SELECT DISTINCT 'observed', source FROM seen
   UNION ALL SELECT 'internal_reachable', node FROM s WHERE node NOT IN (SELECT source FROM seen) UNION ALL SELECT 'support_unreachable', path FROM src WHERE path NOT IN (SELECT node FROM s) AND path NOT IN (SELECT source FROM up))"""


def static_inputs(spark, sf_dir):
    o, c, s = (table(spark, sf_dir, t) for t in ("orders", "customer", "supplier"))
    key = lambda p, x: F.concat(F.lit(p), x)
    up = o.where("o_orderkey % 2 = 0").select(key("page", "o_orderkey").alias("url"), key("o", "o_orderkey").alias("source"), F.lit("route").alias("origin"))
    up = up.union(s.select(key("install/", "s_suppkey"), key("s", "s_suppkey"), F.lit("direct"))).union(s.select(key("x", "s_suppkey"), key("s", "s_suppkey"), F.lit("http"))).union(s.select(key("x", "s_suppkey"), F.lit("zzz"), F.lit("direct")))
    files = o.select(key("o", "o_orderkey").alias("path")).union(c.select(key("c", "c_custkey"))).union(s.select(key("s", "s_suppkey")))
    seen = o.where("o_orderkey % 5 = 0").select(F.concat(F.lit("/page"), "o_orderkey", F.lit("?id=p1")).alias("page"))
    return files, static_graph.url_sources(up), dependency(spark, sf_dir), http(spark, sf_dir), seen


@query(f"WITH RECURSIVE {LABELS} SELECT label, member FROM l")
def static_classification(spark, sf_dir):
    return static_graph.classify(*static_inputs(spark, sf_dir))


@query(f"""WITH RECURSIVE {LABELS}, n AS (SELECT 'page' || o_orderkey AS node, 'dynamic' AS origin FROM orders WHERE o_orderkey % 7 = 0 UNION ALL SELECT url, 'static' FROM up UNION ALL SELECT member, 'static' FROM l WHERE label = 'CP')
 SELECT node, string_agg(DISTINCT origin, ',' ORDER BY origin) AS origins FROM n GROUP BY node""")
def node_origins(spark, sf_dir):
    files, up, dep, web, seen = static_inputs(spark, sf_dir)
    dynamic = table(spark, sf_dir, "orders").where("o_orderkey % 7 = 0").select(F.concat(F.lit("page"), "o_orderkey").alias("page"))
    nodes = static_graph.fuse(dynamic, up, static_graph.classify(files, up, dep, web, seen))["nodes"]
    return nodes.select("node", joined("origins"))


@query(f"WITH RECURSIVE {LABELS} SELECT member AS page FROM l WHERE label IN ('UPdiff2', 'CP')")
def static_detection(spark, sf_dir):
    files, up, dep, web, seen = static_inputs(spark, sf_dir)
    return static_graph.fuse(seen, up, static_graph.classify(files, up, dep, web, seen))["static_detection"]


@query(f"""WITH {MATRIX}, {CASES}, w AS (SELECT *, [u FOR u IN who IF u IN ('u1', 'u2', 'u3')] AS own FROM hv),
 x AS (SELECT category, unnest([NULL, 'u1', 'u2', 'u3']) AS actor FROM av WHERE category = 'admin_only' UNION ALL SELECT category, NULL FROM av WHERE category = 'authenticated_only' UNION ALL SELECT category, unnest([own[1], own[1]]) FROM w WHERE len(own) > 0)
 SELECT category, actor, count(*) AS n FROM x GROUP BY category, actor""")
def fanout_attackers(spark, sf_dir):
    v = vectors.enumerate_vectors(matrix(spark, sf_dir), spark.createDataFrame([], "page string"), vectors.Rules(identity=["d"]))
    roles = [("u0", "admin"), ("u1", "user"), ("u2", "user"), ("u3", "user"), ("u7", "visitor")]
    return vectors.fan_out(v, roles, overrides={"d": ["2024-01-01", "2024-01-02"]}).groupBy("category", "actor").agg(F.count("*").alias("n"))


@query(f"WITH {CRAWL}, {EDGES}, x AS (SELECT split_part(page, '/', 1) AS app, 1 AS n, 0 AS e FROM (SELECT DISTINCT page FROM c) UNION ALL SELECT split_part(a, '/', 1), 0, 1 FROM (SELECT DISTINCT a, b FROM ed)) SELECT app, CAST(sum(n) AS BIGINT) AS nodes, CAST(sum(e) AS BIGINT) AS edges FROM x GROUP BY app")
def graph_counts(spark, sf_dir):
    app = lambda c: F.substring_index(c, "/", 1).alias("app")
    return reporting.graph_counts(crawl(spark, sf_dir).select("page").distinct().select(app("page")), access.edge_union(walks(spark, sf_dir)).select(app("from")), ["app"])


@query("""WITH w AS (SELECT o_orderkey AS id, ['o' || (o_orderkey * 2), 'c' || (o_custkey * 3), 'o' || o_orderkey] AS cand FROM orders), k AS (SELECT 'o' || o_orderkey AS spelling, 'order' || o_orderkey AS value FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT 'c' || c_custkey, 'cust' || c_custkey FROM customer),
 h AS (SELECT w.id, x.i, k.value FROM (SELECT id, unnest(cand) AS s, unnest([1, 2, 3]) AS i FROM w) x JOIN w ON w.id = x.id JOIN k ON k.spelling = x.s)
 SELECT w.id, (SELECT arg_min(value, i) FROM h WHERE h.id = w.id) AS value FROM w""")
def first_match(spark, sf_dir):
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    wanted = o.select(F.col("o_orderkey").alias("id"), F.array(F.concat(F.lit("o"), F.col("o_orderkey") * 2), F.concat(F.lit("c"), F.col("o_custkey") * 3), F.concat(F.lit("o"), "o_orderkey")).alias("cand"))
    known = o.where("o_orderkey % 3 = 0").select(F.concat(F.lit("o"), "o_orderkey").alias("spelling"), F.concat(F.lit("order"), "o_orderkey").alias("value")).union(c.select(F.concat(F.lit("c"), "c_custkey"), F.concat(F.lit("cust"), "c_custkey")))
    return entities.first_match(wanted, known, "id", "cand", "value").select("id", "value")
