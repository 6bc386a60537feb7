"""Repair: which findings are taken up, by which roles and requests they are checked, and what that comes to."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import repair
from ..sources import artifacts
from .adapters import CRAWL, crawl, table
from .registry import query
from .reports import FINDINGS, findings

SKIP = [{"category": "click", "page": "/click/25"}, {"category": "view", "pattern": "^VIEW/[0-4]+$", "reason": "view"}, {"category": "signup"}, {"pattern": r"/7\d$", "reason": "seventies"}]


@query(f"""{FINDINGS} SELECT ord, CASE WHEN category = 'click' AND page = 'click/25' THEN 'matched repair.skip_findings' WHEN category = 'view' AND regexp_matches(page, '^view/[0-4]+$') THEN 'view' WHEN regexp_matches(page, '/7[0-9]$') THEN 'seventies' END AS reason FROM f""")
def repair_skips(spark, sf_dir):
    return findings(spark, sf_dir).select("ord", repair.skip_reason(F.col("page"), F.col("category"), SKIP).alias("reason"))


ROLES = [{"role": "ghost", "pattern": "."}, {"role": "editor", "page": "/item/p1/edit"}, {"role": "owner", "pattern": "^shop/"}, {"name": "admin", "pattern": "5"}]


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'editor' WHEN p_partkey % 3 = 1 THEN 'owner' WHEN CAST(p_partkey AS VARCHAR) LIKE '%5%' THEN 'admin' END AS role FROM part""")
def regression_roles(spark, sf_dir):
    k = F.col("p_partkey")
    page = F.when(k % 3 == 0, F.concat(F.lit("/item/"), k, F.lit("/edit?a=1"))).when(k % 3 == 1, "x").otherwise(F.concat(F.lit("y"), k))
    overrides = F.when(k % 3 == 1, F.array(F.lit("/Shop/1"))).otherwise(F.expr("CAST(NULL AS array<string>)"))
    return table(spark, sf_dir, "part").select("p_partkey", repair.regression_role(page, overrides, ROLES, ["editor", "owner", "admin"]).alias("role"))


@query("""SELECT p_partkey AS id, CAST(r AS INT) AS rule FROM part, (SELECT unnest([0, 1, 2]) AS r) q WHERE (r = 0 AND p_partkey % 2 = 0) OR (r = 1 AND p_partkey % 5 = 0) OR (r = 2 AND p_partkey % 2 = 1 AND p_partkey % 3 = 0)""")
def database_rules(spark, sf_dir):
    rules = [{"category": "horizontal", "pattern": "^p/"}, {"page": "/p/p1/five"}, {"category": "vertical", "page_pattern": "three$", "page": "q/three"}, {"category": "vertical"}]
    k = F.col("p_partkey")
    v = table(spark, sf_dir, "part").select(k.alias("id"), F.when(k % 2 == 0, "horizontal").otherwise("vertical").alias("category"), F.concat(F.lit("/p/"), k, F.when(k % 5 == 0, "/five").otherwise("/x")).alias("page"), F.when(k % 3 == 0, F.array(F.lit("q/three"))).alias("page_overrides"))
    return repair.oracle_rules(v, rules).select("id", "rule")


@query("""SELECT o_orderkey, 'edit.php' AS page, 'POST' AS method, 'kind=new,note=t1' || CASE WHEN o_orderkey % 2 = 0 THEN ',password=s' ELSE '' END AS params, 'kind=new,note=t1' || CASE WHEN o_orderkey % 2 = 0 THEN ',password=<redacted>' ELSE '' END AS logged,
 'kind=new,note=t1' AS replaced FROM orders""")
def phase_requests(spark, sf_dir):
    k = F.col("o_orderkey")
    own = F.when(k % 2 == 0, F.create_map(F.lit("kind"), F.lit("old"), F.lit("password"), F.lit("s"))).when(k % 3 == 0, F.create_map(F.lit("note"), F.lit("x")))
    v = table(spark, sf_dir, "orders").select("o_orderkey", F.lit("/view.php").alias("page"), F.lit("get").alias("method"), own.alias("params"))
    context = repair.resolved({"note": "{token}1", "kind": "{base}w", "base": "ne"}, {"token": "t"})
    request = {"page": "/edit.php", "method": "post", "params": {"kind": "{kind}", "note": "{note}"}}
    text = lambda m: F.array_join(F.transform(F.array_sort(F.map_keys(m)), lambda x: F.concat(x, F.lit("="), F.element_at(m, x))), ",")
    laid = repair.phase_request(v, request, context).select("o_orderkey", "page", "method", text("params").alias("params"), text("logged").alias("logged"))
    replaced = repair.phase_request(v, request | {"replace_params": True}, context).select("o_orderkey", text("params").alias("replaced"))
    return laid.join(replaced, "o_orderkey")


@query("""WITH s AS (SELECT l_orderkey AS item, l_suppkey % 2 AS scenario, CASE l_linenumber % 2 WHEN 0 THEN 'attack' ELSE 'authorized' END AS phase, l_quantity > 3 AS passed, l_tax > 0.07 AND l_returnflag = 'R' AS broken FROM lineitem WHERE l_orderkey % 3 <> 0),
 g AS (SELECT item, scenario, coalesce(bool_and(passed AND NOT broken) FILTER (WHERE phase = 'attack'), false) AS a, coalesce(bool_and(passed AND NOT broken) FILTER (WHERE phase = 'authorized'), false) AS b FROM s GROUP BY ALL), h AS (SELECT item, bool_and(a) AS a, bool_and(b) AS b FROM g GROUP BY item)
 SELECT o_orderkey AS item, a IS NOT NULL AS applied, CASE WHEN a IS NULL THEN CASE WHEN o_orderkey % 2 = 0 THEN 'response_only' ELSE 'not_configured' END WHEN a AND b THEN 'passed' ELSE 'failed' END AS validation, coalesce(a, true) AS exploit, coalesce(b, true) AS regression, coalesce(a AND b, true) AS passed
 FROM orders LEFT JOIN h ON h.item = o_orderkey""")
def database_validation(spark, sf_dir):
    """Items whose key is divisible by three stand for those that no rule covers."""
    s = table(spark, sf_dir, "lineitem").where("l_orderkey % 3 <> 0").selectExpr("l_orderkey AS item", "l_suppkey % 2 AS scenario", "IF(l_linenumber % 2 = 0, 'attack', 'authorized') AS phase", "l_quantity > 3 AS passed", "IF(l_tax > 0.07 AND l_returnflag = 'R', 'x', null) AS error")
    items = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS item", "o_orderkey % 2 = 0 AS response_only")
    return repair.database_validation(items, s, "item").select("item", "applied", "validation", "exploit", "regression", "passed")


@query("""WITH a AS (SELECT l_orderkey AS item, l_linenumber AS attempt, l_discount < 0.08 AS has_output, l_discount < 0.08 AND l_tax < 0.05 AS successful FROM lineitem),
 f AS (SELECT item, count(*) AS tries, count(*) FILTER (WHERE has_output AND NOT successful) AS failed, min(attempt) FILTER (WHERE successful) AS first FROM a GROUP BY item)
 SELECT count(*) AS items, CAST(sum(o_orderkey % 4) AS BIGINT) AS attempts, CAST(sum(tries) AS BIGINT) AS generation_attempts, CAST(sum(failed) AS BIGINT) AS failed_patches, CAST(sum(o_orderkey % 5) AS BIGINT) AS patches_generated, CAST(sum(o_orderkey % 6) AS BIGINT) AS syntax_ok, CAST(sum(o_orderkey % 7) AS BIGINT) AS exploit_blocked,
 CAST(sum(o_orderkey % 3) AS BIGINT) AS regression_passed, CAST(sum(o_orderkey % 2) AS BIGINT) AS database_applied, CAST(sum(o_orderkey % 4 // 2) AS BIGINT) AS database_passed, count(first) AS successful, count(*) - count(first) AS failed_repairs, count(*) FILTER (WHERE first = 1) AS first_try_1, count(*) FILTER (WHERE first = 2) AS first_try_2,
 count(*) FILTER (WHERE first = 3) AS first_try_3, CAST(sum(CASE WHEN o_orderkey % 2 = 0 THEN o_custkey END) AS BIGINT) AS covered_findings, CAST(sum(CASE WHEN o_orderkey % 2 = 0 THEN 2 END) AS BIGINT) AS attack_vectors FROM orders LEFT JOIN f ON f.item = o_orderkey""".replace("o_orderkey % 4 // 2", "CASE WHEN o_orderkey % 4 >= 2 THEN 1 ELSE 0 END"))
def repair_figures(spark, sf_dir):
    a = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS item", "l_linenumber AS attempt", "l_discount < 0.08 AS has_output", "l_discount < 0.08 AND l_tax < 0.05 AS successful")
    good = a.groupBy("item").agg(F.bool_or("successful").alias("successful"))
    o = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS item", "o_orderkey % 4 AS attempts", "o_orderkey % 5 AS patches_generated", "o_orderkey % 6 AS syntax_ok", "o_orderkey % 7 AS exploit_blocked", "o_orderkey % 3 AS regression_passed", "o_orderkey % 2 AS database_applied", "IF(o_orderkey % 4 >= 2, 1, 0) AS database_passed", "IF(o_orderkey % 2 = 0, o_custkey, null) AS covered_findings", "IF(o_orderkey % 2 = 0, 2, null) AS attack_vectors")
    return repair.full_summary(o.join(good, "item", "left"), a)


@query(f"""{FINDINGS}, i AS (SELECT category, page, min(ord) AS ord FROM f WHERE status = 'vulnerable' GROUP BY ALL), x AS (SELECT category, page, count(*) AS n FROM f WHERE status = 'vulnerable' GROUP BY ALL),
 y AS (SELECT category, e2, min(ord) AS o, count(*) AS n FROM f WHERE ord % 2 = 0 GROUP BY ALL), z AS (SELECT category, sum(n) AS n, string_agg(e2, ',' ORDER BY o) AS ops FROM y GROUP BY ALL)
 SELECT i.category, i.page, i.ord, coalesce(x.n, 0) AS covered_findings, CAST(coalesce(z.n, 0) AS BIGINT) AS attack_vectors, coalesce(ops, '') AS operations FROM i LEFT JOIN x USING (category, page) LEFT JOIN z USING (category)""")
def repair_spellings(spark, sf_dir):
    """Vectors name a page with a query, a slash in front or as an override; numbers fold, so that a category's vectors meet each
    of its pages, once each."""
    f = findings(spark, sf_dir)
    c = crawl(spark, sf_dir).where("event_id % 2 = 0")
    page = F.substring_index("page", "?", 1)
    v = c.select(F.col("event_id").alias("id"), F.substring_index("page", "/", 1).alias("category"), F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("/"), "page")).otherwise("other.php").alias("page"), F.array(page).alias("page_overrides"), F.col("method").alias("operation"), F.col("event_id").alias("ord"))
    return repair.covered(repair.repair_items(f, []), f, v).withColumn("operations", F.array_join("operations", ","))


@query("""SELECT min(p_partkey) AS ord, lower(p_brand) AS "table", lower(p_type) AS field, CASE WHEN p_size > 25 THEN p_size ELSE 0 END AS line FROM part GROUP BY p_brand, p_type, CASE WHEN p_size > 25 THEN p_size ELSE 0 END""")
def relation_dedupe(spark, sf_dir):
    k = F.col("p_partkey")
    r = table(spark, sf_dir, "part").select(k.alias("ord"), F.when(k % 2 == 0, F.upper("p_brand")).otherwise(F.lower("p_brand")).alias("table"), F.col("p_type").alias("field"), F.when(F.col("p_size") > 25, F.col("p_size")).alias("line"))
    return repair.dedupe_relations(r).select("ord", F.lower("table").alias("table"), F.lower("field").alias("field"), F.coalesce("line", F.lit(0)).alias("line"))


@query("""SELECT 't' || c_custkey AS "table", field, CASE WHEN field = 'role' THEN c_mktsegment || ',x' ELSE '' END AS enums FROM customer, (SELECT unnest(['id', 'role']) AS field) q""")
def schema_scan(spark, sf_dir):
    sql = F.concat(F.lit("CREATE TABLE IF NOT EXISTS `t"), "c_custkey", F.lit("` (\n  `id` int(11) NOT NULL,\n  `role` enum('"), "c_mktsegment", F.lit("','x') DEFAULT 'x',\n  PRIMARY KEY (`id`)\n) ENGINE=InnoDB;\nDROP TABLE x;"))
    out = artifacts.schema_fields(table(spark, sf_dir, "customer").select(F.lit("a.sql").alias("path"), sql.alias("code")))
    return out.select("table", "field", F.array_join("enum_values", ",").alias("enums"))


@query("""SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'a/f' || p_partkey WHEN 1 THEN 'f' || p_partkey END AS path FROM part""")
def safe_paths(spark, sf_dir):
    k = F.col("p_partkey")
    raw = F.when(k % 5 == 0, F.concat(F.lit("./a//f"), k)).when(k % 5 == 1, F.concat(F.lit("a/../f"), k)).when(k % 5 == 2, F.concat(F.lit("../f"), k)).when(k % 5 == 3, F.concat(F.lit("/etc/f"), k)).otherwise("a/b/../../../c/d")
    return table(spark, sf_dir, "part").select("p_partkey", artifacts.safe_path(raw).alias("path"))


@query(f"WITH {CRAWL} SELECT event_id, event_type || '/x?' || CASE WHEN event_id % 2 = 0 THEN 'k=' || k || '&n=2' ELSE 'k=9&z=' || k END AS page FROM c")
def effective_pages(spark, sf_dir):
    from ..functions import urls

    c = crawl(spark, sf_dir)
    even = F.col("event_id") % 2 == 0
    params = F.when(even, F.create_map(F.lit("n"), F.lit("2"))).otherwise(F.create_map(F.lit("z"), F.col("k"), F.lit("k"), F.lit("9")))
    return c.select("event_id", urls.effective_page(F.concat("event_type", F.lit("/x?k="), "k"), params).alias("page"))
