"""Summaries, evaluation and consistency."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names
from ..operators import entities, evaluate, rendering, reporting
from ..operators.access import first_wins
from .adapters import CRAWL, crawl, table
from .registry import query

FINDINGS = f"""WITH {CRAWL}, f AS (SELECT split_part(page, '/', 1) AS category, split_part(page, '?', 1) AS page, role AS actor, CASE WHEN value > 5 THEN 'vulnerable' ELSE 'not_vulnerable' END AS status, CASE WHEN value > 50 THEN 'high' ELSE 'medium' END AS confidence, 'k=' || k AS e1, method AS e2, event_id AS ord FROM c)"""


def findings(spark, sf_dir):
    v = F.col("value")
    return crawl(spark, sf_dir).select(
        F.substring_index("page", "/", 1).alias("category"), F.substring_index("page", "?", 1).alias("page"), F.col("role").alias("actor"), F.when(v > 5, "vulnerable").otherwise("not_vulnerable").alias("status"),
        F.when(v > 50, "high").otherwise("medium").alias("confidence"), F.array(F.concat(F.lit("k="), "k"), "method").alias("evidence"), F.col("event_id").alias("ord"),
    )


@query(f"{FINDINGS} SELECT count(*) FILTER (WHERE status = 'vulnerable') AS vulnerable, count(*) FILTER (WHERE status <> 'vulnerable') AS not_vulnerable, count(*) AS total FROM f")
def findings_summary(spark, sf_dir):
    return reporting.findings_summary(findings(spark, sf_dir))


@query(f"""{FINDINGS}, a AS (SELECT category, page, actor, min(ord) AS o FROM f WHERE status = 'vulnerable' GROUP BY ALL), l AS (SELECT category, page, string_agg(actor, ',' ORDER BY o) AS actors FROM a GROUP BY ALL),
 v AS (SELECT category, page, unnest([e1, e2]) AS e FROM f WHERE status = 'vulnerable')
 SELECT f.category, f.page, any_value(l.actors) AS actors, string_agg(DISTINCT confidence, ',' ORDER BY confidence) AS confidence, (SELECT string_agg(DISTINCT e, ',' ORDER BY e) FROM v WHERE v.category = f.category AND v.page = f.page) AS evidence, count(*) AS requests
 FROM f JOIN l ON l.category = f.category AND l.page = f.page WHERE status = 'vulnerable' GROUP BY f.category, f.page""")
def findings_report(spark, sf_dir):
    r = reporting.findings_report(findings(spark, sf_dir))
    return r.select("category", "page", *[F.array_join(c, ",").alias(c) for c in ("actors", "confidence", "evidence")], "requests")


@query(f"""{FINDINGS}, g AS (SELECT *, CASE WHEN status = 'vulnerable' THEN 1 ELSE 2 END AS section FROM f),
 a AS (SELECT section, category, page, actor, min(ord) AS o FROM g GROUP BY ALL), l AS (SELECT section, category, page, string_agg(actor, ', ' ORDER BY o) AS actors FROM a GROUP BY ALL),
 v AS (SELECT DISTINCT section, category, page, unnest([e1, e2]) AS e FROM g), w AS (SELECT section, category, page, string_agg('- Evidence: ' || e, chr(10) ORDER BY e) AS evidence FROM v GROUP BY ALL),
 d AS (SELECT DISTINCT section, category, page, confidence FROM g), h AS (SELECT section, category, page, string_agg(confidence, ', ' ORDER BY confidence) AS confidence FROM d GROUP BY ALL),
 r AS (SELECT section, 1 AS place, category, page, '### `' || page || '`' || chr(10) || chr(10) || '- Category: ' || category || chr(10) || '- Actors: ' || actors || chr(10) || '- Confidence: ' || confidence || chr(10) || evidence || chr(10) AS m FROM l JOIN w USING (section, category, page) JOIN h USING (section, category, page)
       UNION ALL SELECT 0, 0, '', '', '# Findings' || chr(10) || chr(10) || '- Confirmed: ' || count(*) FILTER (WHERE section = 1) || chr(10) || '- Not confirmed: ' || count(*) FILTER (WHERE section = 2) || chr(10) FROM g
       UNION ALL SELECT n, 0, '', '', '## ' || t || chr(10) || CASE WHEN (SELECT count(*) FROM g WHERE section = n) = 0 THEN chr(10) || 'None.' || chr(10) ELSE '' END FROM (VALUES (1, 'Confirmed'), (2, 'Not confirmed')) x(n, t))
 SELECT row_number() OVER (ORDER BY section, place, category, page) AS "row", section, category, page, md5(m) AS digest FROM r""")
def findings_lines(spark, sf_dir):
    """The whole findings report, numbered by ranges."""
    report = rendering.numbered(rendering.findings_sections(findings(spark, sf_dir)), rendering.ORDER)
    return report.select("row", "section", "category", "page", F.md5("markdown").alias("digest"))


ATTEMPTS = "WITH a AS (SELECT l_orderkey AS item, l_linenumber AS attempt, l_discount < 0.08 AS syntax_ok, l_tax < 0.05 AS exploit_blocked, l_quantity > 10 AS regression_passed, l_discount < 0.08 AND l_tax < 0.05 AND l_quantity > 10 AS successful FROM lineitem)"


def attempts(spark, sf_dir):
    a = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS item", "l_linenumber AS attempt", "l_discount < 0.08 AS syntax_ok", "l_tax < 0.05 AS exploit_blocked", "l_quantity > 10 AS regression_passed")
    return a.withColumn("successful", F.expr("syntax_ok AND exploit_blocked AND regression_passed"))


@query(f"""{ATTEMPTS}, b AS (SELECT item, min(attempt) FILTER (WHERE successful) AS first FROM a GROUP BY item)
 SELECT (SELECT count(*) FROM b) AS items, count(*) AS attempts, count(*) FILTER (WHERE syntax_ok) AS syntax_ok, count(*) FILTER (WHERE exploit_blocked) AS exploit_blocked, count(*) FILTER (WHERE regression_passed) AS regression_passed,
   (SELECT count(first) FROM b) AS successful, (SELECT count(*) FROM b WHERE first = 1) AS first_try_1, (SELECT count(*) FROM b WHERE first = 2) AS first_try_2, (SELECT count(*) FROM b WHERE first = 3) AS first_try_3 FROM a""")
def repair_summary(spark, sf_dir):
    return reporting.repair_summary(attempts(spark, sf_dir))


@query(f"""{FINDINGS}, i AS (SELECT DISTINCT category, page FROM f), x AS (SELECT category, page, count(*) AS n FROM f WHERE status = 'vulnerable' GROUP BY ALL), y AS (SELECT category, page, count(*) AS n, string_agg(DISTINCT e2, ',' ORDER BY e2) AS ops FROM f WHERE ord % 2 = 0 GROUP BY ALL)
 SELECT i.category, i.page, coalesce(x.n, 0) AS covered_findings, coalesce(y.n, 0) AS attack_vectors, coalesce(ops, '') AS operations FROM i LEFT JOIN x USING (category, page) LEFT JOIN y USING (category, page)""")
def repair_coverage(spark, sf_dir):
    f = findings(spark, sf_dir)
    v = crawl(spark, sf_dir).where("event_id % 2 = 0").select(F.substring_index("page", "/", 1).alias("category"), F.substring_index("page", "?", 1).alias("page"), F.col("method").alias("operation"))
    return reporting.coverage(f.select("category", "page").distinct(), f, v, ["category", "page"]).withColumn("operations", F.array_join("operations", ","))


@query("""SELECT o_orderkey, round(greatest(o_totalprice - greatest(c_acctbal, 0), 0) + 10, 6) AS total, round(greatest(o_totalprice - 5.0 - greatest(c_acctbal, 0), 0) + 1.5 + 10, 6) AS both
 FROM orders JOIN customer ON o_custkey = c_custkey""")
def metric_merge(spark, sf_dir):
    j = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    one = reporting.merged_total(F.col("o_totalprice"), [F.col("c_acctbal")], [F.lit(10.0)])
    two = reporting.merged_total(F.col("o_totalprice"), [F.lit(5.0), F.col("c_acctbal")], [F.lit(1.5), F.lit(10.0)])
    return j.select("o_orderkey", reporting.rounded(one).alias("total"), reporting.rounded(two).alias("both"))


@query("SELECT o_orderpriority AS app, count(*) AS requests, CAST(sum(l_partkey) AS BIGINT) AS tokens_in, CAST(sum(l_suppkey) AS BIGINT) AS tokens_out, CAST(sum(l_partkey) + sum(l_suppkey) AS BIGINT) AS tokens_total, round((sum(l_partkey) * 0.5 + sum(l_suppkey) * 2.0) / 1e6, 6) AS cost FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_orderpriority")
def model_costs(spark, sf_dir):
    j = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    out = reporting.model_costs(j.select(F.col("o_orderpriority").alias("app"), F.col("l_partkey").alias("tokens_in"), F.col("l_suppkey").alias("tokens_out")), ["app"], 0.5, 2.0)
    return out.withColumn("cost", reporting.rounded(F.col("cost")))


@query("""WITH p AS (SELECT source, quality, n_chars > 500 AS yes FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL),
 r AS (SELECT coalesce(source, 'TOTAL') AS source, CAST(count(*) FILTER (WHERE yes AND quality = 1) AS BIGINT) AS tp, CAST(count(*) FILTER (WHERE yes AND quality = 0) AS BIGINT) AS fp, CAST(count(*) FILTER (WHERE NOT yes AND quality = 1) AS BIGINT) AS fn FROM p GROUP BY ROLLUP (source))
 SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall FROM r""")
def precision_recall(spark, sf_dir):
    j = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars").join(table(spark, sf_dir, "labels").where("quality IS NOT NULL"), "doc_id")
    yes, good = F.col("n_chars") > 500, F.col("quality") == 1
    counts = j.groupBy("source").agg(F.count_if(yes & good).alias("tp"), F.count_if(yes & ~good).alias("fp"), F.count_if(~yes & good).alias("fn"))
    return evaluate.scores(counts, "source")


@query("""WITH a AS (SELECT p_brand AS app, p_type AS kind, p_size, min(p_partkey) AS o FROM part GROUP BY ALL)
 SELECT p_brand AS app, p_type AS kind, count(*) AS occurrences, (SELECT string_agg(CAST(p_size AS VARCHAR), ' | ' ORDER BY o) FROM a WHERE a.app = part.p_brand AND a.kind = part.p_type) AS p_size FROM part GROUP BY p_brand, p_type""")
def entity_index(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("app"), F.col("p_type").alias("kind"), "p_size", F.col("p_partkey").alias("ord"))
    return evaluate.entity_index(p, ["app", "kind"], ["p_size"], "ord")


@query("""WITH e AS (SELECT 'e' || p_partkey AS id FROM part WHERE p_partkey % 2 = 0), s AS (SELECT 'e' || (doc_id % 300) AS id FROM documents),
 w AS (SELECT DISTINCT source AS path, text FROM documents WHERE doc_id % 10 <> 1), m AS (SELECT source AS path, text FROM documents WHERE doc_id % 10 <> 2)
 SELECT 'unknown id' AS problem, count(DISTINCT id) AS n FROM s WHERE id NOT IN (SELECT id FROM e) UNION ALL SELECT 'uncovered id', count(*) FROM e WHERE id NOT IN (SELECT id FROM s)
 UNION ALL SELECT 'lost snippet', count(*) FROM (SELECT * FROM w EXCEPT SELECT * FROM m) UNION ALL SELECT 'duplicated snippet', count(*) FROM (SELECT path, text FROM m GROUP BY ALL HAVING count(*) > 1) UNION ALL SELECT 'foreign snippet', count(*) FROM (SELECT * FROM m EXCEPT SELECT * FROM w)""")
def consistency_problems(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    e = table(spark, sf_dir, "part").where("p_partkey % 2 = 0").select(F.concat(F.lit("e"), "p_partkey").alias("id"))
    s = d.select(F.col("source").alias("path"), F.col("text").alias("code"), F.array(F.concat(F.lit("e"), F.col("doc_id") % 300)).alias("ids"), "doc_id")
    found = evaluate.consistency(e, s.select("path", "code", "ids").where(F.lit(True)), s.where("doc_id % 10 <> 2").select("path", "code"))
    ids = found.where("problem LIKE '%id'")
    rest = evaluate.consistency(e.limit(0), s.where("doc_id % 10 <> 1").select("path", "code", F.expr("CAST(array() AS array<string>)").alias("ids")), s.where("doc_id % 10 <> 2").select("path", "code")).where("problem LIKE '%snippet'")
    named = spark.createDataFrame([(x,) for x in ("unknown id", "uncovered id", "lost snippet", "duplicated snippet", "foreign snippet")], "problem string")
    return named.join(ids.union(rest).groupBy("problem").agg(F.count("*").alias("n")), "problem", "left").select("problem", F.coalesce("n", F.lit(0)).alias("n"))


@query("""WITH s AS (SELECT l_orderkey AS item, l_linenumber AS scenario, CASE l_linenumber % 2 WHEN 0 THEN 'exploit' ELSE 'regression' END AS phase, l_quantity > 3 AS passed, l_returnflag = 'R' AND l_tax > 0.07 AS broken FROM lineitem),
 g AS (SELECT item, scenario, coalesce(bool_and(passed AND NOT broken) FILTER (WHERE phase = 'exploit'), false) AS ok FROM s GROUP BY ALL) SELECT item, bool_and(ok) AS passed FROM g GROUP BY item""")
def phase_passed(spark, sf_dir):
    s = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS item", "l_linenumber AS scenario", "IF(l_linenumber % 2 = 0, 'exploit', 'regression') AS phase", "l_quantity > 3 AS passed", "IF(l_returnflag = 'R' AND l_tax > 0.07, 'x', null) AS error")
    return reporting.phase_passed(s, "item", "exploit")


@query("""SELECT o_orderkey AS item, o_orderkey % 3 = 0 AS applied, CASE WHEN o_orderkey % 3 = 0 THEN (o_orderkey % 2 = 0) AND (o_totalprice > 50000 OR o_orderkey % 5 = 0) ELSE o_totalprice > 50000 END AS exploit_blocked,
 CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus = 'F' OR o_orderkey % 5 = 0 ELSE o_orderstatus = 'F' END AS regression_passed FROM orders""")
def combined_verdicts(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    items = o.selectExpr("o_orderkey AS item", "o_totalprice > 50000 AS exploit_response", "o_orderstatus = 'F' AS regression_response", "o_orderkey % 5 = 0 AS database_primary")
    rules = o.where("o_orderkey % 3 = 0").selectExpr("o_orderkey AS item", "o_orderkey % 2 = 0 AS exploit", "true AS regression")
    return reporting.combined_verdicts(items, rules, "item").select("item", "applied", "exploit_blocked", "regression_passed")


@query("""WITH x AS (SELECT o_orderpriority || (o_orderkey % 50) AS line, 1 AS n FROM orders WHERE o_orderkey % 4 <> 0 UNION ALL SELECT o_orderpriority || (o_orderkey % 50), -1 FROM orders WHERE o_orderkey % 6 <> 0)
 SELECT line, CAST(sum(n) AS BIGINT) AS surplus FROM x GROUP BY line HAVING sum(n) <> 0""")
def dump_differences(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    line = F.concat("o_orderpriority", F.col("o_orderkey") % 50).alias("line")
    noise = spark.createDataFrame([("-- dumped at noon",), ("/*!40101 SET */",), ("   ",)], "line string")
    return reporting.dumps_differ(o.where("o_orderkey % 4 <> 0").select(line).union(noise), o.where("o_orderkey % 6 <> 0").select(line))


@query("SELECT l_linenumber AS line, count(*) FILTER (WHERE CASE l_linenumber WHEN 1 THEN l_returnflag = 'R' WHEN 2 THEN l_returnflag <> 'R' WHEN 3 THEN l_quantity = 7 WHEN 4 THEN l_quantity <> 7 WHEN 5 THEN l_discount = 0 ELSE l_discount <> 0 END) AS passed FROM lineitem GROUP BY l_linenumber")
def oracle_assertions(spark, sf_dir):
    n = F.col("l_linenumber")
    kind = F.when(n == 1, "contains").when(n == 2, "not_contains").when(n == 3, "equals").when(n == 4, "not_equals").when(n == 5, "zero").otherwise("nonzero")
    actual = F.when(n < 3, F.concat(F.lit("flag "), "l_returnflag")).when(n < 5, F.col("l_quantity").cast("int").cast("string")).otherwise(F.when(F.col("l_discount") == 0, " 0 ").otherwise(F.col("l_discount").cast("string")))
    checks = table(spark, sf_dir, "lineitem").select(n.alias("line"), kind.alias("kind"), actual.alias("actual"), F.when(n < 3, "R").otherwise("7").alias("expected"))
    return reporting.assertions(checks).groupBy("line").agg(F.count_if("passed").alias("passed"))


@query("""WITH x AS (SELECT c_nationkey AS app, 'user.' || lower(c_mktsegment) AS expression, c_custkey AS o FROM customer), y AS (SELECT app, lower(split_part(expression, '.', 2)) AS key, min(o) AS o FROM x GROUP BY ALL)
 SELECT y.app, y.key, x.expression AS name FROM y JOIN x ON x.app = y.app AND x.o = y.o""")
def predicted_entities(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("app"), F.concat(F.lit("user."), F.lower("c_mktsegment")).alias("expression"), F.array(F.lit("$x")).alias("aliases"), F.lit("a.php").alias("path"), F.col("c_custkey").alias("ord"))
    return evaluate.unique_predicted(c, ["app"]).select("app", "key", "name")


@query()
def greedy_match(spark, sf_dir):
    """Order decides, so there is no SQL; tests/test_plans.py holds it against a loop."""
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    e = evaluate.unique_expected(c.select(F.col("c_nationkey").alias("app"), F.concat(F.lit("user."), F.col("c_mktsegment")).alias("name"), F.col("c_custkey").alias("ord")), ["app"])
    p = c.where("c_custkey % 3 = 0").select(F.col("c_nationkey").alias("app"), F.lower("c_mktsegment").alias("name"), F.col("c_custkey").alias("ord"))
    p = first_wins(p, ["app", "name"], ["ord"]).withColumn("variants", names.name_variants(F.col("name")))
    return evaluate.greedy_match(e, p, ["app"])


@query("""WITH f AS (SELECT 'lib/' || p_brand || '/item' || p_partkey || '.java' AS path FROM part UNION ALL SELECT 'instrumented/x/' || p_brand || '/item' || p_partkey || '.java' FROM part WHERE p_partkey % 2 = 0)
 SELECT p_partkey AS id, 'lib/' || p_brand || '/item' || p_partkey || '.java' AS path, CASE WHEN p_partkey % 2 = 0 THEN 2 ELSE 1 END AS n_matches FROM part""")
def suffix_match(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    tail = F.concat("p_brand", F.lit("/item"), "p_partkey", F.lit(".java"))
    files = p.select(F.concat(F.lit("lib/"), tail).alias("path")).union(p.where("p_partkey % 2 = 0").select(F.concat(F.lit("instrumented/x/"), tail)))
    return entities.suffix_match(p.select(F.col("p_partkey").alias("id"), tail.alias("suffix")), files, "id", "suffix")
