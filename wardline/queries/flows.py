"""Flow through recorded code: session predicates, database rows, prepared statements, roles by calls, validated entities."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import entities, flow
from .adapters import table
from .code import CLUSTERS, aliases
from .registry import query


def lines(spark, sf_dir):
    """Line items with their customer, at their place in the customer's file."""
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    at = (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("at")
    return li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey", at, "l_partkey", "l_suppkey", "l_orderkey", "l_linenumber")


LINES = "ln AS (SELECT o_custkey, l_orderkey * 10 + l_linenumber AS po, l_partkey AS p, l_suppkey AS s, l_orderkey, l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"


def named(prefix: str, n):
    return F.concat(F.lit(prefix), n.cast("string"))


@query(rf"""WITH RECURSIVE {LINES},
 a AS (SELECT o_custkey AS f, po, '$v' || (p % 4) AS t, CASE s % 9 WHEN 0 THEN '$_SESSION' WHEN 1 THEN '$v' || (s % 4) WHEN 2 THEN '$v' || (s % 4) ELSE '' END AS r, CASE WHEN s % 9 = 3 THEN p % 500 END AS c FROM ln),
 r AS (SELECT o_custkey AS f, CASE WHEN o_orderkey % 11 = 0 THEN '$v' || (o_orderkey % 4) ELSE '$w' END AS v, o_orderkey % 37 <> 0 AS b FROM orders),
 e AS (SELECT DISTINCT 'v' || f || r AS src, po AS before, 'v' || f || t AS dst, po AS dst_at FROM a WHERE r LIKE '$v%'
       UNION SELECT DISTINCT 'f' || c, 4000000000000000000, 'v' || f || t, po FROM a WHERE c IS NOT NULL
       UNION SELECT DISTINCT 'v' || f || v, 4000000000000000000, 'f' || f, -1 FROM r),
 h(node, po) AS (SELECT 'v' || f || t, po FROM a WHERE r = '$_SESSION' UNION SELECT e.dst, e.dst_at FROM h JOIN e ON e.src = h.node AND h.po < e.before)
 SELECT 'fn' || f AS function FROM r GROUP BY f HAVING bool_and(b) AND 'f' || f IN (SELECT node FROM h)""")
def session_predicates(spark, sf_dir):
    ln, o = lines(spark, sf_dir), table(spark, sf_dir, "orders")
    s = F.col("l_suppkey")
    use = named("$v", s % 4)
    right = F.when(s % 9 == 0, F.array(F.lit("$_SESSION[ 'id' ]"))).when(s % 9 == 1, F.array(F.concat(use, F.lit(" ->ok")))).when(s % 9 == 2, F.array(F.lit("$x"), F.concat(use, F.lit("['a'][0]")))).otherwise(F.array().cast("array<string>"))
    calls = F.when(s % 9 == 3, F.array(named("FN", F.col("l_partkey") % 500))).otherwise(F.array().cast("array<string>"))
    assignments = ln.select(named("fn", F.col("o_custkey")).alias("function"), "at", F.array(named("$v", F.col("l_partkey") % 4)).alias("left"), right.alias("right"), calls.alias("calls"))
    k = F.col("o_orderkey")
    variables = F.array(F.when(k % 11 == 0, named("$v", k % 4)).otherwise("$w"))
    code = F.when(k % 37 == 0, "return $v;").when(k % 3 == 0, "return ($v === 1);").when(k % 3 == 1, "return !isset($v['x']);").otherwise("return TRUE ;")
    return flow.session_predicates(assignments, o.select(named("fn", F.col("o_custkey")).alias("function"), code.alias("code"), variables.alias("variables")))


@query(f"""WITH {LINES},
 a AS (SELECT o_custkey AS scope, po, s % 4 AS kind, (p // 3) % 2 AS n, (p // 7) % 2 AS u, CASE WHEN s % 4 = 0 OR (s % 4 = 1 AND p % 10 = 0) THEN 't' || (p % 5) END AS tb, p % 3 AS f FROM ln),
 q AS (SELECT scope, n, po, tb, po AS qa FROM a WHERE kind = 0),
 r1 AS (SELECT a.scope, a.n, a.u, a.po, max(q.po) AS d FROM a JOIN q ON q.scope = a.scope AND q.n = a.u AND q.po < a.po WHERE kind = 1 GROUP BY a.scope, a.n, a.u, a.po),
 r AS (SELECT r1.scope, r1.n, r1.po, q.tb, q.qa FROM r1 JOIN q ON q.scope = r1.scope AND q.n = r1.u AND q.po = r1.d UNION SELECT scope, n, po, tb, po FROM a WHERE kind = 1 AND tb IS NOT NULL),
 w1 AS (SELECT a.scope, a.n, a.u, a.po, max(r.po) AS d FROM a JOIN r ON r.scope = a.scope AND r.n = a.u AND r.po < a.po WHERE kind = 2 GROUP BY a.scope, a.n, a.u, a.po),
 w AS (SELECT DISTINCT w1.scope, w1.n, w1.po, r.tb, r.qa FROM w1 JOIN r ON r.scope = w1.scope AND r.n = w1.u AND r.po = w1.d),
 f1 AS (SELECT a.scope, a.u, a.f, a.po, max(w.po) AS d FROM a JOIN w ON w.scope = a.scope AND w.n = a.u AND w.po < a.po WHERE kind = 3 GROUP BY a.scope, a.u, a.f, a.po)
 SELECT f1.scope, f1.po AS "at", '$w' || f1.u || '->f' || f1.f AS expression, w.tb AS "table", 'f' || f1.f AS field, w.qa AS query_at FROM f1 JOIN w ON w.scope = f1.scope AND w.n = f1.u AND w.po = f1.d""")
def result_flow(spark, sf_dir):
    """Queries, results, rows and fields of a customer's file, one record a line item."""
    ln = lines(spark, sf_dir)
    s, p = F.col("l_suppkey") % 4, F.col("l_partkey")
    pick = lambda *values: F.element_at(F.array(*values), (s + 1).cast("int"))
    n, u = F.floor(p / 3) % 2, F.floor(p / 7) % 2
    none = F.lit(None).cast("string")
    a = ln.select(
        F.col("o_custkey").alias("scope"), "at", pick(F.lit("query"), F.lit("result"), F.lit("row"), F.lit("field")).alias("kind"), pick(named("$q", n), named("$r", n), named("$w", n), none).alias("name"),
        F.array(pick(F.lit("$x"), named("$q", u), named("$r", u), named("$w", u))).alias("uses"), F.when((s == 0) | (s == 1) & (p % 10 == 0), named("t", p % 5)).alias("table"), named("f", p % 3).alias("field"),
        F.concat(named("$w", u), F.lit("->f"), (p % 3).cast("string")).alias("expression"),
    )
    return flow.result_flow(a)


@query(f"""WITH {LINES},
 pr AS (SELECT o_custkey AS scope, o_orderkey % 2 AS n, o_orderkey * 10 AS po, o_orderkey AS st, 't' || (o_orderkey % 5) AS tb, CAST(o_orderkey % 4 AS INT) AS k FROM orders),
 m AS (SELECT ln.o_custkey AS scope, p % 2 AS n, ln.po, max(pr.po) AS d, l_linenumber AS pos, p % 50 AS x FROM ln JOIN pr ON pr.scope = ln.o_custkey AND pr.n = ln.p % 2 AND pr.po < ln.po GROUP BY ALL)
 SELECT DISTINCT m.scope, '$a' || x AS expression, tb AS "table", 'c' || m.pos AS field, st AS start, m.po AS "end", 'prepare' || chr(10) || 'set' AS code
 FROM m JOIN pr ON pr.scope = m.scope AND pr.n = m.n AND pr.po = m.d WHERE m.pos <= k""")
def prepared_bindings(spark, sf_dir):
    """Orders prepare statements of none to three places, line items set them."""
    k = F.col("o_orderkey")
    fields = F.slice(F.array(*map(F.lit, ["c1", "c2", "c3"])), F.lit(1), (k % 4).cast("int"))
    prepared = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("scope"), named("s", k % 2).alias("name"), (k * 10).alias("at"), k.alias("start"), F.lit("prepare").alias("code"), named("t", k % 5).alias("table"), fields.alias("fields"))
    p = F.col("l_partkey")
    setters = lines(spark, sf_dir).select(F.col("o_custkey").alias("scope"), named("s", p % 2).alias("name"), "at", F.col("at").alias("end"), F.lit("set").alias("code"), F.col("l_linenumber").alias("position"), F.array(named("$a", p % 50)).alias("expressions"))
    return flow.prepared_bindings(prepared, setters)


@query("""WITH RECURSIVE c AS (SELECT DISTINCT 'm' || (l_suppkey % 80) AS a, 'm' || (l_partkey % 80) AS b, l_linenumber % 2 AS q, l_quantity < 3 AS lit, l_partkey % 3 AS r FROM lineitem WHERE l_linenumber % 3 <> 2),
 s(f, p, r) AS (SELECT b || '/2', 0, CASE r WHEN 0 THEN 'admin' WHEN 1 THEN 'editor' ELSE 'author' END FROM c WHERE lit UNION SELECT c.b || '/2', x.p, s.r FROM s JOIN c ON c.a || '/2' = s.f JOIN (SELECT 0 AS p UNION SELECT 1) x ON (x.p = 1 AND c.q = s.p) OR (x.p = 0 AND NOT c.lit AND s.p = 0))
 SELECT f AS function, CAST(p AS INT) AS pos, r AS role FROM s""")
def call_flow(spark, sf_dir):
    """Roles through calls by name and arity: the first argument is a literal or the caller's first, the second one of the caller's."""
    li = table(spark, sf_dir, "lineitem").where("l_linenumber % 3 <> 2")
    role = F.element_at(F.array(*[F.lit(x) for x in ("'admin'", '"editor"', "'author'")]), (F.col("l_partkey") % 3 + 1).cast("int"))
    first = F.when(F.col("l_quantity") < 3, role).otherwise("a")
    second = F.when(F.col("l_linenumber") % 2 == 0, "a").otherwise(" b ")
    calls = li.select(named("m", F.col("l_suppkey") % 80).alias("caller"), F.lit(2).alias("caller_arity"), named("M", F.col("l_partkey") % 80).alias("callee"), F.array(first, second).alias("arguments"))
    methods = table(spark, sf_dir, "lineitem").select(F.explode(F.array(named("m", F.col("l_suppkey") % 80), named("m", F.col("l_partkey") % 80))).alias("name")).distinct().select("name", F.array(F.lit("a"), F.lit("b")).alias("parameters"))
    return entities.role_flow(*entities.call_flow(calls, methods))


@query(f"""WITH RECURSIVE {CLUSTERS}, rel AS (SELECT 'f' || (s_suppkey % 5) AS scope, 'v' || (s_suppkey * 3 % 40) AS expression FROM supplier WHERE s_suppkey % 3 = 0), rd AS (SELECT DISTINCT g.scope, cluster FROM rel JOIN g USING (scope, expression)),
 co AS (SELECT l_orderkey * 10 + l_linenumber AS id, 'p' || (l_suppkey % 50) AS path, 'f' || (l_suppkey % 5) AS scope, (l_partkey * 7) % 1000 AS s, (l_partkey * 7) % 1000 + l_linenumber AS e, 'v' || (l_partkey % 60) AS x FROM lineitem WHERE l_partkey % 5 = 0 AND l_returnflag = 'R'),
 gate AS (SELECT co.*, g.cluster FROM co JOIN g ON g.scope = co.scope AND g.expression = co.x JOIN rd ON rd.scope = g.scope AND rd.cluster = g.cluster),
 fn AS (SELECT 'h' || (o_orderkey % 400) AS name, 'p' || (o_custkey % 50) AS path, (o_orderkey * 13) % 900 AS s, (o_orderkey * 13) % 900 + 2 + o_orderkey % 9 AS e FROM orders),
 ca AS (SELECT DISTINCT 'h' || (l_orderkey % 400) AS caller, 'h' || (l_partkey % 400) AS callee, 'p' || (l_suppkey % 50) AS path, l_linenumber AS line FROM lineitem WHERE l_partkey % 9 = 0),
 den AS (SELECT DISTINCT name FROM fn JOIN co ON co.path = fn.path AND fn.s <= co.s AND co.e <= fn.e),
 val(name, depth) AS (SELECT DISTINCT name, 0 FROM fn JOIN gate ON gate.path = fn.path AND fn.s <= gate.s AND gate.e <= fn.e
                      UNION SELECT ca.caller, val.depth + 1 FROM val JOIN ca ON ca.callee = val.name WHERE ca.caller IN (SELECT name FROM den) AND val.depth < 12),
 v AS (SELECT name, min(depth) AS depth FROM val GROUP BY name)
 SELECT 'parameter' AS entity, scope AS place, cluster AS name, count(DISTINCT id) AS n FROM gate GROUP BY scope, cluster
 UNION ALL SELECT 'function', '', name, depth FROM v
 UNION ALL SELECT 'conditional', path, '', count(DISTINCT s) FROM gate GROUP BY path
 UNION ALL SELECT 'guard_call', path, '', count(DISTINCT line) FROM ca WHERE callee IN (SELECT name FROM v) GROUP BY path
 UNION ALL SELECT 'validation_function', path, '', count(DISTINCT s) FROM fn WHERE name IN (SELECT name FROM v) GROUP BY path""")
def validated_entities(spark, sf_dir):
    """Parameters, functions and snippets of one validation: orders are functions, line items conditions and calls."""
    o, li, sup = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "supplier")
    k, p, s = F.col("s_suppkey"), F.col("l_partkey"), F.col("l_suppkey")
    rel = sup.where("s_suppkey % 3 = 0").select(k.alias("id"), named("f", k % 5).alias("scope"), named("v", k * 3 % 40).alias("expression"), F.lit("Users").alias("table"), F.lit("Role").alias("field"))
    start = p * 7 % 1000
    cond = li.where("l_partkey % 5 = 0").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), named("p", s % 50).alias("path"), named("f", s % 5).alias("scope"), start.alias("start"), (start + F.col("l_linenumber")).alias("end"), F.array(named("v", p % 60)).alias("expressions"), (F.col("l_returnflag") == "R").alias("denies"))
    begin = F.col("o_orderkey") * 13 % 900
    fns = o.select(F.col("o_orderkey").alias("id"), named("h", F.col("o_orderkey") % 400).alias("name"), named("p", F.col("o_custkey") % 50).alias("path"), begin.alias("start"), (begin + 2 + F.col("o_orderkey") % 9).alias("end"))
    calls = li.where("l_partkey % 9 = 0").select(F.col("l_orderkey").alias("id"), named("h", F.col("l_orderkey") % 400).alias("caller"), named("Guard::h", p % 400).alias("callee"), named("p", s % 50).alias("path"), F.col("l_linenumber").alias("line"))
    fields = spark.createDataFrame(entities.field_rules(["users.role"]), "mode string, ctable string, cfield string")
    out = entities.validate(aliases(spark, sf_dir), rel, cond, fns, calls, fields)
    snippets = out["snippets"].groupBy(F.col("kind").alias("entity"), F.col("path").alias("place"), F.lit("").alias("name")).agg(F.count("*").alias("n"))
    parameters = out["parameters"].select(F.lit("parameter").alias("entity"), F.col("scope").alias("place"), F.col("cluster").alias("name"), F.col("n_conditions").alias("n"))
    return parameters.union(out["functions"].select(F.lit("function"), F.lit(""), "name", F.col("depth").cast("long"))).union(snippets)
