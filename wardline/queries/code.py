"""Code records: spans, fields, calls, aliases, validated entities, snippets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names
from ..operators import entities, graph, snippets
from .adapters import table
from .registry import query

# spans: orders are functions of their customer's file, line items conditions
SPANS = """fn AS (SELECT o_custkey AS file, o_orderkey AS fn, (o_orderkey * 13) % 900 AS s, (o_orderkey * 13) % 900 + 40 + o_orderkey % 300 AS e FROM orders),
 cd AS (SELECT o.o_custkey AS file, l.l_orderkey * 10 + l.l_linenumber AS cond, (l.l_partkey * 7) % 1000 AS s, (l.l_partkey * 7) % 1000 + l.l_linenumber AS e FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey)"""


def spans(spark, sf_dir):
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    s = F.col("o_orderkey") * 13 % 900
    fn = o.select(F.col("o_custkey").alias("file"), F.col("o_orderkey").alias("fn"), s.alias("start"), (s + 40 + F.col("o_orderkey") % 300).alias("end"))
    t = F.col("l_partkey") * 7 % 1000
    cond = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("file"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("cond"), t.alias("start"), (t + F.col("l_linenumber")).alias("end"))
    return fn, cond


@query(f"WITH {SPANS} SELECT cd.file, cond, fn, CAST(fn.e - fn.s AS BIGINT) AS width FROM cd JOIN fn ON cd.file = fn.file AND fn.s <= cd.s AND cd.e <= fn.e")
def span_containment(spark, sf_dir):
    fn, cond = spans(spark, sf_dir)
    return entities.contained(cond, fn, "file", "cond", "fn")


@query(f"WITH {SPANS}, x AS (SELECT cd.file, cond, fn, fn.e - fn.s AS w FROM cd JOIN fn ON cd.file = fn.file AND fn.s <= cd.s AND cd.e <= fn.e) SELECT file, cond, fn, depth FROM (SELECT *, count(*) OVER (PARTITION BY file, cond) AS depth, row_number() OVER (PARTITION BY file, cond ORDER BY w, fn) AS r FROM x) WHERE r = 1")
def innermost_span(spark, sf_dir):
    fn, cond = spans(spark, sf_dir)
    return entities.innermost(cond, fn, "file", "cond", "fn")


@query("""WITH r AS (SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 'wp_users' WHEN 1 THEN 'Users' WHEN 2 THEN '' ELSE 'posts' END AS t, CASE p_partkey % 3 WHEN 0 THEN 'Role' WHEN 1 THEN 'owner' ELSE 'id' END AS f FROM part),
 c AS (SELECT * FROM (VALUES ('exact', 'users', 'role'), ('wildcard', NULL, 'owner'), ('bare', NULL, 'id')) v(mode, ctable, cfield))
 SELECT id, mode, ctable, cfield FROM r JOIN c ON lower(f) = cfield WHERE mode <> 'exact' OR (t <> '' AND (lower(t) = ctable OR ends_with(ctable, '_' || lower(t)) OR ends_with(lower(t), '_' || ctable)))""")
def field_match(spark, sf_dir):
    k = F.col("p_partkey")
    pick = lambda n, values: F.element_at(F.array(*map(F.lit, values)), (k % n + 1).cast("int"))
    rel = table(spark, sf_dir, "part").select(k.alias("id"), pick(4, ["wp_users", "Users", "", "posts"]).alias("table"), pick(3, ["Role", "owner", "id"]).alias("field"))
    fields = spark.createDataFrame(entities.field_rules(["users.role", "*.owner", "id"]), "mode string, ctable string, cfield string")
    return entities.field_matches(rel, fields)


@query("SELECT p_partkey AS id, simple FROM (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'require_owner' WHEN 1 THEN 'check' ELSE 'other' END AS simple FROM part) WHERE simple <> 'other'")
def call_match(spark, sf_dir):
    name = F.when(F.col("p_partkey") % 3 == 0, "Auth::require_owner").when(F.col("p_partkey") % 3 == 1, "$this->app.check").otherwise("other")
    fns = spark.createDataFrame([("Guard.check",), ("require_owner",)], "name string")
    return entities.call_matches(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), name.alias("name")), fns).select("id", "simple")


@query("""WITH f AS (SELECT o_orderkey AS id, unnest(['owner', 'role', 'state']) AS field, unnest([0, 1, 2]) AS pos FROM orders), a AS (SELECT o_orderkey AS id, unnest([o_orderstatus, o_orderpriority]) AS argument, unnest([0, 1]) AS pos FROM orders)
 SELECT field, argument, count(*) AS n FROM f JOIN a USING (id, pos) GROUP BY field, argument""")
def bound_positions(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    f = o.select(F.col("o_orderkey").alias("id"), F.array(*map(F.lit, ["owner", "role", "state"])).alias("fields"))
    a = o.select(F.col("o_orderkey").alias("id"), F.array("o_orderstatus", "o_orderpriority").alias("arguments"))
    return entities.bound_positions(f, a, "id").groupBy("field", "argument").agg(F.count("*").alias("n"))


ALIAS = "al AS (SELECT DISTINCT 'f' || (c_nationkey % 5) AS scope, 'v' || (c_custkey % 40) AS l, 'v' || (c_custkey * 7 % 53) AS r FROM customer)"


def aliases(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    return c.select(F.concat(F.lit("f"), F.col("c_nationkey") % 5).alias("scope"), F.concat(F.lit("v"), k % 40).alias("left"), F.concat(F.lit("v"), k * 7 % 53).alias("right")).distinct()


CLUSTERS = f"{ALIAS}, e AS (SELECT scope, l AS a, r AS b FROM al UNION SELECT scope, r, l FROM al), cl(scope, x, y) AS (SELECT scope, a, a FROM e UNION SELECT cl.scope, cl.x, e.b FROM cl JOIN e ON cl.scope = e.scope AND cl.y = e.a), g AS (SELECT scope, x AS expression, min(y) AS cluster FROM cl GROUP BY scope, x)"


@query(f"WITH RECURSIVE {CLUSTERS} SELECT scope, expression, cluster FROM g")
def alias_clusters(spark, sf_dir):
    return entities.alias_clusters(aliases(spark, sf_dir))


CALLS = "ca AS (SELECT DISTINCT 'f' || (l_suppkey * 3 % 97) AS a, 'f' || (l_partkey * 5 % 97) AS b FROM lineitem), ga AS (SELECT 'f' || i AS n FROM range(97) t(i) WHERE i % 3 <> 0)"


@query(f"WITH RECURSIVE {CALLS}, s(name, depth) AS (SELECT unnest(['f1', 'f2']), 0 UNION SELECT ca.a, s.depth + 1 FROM s JOIN ca ON ca.b = s.name WHERE ca.a IN (SELECT n FROM ga) AND s.depth < 60) SELECT name, CAST(min(depth) AS INT) AS depth FROM s GROUP BY name")
def wrapper_fixpoint(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    calls = li.select(F.concat(F.lit("f"), F.col("l_suppkey") * 3 % 97).alias("caller"), F.concat(F.lit("f"), F.col("l_partkey") * 5 % 97).alias("callee")).distinct()
    gate = spark.range(97).where("id % 3 <> 0").select(F.concat(F.lit("f"), "id").alias("name"))
    return graph.fixpoint(spark.createDataFrame([("f1",), ("f2",)], "name string"), calls, gate)


@query("""WITH RECURSIVE b AS (SELECT o_custkey AS scope, o_orderkey AS id, o_orderkey AS start, o_orderkey % 7 AS sets, (o_orderkey + 3) % 7 AS tests, o_orderstatus = 'F' AND o_orderkey % 5 = 0 AS denies FROM orders),
 s(id, depth) AS (SELECT id, 0 FROM b WHERE denies UNION SELECT x.id, s.depth + 1 FROM s JOIN b y ON y.id = s.id JOIN b x ON x.scope = y.scope AND x.sets = y.tests AND x.start < y.start)
 SELECT b.scope, b.id, CAST(min(s.depth) AS INT) AS denies_by FROM b LEFT JOIN s USING (id) GROUP BY b.scope, b.id""")
def flag_chain(spark, sf_dir):
    k = F.col("o_orderkey")
    b = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("scope"), k.alias("id"), k.alias("start"), (k % 7).alias("sets"), ((k + 3) % 7).alias("tests"), ((F.col("o_orderstatus") == "F") & (k % 5 == 0)).alias("denies"))
    return graph.chain_of_flags(b)


@query(f"""WITH RECURSIVE {CLUSTERS}, rel AS (SELECT 'f' || (s_suppkey % 5) AS scope, 'v' || (s_suppkey * 3 % 40) AS expression FROM supplier), rd AS (SELECT DISTINCT g.scope, cluster FROM rel JOIN g USING (scope, expression)),
 co AS (SELECT o_orderkey AS id, 'f' || (o_custkey % 5) AS scope, unnest(['v' || (o_orderkey % 60), 'v' || (o_custkey % 60)]) AS expression FROM orders WHERE o_orderstatus = 'F')
 SELECT g.scope, g.cluster, count(DISTINCT co.id) AS n_conditions, (SELECT string_agg(DISTINCT expression, ',' ORDER BY expression) FROM g h WHERE h.scope = g.scope AND h.cluster = g.cluster) AS aliases
 FROM co JOIN g ON co.scope = g.scope AND co.expression = g.expression JOIN rd ON rd.scope = g.scope AND rd.cluster = g.cluster GROUP BY g.scope, g.cluster""")
def validated_parameters(spark, sf_dir):
    o, s = table(spark, sf_dir, "orders"), table(spark, sf_dir, "supplier")
    rel = s.select(F.col("s_suppkey").alias("id"), F.concat(F.lit("f"), F.col("s_suppkey") % 5).alias("scope"), F.concat(F.lit("v"), F.col("s_suppkey") * 3 % 40).alias("expression"), F.lit("users").alias("table"), F.lit("role").alias("field"))
    k = F.col("o_orderkey")
    cond = o.select(k.alias("id"), F.lit("p").alias("path"), F.concat(F.lit("f"), F.col("o_custkey") % 5).alias("scope"), k.alias("start"), (k + 1).alias("end"), F.array(F.concat(F.lit("v"), k % 60), F.concat(F.lit("v"), F.col("o_custkey") % 60)).alias("expressions"), (F.col("o_orderstatus") == "F").alias("denies"))
    none = spark.createDataFrame([], "id long, name string, path string, start long, end long")
    calls = spark.createDataFrame([], "id long, caller string, callee string, path string, line long")
    fields = spark.createDataFrame(entities.field_rules(["users.role"]), "mode string, ctable string, cfield string")
    return entities.validate(aliases(spark, sf_dir), rel, cond, none, calls, fields)["parameters"].select("scope", "cluster", "n_conditions", F.array_join("aliases", ",").alias("aliases"))


SNIPPETS = r"""sn AS (SELECT doc_id AS ord, source AS path, lang AS kind, text,
   regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g'), '(?m)[ \t\f\x0B]+$', '', 'g'), '^\s+|\s+$', '', 'g') AS code FROM documents),
 ks AS (SELECT path, code, min(ord) AS ord FROM sn WHERE coalesce(kind, '') <> 'fr' AND coalesce(path, '') <> '' AND code <> '' AND NOT regexp_matches(code, '(?i)disgusting') GROUP BY path, code)"""


def snippet_rows(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ord"), F.col("source").alias("path"), F.col("lang").alias("kind"), F.col("text").alias("code"), F.lit(None).cast("string").alias("if_framework"))


@query(f"WITH {SNIPPETS} SELECT path, ord, md5(CASE WHEN path = 'src0' THEN '# guarded' || chr(10) || code ELSE code END) AS digest FROM ks")
def snippet_compact(spark, sf_dir):
    out = snippets.compact(snippet_rows(spark, sf_dir), exclude_kinds=["FR"], exclude_code=["disgusting"], prefixes=[("^src0$", "", "# guarded")])
    return out.select("path", "ord", F.md5("code").alias("digest"))


@query(f"WITH {SNIPPETS} SELECT (SELECT count(*) FROM sn) AS source_items, (SELECT count(*) FROM ks) AS llm_items, (SELECT count(*) FROM sn) - (SELECT count(*) FROM ks) AS items_removed")
def snippet_counts(spark, sf_dir):
    rows = snippet_rows(spark, sf_dir)
    return snippets.compaction_counts(rows, snippets.compact(rows, exclude_kinds=["fr"], exclude_code=["disgusting"]))


@query("""WITH s AS (SELECT doc_id, source, n_chars, CAST((lower(text) LIKE '%idiot%')::INT * 3 + (lower(text) LIKE '%the%')::INT + (lower(text) LIKE '%license%')::INT * 5 AS INT) AS score FROM documents)
 SELECT doc_id, source, score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, n_chars, doc_id) AS rank FROM s) WHERE rank <= 5""")
def topk_score(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars", "text")
    out = snippets.top_k(d, "source", snippets.keyword_score(F.col("text"), [("idiot", 3), ("the", 1), ("license", 5)]), 5, ["n_chars", "doc_id"])
    return out.select("doc_id", "source", "score", "rank")


#: Statements for every rule of the classifier, with the kind that the survey's rules give.
STATEMENTS = [
    ("php", "die(mysql_error());", None), ("php", "header('Location: login.php'); exit;", "redirect"), ("php", "header('Location: index.php'); exit;", None),
    ("php", "echo \"<meta http-equiv='refresh' content='0;url=signin.php'>\";", "redirect"), ("php", "http_response_code(403);", "http_denial"), ("php", "wp_redirect(auth_url());", "redirect"),
    ("php", "die('Access denied');", "denial_output"), ("php", "throw new SecurityException('x');", "exception"), ("php", "exit;", None), ("php", "deny_now();", "configured_denial"),
    ("java", "throw new SecurityException();", "exception"), ("java", "throw new IOException();", None), ("java", "System.exit(1); // login required", "execution_termination"),
    ("java", "resp.sendError(HttpServletResponse.SC_FORBIDDEN);", "http_denial"), ("java", "resp.setStatus(401);", "http_denial"), ("java", "resp.sendRedirect(\"/login\");", "redirect"),
    ("java", "resp.sendRedirect(\"/home\");", None), ("java", "rd.forward(req, resp); // forbidden", "redirect"), ("java", "return false;", None),
    ("python", "raise PermissionDenied(\"no\")", "denial"), ("python", "raise ValueError('login')", "exception"), ("python", "abort(403)", "http_denial"), ("python", "return Response(status=401)", "http_denial"),
    ("python", "return redirect('login')", "redirect"), ("python", "return redirect('home')", None), ("python", "sys.exit('forbidden')", "denial"),
    ("go", "w.WriteHeader(http.StatusForbidden)", "http_denial"), ("go", "http.Redirect(w, r, \"/login\", 302)", "redirect"), ("go", "http.Redirect(w, r, \"/home\", 302)", None),
    ("go", "c.AbortWithStatus(500)", "denial"), ("go", "http.Error(w, \"access denied\", 500)", "denial"), ("go", "return", None),
]


@query(f"SELECT p_partkey, [{', '.join('NULL' if k is None else repr(k) for _, _, k in STATEMENTS)}][p_partkey % {len(STATEMENTS)} + 1] AS kind FROM part")
def termination_kinds(spark, sf_dir):
    at = (F.col("p_partkey") % len(STATEMENTS) + 1).cast("int")
    pick = lambda i: F.element_at(F.array(*[F.lit(x[i]) for x in STATEMENTS]), at)
    return table(spark, sf_dir, "part").select("p_partkey", names.termination_kind(pick(0), pick(1), configured=(r"deny_now\(",)).alias("kind"))


@query("SELECT s_suppkey, 'supplier#' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') AS name, substr(sha256(s_name), 1, 12) AS digest, CASE s_suppkey % 3 WHEN 0 THEN 'role' WHEN 1 THEN 'request.user.role' ELSE '_session[''id'']' END AS key FROM supplier")
def name_keys(spark, sf_dir):
    k = F.col("s_suppkey")
    raw = F.when(k % 3 == 0, " $Current.User.ROLE ").when(k % 3 == 1, "request.user.role").otherwise('$_SESSION["id"]')
    return table(spark, sf_dir, "supplier").select("s_suppkey", names.normalized_name(F.col("s_name")).alias("name"), names.digest(F.col("s_name")).alias("digest"), names.semantic_key(raw).alias("key"))


@query("""WITH RECURSIVE a AS (SELECT DISTINCT 'f' || (l_suppkey % 90) AS c, l_linenumber % 3 AS cp, 'f' || (l_partkey % 90) AS d, (l_linenumber + 1) % 3 AS dp FROM lineitem),
 s(f, p, r) AS (SELECT 'f' || n_nationkey, n_regionkey % 3, CASE WHEN n_regionkey = 0 THEN 'admin' ELSE 'editor' END FROM nation UNION SELECT d, dp, r FROM s JOIN a ON a.c = s.f AND a.cp = s.p)
 SELECT f AS function, CAST(p AS INT) AS pos, r AS role FROM s""")
def role_flow(spark, sf_dir):
    li, n = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "nation")
    literals = n.select(F.concat(F.lit("F"), "n_nationkey").alias("function"), (F.col("n_regionkey") % 3).alias("pos"), F.when(F.col("n_regionkey") == 0, "admin").otherwise("editor").alias("role"))
    k = F.col("l_linenumber")
    args = li.select(F.concat(F.lit("f"), F.col("l_suppkey") % 90).alias("caller"), (k % 3).alias("caller_pos"), F.concat(F.lit("F"), F.col("l_partkey") % 90).alias("callee"), ((k + 1) % 3).alias("callee_pos"))
    return entities.role_flow(literals, args)


@query("""WITH s AS (SELECT DISTINCT 'session:k' || (s_suppkey % 7) AS key, s_nationkey AS f FROM supplier), r AS (SELECT DISTINCT 'p' || (c_custkey % 20) AS path, 'session:k' || (c_custkey % 9) AS key FROM customer)
 SELECT path, key, 'users' AS "table", 'f' || f AS field FROM r JOIN s USING (key)""")
def shared_state(spark, sf_dir):
    s, c = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "customer")
    at = F.concat(F.lit("w"), "s_suppkey")
    rel = s.select(at.alias("path"), F.lit("$r").alias("variable"), F.lit("users").alias("table"), F.concat(F.lit("f"), "s_nationkey").alias("field"))
    writes = s.select(at.alias("path"), F.lit("$r").alias("variable"), F.concat(F.lit("$_SESSION['K"), F.col("s_suppkey") % 7, F.lit("']")).alias("state"))
    reads = c.select(F.concat(F.lit("p"), F.col("c_custkey") % 20).alias("path"), F.concat(F.lit('$_session[ "k'), F.col("c_custkey") % 9, F.lit('" ]')).alias("state"))
    return entities.shared_state(rel, writes, reads)


@query(r"SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '$ok' WHEN 1 THEN '$ok' WHEN 2 THEN '$x' END AS flag, CASE p_partkey % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN false END AS value, p_partkey % 4 <> 3 AS boolean_like FROM part")
def state_gates(spark, sf_dir):
    k = F.col("p_partkey") % 4
    text = F.when(k == 0, "$ok").when(k == 1, "!$ok").when(k == 2, "$x === false").otherwise("compute($x)")
    gate = names.state_gate(text)
    return table(spark, sf_dir, "part").select("p_partkey", gate["name"].alias("flag"), gate["value"].alias("value"), F.when(k == 0, True).otherwise(names.returns_boolean(text)).alias("boolean_like"))
