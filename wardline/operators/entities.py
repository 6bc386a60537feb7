"""Joins over code records: containment, innermost scope, fields, calls, positions, and the validation of entities."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names
from . import graph

#: Lines in one bucket of a span join.
SPAN_BUCKET = 256


def contained(inner: DataFrame, outer: DataFrame, key: str, inner_id: str, outer_id: str, bucket: int = SPAN_BUCKET) -> DataFrame:
    """(inner_id, outer_id, width) for spans [start, end] of one key where the outer holds the inner.

    An equi-join on (key, bucket): the outer is listed in every bucket it touches, the inner in that of its start, so no
    key's spans meet all of each other in one place and every pair meets once."""
    o = outer.select(F.col(key), F.col(outer_id).alias("oid"), F.col("start").alias("os"), F.col("end").alias("oe"), F.explode(F.sequence(F.floor(F.col("start") / bucket), F.floor(F.col("end") / bucket))).alias("bucket"))
    i = inner.select(F.col(key), F.col(inner_id).alias("iid"), F.col("start").alias("is"), F.col("end").alias("ie"), F.floor(F.col("start") / bucket).alias("bucket"))
    return i.join(o, [key, "bucket"]).where("os <= `is` AND ie <= oe").select(key, F.col("iid").alias(inner_id), F.col("oid").alias(outer_id), (F.col("oe") - F.col("os")).alias("width"))


def holding(inner: DataFrame, outer: DataFrame, key: str) -> DataFrame:
    """Rows of ``outer`` whose span [start, end] holds an inner span of the key. Pairs are not listed: of the inner spans that
    begin at an outer's start or later, the least end decides, by one sort of the distinct spans of both."""
    i = inner.where(F.col("start").isNotNull()).groupBy(key, F.col("start").alias("s")).agg(F.min("end").alias("least")).withColumn("e", F.lit(None).cast("long"))
    o = outer.select(key, F.col("start").alias("s"), F.lit(None).cast("long").alias("least"), F.col("end").cast("long").alias("e")).where("s IS NOT NULL AND e IS NOT NULL").distinct()
    # from the last start to the first; an inner span comes before an outer one of its own start
    order = Window.partitionBy(key).orderBy(F.desc("s"), F.col("e").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = i.unionByName(o).withColumn("least", F.min("least").over(order)).where("least <= e").select(key, F.col("s").alias("start"), F.col("e").alias("end"))
    return outer.join(met, [key, "start", "end"], "left_semi")


def innermost(inner: DataFrame, outer: DataFrame, key: str, inner_id: str, outer_id: str) -> DataFrame:
    """For each inner span the narrowest outer that holds it; the smaller id of equals."""
    pairs = contained(inner, outer, key, inner_id, outer_id)
    return pairs.groupBy(key, inner_id).agg(F.min_by(outer_id, F.struct("width", outer_id)).alias(outer_id), F.count("*").alias("depth"))


def field_matches(relations: DataFrame, fields: DataFrame) -> DataFrame:
    """Relations (id, table, field) joined with configured fields (mode, ctable, cfield): exact tables allow a prefix up to an
    underscore on either side, a wildcard any table, a bare field one without a table or any. Equal fields meet by hash."""
    r = relations.withColumn("cfield", F.lower("field"))
    joined = r.join(fields, "cfield")
    t, c = F.lower(F.coalesce("table", F.lit(""))), F.lower(F.coalesce("ctable", F.lit("")))
    near = (t == c) | F.endswith(c, F.concat(F.lit("_"), t)) | F.endswith(t, F.concat(F.lit("_"), c))
    return joined.where((F.col("mode") != "exact") | ((t != "") & near)).select("id", "mode", "ctable", "cfield")


def field_rules(patterns: list[str]) -> list[tuple[str, str | None, str]]:
    """(mode, table, field) of t.f, *.f and f."""
    out = []
    for p in patterns:
        table, dot, name = p.strip().lower().rpartition(".")
        out.append(("wildcard", None, name) if table == "*" else ("exact", table, name) if dot else ("bare", None, name))
    return out


def call_matches(calls: DataFrame, functions: DataFrame) -> DataFrame:
    """Calls (id, name) of validated functions (name), by simple name."""
    return calls.withColumn("simple", names.simple_function_name(F.col("name"))).join(functions.select(names.simple_function_name(F.col("name")).alias("simple")).distinct(), "simple", "left_semi").select("id", "name", "simple")


def bound_positions(fields: DataFrame, arguments: DataFrame, key: str) -> DataFrame:
    """(key, pos, field, argument): lists zipped by place; what one list has more is dropped."""
    f = fields.select(key, F.posexplode("fields").alias("pos", "field"))
    a = arguments.select(key, F.posexplode("arguments").alias("pos", "argument"))
    return f.join(a, [key, "pos"])


def first_match(wanted: DataFrame, known: DataFrame, key: str, candidates: str, value: str) -> DataFrame:
    """For each row the value of the first of its candidate spellings that ``known`` (spelling, value) has; null without one."""
    each = wanted.select(key, F.posexplode(candidates).alias("pos", "spelling"))
    hit = each.join(known, "spelling").groupBy(key).agg(F.min_by(value, F.struct("pos", value)).alias(value))
    return wanted.join(hit, key, "left")


def suffix_match(wanted: DataFrame, files: DataFrame, key: str, suffix: str) -> DataFrame:
    """Files (path) that end, by whole segments, in a row's suffix, by an equi-join on as many last segments; shortest path
    first, paths with "instrumented" last."""
    n = F.size(F.split(F.col(suffix), "/"))
    w = wanted.withColumn("n", n)
    tails = files.select("path", F.posexplode(F.transform(F.sequence(F.lit(1), F.size(F.split("path", "/"))), lambda k: F.array_join(F.slice(F.split("path", "/"), -k, k), "/"))).alias("k", "tail"))
    rank = F.struct(F.contains(F.lower("path"), F.lit("instrumented")), F.length("path"), "path")
    return w.join(tails, F.col(suffix) == F.col("tail")).groupBy(key).agg(F.min_by("path", rank).alias("path"), F.count("*").alias("n_matches"))


def alias_clusters(pairs: DataFrame, scope: str = "scope") -> DataFrame:
    """(scope, expression, cluster): connected expressions within each scope; a cluster is named by its least member."""
    tag = lambda c: F.concat(F.col(scope), F.lit("\x01"), F.col(c))
    out = graph.components(pairs.select(tag("left").alias("a"), tag("right").alias("b")))
    part = lambda c: F.substring_index(F.col(c), "\x01", -1)
    return out.select(F.substring_index("node", "\x01", 1).alias(scope), part("node").alias("expression"), part("component").alias("cluster"))


def validate(pairs: DataFrame, relations: DataFrame, conditions: DataFrame, functions: DataFrame, calls: DataFrame, fields: DataFrame) -> dict[str, DataFrame]:
    """The entities that guard access.

    A cluster of aliases (scope, left, right) is a validated parameter if a member reads a configured database field
    (``relations``: id, scope, expression, table, field) and a condition that ends in a denial (``conditions``: id, path,
    scope, start, end, expressions, denies) tests a member. A function (``functions``: id, name, path, start, end) is
    validated if it holds such a condition, or holds a denying condition and calls a validated one (``calls``: id, caller,
    callee). Returns parameters, functions and snippets.
    """
    clusters = graph.checkpointed(alias_clusters(pairs))
    hit = relations.join(field_matches(relations, fields).select("id").distinct(), "id", "left_semi")
    read = hit.join(clusters, ["scope", "expression"]).select("scope", "cluster").distinct()
    tested = conditions.where("denies").select("id", "path", "scope", "start", "end", F.explode("expressions").alias("expression")).join(clusters, ["scope", "expression"]).select("scope", "cluster", "id", "path", "start", "end").distinct()
    gates = graph.checkpointed(tested.join(read, ["scope", "cluster"], "left_semi"))
    parameters = gates.groupBy("scope", "cluster").agg(F.count_distinct("id").alias("n_conditions"))
    members = clusters.groupBy("scope", "cluster").agg(F.array_sort(F.collect_set("expression")).alias("aliases"))
    parameters = parameters.join(members, ["scope", "cluster"])
    seeds = holding(gates, functions, "path").select("name").distinct()
    denying = holding(conditions.where("denies"), functions, "path").select("name").distinct()
    validated = graph.fixpoint(seeds, calls.select("caller", names.simple_function_name(F.col("callee")).alias("callee")), denying)
    guard = calls.withColumn("simple", names.simple_function_name(F.col("callee"))).join(validated.select(F.col("name").alias("simple")), "simple", "left_semi")
    snippets = gates.select("path", F.lit("conditional").alias("kind"), F.col("start").cast("long").alias("line")).union(guard.select("path", F.lit("guard_call"), F.col("line").cast("long"))).union(functions.join(validated, "name", "left_semi").select("path", F.lit("validation_function"), F.col("start").cast("long")))
    return {"parameters": parameters, "functions": validated, "snippets": snippets.distinct()}


def role_flow(literals: DataFrame, arguments: DataFrame) -> DataFrame:
    """(function, pos, role): role literals carried from caller to callee by parameter position until nothing is added.

    ``literals`` has function, pos, role where a parameter takes a literal; ``arguments`` has caller, caller_pos, callee,
    callee_pos where a parameter is handed on. Callees are met by lower-cased name and place."""
    node = lambda f, p: F.concat(F.lower(f), F.lit("\x01"), p.cast("string"))
    edges = arguments.select(node(F.col("caller"), F.col("caller_pos")).alias("from"), node(F.col("callee"), F.col("callee_pos")).alias("to"))
    out = graph.labelled_closure(edges, literals.select(node(F.col("function"), F.col("pos")).alias("node"), F.col("role").alias("label")))
    return out.select(F.substring_index("node", "\x01", 1).alias("function"), F.substring_index("node", "\x01", -1).cast("int").alias("pos"), F.col("label").alias("role"))


def call_flow(calls: DataFrame, methods: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The inputs of ``role_flow`` from calls (caller, caller_arity, callee, arguments) and methods (name, parameters).

    A call meets the methods of its callee's lower-cased name and number of arguments, place by place; functions are named
    name/arity, so that overloads stay apart. A quoted argument is a literal, one equal to a parameter of the caller is handed
    on, any other is neither. Null names or lists meet nothing; repeated rows count once."""
    key = lambda name, arity: F.concat(F.lower(name), F.lit("/"), arity.cast("string"))
    known = methods.select(key(F.col("name"), F.size("parameters")).alias("callee"), F.posexplode("parameters").alias("callee_pos", "parameter")).distinct()
    of = calls.select(key(F.col("caller"), F.col("caller_arity")).alias("caller"), key(F.col("callee"), F.size("arguments")).alias("callee"), F.posexplode("arguments").alias("callee_pos", "argument"))
    met = of.join(known.select("callee", "callee_pos"), ["callee", "callee_pos"], "left_semi")
    role = F.regexp_extract(F.trim("argument"), r"""^(["'])(.*)\1$""", 2)
    literals = met.select(F.col("callee").alias("function"), F.col("callee_pos").alias("pos"), role.alias("role")).where("role <> ''").distinct()
    own = known.select(F.col("callee").alias("caller"), F.col("callee_pos").alias("caller_pos"), F.col("parameter").alias("argument"))
    handed = met.withColumn("argument", F.trim("argument")).join(own, ["caller", "argument"])
    return literals, handed.select("caller", "caller_pos", "callee", "callee_pos").distinct()


def state_key(expression):
    """The key of a session or cookie expression whatever its quotes and spaces; null for others."""
    key = F.regexp_extract(expression, r"(?i)^\s*\$_(session|cookie)\s*\[\s*[\"']?(\w+)[\"']?\s*\]", 2)
    kind = F.lower(F.regexp_extract(expression, r"(?i)^\s*\$_(session|cookie)\s*\[", 1))
    return F.when(key != "", F.concat(kind, F.lit(":"), F.lower(key)))


def shared_state(relations: DataFrame, writes: DataFrame, reads: DataFrame) -> DataFrame:
    """Database relations (path, variable, table, field) carried to other files through session state: a file that writes the
    variable to a state key (path, variable, state) meets every file that reads the key (path, state), by hash of the key."""
    sent = relations.join(writes, ["path", "variable"]).select(state_key(F.col("state")).alias("key"), "table", "field").where("key IS NOT NULL").distinct()
    read = reads.select("path", state_key(F.col("state")).alias("key")).where("key IS NOT NULL").distinct()
    return read.join(sent, "key").select("path", "key", "table", "field")
