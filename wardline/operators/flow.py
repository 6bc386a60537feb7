"""Data flow over recorded code: values that take the latest earlier definition, segments of prepared statements, and
functions whose boolean answer comes from session state.

Records are rows of (scope, position) as an extractor leaves them; a scope is a file or a function.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names
from . import graph


def latest_before(uses: DataFrame, definitions: DataFrame, keys: list[str], at: str, found: str) -> DataFrame:
    """``uses`` with the position of the latest definition of the same keys that lies before its own, as ``found``; null where
    there is none. Both sides are sorted together once, so that the cost is linear however many definitions a key has."""
    d = definitions.select(*keys, F.col(at), F.lit(None).cast(uses.schema).alias("_use")).distinct()
    u = uses.select(*keys, F.col(at), F.struct(*[uses[c] for c in uses.columns]).alias("_use"))
    # a use comes before a definition of its own position
    order = Window.partitionBy(*keys).orderBy(at, F.col("_use").isNull()).rowsBetween(Window.unboundedPreceding, -1)
    both = d.unionByName(u).withColumn(found, F.max(F.when(F.col("_use").isNull(), F.col(at))).over(order))
    return both.where("_use IS NOT NULL").select("_use.*", found)


def result_flow(assignments: DataFrame) -> DataFrame:
    """Fields read from database rows: (scope, at, expression, table, field, query_at).

    ``assignments`` has scope, at (position), name (what is assigned), kind, uses (variables on the right), table, field,
    expression. Of kind ``query``, a text with SQL on ``table``; ``result``, a call that runs a query: its variables hold
    texts, and it may name a table itself; ``row``, a fetch whose variables hold results; ``field``, a read of ``field`` from
    a row variable. Each use takes the latest earlier definition of its variable in the scope. A result without a query and
    a row without a result define nothing, so that the definition before them still holds. A definition that several
    queries reach passes all of them on. Rows without a scope, position or name define nothing; repeated rows count once.
    """
    a = assignments.where("scope IS NOT NULL AND at IS NOT NULL")
    known = a.where("kind = 'query' AND table IS NOT NULL AND name IS NOT NULL").select("scope", "name", "at", "table", F.col("at").alias("query_at")).distinct()
    for kind in ("result", "row", "field"):
        some = a.where(F.col("kind") == kind)
        uses = some.select("scope", F.explode("uses").alias("name"), "at", F.col("name").alias("target"), "field", "expression").distinct()
        met = latest_before(uses, known.select("scope", "name", "at").distinct(), ["scope", "name"], "at", "def_at").where("def_at IS NOT NULL")
        reached = met.join(known.withColumnRenamed("at", "def_at"), ["scope", "name", "def_at"])
        if kind == "field":
            return reached.where("coalesce(field, '') <> ''").select("scope", "at", "expression", "table", "field", "query_at").distinct()
        known = reached.select("scope", F.col("target").alias("name"), "at", "table", "query_at")
        if kind == "result":
            direct = some.where("table IS NOT NULL").select("scope", "name", "at", "table", F.col("at").alias("query_at"))
            known = known.unionByName(direct)
        known = graph.checkpointed(known.where("name IS NOT NULL").distinct())


def prepared_bindings(preparations: DataFrame, setters: DataFrame) -> DataFrame:
    """(scope, expression, table, field, start, end, code): arguments bound to the fields of a prepared statement.

    ``preparations`` has scope, name, at, start, end, code, table, fields (of the placeholders, in order); ``setters`` has
    scope, name, at, end, code, position (from 1), expressions. A statement lives from its preparation to the next one of
    its name; a setter fills the field at its position in the statement that lives there, and the relation reaches from the
    preparation to the setter. A position beyond the fields, or below 1, binds nothing; a setter may come again and binds
    again; one before any preparation binds nothing.
    """
    at = latest_before(setters, preparations, ["scope", "name"], "at", "prepared_at").where("prepared_at IS NOT NULL AND position >= 1")
    fields = preparations.select("scope", "name", F.col("at").alias("prepared_at"), "start", F.col("code").alias("before"), "table", F.posexplode("fields").alias("pos", "bound"))
    of = at.select("scope", "name", "prepared_at", (F.col("position") - 1).cast("int").alias("pos"), F.col("end").alias("till"), F.col("code").alias("after"), "expressions")
    met = of.join(fields, ["scope", "name", "prepared_at", "pos"])
    return met.select("scope", F.explode("expressions").alias("expression"), "table", F.col("bound").alias("field"), "start", F.col("till").alias("end"), F.concat_ws("\n", F.nullif("before", F.lit("")), F.nullif("after", F.lit(""))).alias("code")).distinct()


#: Fixed value: expressions that hold session or cookie state.
STATE = r"(?i)^\$_(?:COOKIE|SESSION)(?:\[.*)?$"


def _bases(expression):
    """What an expression may be read from: itself and what stands before each index or member of it."""
    plain = F.regexp_replace(expression, r"\s+", "")
    steps = F.regexp_extract_all(plain, F.lit(r"(?s)(?:^|\[|->)(?:(?!\[|->).)*"), F.lit(0))
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(steps), F.lit(1))), lambda k: F.array_join(F.slice(steps, F.lit(1), k), ""))


def session_predicates(assignments: DataFrame, returns: DataFrame) -> DataFrame:
    """Functions (function) whose answer is a boolean made of session or cookie state.

    ``assignments`` has function, at (order in the function), left, right (variables of both sides), calls (on the right
    side); ``returns`` has function, code, variables. A function carries state if a return of it reads the state or an alias
    of it. An alias is what is assigned, at some place, from the state, from an alias of an earlier place, or from a call of
    a function that carries state. Both relations grow together to their least fixpoint: a variable holds from the least
    place it became an alias at, a function from the start, and what lowers such a place is looked at again. Of the functions
    that carry state those count all of whose returns are booleans; one without returns carries none. Names are compared
    without case. Rows without a function name count for nothing.
    """
    fn = F.lower(F.trim("function"))
    var = lambda name: F.concat(F.lit("v\x01"), fn, F.lit("\x01"), name)
    plain = lambda c: F.regexp_replace(c, r"\s+", "")
    a = assignments.where("trim(function) <> ''").select("function", F.col("at").cast("long").alias("at"), F.explode(F.array_distinct(F.transform("left", plain))).alias("to"), "right", "calls")
    r = returns.where("trim(function) <> ''")
    never = F.lit(2**62).cast("long")
    target = [var(F.col("to")).alias("to"), F.col("at").alias("to_at")]
    answer = [F.concat(F.lit("f\x01"), fn).alias("to"), F.lit(-1).cast("long").alias("to_at")]
    edge = lambda before: lambda b: F.struct(b.alias("from"), before.alias("before"))
    read = lambda names_: F.array_distinct(F.transform(F.flatten(F.transform(names_, _bases)), var))
    through = F.transform(read("right"), edge(F.col("at")))
    called = F.transform(F.array_distinct(F.transform("calls", lambda c: F.concat(F.lit("f\x01"), F.lower(F.trim(c))))), edge(never))
    # values and calls of a row leave it together, so that rows are read once
    none = F.expr("CAST(array() AS array<struct<from: string, before: bigint>>)")
    edges = a.select(F.explode(F.concat(F.coalesce(through, none), F.coalesce(called, none))).alias("x"), *target).select("x.*", "to", "to_at")
    edges = edges.union(r.select(F.explode(read("variables")).alias("from"), never.alias("before"), *answer))
    begun = a.where(F.exists("right", lambda v: F.rlike(plain(v), F.lit(STATE)))).select(*target)
    begun = begun.union(r.where(F.exists("variables", lambda v: F.rlike(plain(v), F.lit(STATE)))).select(*answer))
    held = graph.earliest(edges, begun.select(F.col("to").alias("node"), F.col("to_at").alias("at")))
    carriers = held.where("node LIKE 'f\x01%'").select(F.substring_index("node", "\x01", -1).alias("function"))
    every = r.select(fn.alias("function"), names.boolean_return(F.col("code")).alias("b")).groupBy("function").agg(F.min(F.coalesce("b", F.lit(False))).alias("b"))
    return every.where("b").join(carriers, "function", "left_semi").select("function")
