"""Flow operators against plain loops over random records."""

import random

from pyspark.sql import functions as F
from wardline.functions import names
from wardline.operators import flow, graph

ASSIGNMENT = "scope string, at long, name string, kind string, uses array<string>, table string, field string, expression string, def_at int"


def flow_by_loop(rows):
    """Assignments in order; each kind's variables remember their last contexts."""
    out = set()
    for scope in {r[0] for r in rows}:
        known = {"query": {}, "result": {}, "row": {}}
        for _, at, name, kind, uses, table, field, expression, _ in sorted((r for r in rows if r[0] == scope), key=lambda r: r[1]):
            before = {"result": "query", "row": "result", "field": "row"}.get(kind)
            if kind == "query":
                if table:
                    known["query"][name] = {(table, at)}
                continue
            contexts = set().union(*[known[before].get(u, set()) for u in uses])
            if kind == "field":
                out |= {(scope, at, expression, t, field, q) for t, q in contexts}
                continue
            if kind == "result" and table:
                contexts |= {(table, at)}
            if contexts:
                known[kind][name] = contexts
    return sorted(out)


def test_result_flow_equals_a_loop(spark):
    rng = random.Random(1)
    rows = []
    for scope in "abcd":
        for at in rng.sample(range(1000), 150):
            kind = rng.choice(["query", "result", "row", "field"])
            var = lambda: f"${rng.randrange(4)}"
            rows.append((scope, at, None if kind == "field" else var(), kind, [var() for _ in range(rng.randrange(0, 3))], f"t{at}" if kind == "query" or kind == "result" and rng.random() < 0.2 else None, "role", f"e{at}", 7))
    df = spark.createDataFrame(rows + rows[:9] + [(None, 1, "$0", "query", [], "t", None, None, 7), ("a", None, "$0", "query", [], "t", None, None, 7)], ASSIGNMENT)
    got = flow.result_flow(df)
    assert got.columns == ["scope", "at", "expression", "table", "field", "query_at"]
    assert sorted(map(tuple, got.collect())) == flow_by_loop(rows) != []
    assert flow.result_flow(df.limit(0)).count() == 0


def test_latest_definition_in_a_large_scope(spark):
    """One variable of 100,000 definitions: one pass over sorted rows."""
    d = spark.range(100_000).select(F.lit("s").alias("scope"), (F.col("id") * 2).alias("at"))
    u = spark.range(100_000).select(F.lit("s").alias("scope"), (F.col("id") * 2 + 1).alias("at"), F.col("id").alias("use"))
    got = flow.latest_before(u, d, ["scope"], "at", "found").agg(F.count("*"), F.min(F.col("at") - F.col("found")), F.max(F.col("at") - F.col("found"))).first()
    assert tuple(got) == (100_000, 1, 1)


def test_prepared_statements(spark):
    p = [("f", "st", 10, 1, "prep a", "users", ["id", "role"]), ("f", "st", 50, 9, "prep b", "posts", ["owner"]), ("g", "st", 5, 1, "", "t", ["x"])]
    s = [
        ("f", "st", 5, 0, "early", 1, ["$e"]), ("f", "st", 20, 2, "set 1", 1, ["$a", "$b"]), ("f", "st", 30, 3, "set 2", 2, ["$c"]), ("f", "st", 31, 3, "again", 2, ["$d"]), ("f", "st", 32, 3, "beyond", 3, ["$x"]),
        ("f", "st", 33, 3, "below", 0, ["$x"]), ("f", "st", 60, 10, "set b", 1, ["$a"]), ("f", "st", 61, 10, "set b", 2, ["$c"]), ("f", "other", 60, 10, "none", 1, ["$x"]), ("g", "st", 9, 4, "set", 1, ["$y"]),
    ]
    got = flow.prepared_bindings(spark.createDataFrame(p, "scope string, name string, at long, start int, code string, table string, fields array<string>"), spark.createDataFrame(s, "scope string, name string, at long, end int, code string, position int, expressions array<string>"))
    assert sorted(map(tuple, got.collect())) == [
        ("f", "$a", "posts", "owner", 9, 10, "prep b\nset b"), ("f", "$a", "users", "id", 1, 2, "prep a\nset 1"), ("f", "$b", "users", "id", 1, 2, "prep a\nset 1"),
        ("f", "$c", "users", "role", 1, 3, "prep a\nset 2"), ("f", "$d", "users", "role", 1, 3, "prep a\nagain"), ("g", "$y", "t", "x", 1, 4, "set"),
    ]


def is_state(v):
    return v.replace(" ", "").upper().split("[")[0] in ("$_SESSION", "$_COOKIE")


def from_alias(v, aliases):
    return any(v == a or v.startswith((a + "[", a + "->")) for a in aliases)


def predicates_by_loop(assignments, returns):
    carriers, boolean = set(), {"return true;", "return $a === 1;", "return (isset($a));", "return !empty($a);"}
    while True:
        found = set()
        for f in {r[0] for r in returns}:
            aliases = set()
            for _, _, left, right, calls in sorted((a for a in assignments if a[0] == f), key=lambda a: a[1]):
                if any(is_state(v) or from_alias(v, aliases) for v in right) or carriers & {c.lower() for c in calls}:
                    aliases |= set(left)
            if any(is_state(v) or from_alias(v, aliases) for r in returns if r[0] == f for v in r[2]):
                found.add(f.lower())
        if found == carriers:
            return sorted(f for f in carriers if all(r[1] in boolean for r in returns if r[0].lower() == f))
        carriers = found


def test_session_predicates_equal_a_loop(spark):
    rng = random.Random(4)
    seen = set()
    for size in (3, 12, 30, 30, 30):
        fns = [f"fn{i}" for i in range(size)]
        value = lambda: rng.choice(["$a", "$b", "$c", "$a['x']", "$b->c[0]", "$ab", "$_POST", "$_SERVER['x']"])
        assignments = [(f, at, [rng.choice(["$a", "$b", "$c", "$b->c"])], [value() for _ in range(rng.randrange(0, 2))] + (["$_session[ 'u' ]"] if rng.random() < 0.06 else []), [rng.choice(fns).upper()] if rng.random() < 0.3 else []) for f in fns for at in range(rng.randrange(0, 5))]
        returns = [(f, rng.choice(["return true;", "return $a === 1;", "return (isset($a));", "return !empty($a);"] * 4 + ["return $a;"]), [value()] if rng.random() < 0.9 else ["$_COOKIE"]) for f in fns for _ in range(rng.randrange(0, 3))]
        got = flow.session_predicates(spark.createDataFrame(assignments, "function string, at int, left array<string>, right array<string>, calls array<string>"), spark.createDataFrame(returns, "function string, code string, variables array<string>"))
        want = predicates_by_loop(assignments, returns)
        assert sorted(r.function for r in got.collect()) == want
        seen.add(len(want))
    assert max(seen) > 4


def test_session_predicates_of_cycles_and_nothing(spark):
    a, r = "function string, at int, left array<string>, right array<string>, calls array<string>", "function string, code string, variables array<string>"
    assignments = [("f", 0, ["$x"], [], ["g"]), ("g", 0, ["$y"], [], ["f"]), ("h", 0, ["$z"], ["$_SESSION"], []), ("late", 1, ["$a"], ["$b"], []), ("late", 2, ["$b"], ["$_COOKIE['c']"], []), ("mute", 0, ["$a"], ["$_SESSION"], [])]
    returns = [("f", "return $x == 1;", ["$x"]), ("g", "return $y == 1;", ["$y"]), ("h", "return $z['a'] == 2;", ["$z['a']"]), ("late", "return $a == 1;", ["$a"]), (None, "return true;", ["$_SESSION"])]
    assert [x.function for x in flow.session_predicates(spark.createDataFrame(assignments, a), spark.createDataFrame(returns, r)).collect()] == ["h"]
    assert flow.session_predicates(spark.createDataFrame([], a), spark.createDataFrame([], r)).count() == 0


def test_boolean_returns(spark):
    texts = {"return true;": True, "return ( FALSE ) ;": True, "return isset($a);": True, "return ! empty ($a);": True, "$a <= 2": True, "return $a;": False, "return !$a;": False, "return f($a);": False, "": False, "return;": False}
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r.t: r.b for r in df.select("t", names.boolean_return(F.col("t")).alias("b")).collect()} == texts


def test_earliest_places_on_a_long_chain(spark):
    """More rounds than are kept side by side."""
    n = 40
    edges = spark.createDataFrame([(f"n{i}", 100, f"n{i + 1}", i) for i in range(n)] + [("n5", 3, "x", 1), ("n0", 0, "y", 1)], "`from` string, before int, `to` string, to_at int")
    got = {r.node: r.at for r in graph.earliest(edges, spark.createDataFrame([("n0", 0)], "node string, at int")).collect()}
    assert got == {"n0": 0, **{f"n{i + 1}": i for i in range(n)}}
