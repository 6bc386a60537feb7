"""Operators whose cost goes by their rows, not by pairs, and whose tasks hold a share."""

import random

from pyspark.sql import functions as F
from wardline.operators import graph, repair


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_edges_are_dealt_before_they_are_folded(spark):
    d = spark.createDataFrame([("a", "b"), ("a", "c"), (None, "b")], "`from` string, `to` string")
    h = spark.createDataFrame([("a", "b"), ("a", "d"), ("a", "d")], "`from` string, `to` string")
    out = graph.edge_kinds(d, h)
    rows = [(r["from"], r["to"], r["kind"]) for r in out.collect()]
    assert sorted(rows, key=str) == sorted([("a", "b", "dependency"), ("a", "c", "dependency"), (None, "b", "dependency"), ("a", "d", "http")], key=str)
    out = graph.edge_kinds(d, h)
    assert plan(out).count("Exchange hashpartitioning") == 1 and "REPARTITION_BY_NUM" in plan(out)


def test_covered_counts_an_id_once_whatever_its_rows(spark):
    rng = random.Random(5)
    names = ["a/1", "/a/2", "a/x?q=1", "b/7/", "b", None]
    rows = [(i % 25, rng.choice("uvw"), rng.choice(names), [rng.choice(names)] if i % 3 else None, rng.choice(["GET", "POST", None]), i) for i in range(90)]
    v = spark.createDataFrame([*rows, *rows[:9]], "id int, category string, page string, page_overrides array<string>, operation string, ord int")
    items = spark.createDataFrame([(c, p, i) for i, (c, p) in enumerate((c, p) for c in "uvx" for p in ("a/1", "a/9", "b/7", "b", "zz"))], "category string, page string, ord int")
    found = items.select("category", "page", F.lit("vulnerable").alias("status"))
    out = {(r.category, r.page): (r.covered_findings, r.attack_vectors, list(r.operations)) for r in repair.covered(items, found, v).collect()}
    spell = {p: set(s) for p, s in spark.createDataFrame([(n,) for n in {*names, "a/9", "b/7", "zz"} if n], "p string").select("p", repair.page_candidates(F.col("p"))).collect()} | {None: set()}
    for (c, p), got in out.items():
        met = {}
        for i, vc, page, more, op, o in rows:
            if vc == c and spell[p] & set().union(*(spell[x] for x in [page, *(more or [])])):
                met.setdefault(i, []).append((op, o))
        uses = {}
        for found_ in met.values():
            op = min((x for x, _ in found_ if x is not None), default=None)
            uses.setdefault(op, []).append(min(o for _, o in found_))
        first = sorted((min(o), op or "") for op, o in uses.items())
        assert got == (1, len(met), [op or None for _, op in first])


def test_vectors_of_equal_pages_meet_the_items_as_one(spark):
    v = spark.range(300).select("id", F.lit("u").alias("category"), F.lit("a/1").alias("page"), F.lit(None).cast("array<string>").alias("page_overrides"), F.lit("GET").alias("operation"), F.col("id").alias("ord"))
    items = spark.createDataFrame([("u", f"a/{i}", i) for i in range(20)], "category string, page string, ord int")
    out = repair.covered(items, items.withColumn("status", F.lit("vulnerable")), v)
    assert {r.attack_vectors for r in out.collect()} == {300}
    assert "Window" in plan(out)


def test_rounds_of_a_loop_deal_their_frontier_alone(spark, monkeypatch):
    """Edges are dealt by their beginning once, whatever the number of rounds, and are let go at the end."""
    plans = []
    save = graph.checkpointed
    monkeypatch.setattr(graph, "checkpointed", lambda df: plans.append(plan(df)) or save(df))
    n = 6
    chain = [(f"n{i}", 100, f"n{i + 1}", i) for i in range(n)]
    edges = spark.createDataFrame([*chain, *chain, (None, 5, "n0", 0), ("n0", None, "z", 0)], "`from` string, before int, `to` string, to_at int")
    starts = spark.createDataFrame([("n0", 1), ("n0", 0), (None, 3)], "node string, at int")
    assert {r.node: r.at for r in graph.earliest(edges, starts).collect()} == {"n0": 0, None: 3, **{f"n{i + 1}": i for i in range(n)}}
    depths = {r.node: r.depth for r in graph.closure(edges.where("before IS NOT NULL"), starts.select("node")).collect()}
    assert depths == {None: 0, **{f"n{i}": i for i in range(n + 1)}}
    labelled = graph.labelled_closure(edges.where("before IS NOT NULL"), starts.select("node", F.lit("x").alias("label")))
    assert labelled.count() == n + 2
    again = [line for p in plans for line in p.splitlines() if "hashpartitioning(from" in line and "REPARTITION_BY_NUM" not in line]
    assert len(plans) > 3 * n and again == []
    assert not spark.sparkContext._jsc.getPersistentRDDs()
