"""Graph algebra. Loops run to a fixpoint over frontiers; each round is checkpointed to shared storage."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage through the session's checkpoint folder; a local one is set where there is none, as in tests."""
    context = df.sparkSession.sparkContext
    local = context.master == "local" or context.master.startswith("local[")
    if not local and not df.sparkSession.conf.get("spark.checkpoint.dir", None) and context._jsc.sc().getCheckpointDir().isEmpty():
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not df.sparkSession.conf.get("spark.checkpoint.dir", None) and context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="wardline-"))
    return df.checkpoint()


def degrees(edges: DataFrame) -> DataFrame:
    """(node, in_degree, out_degree), parallel edges counted; one shuffle of partial sums."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("from").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("to").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("x"))
    return ends.select("x.*").where("node <> ''").groupBy("node").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))


def edge_kinds(dependency: DataFrame, http: DataFrame) -> DataFrame:
    """Dependency edges and the http edges that are not among them, labelled. A single aggregation instead of a set difference.

    Edges are dealt by their beginning before they meet, so that no task folds all that it reads, and counts by beginnings
    need no further shuffle; the number of tasks is explicit, since a hash table holds many times the bytes of a shuffle."""
    both = dependency.select("from", "to", F.lit("dependency").alias("kind")).union(http.select("from", "to", F.lit("http")))
    n = int(both.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return both.repartition(n, "from").groupBy("from", "to").agg(F.min("kind").alias("kind"))


def node_origins(tagged: DataFrame) -> DataFrame:
    """(node, origins) of (node, origin) rows, origins sorted."""
    return tagged.groupBy("node").agg(F.array_sort(F.collect_set("origin")).alias("origins"))


#: Rounds whose additions are kept side by side before they are written as one table: no round rewrites what others found.
SIDE_BY_SIDE = 16


def _grown(seen: DataFrame, more: DataFrame, number: int) -> DataFrame:
    out = seen.unionByName(more)
    return out if number % SIDE_BY_SIDE else checkpointed(out)


@contextmanager
def kept(edges: DataFrame) -> Iterator[DataFrame]:
    """Distinct edges of a loop, dealt and sorted by their beginning once and held on the disks of the executors till it ends: a
    round deals its frontier alone. The share of a lost executor is read and dealt again."""
    n = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = edges.repartition(n, "from").distinct().sortWithinPartitions("from").persist(StorageLevel.DISK_ONLY)
    try:
        held.count()  # a plan knows how held rows are dealt once they are there
        yield held
    finally:
        held.unpersist()


def earliest(edges: DataFrame, starts: DataFrame, most_rounds: int = 1000) -> DataFrame:
    """(node, at): the least place from which each node holds. ``starts`` has node and at; an edge (from, before, to, to_at)
    passes on what holds before its place: its end holds from ``to_at``. A round looks at the nodes whose place the last
    one lowered. Starts lie among the edges, with no place, so that what both are made from is read once."""
    begun = starts.select(F.col("node").alias("from"), F.lit(None).cast("long").alias("before"), F.col("node").alias("to"), F.col("at").alias("to_at"))
    with kept(edges.where("`from` IS NOT NULL AND before IS NOT NULL").select("from", "before", "to", "to_at").union(begun)) as edges:
        seen = frontier = checkpointed(edges.where("before IS NULL").groupBy(F.col("to").alias("node")).agg(F.min("to_at").alias("at")))
        for depth in range(1, most_rounds + 1):
            step = frontier.join(edges.hint("merge"), F.col("node") == F.col("from")).where("at < before").groupBy(F.col("to").alias("node")).agg(F.min("to_at").alias("at"))
            best = seen.groupBy("node").agg(F.min("at").alias("was"))
            frontier = checkpointed(step.join(best, "node", "left").where("was IS NULL OR at < was").select("node", "at"))
            if not frontier.take(1):
                return seen.groupBy("node").agg(F.min("at").alias("at"))
            seen = _grown(seen, frontier, depth)
    raise RuntimeError("earliest places did not settle")


def closure(edges: DataFrame, starts: DataFrame, most_rounds: int = 1000) -> DataFrame:
    """(node, depth): everything reachable from ``starts`` (node), with the fewest steps. Each round joins the frontier only,
    and drops what was seen, so cycles end."""
    seen = frontier = checkpointed(starts.select("node").distinct().withColumn("depth", F.lit(0)))
    with kept(edges.where("`from` IS NOT NULL").select("from", "to")) as edges:
        for depth in range(1, most_rounds + 1):
            step = frontier.join(edges.hint("merge"), F.col("node") == F.col("from")).select(F.col("to").alias("node")).distinct()
            frontier = checkpointed(step.join(seen, "node", "left_anti").withColumn("depth", F.lit(depth)))
            if not frontier.take(1):
                return seen
            seen = _grown(seen, frontier, depth)
    raise RuntimeError("closure did not settle")


def components(pairs: DataFrame, most_rounds: int = 200) -> DataFrame:
    """(node, component): the least node of each connected component of (a, b) pairs.

    Rounds of hanging larger neighbours, then smaller ones, on the least neighbour: edges turn into stars in about
    log(n) rounds, also on long chains."""
    edge = lambda d: d.where("u <> v").distinct()
    e = edge(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")))
    alone = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    e, last = checkpointed(e), None
    for _ in range(most_rounds):
        both = e.union(e.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = edge(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        e = checkpointed(edge(large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least).select("u", "v")))
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == last:
            break
        last = now
    else:
        raise RuntimeError("components did not settle")
    return alone.join(e, alone["node"] == e["u"], "left").select("node", F.coalesce("v", "node").alias("component"))


def fixpoint(seeds: DataFrame, calls: DataFrame, gate: DataFrame, most_rounds: int = 1000) -> DataFrame:
    """Functions that count as validated: ``seeds`` (name), and then every caller in ``gate`` (name) that calls a validated one;
    ``calls`` has caller and callee. Semi-naive: a round joins what the last one added. Adds the round as ``depth``."""
    relevant = checkpointed(calls.join(gate.select(F.col("name").alias("caller")), "caller", "left_semi").select("caller", "callee").distinct())
    return closure(relevant.select(F.col("callee").alias("from"), F.col("caller").alias("to")), seeds.select(F.col("name").alias("node")), most_rounds).withColumnRenamed("node", "name")


def chain_of_flags(branches: DataFrame, most_rounds: int = 1000) -> DataFrame:
    """Branches that deny in the end: ``branches`` has id, start, sets, tests, denies; a branch that sets a flag denies if a later
    branch of the scope that tests the flag does. Adds ``denies_by``, the round in which that was found (0 for its own).

    Of the branches found in a round that test one flag, the last decides for all that set it: a round joins one row for
    each (scope, flag), so that pairs of branches are never listed."""
    b = checkpointed(branches.select("scope", "id", "start", "sets", "tests", "denies"))
    found = frontier = checkpointed(b.where("denies").select("scope", "id", "start", "tests").withColumn("denies_by", F.lit(0)))
    open_ = checkpointed(b.where("NOT coalesce(denies, false)"))
    for depth in range(1, most_rounds + 1):
        last = frontier.groupBy("scope", F.col("tests").alias("sets")).agg(F.max("start").alias("last"))
        frontier = checkpointed(open_.join(last, ["scope", "sets"]).where("start < last").select("scope", "id", "start", "tests", F.lit(depth).alias("denies_by")))
        if not frontier.take(1):
            return b.select("scope", "id").join(found.select("id", "denies_by"), "id", "left").select("scope", "id", "denies_by")
        found = _grown(found, frontier, depth)
        open_ = checkpointed(open_.join(frontier.select("id"), "id", "left_anti"))
    raise RuntimeError("chain of flags did not settle")


def labelled_closure(edges: DataFrame, starts: DataFrame, most_rounds: int = 1000) -> DataFrame:
    """(node, label) reachable from labelled starts (node, label). The frontier alone is joined; a pair seen before is dropped."""
    seen = frontier = checkpointed(starts.select("node", "label").distinct())
    with kept(edges.where("`from` IS NOT NULL").select("from", "to")) as edges:
        for depth in range(1, most_rounds + 1):
            step = frontier.join(edges.hint("merge"), F.col("node") == F.col("from")).select(F.col("to").alias("node"), "label").distinct()
            frontier = checkpointed(step.join(seen, ["node", "label"], "left_anti"))
            if not frontier.take(1):
                return seen
            seen = _grown(seen, frontier, depth)
    raise RuntimeError("labelled closure did not settle")
