"""Predictions against annotations: uniqueness, matching, scores, indexes, consistency."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import names
from . import graph
from .access import first_wins


def unique_expected(items: DataFrame, keys: list[str], order: str = "ord") -> DataFrame:
    """The first annotation of each normalised name, with its variants."""
    d = items.withColumn("key", names.normalized_name(F.col("name"))).where("key <> ''")
    return first_wins(d, [*keys, "key"], [order]).withColumn("variants", F.array_sort(F.array_union(names.name_variants(F.col("name")), F.array("key"))))


def unique_predicted(items: DataFrame, keys: list[str], order: str = "ord") -> DataFrame:
    """Predictions of one semantic key as one: the first spelling, and the union of aliases, paths and variants."""
    spelled = F.array_union(F.array("expression"), F.coalesce("aliases", F.expr("CAST(array() AS array<string>)")))
    d = items.withColumn("key", names.semantic_key(F.col("expression"))).where("key <> ''").withColumn("spelled", F.filter(spelled, lambda x: x.isNotNull() & (x != "")))
    variants = F.flatten(F.transform("spelled", lambda x: F.concat(names.name_variants(x), F.array(names.semantic_key(x)))))
    d = d.withColumn("variants", F.filter(variants, lambda x: x != ""))
    union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(c))))
    return d.groupBy(*keys, "key").agg(F.min_by("expression", order).alias("name"), union("spelled").alias("aliases"), F.array_sort(F.collect_set(F.when(F.col("path") != "", F.col("path")))).alias("paths"), union("variants").alias("variants"))


def greedy_match(expected: DataFrame, predicted: DataFrame, keys: list[str], most_rounds: int = 1000) -> DataFrame:
    """(keys, ord, name, prediction): each annotation, in order, takes the best prediction left in its group: equal name, then
    name among the variants, then common variants; the earlier of equals.

    Candidates meet by a common name, never as all pairs. Then rounds: every annotation without a prediction asks for the
    best one that has not turned it down, and a prediction keeps the earliest that asks, whoever held it before. All
    predictions rank annotations alike, so that the outcome is the one of taking turns, though no group is ever in one
    place. Names of one group at one place in the order go by name."""
    group = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"})
    no = F.expr("CAST(array() AS array<string>)")
    e = expected.select(*keys, group.alias("g"), F.struct(F.col("ord").cast("long").alias("ord"), "name").alias("a"), F.col("key").alias("ekey"), F.coalesce("variants", no).alias("evariants"))
    p = predicted.select(group.alias("g"), F.struct(F.col("ord").cast("long").alias("ord"), "name").alias("p"), names.normalized_name(F.col("name")).alias("pkey"), F.coalesce("variants", no).alias("pvariants"))
    e = graph.checkpointed(e)
    said = lambda key, variants: F.explode(F.array_distinct(F.array_append(F.col(variants), F.col(key)))).alias("said")
    met = e.drop(*keys).select("*", said("ekey", "evariants")).join(p.select("*", said("pkey", "pvariants")), ["g", "said"])
    tier = F.when(F.col("pkey") == F.col("ekey"), 0).when(F.array_contains("pvariants", F.col("ekey")), 1).when(F.arrays_overlap("pvariants", "evariants"), 2)
    pairs = graph.checkpointed(met.select("g", "a", "p", tier.alias("tier")).where("tier IS NOT NULL").distinct())
    held = pairs.limit(0)
    for _ in range(most_rounds):
        asks = pairs.join(held, ["g", "a"], "left_anti").groupBy("g", "a").agg(F.min(F.struct("tier", "p")).alias("x")).select("g", "a", "x.p", "x.tier")
        asks = graph.checkpointed(asks)
        if not asks.take(1):
            break
        both = held.unionByName(asks)
        kept = graph.checkpointed(both.groupBy("g", "p").agg(F.min(F.struct("a", "tier")).alias("x")).select("g", "x.a", "p", "x.tier"))
        lost = both.join(kept, ["g", "a", "p"], "left_anti").select("g", "a", "p")
        pairs, held = graph.checkpointed(pairs.join(lost, ["g", "a", "p"], "left_anti")), kept
    else:
        raise RuntimeError("matching did not settle")
    return e.join(held.select("g", "a", F.col("p.name").alias("prediction")), ["g", "a"], "left").select(*keys, "a.ord", "a.name", "prediction")


def scores(counts: DataFrame, key: str, total: str = "TOTAL") -> DataFrame:
    """Precision and recall of (key, tp, fp, fn) by key and over all; 0 where there is nothing to divide by."""
    r = counts.rollup(key).agg(F.grouping(key).alias("g"), *[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    ratio = lambda a, b: F.when(a + b > 0, a / (a + b)).otherwise(0.0)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return r.select(F.when(F.col("g") == 1, total).otherwise(F.col(key)).alias(key), "tp", "fp", "fn", ratio(tp, fp).alias("precision"), ratio(tp, fn).alias("recall"))


def entity_index(items: DataFrame, keys: list[str], lists: list[str], order: str) -> DataFrame:
    """One row an entity: how often it occurs, and the distinct values of other columns in order, joined by " | "."""
    merge = lambda c: F.array_join(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when((F.col(c).isNotNull()) & (F.col(c).cast("string") != ""), F.struct(F.col(order).alias("o"), F.col(c).cast("string").alias("v"))))), lambda x: x["v"])), " | ").alias(c)
    return items.groupBy(*keys).agg(F.count("*").alias("occurrences"), *map(merge, lists))


def consistency(entities: DataFrame, snippets: DataFrame, minimal: DataFrame) -> DataFrame:
    """(problem, item) rows of what breaks the chain from ``entities`` (id) over ``snippets`` (path, code, ids) to ``minimal``
    (path, code): ids nobody declared, entities without a snippet, snippets that were lost, came twice or are not of a snippet."""
    used = snippets.select(F.explode("ids").alias("id")).distinct()
    whole = snippets.select("path", F.sha2("code", 256).alias("digest")).distinct()
    small = minimal.select("path", F.sha2("code", 256).alias("digest"))
    row = lambda d, name, item: d.select(F.lit(name).alias("problem"), item.cast("string").alias("item"))
    at = F.concat_ws(":", "path", F.substring("digest", 1, 12))
    return (
        row(used.join(entities.select("id"), "id", "left_anti"), "unknown id", F.col("id"))
        .union(row(entities.select("id").join(used, "id", "left_anti"), "uncovered id", F.col("id")))
        .union(row(whole.join(small, ["path", "digest"], "left_anti"), "lost snippet", at))
        .union(row(small.groupBy("path", "digest").count().where("count > 1"), "duplicated snippet", at))
        .union(row(small.join(whole, ["path", "digest"], "left_anti").distinct(), "foreign snippet", at))
    )
