"""Summaries of findings, repairs, runs and their costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CATEGORIES = ("admin_only", "authenticated_only", "horizontal", "vertical", "static_only")


def findings_summary(findings: DataFrame) -> DataFrame:
    return findings.agg(F.count_if(F.col("status") == "vulnerable").alias("vulnerable"), (F.count("*") - F.count_if(F.col("status") == "vulnerable")).alias("not_vulnerable"), F.count("*").alias("total"))


def findings_report(findings: DataFrame, order: str = "ord") -> DataFrame:
    """Vulnerable findings by category and page: actors in order of first mention, and sorted confidences and evidence."""
    some = findings.where("status = 'vulnerable'")
    actors = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), "actor"))), lambda x: x["actor"]))
    return some.groupBy("category", "page").agg(actors.alias("actors"), F.array_sort(F.collect_set("confidence")).alias("confidence"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("evidence")))).alias("evidence"), F.count("*").alias("requests"))


def report_lines(report: DataFrame) -> DataFrame:
    """Markdown sections of a findings report, one row each, in order."""
    rank = F.array_position(F.array(*map(F.lit, CATEGORIES)), F.col("category"))
    text = F.concat(F.lit("### "), "page", F.lit("\n\n- Category: "), "category", F.lit("\n- Actors: "), F.array_join("actors", ", "), F.lit("\n- Confidence: "), F.array_join("confidence", ", "), F.lit("\n"), F.array_join(F.transform("evidence", lambda e: F.concat(F.lit("- "), e)), "\n"))
    return report.select(rank.alias("section"), "page", text.alias("markdown")).orderBy("section", "page")


def graph_counts(nodes: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """Nodes and edges by key, in one aggregation of both."""
    both = nodes.select(*keys, F.lit(1).alias("n"), F.lit(0).alias("e")).union(edges.select(*keys, F.lit(0), F.lit(1)))
    return both.groupBy(*keys).agg(F.sum("n").alias("nodes"), F.sum("e").alias("edges"))


def repair_summary(attempts: DataFrame, item: str = "item") -> DataFrame:
    """Counts over (item, attempt, syntax_ok, exploit_blocked, regression_passed, successful) rows, and at which attempt the
    items first succeeded."""
    first = F.min(F.when(F.col("successful"), F.col("attempt")))
    by = attempts.groupBy(item).agg(F.count("*").alias("attempts"), *[F.count_if(F.col(c)).alias(c) for c in ("syntax_ok", "exploit_blocked", "regression_passed")], first.alias("first"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return by.agg(F.count("*").alias("items"), total("attempts"), total("syntax_ok"), total("exploit_blocked"), total("regression_passed"), F.count("first").alias("successful"), *[F.count_if(F.col("first") == i).alias(f"first_try_{i}") for i in (1, 2, 3)])


def coverage(items: DataFrame, findings: DataFrame, vectors: DataFrame, keys: list[str]) -> DataFrame:
    """Per repair item: vulnerable findings, attack vectors and distinct operations, each side reduced before it is joined."""
    f = findings.where("status = 'vulnerable'").groupBy(*keys).agg(F.count("*").alias("covered_findings"))
    v = vectors.groupBy(*keys).agg(F.count("*").alias("attack_vectors"), F.array_sort(F.collect_set("operation")).alias("operations"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return items.join(f, keys, "left").join(v, keys, "left").select(*items.columns, zero("covered_findings"), zero("attack_vectors"), F.coalesce("operations", F.expr("CAST(array() AS array<string>)")).alias("operations"))


def rounded(metric: Column) -> Column:
    return F.round(metric, 6)


def merged_total(old_total: Column, old_parts: list[Column], new_parts: list[Column]) -> Column:
    """A run's total after some stages ran again: without their old seconds, not below 0, with the new ones."""
    clamp = lambda c: F.greatest(F.coalesce(c, F.lit(0.0)), F.lit(0.0))
    rest = clamp(old_total)
    for p in old_parts:
        rest = rest - clamp(p)
    out = F.greatest(rest, F.lit(0.0))
    for p in new_parts:
        out = out + clamp(p)
    return out


def model_costs(calls: DataFrame, keys: list[str], per_million_in: float, per_million_out: float) -> DataFrame:
    """Requests, tokens and cost of model calls."""
    cost = (F.sum("tokens_in") * per_million_in + F.sum("tokens_out") * per_million_out) / 1e6
    return calls.groupBy(*keys).agg(F.count("*").alias("requests"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), (F.sum("tokens_in") + F.sum("tokens_out")).alias("tokens_total"), cost.alias("cost"))


def phase_passed(scenarios: DataFrame, item: str, phase: str) -> DataFrame:
    """Whether every scenario of an item has the phase and passed it without an error. ``scenarios``: item, scenario, phase, passed, error."""
    own = (F.col("phase") == phase) & F.col("passed") & F.col("error").isNull()
    by = scenarios.groupBy(item, "scenario").agg(F.coalesce(F.bool_or(F.when(F.col("phase") == phase, own)), F.lit(False)).alias("good"), F.coalesce(F.bool_and(F.when(F.col("phase") == phase, own)), F.lit(False)).alias("all"))
    return by.groupBy(item).agg(F.bool_and(F.col("good") & F.col("all")).alias("passed"))


def combined_verdicts(items: DataFrame, validation: DataFrame, item: str) -> DataFrame:
    """exploit_blocked and regression_passed of ``items`` (item, exploit_response, regression_response, database_primary) with the
    database's word; an item no rule covers passes and is marked as not applied."""
    j = items.join(validation.select(item, F.col("exploit").alias("db_exploit"), F.col("regression").alias("db_regression")), item, "left")
    both = lambda db, response: F.coalesce(db, F.lit(True)) & (F.col(response) | (F.col("database_primary") & db.isNotNull()))
    return j.select(*items.columns, F.col("db_exploit").isNotNull().alias("applied"), both(F.col("db_exploit"), "exploit_response").alias("exploit_blocked"), both(F.col("db_regression"), "regression_response").alias("regression_passed"))


VOLATILE = r"^(--|/\*|\s*$)"


def dumps_differ(left: DataFrame, right: DataFrame, volatile: str = VOLATILE) -> DataFrame:
    """(line, surplus) of two dumps (line) without volatile lines: how many more the left has. One aggregation of both sides."""
    side = lambda d, n: d.where(~F.rlike("line", F.lit(volatile))).select("line", F.lit(n).alias("n"))
    return side(left, 1).union(side(right, -1)).groupBy("line").agg(F.sum("n").alias("surplus")).where("surplus <> 0")


def assertions(checks: DataFrame) -> DataFrame:
    """Adds ``passed`` to checks (kind, actual, expected): contains, not_contains, equals, not_equals, zero, nonzero. An unknown
    kind fails the job."""
    a, e = F.coalesce("actual", F.lit("")), F.coalesce("expected", F.lit(""))
    zero = F.trim(a).isin("", "0")
    test = F.when(F.col("kind") == "contains", F.contains(a, e)).when(F.col("kind") == "not_contains", ~F.contains(a, e)).when(F.col("kind") == "equals", F.trim(a) == F.trim(e)).when(F.col("kind") == "not_equals", F.trim(a) != F.trim(e)).when(F.col("kind") == "zero", zero).when(F.col("kind") == "nonzero", ~zero)
    return checks.withColumn("passed", test.otherwise(F.raise_error(F.concat(F.lit("unknown check "), F.coalesce("kind", F.lit("null")))).cast("boolean")))
