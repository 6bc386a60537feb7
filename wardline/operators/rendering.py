"""Reports as ordered text: sections of any size, numbered and written by ranges, never sorted in one task.

A report is rows (section, place, *keys, markdown); its order is by section, place and keys. Files of a written report
bear numbers in that order, so that they are the report when they are read one after another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import graph
from .repair import full_summary
from .reporting import findings_summary


def ordered(df: DataFrame, order: list[str]) -> DataFrame:
    """The rows dealt by ranges of their order and sorted within each."""
    return df.repartitionByRange(*order).sortWithinPartitions(*order)


def numbered(df: DataFrame, order: list[str], name: str = "row") -> DataFrame:
    """Adds the place of each row in the whole order, from 1. Ranges number their own rows; what the ranges before hold comes
    from one row a range. Rows of equal keys come in any order."""
    mask = (1 << 33) - 1
    some = graph.checkpointed(ordered(df, order)).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit(mask)))
    some = graph.checkpointed(some)
    sizes = some.groupBy("_part").agg(F.count("*").alias("n"))
    before = sizes.select("_part", (F.sum("n").over(Window.orderBy("_part")) - F.col("n")).alias("before"))  # a row a range
    return some.join(F.broadcast(before), "_part").withColumn(name, F.col("before") + F.col("_at") + 1).drop("_part", "_at", "before")


def written(report: DataFrame, order: list[str], path: str) -> None:
    """One text file a range, their names in order."""
    ordered(report, order).select("markdown").write.text(path)


ORDER = ["section", "place", "category", "page"]


def _bullets(*lines: tuple[str, Column]) -> Column:
    return F.array(*[F.concat(F.lit(f"- {label}: "), value) for label, value in lines])


def findings_sections(findings: DataFrame, order: str = "ord") -> DataFrame:
    """(section, place, category, page, markdown): figures, then confirmed findings and the others, each by category and page
    with actors and statuses in order of mention, and sorted confidences, evidence and errors. ``findings`` has category,
    page, actor, status, confidence, evidence, and may have http_status and error. A section without rows says so."""
    yes = F.col("status") == "vulnerable"
    has = lambda c: F.col(c).cast("string") if c in findings.columns else F.lit(None).cast("string")
    f = findings.select(F.when(yes, 1).otherwise(2).alias("section"), "category", "page", "actor", "confidence", "evidence", has("http_status").alias("http"), has("error").alias("error"), F.col(order).alias("o"))
    # repeats are gone before lists are made
    keys = ["section", "category", "page"]
    said = f.select(*keys, "o", F.explode(F.array(F.struct(F.lit("actor").alias("k"), F.col("actor").alias("v")), F.struct(F.lit("confidence").alias("k"), F.col("confidence").alias("v")), F.struct(F.lit("status").alias("k"), F.col("http").alias("v")), F.struct(F.lit("error").alias("k"), F.nullif("error", F.lit("")).alias("v")))).alias("x"))
    said = said.select(*keys, "o", "x.k", "x.v").union(f.select(*keys, "o", F.lit("evidence"), F.explode("evidence"))).where("v IS NOT NULL")
    once = said.groupBy(*keys, "k", "v").agg(F.min("o").alias("o"))
    listed = lambda k, by: F.transform(F.array_sort(F.collect_list(F.when(F.col("k") == k, F.struct(*by, "v")))), lambda x: x["v"])
    each = once.groupBy(*keys).agg(*[listed(k, by).alias(k) for k, by in (("actor", ["o"]), ("status", ["o"]), ("confidence", []), ("evidence", []), ("error", []))])
    joined = lambda c: F.array_join(c, ", ")
    body = F.concat(
        _bullets(("Category", F.col("category")), ("Actors", joined("actor"))), F.when(F.size("status") > 0, _bullets(("HTTP status", joined("status")))).otherwise(F.expr("CAST(array() AS array<string>)")),
        _bullets(("Confidence", joined("confidence"))), F.transform("evidence", lambda e: F.concat(F.lit("- Evidence: "), e)), F.transform("error", lambda e: F.concat(F.lit("- Error: "), e)),
    )
    items = each.select("section", F.lit(1).alias("place"), "category", "page", F.concat(F.lit("### `"), "page", F.lit("`\n\n"), F.array_join(body, "\n"), F.lit("\n")).alias("markdown"))
    counts = findings_summary(findings)
    row = lambda section, text: F.struct(F.lit(section).alias("section"), text.alias("markdown"))
    titled = lambda title, n: F.concat(F.lit(f"## {title}\n"), F.when(n == 0, F.lit("\nNone.\n")).otherwise(""))
    head = F.concat(F.lit("# Findings\n\n- Confirmed: "), F.col("vulnerable"), F.lit("\n- Not confirmed: "), F.col("not_vulnerable"), F.lit("\n"))
    heads = counts.select(F.explode(F.array(row(0, head), row(1, titled("Confirmed", F.col("vulnerable"))), row(2, titled("Not confirmed", F.col("not_vulnerable"))))).alias("x"))
    return heads.select("x.section", F.lit(0).alias("place"), F.lit("").alias("category"), F.lit("").alias("page"), "x.markdown").union(items)


#: Labels of a repair run's figures, in order.
FIGURES = [
    ("items", "Repair items"), ("covered_findings", "Covered findings"), ("attack_vectors", "Attack vectors"), ("attempts", "Attempts"), ("generation_attempts", "Generation attempts"), ("patches_generated", "Patches generated"), ("failed_patches", "Failed patches"),
    ("syntax_ok", "Syntax right"), ("exploit_blocked", "Exploit blocked"), ("regression_passed", "Regression passed"), ("database_applied", "Database validation applied"), ("database_passed", "Database validation passed"), ("successful", "Successful"), ("failed_repairs", "Failed"),
    ("first_try_1", "Successful on attempt 1"), ("first_try_2", "Successful on attempt 2"), ("first_try_3", "Successful on attempt 3"),
]


def repair_sections(items: DataFrame, attempts: DataFrame) -> DataFrame:
    """(section, ord, markdown): the figures of a repair run, then its items in order, each with its attempts. ``items`` as for
    ``repair.full_summary`` and ord, page, category, status, message; ``attempts`` too, with message. Figures of coverage are
    left out where no item has any."""
    text = F.lit("# Repairs\n")
    for name, label in FIGURES:
        text = F.concat(text, F.when(F.col(name).isNotNull(), F.concat(F.lit(f"\n- {label}: "), F.col(name))).otherwise(""))
    heads = full_summary(items, attempts).select(F.lit(0).alias("section"), F.lit(0).cast("long").alias("ord"), F.concat(text, F.lit("\n\n## Details\n"), F.when(F.col("items") == 0, F.lit("\nNo repairs.\n")).otherwise("")).alias("markdown"))
    line = F.concat(F.lit("  - Attempt "), "attempt", F.lit(": "), F.when(F.col("successful"), "successful").otherwise("failed"), F.coalesce(F.concat(F.lit("; "), "message"), F.lit("")))
    tries = attempts.groupBy("item").agg(F.transform(F.array_sort(F.collect_list(F.struct("attempt", line.alias("t")))), lambda x: x["t"]).alias("tries"))  # as many as a retry budget
    met = items.join(tries, "item", "left")
    body = F.concat(_bullets(("Category", F.col("category")), ("Status", F.col("status")), ("Successful", F.coalesce("successful", F.lit(False)).cast("string")), ("Message", F.coalesce("message", F.lit("")))), F.coalesce("tries", F.expr("CAST(array() AS array<string>)")))
    each = met.select(F.lit(1).alias("section"), F.col("ord").cast("long").alias("ord"), F.concat(F.lit("### `"), "page", F.lit("`\n\n"), F.array_join(body, "\n"), F.lit("\n")).alias("markdown"))
    return heads.union(each)
