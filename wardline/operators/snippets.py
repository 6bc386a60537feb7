"""Snippets for review: compaction, counts, ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.names import normalized_code
from .access import first_wins


def prefix_for(path: Column, code: Column, rules: list[tuple[str, str, str]]) -> Column:
    """Prefix of the first (path pattern, code pattern, prefix) rule that fits; empty without one."""
    out = F.lit("")
    for path_pattern, code_pattern, prefix in reversed(rules):
        test = F.lit(True)
        if path_pattern:
            test = test & F.rlike(path, F.lit(f"(?i){path_pattern}"))
        if code_pattern:
            test = test & F.rlike(code, F.lit(f"(?is){code_pattern}"))
        out = F.when(test, F.lit(prefix)).otherwise(out)
    return out


def compact(snippets: DataFrame, exclude_kinds: list[str] = (), exclude_code: list[str] = (), require_framework: bool = False, prefixes: list[tuple[str, str, str]] = (), order: str = "ord") -> DataFrame:
    """(path, field, code, ord): each file's distinct codes, the first of each; the bare branch instead of the whole code where a
    snippet has one. Rows are told apart by a digest, so long codes do not make the key of the shuffle."""
    s = snippets.where(~F.lower(F.trim(F.coalesce("kind", F.lit("")))).isin([k.strip().lower() for k in exclude_kinds])) if exclude_kinds else snippets
    frame, code = normalized_code(F.col("if_framework")), normalized_code(F.col("code"))
    s = s.select(F.regexp_replace(F.trim(F.coalesce("path", F.lit(""))), r"\\", "/").alias("path"), frame.alias("frame"), F.when(frame != "", frame).otherwise(code).alias("code"), F.col(order).alias("ord"))
    s = s.where((F.col("path") != "") & (F.col("code") != ""))
    if require_framework:
        s = s.where("frame <> ''")
    for p in exclude_code:
        s = s.where(~F.rlike("code", F.lit(f"(?is){p}")))
    if prefixes:
        before = prefix_for(F.col("path"), F.col("code"), list(prefixes))
        s = s.withColumn("code", F.when(before != "", F.concat(before, F.lit("\n"), F.col("code"))).otherwise(F.col("code")))
    s = s.withColumn("field", F.when(F.col("frame") != "", "if_framework").otherwise("code")).withColumn("digest", F.sha2("code", 256))
    return first_wins(s, ["path", "digest"], ["ord"]).select("path", "field", "code", "ord")


def compaction_counts(snippets: DataFrame, compacted: DataFrame) -> DataFrame:
    n = snippets.agg(F.count("*").alias("source_items"))
    m = compacted.agg(F.count("*").alias("llm_items"))
    both = n.select("source_items", F.lit(0).cast("long").alias("llm_items")).union(m.select(F.lit(0).cast("long"), "llm_items"))
    return both.agg(F.sum("source_items").alias("source_items"), F.sum("llm_items").alias("llm_items")).withColumn("items_removed", F.col("source_items") - F.col("llm_items"))


def keyword_score(text: Column, weights: list[tuple[str, int]]) -> Column:
    """Sum of the weights of the words a text holds."""
    out = F.lit(0)
    for word, weight in weights:
        out = out + F.when(F.contains(F.lower(text), F.lit(word.lower())), weight).otherwise(0)
    return out


def top_k(snippets: DataFrame, target: str, score: Column, k: int, order: list[str]) -> DataFrame:
    """The k best of each target, best first, ties in the given order. Spark's group limit cuts each task's rows before the
    shuffle."""
    w = W.partitionBy(target).orderBy(F.desc("score"), *order)
    return snippets.withColumn("score", score).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
