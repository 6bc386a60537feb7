"""Mixing sources to target weights, in DataFrame operations only.

Every row gets a hash-random key; the key's leading bits cut each source into ranges that are sorted by key, sums by
range give each range its offset, and a running sum inside the range completes the prefix sum. No source, however
large, is in one task: ranges are as many as the input needs.

Defined results: a null text has size 0; a null source is a source of its own, last in order; repeated rows count
each for itself; a null id is hashed as an empty string; an empty table gives an empty result; only the named columns
are read, so further columns and their names do not matter.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import n_words, stored

#: Rows for each range, about; leading bits at least and at most.
RANGE_ROWS, LEAST_BITS, MOST_BITS = 1000, 4, 16
KEY_BITS = 60


def random_key(id_col: str, salt: str) -> Column:
    """60 bits of md5, as a non-negative long; SQL engines agree on it."""
    return F.conv(F.substring(F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(f":{salt}"))), 1, 15), 16, 10).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = (1, 2, 3), share: float = 1.0, most: int = 3) -> DataFrame:
    """Add ``target`` to (source, source_size): weights repeat over sources in code point order, null last.

    The target is min(cap, weight * level) with cap = most * size; the level is where the targets add up to
    share * total, which is what resharing the excess by weight settles at. Its candidates come from running sums
    over the sources ordered by cap / weight. One row a source: the only unpartitioned windows, over aggregated rows.
    """
    order = W.orderBy(F.col("source").isNull(), "source")
    whole = W.partitionBy()
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    by_ratio = W.orderBy("ratio", F.col("source").isNull(), "source")
    return (
        sources.withColumn("weight", w)
        .withColumn("cap", F.lit(most) * F.col("source_size"))
        .withColumn("ratio", F.col("cap").cast("double") / F.col("weight"))
        .withColumn("before", F.sum("cap").over(by_ratio.rowsBetween(W.unboundedPreceding, 0)) - F.col("cap"))
        .withColumn("left", F.sum("weight").over(by_ratio.rowsBetween(0, W.unboundedFollowing)))
        .withColumn("total", F.sum("source_size").over(whole) * F.lit(share))
        .withColumn("level", (F.col("total") - F.col("before")).cast("double") / F.col("left"))
        .withColumn("level", F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(whole))
        .withColumn("target", F.least(F.col("cap").cast("double"), F.col("weight") * F.col("level")))
        .select("source", "source_size", "target")
    )


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), share: float = 1.0, most: int = 3, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", salt: str = "mix", keep: bool = False) -> DataFrame:
    """Per row: id, size, source, source_size, target, taken (words the mix takes of it, repeats counted).

    A source's budget is its target rounded down. Whole epochs of the source come first, then its rows in key order
    until the budget is spent; the last row is cut. ``keep`` adds the input row as struct ``row``.
    """
    sized = stored(
        docs.select(
            F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), n_words(text_col).alias("size"), random_key(id_col, salt).alias("k"),
            *([F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row")] if keep else []),
        ).withColumn("s", F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))),
        "sized",
    )
    bits = min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(max(1, sized.count()) / RANGE_ROWS))))
    ranged = sized.withColumn("bucket", F.shiftright("k", KEY_BITS - bits).cast("int"))
    sums = stored(ranged.groupBy("s", "source", "bucket").agg(F.sum("size").alias("in_bucket")), "sums")
    goal = targets(sums.groupBy("source").agg(F.sum("in_bucket").alias("source_size")), weights, share, most)
    goal = goal.withColumn("s", F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))).drop("source")
    ahead = F.sum("in_bucket").over(W.partitionBy("s").orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)) - F.col("in_bucket")
    offsets = sums.select("s", "bucket", ahead.alias("ahead")).join(goal, "s")
    here = W.partitionBy("s", "bucket").orderBy("k", "id", "size").rowsBetween(W.unboundedPreceding, 0)
    budget = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.expr("floor(target) div source_size")).otherwise(0)
    return (
        ranged.withColumn("before", F.sum("size").over(here) - F.col("size"))
        .join(offsets, ["s", "bucket"])
        .withColumn("before", F.col("before") + F.col("ahead"))
        .withColumn("epochs", epochs)
        .withColumn("rest", budget - F.col("epochs") * F.col("source_size"))
        .withColumn("taken", F.col("epochs") * F.col("size") + F.least(F.col("size"), F.greatest(F.lit(0), F.col("rest") - F.col("before"))))
        .select(F.col("id").alias(id_col), "source", "size", "source_size", "target", F.col("taken").cast("long").alias("taken"), *(["row"] if keep else []))
    )


def copies(mixed: DataFrame, columns: list[str], text_col: str = "text") -> DataFrame:
    """The mixed corpus itself: whole copies of each row, and the cut one with its first words joined by a space."""
    n = F.expr("CASE WHEN size = 0 THEN 0 ELSE taken div size END")
    rest = F.expr("CASE WHEN size = 0 THEN 0 ELSE taken % size END")
    some = mixed.select("row", n.cast("int").alias("n"), rest.cast("int").alias("rest"))
    copy = F.explode(F.expr("filter(array_append(array_repeat(0, n), rest), (x, i) -> i < n OR x > 0)"))
    words = F.array_join(F.slice(F.regexp_extract_all(F.col(f"row.{text_col}"), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)), 1, F.col("cut")), " ")
    out = some.where("n > 0 OR rest > 0").select("row", copy.alias("cut"))
    text = F.when(F.col("cut") > 0, words).otherwise(F.col(f"row.{text_col}"))
    return out.select(*[(text if c == text_col else F.length(text).cast("long") if c == "n_chars" else F.col(f"row.`{c}`")).alias(c) for c in columns])


def op8_query(spark, sf_dir):
    from .common import table

    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':mix'), 1, 15) AS BIGINT) AS k
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3) + 1 AS weight, 3 * source_size AS cap FROM s),
r AS (SELECT *, CAST(cap AS DOUBLE) / weight AS ratio FROM w),
b AS (SELECT *, sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS UNBOUNDED PRECEDING) - cap AS before,
             sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS left_w,
             sum(source_size) OVER () AS total FROM r),
l AS (SELECT *, CAST(total - before AS DOUBLE) / CAST(left_w AS DOUBLE) AS level FROM b),
t AS (SELECT source, source_size, least(CAST(cap AS DOUBLE), weight * max(CASE WHEN level <= ratio THEN level END) OVER ()) AS target FROM l),
p AS (SELECT d.doc_id, d.source, d.size, t.source_size, t.target,
             CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY k, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) - d.size AS BIGINT) AS before,
             CASE WHEN t.source_size > 0 THEN CAST(floor(t.target) AS BIGINT) // t.source_size ELSE 0 END AS epochs
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(epochs * size + least(size, greatest(0, CAST(floor(target) AS BIGINT) - epochs * source_size - before)) AS BIGINT) AS taken, source
FROM p
"""
