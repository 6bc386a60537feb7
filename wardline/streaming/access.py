"""The access matrix kept up to date from a stream of crawl events (an addition: the batch operators stand alone)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StringType, StructField, StructType


def page_kinds(events: DataFrame) -> DataFrame:
    """Per page the kinds and number of visits; state is one row a page, for complete or update mode."""
    flag = lambda k: F.max((F.col("kind") == k).cast("int")).alias(k)
    return events.groupBy("page").agg(flag("admin"), flag("user"), flag("visitor"), F.count("*").alias("visits"))


def windowed_visits(events: DataFrame, delay: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Visits by window and kind in append mode; rows later than the delay are left out and their windows' state is dropped."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", width), "kind").agg(F.count("*").alias("visits"), F.approx_count_distinct("page").alias("pages"))


def upgraded_requests(requests: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``operators.access.request_upgrade`` over a stream whose batches come in order, in update mode: the state of a key is the
    request kept so far and how many were seen, so that the last row of a key is what the batch operator gives."""
    fields = [f for f in requests.schema if f.name in keys]
    schema = StructType([*sorted(fields, key=lambda f: keys.index(f.name)), StructField("method", StringType()), StructField("n_params", LongType()), StructField("seen", LongType())])

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        method, n, seen = state.get if state.exists else (None, 0, 0)
        rows = pd.concat(list(frames)).sort_values([*order, "method", "n_params"])
        for m, k in zip(rows["method"].str.upper(), rows["n_params"], strict=True):
            if not seen or method == "GET" != m or not n and k > 0:
                method, n = m, int(k)
            seen += 1
        state.update((method, n, seen))
        yield pd.DataFrame([(*key, method, n, seen)], columns=schema.names)

    return requests.groupBy(*keys).applyInPandasWithState(fold, schema, "method string, n_params long, seen long", "update", GroupStateTimeout.NoTimeout)


def upsert(target: str):
    """A ``foreachBatch`` sink that replaces a batch's output when the batch is run again."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return write
