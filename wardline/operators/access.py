"""The access matrix and requests: who reached which page, and how."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import urls


def access_matrix(nodes: DataFrame, requests: DataFrame | None = None) -> DataFrame:
    """Per page: sorted roles and kinds, and its requests in role order. ``nodes`` has role, kind, page, role_ord; a node without
    a recorded request has none in the list. One shuffle on the page; lists are as long as there are roles."""
    if requests is None:
        joined = nodes.withColumn("req", F.struct("role", "kind", F.lit("GET").alias("method"), F.expr("map()").cast("map<string,string>").alias("params"), F.lit(None).cast("string").alias("referer")))
    else:
        right = requests.select("role", "page", F.struct("method", "params", "referer").alias("r"))
        joined = nodes.join(right, ["role", "page"], "left").withColumn("req", F.when(F.col("r").isNotNull(), F.struct("role", "kind", "r.method", "r.params", "r.referer")))
    # maps do not order: sort positions, then take the requests
    listed = F.array_compact(F.transform(F.array_sort(F.collect_list(F.struct("role_ord", "role", F.to_json("req").alias("j")))), lambda x: x["j"]))
    schema = "struct<role: string, kind: string, method: string, params: map<string,string>, referer: string>"
    return joined.groupBy("page").agg(F.array_sort(F.collect_set("role")).alias("roles"), F.array_sort(F.collect_set("kind")).alias("kinds"), F.transform(listed, lambda j: F.from_json(j, schema)).alias("requests"))


def edge_union(edges: DataFrame) -> DataFrame:
    return edges.select("from", "to").distinct()


def roles_of(requests: Column, kind: str) -> Column:
    """Roles of a kind, in order of their first request."""
    return F.array_distinct(F.transform(F.filter(requests, lambda r: (r["kind"] == kind) & r["role"].isNotNull()), lambda r: r["role"]))


def representative(requests: Column, kind: str | None = None) -> Column:
    """The first request of a kind, else the first, else a plain GET."""
    own = F.try_element_at(F.filter(requests, lambda r: r["kind"] == kind), F.lit(1)) if kind else F.lit(None)
    chosen = F.coalesce(own, F.try_element_at(requests, F.lit(1))) if kind else F.try_element_at(requests, F.lit(1))
    none = F.expr("map()").cast("map<string,string>")
    return F.struct(F.upper(F.coalesce(chosen["method"], F.lit("GET"))).alias("method"), F.coalesce(chosen["params"], none).alias("params"), chosen["referer"].alias("referer"))


def request_upgrade(requests: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The request kept for each key when they come in order: the first; a later one takes over if it brings a method other
    than GET to a GET, or parameters to one without. ``requests`` has method and n_params; adds ``seen``.

    No list of a key's requests is made. Nothing takes over from a request that has both a method and parameters: the first
    of these stays. Without one, GETs with parameters and other methods without them take over from each other by turns, so
    that the first one behind the last of the other kind stays; without either, the first request. Both steps are minima and
    maxima of places, which partitions sum up by themselves."""
    get, full = F.upper("method") == "GET", F.coalesce(F.col("n_params") > 0, F.lit(False))
    kind = F.when(~get & full, "both").when(get & full, "params").when(~get & ~full, "method").otherwise("none")
    rows = requests.select(*keys, F.struct(*order, F.upper("method").alias("method"), F.col("n_params").cast("long").alias("n_params")).alias("at"), F.coalesce(kind, F.lit("none")).alias("kind"))
    of = lambda name: F.when(F.col("kind") == name, F.col("at"))
    marks = rows.groupBy(*keys).agg(
        F.count("*").alias("seen"), F.min("at").alias("first"), F.min(of("both")).alias("both"), F.min(of("params")).alias("params"), F.min(of("method")).alias("other"), F.max(of("params")).alias("last_params"), F.max(of("method")).alias("last_other"),
    )
    turns = F.col("both").isNull() & F.col("params").isNotNull() & F.col("other").isNotNull()
    plain = marks.where(~turns).select(*keys, F.coalesce("both", "params", "other", "first").alias("kept"), "seen")
    wins = F.col("last_params") > F.col("last_other")
    asked = marks.where(turns).select(*[F.col(k).alias(f"_{k}") for k in keys], "seen", F.when(wins, "params").otherwise("method").alias("wanted"), F.when(wins, F.col("last_other")).otherwise(F.col("last_params")).alias("behind"))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    late = rows.where("kind IN ('params', 'method')").join(asked, [*same, F.col("kind") == F.col("wanted"), F.col("at") > F.col("behind")])
    late = late.groupBy(*keys).agg(F.min("at").alias("kept"), F.first("seen").alias("seen"))
    return plain.unionByName(late).select(*keys, "kept.method", "kept.n_params", "seen")


def first_wins(df: DataFrame, keys: list, order: list) -> DataFrame:
    """The first row of each key. The window's group limit drops later rows before the shuffle."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def dedupe_vectors(vectors: DataFrame, order: str = "ord") -> DataFrame:
    """One vector for each category, folded page, method, parameters, roles, identity parameters and overrides: the first in
    order, then by page."""
    params = F.array_sort(F.map_entries("request.params"))
    keys = ["category", urls.vulnerability_page(F.col("page")), F.upper("request.method"), params, "authorized_roles", "identity_parameters", "page_overrides"]
    return first_wins(vectors, keys, [order, "page"])


def visit_key(url: Column, canonical: Column, rules: list[tuple[str, str]]) -> Column:
    """What a crawl visits once: the first matching rule's key, else the canonical page."""
    out = canonical
    for pattern, key in reversed(rules):
        out = F.when(F.rlike(url, F.lit(f"(?i){pattern}")), F.lit(key)).otherwise(out)
    return out
