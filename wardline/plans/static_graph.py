"""Static resources against observed pages, and the fusion of both graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import urls
from ..operators import graph

#: Later origins win where two name a source for one URL.
PRECEDENCE = {"direct": 0, "route": 1, "http": 2}


def url_sources(rows: DataFrame) -> DataFrame:
    """(url, source) of (url, source, origin): http over route over direct, then the last source in order."""
    rank = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in PRECEDENCE.items() for x in kv]), F.col("origin")), F.lit(-1))
    return rows.groupBy("url").agg(F.max_by("source", F.struct(rank, "source")).alias("source"))


def classify(sources: DataFrame, url_to_source: DataFrame, dependency: DataFrame, http: DataFrame, observed: DataFrame) -> DataFrame:
    """(label, member): resource sets of ``sources`` (path), ``url_to_source`` (url, source), edges and observed pages (page).

    UP are URLs with a source, CP files without a URL. UP_prime0 are UP that were observed; of the others UPdiff1 hang on
    an edge and UPdiff2 are isolated or stand alone. observed, internal_reachable and support_unreachable are about
    files: seen, reachable from seen ones over dependencies, and neither reachable nor public.
    """
    base = observed.select(urls.base_page(F.col("page")).alias("base")).distinct().withColumn("seen", F.lit(True))
    edges = dependency.select("from", "to").union(http.select("from", "to"))
    touched = edges.select(F.explode(F.array("from", "to")).alias("source")).distinct().withColumn("touched", F.lit(True))
    up = url_to_source.select("url", "source", urls.base_page(F.col("url")).alias("base")).join(base, "base", "left").join(touched, "source", "left")
    first = F.coalesce("touched", F.lit(False)) & ~F.rlike("url", F.lit(urls.STANDALONE))
    up = graph.checkpointed(up.select("url", "source", F.coalesce("seen", F.lit(False)).alias("seen"), F.coalesce(first, F.lit(False)).alias("first")))
    reach = graph.closure(dependency, up.where("seen").select(F.col("source").alias("node")))
    # what is known of each file, in one aggregation; then every URL and every file names its labels
    none, yes = F.lit(None), F.lit(True)
    facts = sources.select("path", yes.alias("file"), none.cast("boolean").alias("public"), none.cast("int").alias("depth"))
    facts = facts.union(up.select("source", none, yes, none)).union(reach.select("node", none, none, "depth"))
    files = facts.groupBy("path").agg(F.max("file").alias("file"), F.max("public").alias("public"), F.min("depth").alias("depth"))
    named = lambda test, *names: F.when(test, F.array(*map(F.lit, names))).otherwise(F.expr("CAST(array() AS array<string>)"))
    own, inner = F.col("file").isNotNull() & F.col("public").isNull(), F.col("depth").isNull()
    of_url = F.concat(named(yes, "UP"), named(F.col("seen"), "UP_prime0"), named(~F.col("seen"), "UPdiff", "public_unobserved"), named(~F.col("seen") & F.col("first"), "UPdiff1"), named(~F.col("seen") & ~F.col("first"), "UPdiff2"))
    of_file = F.concat(named(own, "CP"), named(own & inner, "support_unreachable"), named(F.col("depth") == 0, "observed"), named(F.col("depth") > 0, "internal_reachable"))
    labels = up.select(F.explode(of_url).alias("label"), F.col("url").alias("member")).distinct()
    return labels.union(files.select(F.explode(of_file).alias("label"), F.col("path").alias("member")))


def fuse(dynamic_nodes: DataFrame, url_to_source: DataFrame, labels: DataFrame) -> dict[str, DataFrame]:
    """nodes (node, origins), static_only, static_detection (page) and source_map (page, source). Without classifications, the
    static pages that were not observed take the place of the isolated ones."""
    cp = labels.where("label = 'CP'").select(F.col("member").alias("page"))
    static = url_to_source.select(F.col("url").alias("page"))
    of = lambda name: labels.where(F.col("label") == name).select(F.col("member").alias("page"))
    if labels.where("label IN ('UPdiff1', 'UPdiff2')").take(1):
        isolated, diff = of("UPdiff2"), of("UPdiff1").union(of("UPdiff2")).distinct()
    else:
        base = dynamic_nodes.select(urls.base_page(F.col("page")).alias("base")).distinct()
        isolated = diff = static.withColumn("base", urls.base_page(F.col("page"))).join(base, "base", "left_anti").select("page")
    tag = lambda d, origin: d.select(F.col("page").alias("node"), F.lit(origin).alias("origin"))
    nodes = graph.node_origins(tag(dynamic_nodes, "dynamic").union(tag(static, "static")).union(tag(cp, "static")))
    own = cp.select("page", F.col("page").alias("source"))
    mapped = url_to_source.select(F.col("url").alias("page"), "source")
    source_map = mapped.union(own.join(mapped, "page", "left_anti"))
    return {"nodes": nodes, "static_only": diff, "static_detection": isolated.union(cp).distinct(), "source_map": source_map}
