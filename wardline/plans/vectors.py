"""Which pages deserve an authorization check, for which roles: test cases from a fused graph, and who runs them."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls
from ..operators import access, graph


@dataclass
class Rules:
    """Configured lists; patterns are searched case-insensitively in the page as it is spelled."""

    identity: list[str] = field(default_factory=list)
    detection_excludes: list[str] = field(default_factory=list)
    force_static: list[str] = field(default_factory=list)
    force_horizontal: list[str] = field(default_factory=list)
    force_vertical: list[str] = field(default_factory=list)
    vertical_only: list[str] = field(default_factory=list)
    horizontal_excludes: list[str] = field(default_factory=list)
    admin_excludes: list[str] = field(default_factory=list)
    authenticated_excludes: list[str] = field(default_factory=list)
    open_get: list[str] = field(default_factory=list)
    vertical_overrides: dict[str, list[str]] = field(default_factory=dict)
    horizontal_pages: list[dict] = field(default_factory=list)


def _any(page: Column, patterns: list[str]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | F.rlike(page, F.lit(f"(?i){p}"))
    return out


def _among(page: Column, pages: list[str]) -> Column:
    return (page.isin(pages) | urls.base_page(page).isin(pages)) if pages else F.lit(False)


_NONE = lambda: F.expr("CAST(array() AS array<string>)")
_GET = lambda referer=None: F.struct(F.lit("GET").alias("method"), F.expr("CAST(map() AS map<string,string>)").alias("params"), (referer if referer is not None else F.lit(None).cast("string")).alias("referer"))


def option_maps(keys: Column, values: dict[str, list[str]]) -> Column:
    """The cross product of the values of those keys that a row has, as maps; none where it has no such key.

    The configured values are one literal list, over which a row folds its product."""
    none = F.expr("CAST(array() AS array<map<string,string>>)")
    if not values:
        return none
    listed = F.array(*[F.struct(F.lit(k).alias("key"), F.array(*[F.lit(str(x)) for x in values[k]]).alias("options")) for k in sorted(values) if values[k]])
    own = F.filter(listed, lambda x: F.array_contains(keys, x["key"]))
    start = F.array(F.expr("CAST(map() AS map<string,string>)"))
    grown = F.aggregate(own, start, lambda maps, x: F.flatten(F.transform(maps, lambda m: F.transform(x["options"], lambda o: F.map_concat(m, F.create_map(x["key"], o))))))
    return F.when(F.size(own) > 0, grown).otherwise(none)


def enumerate_vectors(matrix: DataFrame, detection: DataFrame, rules: Rules, edges: DataFrame | None = None) -> DataFrame:
    """Test cases of ``matrix`` (page, roles, kinds, requests) and static pages ``detection`` (page).

    One pass over the matrix: each row makes a list of its cases, which is exploded. Static pages get one anonymous GET
    each, with the request of the matrix where they have one; with ``edges`` (static edges) only isolated pages and
    stand-alone entries are taken. Cases that fold to one stay once.
    """
    page = F.col("page")
    forced_static = _among(page, rules.force_static)
    found = detection.select("page").distinct().where(forced_static | ~urls.excluded_from_detection(page, rules.detection_excludes))
    if edges is not None:
        deg = graph.degrees(edges)
        found = found.withColumn("node", urls.base_page(page)).join(deg, "node", "left")
        alone = (F.coalesce("in_degree", F.lit(0)) == 0) & (F.coalesce("out_degree", F.lit(0)) == 0)
        found = found.where(_among(page, rules.force_static) | F.rlike(page, F.lit(urls.STANDALONE)) | alone).select("page")
    static = found.join(matrix.select("page", "requests"), "page", "left").select(
        F.lit("static_only").alias("category"), "page", _NONE().alias("authorized_roles"), F.coalesce(access.representative(F.col("requests")), _GET()).alias("request"), _NONE().alias("identity_parameters"), _NONE().alias("page_overrides"), F.lit(0).alias("ord"))

    kinds, requests, roles = F.col("kinds"), F.col("requests"), F.col("roles")
    has = lambda k: F.array_contains(kinds, k)
    by_kind = lambda kind: F.when(F.size(access.roles_of(requests, kind)) > 0, access.roles_of(requests, kind)).otherwise(roles)
    vertical_only = _any(page, rules.vertical_only)
    admin = ~vertical_only & ~_any(page, rules.admin_excludes) & (F.array_sort(kinds) == F.array(F.lit("admin")))
    signed_in = ~admin & ~vertical_only & ~_any(page, rules.authenticated_excludes) & ~has("visitor") & (has("user") | has("admin"))
    used = F.flatten(F.transform(F.filter(requests, lambda r: r["kind"] == "user"), lambda r: F.map_keys(r["params"])))
    identity = F.array(*map(F.lit, rules.identity)) if rules.identity else _NONE()
    matched = F.array_sort(F.array_union(F.array_intersect(used, identity), urls.query_keys(page, rules.identity) if rules.identity else _NONE()))
    forced_horizontal, forced_vertical = _among(page, rules.force_horizontal), _among(page, rules.force_vertical)
    horizontal_out = _any(page, rules.horizontal_excludes)
    case = lambda category, who, request, ids, ord_, at=page, overrides=None: F.struct(F.lit(category).alias("category"), at.alias("page"), who.alias("authorized_roles"), request.alias("request"), ids.alias("identity_parameters"), (overrides if overrides is not None else _NONE()).alias("page_overrides"), F.lit(ord_).alias("ord"))
    user_request, admin_request = access.representative(requests, "user"), access.representative(requests, "admin")
    twin = lambda r: (r["method"] == "POST") & _any(page, rules.open_get)
    cases = [
        F.when(admin, case("admin_only", by_kind("admin"), admin_request, _NONE(), 1)),
        F.when(admin & twin(admin_request), case("admin_only", by_kind("admin"), _GET(admin_request["referer"]), _NONE(), 2)),
        F.when(signed_in, case("authenticated_only", by_kind("user"), user_request, _NONE(), 3)),
        F.when(signed_in & twin(user_request), case("authenticated_only", by_kind("user"), _GET(user_request["referer"]), _NONE(), 4)),
    ]
    for n, rule in enumerate(rules.horizontal_pages):
        hit = F.lit(True)
        if rule.get("page"):
            hit = hit & ((page == rule["page"].lstrip("/")) | (urls.base_page(page) == rule["page"].lstrip("/")))
        if rule.get("pattern"):
            hit = hit & (F.rlike(page, F.lit(f"(?i){rule['pattern']}")) | F.rlike(urls.base_page(page), F.lit(f"(?i){rule['pattern']}")))
        pages = F.array(*[F.lit(p.lstrip("/")) for p in rule["pages"]])
        cases.append(F.when(hit & ~vertical_only & ~horizontal_out, case("horizontal", access.roles_of(requests, "user"), user_request, F.array(*map(F.lit, rule.get("identity_parameters", ["path"]))), 5 + n, overrides=pages)))
    open_ = F.when((F.size(matched) > 0) & ~vertical_only & ~horizontal_out & (~has("visitor") | forced_horizontal), case("horizontal", access.roles_of(requests, "user"), user_request, matched, 9000))
    options = F.when(forced_vertical, option_maps(matched, rules.vertical_overrides)).otherwise(F.expr("CAST(array() AS array<map<string,string>>)"))
    merged = lambda o: F.struct(admin_request["method"].alias("method"), F.map_concat(F.map_filter(admin_request["params"], lambda k, v: ~F.map_contains_key(o, k)), o).alias("params"), admin_request["referer"].alias("referer"))
    vertical = F.transform(options, lambda o: case("vertical", by_kind("admin"), merged(o), matched, 8000, at=urls.with_overrides(page, o)))
    every = F.concat(F.array_compact(F.array(*cases)), vertical, F.array_compact(F.array(open_)))
    dynamic = matrix.where(~urls.excluded_from_detection(page, rules.detection_excludes)).select(F.explode(every).alias("v")).select("v.*")
    return access.dedupe_vectors(static.unionByName(dynamic))


def fan_out(vectors: DataFrame, roles: list[tuple[str, str]], attackers: dict[str, list[str | None]] | None = None, overrides: dict[str, list[str]] | None = None) -> DataFrame:
    """One row for each request to send: vectors with ``actor`` (null: a visitor), ``override`` (map) and ``page_override``;
    ``status`` is set on rows that stand for a case nobody could run. Roles are configuration, so lists are literals."""
    users = [n for n, k in roles if k == "user"]
    chosen = {"static_only": [None], "authenticated_only": [None], "admin_only": [None, *users], "vertical": users[:1]} | (attackers or {})
    text = lambda xs: F.array(*[F.lit(x).cast("string") for x in xs]) if xs else F.expr("CAST(array() AS array<string>)")
    run = lambda actor, override=None, page=None: F.struct(actor.cast("string").alias("actor"), (override if override is not None else F.expr("CAST(map() AS map<string,string>)")).alias("override"), (page if page is not None else F.lit(None).cast("string")).alias("page_override"), F.lit(None).cast("string").alias("status"))
    idle = lambda actor: F.array(F.struct(actor.cast("string").alias("actor"), F.expr("CAST(map() AS map<string,string>)").alias("override"), F.lit(None).cast("string").alias("page_override"), F.lit("not_vulnerable").alias("status")))
    known = F.array(*[F.lit(n) for n, _ in roles])
    own = F.try_element_at(F.filter("authorized_roles", lambda r: F.array_contains(known, r)), F.lit(1))
    values = option_maps(F.col("identity_parameters"), overrides or {})
    pages = F.col("page_overrides")
    some_values = F.when(F.size(values) > 0, values).otherwise(F.array(F.expr("CAST(map() AS map<string,string>)")))
    some_pages = F.when(F.size(pages) > 0, pages).otherwise(F.array(F.lit(None).cast("string")))
    crossed = F.flatten(F.transform(some_pages, lambda p: F.transform(some_values, lambda o: run(own, o, p))))
    horizontal = F.when((F.size(values) == 0) & (F.size(pages) == 0), idle(F.coalesce(own, F.lit("user")))).when(own.isNotNull(), crossed).otherwise(F.filter(crossed, lambda x: F.lit(False)))
    out = horizontal
    for category, names in chosen.items():
        rows = F.transform(text(names), lambda a: run(a)) if names else idle(F.lit("user"))
        out = F.when(F.col("category") == category, rows).otherwise(out)
    return vectors.withColumn("x", F.explode(out)).select(*vectors.columns, "x.*")
