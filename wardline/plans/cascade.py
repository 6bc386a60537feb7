"""Responses to verdicts: an ordered cascade in which the first rule that fits decides."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import html, urls

#: Texts of pages that say a resource is not there.
INVALID_MARKERS = (
    "you seem to have followed an invalid address",
    "please be sure the specified post exists",
    "specified post exists",
    "specified thread does not exist",
    "specified forum does not exist",
)
LEAST_BODY = 100


@dataclass
class Oracle:
    denied_statuses: list[int] = field(default_factory=lambda: [401, 403])
    deny_markers: list[str] = field(default_factory=list)
    invalid_markers: list[str] = field(default_factory=list)
    login_markers: list[str] = field(default_factory=lambda: ["login", "signin"])
    redirect_markers: list[str] = field(default_factory=list)
    public_pages: list[str] = field(default_factory=list)
    authenticated_pages: list[str] = field(default_factory=list)
    static_confirm: list[str] = field(default_factory=list)
    force_static: list[str] = field(default_factory=list)
    protected: list[tuple[str, str]] = field(default_factory=list)
    write_redirects: list[str] = field(default_factory=list)
    write_redirect_is_vulnerable: bool = True
    login_form_denies: bool = True
    base_url: str = ""


def first_marker(content: Column, markers: list[str]) -> Column:
    """The first marker, in the given order, that the folded content holds; null without one."""
    if not markers:
        return F.lit(None).cast("string")
    return F.try_element_at(F.filter(F.array(*[F.lit(m.lower()) for m in markers]), lambda m: F.contains(content, m)), F.lit(1))


def denial(oracle: Oracle, status: Column, url: Column, headers: Column, body: Column, target: Column | None = None, length: Column | None = None) -> Column:
    """Evidence of a denial, in a fixed order; empty without any. The redirect's target and the body's bare length may be given
    as columns, where they are at hand."""
    target = html.redirect_target(headers, body, url) if target is None else target
    length = html.body_length(body) if length is None else length
    folded = F.lower(body)
    marked = lambda c, markers: F.rlike(F.lower(c), F.lit("|".join(rf"\Q{m.lower()}\E" for m in markers))) if markers else F.lit(False)
    marker = first_marker(folded, oracle.deny_markers)
    trace = html.has_exception_trace(body)
    return F.array_compact(
        F.array(
            F.when(status.isin(oracle.denied_statuses), F.concat(F.lit("HTTP "), status)),
            F.when(target.isNotNull() & marked(target, [*oracle.login_markers, *oracle.redirect_markers]), F.concat(F.lit("denial redirect: "), target)),
            F.when(marked(url, oracle.login_markers), F.concat(F.lit("authentication page: "), url)),
            F.when(marker.isNotNull(), F.concat(F.lit("denial marker: "), marker)),
            F.when(F.rlike(body, F.lit(r"(?i)history\.back\s*\(")), F.lit("client-side denial: history.back()")),
            F.when(html.has_login_form(body, url, tuple(oracle.login_markers)), F.lit("login form in response")) if oracle.login_form_denies else F.lit(None).cast("string"),
            F.when(trace, F.lit("exception trace in response body")),
            F.when(~trace & (length == 0) & (status == 200), F.lit("empty response body")),
        )
    )


def _matches(page: Column, patterns: list[str], *spelled: Column) -> Column:
    """Whether a pattern is in a page, its base page or a further spelling."""
    out = F.lit(False)
    for p in patterns:
        for target in (page, urls.base_page(page), *spelled):
            out = out | F.coalesce(F.rlike(target, F.lit(f"(?i){p}")), F.lit(False))
    return out


def redirect_spellings(target: Column, base_url: str) -> Column:
    """A redirect's target as it is, relative to the application, and its path and query without the application's path."""
    base = base_url.rstrip("/") + "/"
    path = F.regexp_replace(urls.path(target), "^/+", "")
    root = urls.path(F.lit(base)) if base_url else F.lit("/")
    root = F.concat(F.regexp_replace(root, "^/+|/+$", ""), F.lit("/"))
    path = F.when((root != "/") & F.startswith(path, root), F.substring(path, F.length(root) + 1, F.length(path))).otherwise(path)
    query = urls.query(target)
    asked = F.when(path != "", F.concat(path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))
    relative = F.when(F.startswith(target, F.lit(base)), F.substring(target, len(base) + 1, F.length(target))) if base_url else F.lit(None).cast("string")
    return F.array_distinct(F.array_compact(F.array(target, relative, asked)))


def classify(responses: DataFrame, oracle: Oracle) -> DataFrame:
    """Adds status, confidence, reason and evidence to (category, page, method, actor, status_code, url, headers, text).

    A narrow projection: every rule is a column expression, and what several rules ask of a body is worked out once, in a step
    before them. A null status code is a request that failed. Where there is a map ``params``, lists of public pages are held
    against the page with the request's parameters too.
    """
    body, status, page = F.coalesce("text", F.lit("")), F.col("status_code"), F.col("page")
    url, headers = F.coalesce("url", F.lit("")), F.coalesce("headers", F.expr("CAST(map() AS map<string,string>)"))
    none = F.expr("CAST(map() AS map<string,string>)")
    asked = urls.effective_page(page, F.coalesce("params", none)) if "params" in responses.columns else F.lit(None).cast("string")
    scanned = responses.select("*", html.redirect_target(headers, body, url).alias("_target"), html.body_length(body).alias("_length"), F.lower(html.compact_body(body)).alias("_squeezed"), asked.alias("_asked"))
    d = scanned.withColumn("evidence", denial(oracle, status, url, headers, body, F.col("_target"), F.col("_length")))
    squeezed, length, effective = F.col("_squeezed"), F.col("_length"), F.col("_asked")
    invalid = first_marker(squeezed, [*INVALID_MARKERS, *oracle.invalid_markers])
    wanted = F.array_compact(F.array(*[F.when(_matches(page, [p]), F.lit(m.lower())) for p, m in oracle.protected])) if oracle.protected else F.expr("CAST(array() AS array<string>)")
    absent = (F.size(wanted) > 0) & (status == 200) & F.forall(wanted, lambda m: ~F.contains(squeezed, m))
    denied, get = F.size("evidence") > 0, F.upper("method") == "GET"
    redirected = (status >= 300) & (status < 400)
    location = redirect_spellings(F.col("_target"), oracle.base_url)
    write_ok = F.lit(oracle.write_redirect_is_vulnerable) & ~get & redirected
    listed = F.lit(False)
    for p in oracle.write_redirects:
        listed = listed | F.coalesce(F.exists(location, lambda x: F.rlike(x, F.lit(f"(?i){p}"))), F.lit(False))  # noqa: B023
    static = F.col("category") == "static_only"
    confirmed = F.lit(True) if not oracle.static_confirm else (F.lower(urls.base_page(page)).isin([x.lower() for x in oracle.force_static]) if oracle.force_static else F.lit(False)) | _matches(page, oracle.static_confirm)
    rules = [
        (_matches(page, oracle.public_pages, effective), "not_vulnerable", "high", "public page"),
        ((F.col("category") != "horizontal") & F.col("actor").isNotNull() & _matches(page, oracle.authenticated_pages, effective), "not_vulnerable", "high", "page of all signed-in users"),
        (status.isNull(), "not_vulnerable", "none", "request failed"),
        (invalid.isNotNull(), "not_vulnerable", "high", "resource does not exist"),
        (absent, "not_vulnerable", "high", "protected content absent"),
        (denied, "not_vulnerable", "high", "denied"),
        (write_ok & listed, "vulnerable", "high", "write accepted with configured redirect"),
        (static & (F.trim(body) == ""), "not_vulnerable", "high", "empty static page"),
        (static & ~confirmed, "not_vulnerable", "high", "static page not confirmed"),
        (static & (status == 200), "vulnerable", "high", "normal response"),
        (static, "not_vulnerable", "high", "no normal response"),
        ((status == 200) & (length < LEAST_BODY), "not_vulnerable", "medium", "nearly empty body"),
        (status == 200, "vulnerable", "high", "normal response"),
        (write_ok, "vulnerable", "high", "write accepted with redirect"),
        (redirected, "not_vulnerable", "high", "redirected"),
    ]
    verdict = F.struct(F.lit("not_vulnerable").alias("status"), F.lit("high").alias("confidence"), F.lit("no normal response").alias("reason"))
    for test, s, c, r in reversed(rules):
        verdict = F.when(test, F.struct(F.lit(s).alias("status"), F.lit(c).alias("confidence"), F.lit(r).alias("reason"))).otherwise(verdict)
    return d.withColumn("verdict", verdict).select(*responses.columns, "verdict.*", "evidence")
