"""URL and page expressions. All are Column to Column and stay in generated code.

Pages are URLs relative to an application's base, with query values folded. Splitting is by pattern, so that invalid
URLs never raise.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

PLACEHOLDER = "p1"


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))


def netloc(url: Column) -> Column:
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)


def query(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def base_page(page: Column) -> Column:
    """The path before the query, without leading slashes."""
    return F.regexp_replace(F.substring_index(page, "?", 1), "^/+", "")


def strip_query_fragment(url: Column) -> Column:
    return F.substring_index(F.substring_index(url, "#", 1), "?", 1)


def pairs(query_: Column) -> Column:
    """Decoded (key, value) pairs of a query string in order; empty pieces go, blank values stay."""
    piece = F.filter(F.split(query_, "&"), lambda x: x != "")
    decode = lambda x: F.coalesce(F.try_url_decode(x), x)
    return F.transform(piece, lambda x: F.struct(decode(F.substring_index(x, "=", 1)).alias("key"), decode(F.when(F.instr(x, "=") > 0, F.regexp_replace(x, "^[^=]*=", "")).otherwise("")).alias("value")))


def encode(text: Column) -> Column:
    """Form encoding with the characters A-Z a-z 0-9 _ . - ~ left alone and a plus for a space."""
    return F.replace(F.replace(F.url_encode(text), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def render(pairs_: Column) -> Column:
    """A query string of (key, value) pairs."""
    return F.array_join(F.transform(pairs_, lambda p: F.concat(encode(p["key"]), F.lit("="), encode(p["value"]))), "&")


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with the value made once a row: a column named several times, or in a lambda, is made anew each time."""
    return F.element_at(F.transform(F.array(value), use), 1)


def with_query(page: Column, pairs_: Column) -> Column:
    return F.when(F.size(pairs_) > 0, F.concat(page, F.lit("?"), render(pairs_))).otherwise(page)


def canonical_page(url: Column, base_path: Column, preserve: list[str] = (), drop: list[str] = (), path_patterns: list[tuple[str, str]] = ()) -> Column:
    """Drop the base's prefix, rewrite path parts by (pattern, replacement), fold values of parameters that are not preserved,
    drop others, sort pairs."""
    p = path(url)
    p = F.when((base_path != "/") & F.startswith(p, base_path), F.substring(p, F.length(base_path) + 1, F.length(p))).otherwise(p)
    p = F.regexp_replace(p, "^/+", "")
    p = F.when(p == "", "./").otherwise(p)
    for pattern, replacement in path_patterns:
        p = F.regexp_replace(p, f"(?i){pattern}", replacement)
    kept = F.filter(pairs(query(url)), lambda x: ~x["key"].isin(list(drop)) if drop else F.lit(True))
    folded = F.transform(kept, lambda x: F.struct(x["key"].alias("key"), (F.when(x["key"].isin(list(preserve)), x["value"]).otherwise(PLACEHOLDER) if preserve else F.lit(PLACEHOLDER)).alias("value")))
    return with_query(p, F.array_sort(folded))


def in_scope(url: Column, base: Column, scope_path: Column | None = None) -> Column:
    """Same host over http or https, and a path that starts, as a string, with the scope."""
    prefix = path(base) if scope_path is None else scope_path
    prefix = F.when(prefix == "", "/").otherwise(prefix)
    return scheme(url).isin("http", "https") & (netloc(url) == netloc(base)) & F.startswith(path(url), prefix)


def absolute(base: Column, value: Column) -> Column:
    """Join a reference to a base whose path is read as a folder: absolute, scheme-relative, rooted and plain references;
    dot segments in front are resolved, deeper ones stay."""
    root = F.concat(scheme(base), F.lit("://"), netloc(base))
    folder = F.concat(F.regexp_replace(F.regexp_extract(base, r"^([^?#]*)", 1), "/+$", ""), F.lit("/"))
    plain = F.regexp_replace(value, r"^(\./)+", "")
    up = F.regexp_replace(plain, r"^\.\./", "")
    parent = F.regexp_replace(folder, "[^/]+/$", "")
    return (
        F.when(scheme(value) != "", value)
        .when(F.startswith(value, F.lit("//")), F.concat(scheme(base), F.lit(":"), value))
        .when(F.startswith(value, F.lit("/")), F.concat(root, value))
        .when(F.startswith(plain, F.lit("../")), F.concat(F.when(parent == F.concat(scheme(base), F.lit("://")), folder).otherwise(parent), up))
        .otherwise(F.concat(folder, plain))
    )


def joined(base: Column, value: Column) -> Column:
    """A reference seen in the document at ``base``, as a browser resolves it: dot segments of the path are taken out."""
    root = F.concat(scheme(base), F.lit("://"), netloc(base))
    tail = F.regexp_extract(value, r"([?#].*)?$", 1)
    own = F.regexp_extract(value, r"^([^?#]*)", 1)
    full = F.when(F.startswith(own, F.lit("/")), own).otherwise(F.concat(F.regexp_extract(path(base), r"^(.*/)", 1), own))
    parts = F.filter(F.split(full, "/"), lambda x: x != ".")
    kept = F.aggregate(parts, F.expr("CAST(array() AS array<string>)"), lambda a, x: F.when(x == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(1)))).otherwise(F.concat(a, F.array(x))))
    closed = F.when(F.rlike(full, F.lit(r"(^|/)\.\.?$")), F.concat(kept, F.array(F.lit("")))).otherwise(kept)
    clean = F.array_join(closed, "/")
    return (
        F.when(scheme(value) != "", value).when(F.startswith(value, F.lit("//")), F.concat(scheme(base), F.lit(":"), value))
        .when(own == "", F.concat(F.when(F.startswith(value, F.lit("?")), strip_query_fragment(base)).otherwise(F.substring_index(base, "#", 1)), tail))
        .otherwise(F.concat(root, F.when(F.startswith(clean, F.lit("/")), "").otherwise("/"), clean, tail))
    )


def effective_page(page: Column, params: Column) -> Column:
    """A page with a request's parameters laid over its query, in the place of equal names and after the others."""

    def laid(own: Column) -> Column:
        changed = F.transform(own, lambda x: F.struct(x["key"].alias("key"), F.coalesce(F.try_element_at(params, x["key"]), x["value"]).alias("value")))
        more = F.filter(F.transform(F.array_sort(F.map_keys(params)), lambda k: F.struct(k.alias("key"), F.element_at(params, k).alias("value"))), lambda x: ~F.exists(own, lambda o: o["key"] == x["key"]))
        return F.concat(changed, more)

    return with_query(F.substring_index(page, "?", 1), once(pairs(query(page)), laid))


def vulnerability_page(page: Column) -> Column:
    """The spelling under which findings of a page are one: distinct sorted keys, every value a star."""
    keys = F.array_sort(F.array_distinct(F.transform(pairs(query(page)), lambda x: x["key"])))
    return with_query(base_page(page), F.transform(keys, lambda k: F.struct(k.alias("key"), F.lit("*").alias("value"))))


def query_keys(page: Column, among: list[str]) -> Column:
    """Sorted distinct query keys that are among the given ones."""
    keys = F.transform(pairs(query(page)), lambda x: x["key"])
    return F.array_sort(F.array_intersect(F.array_distinct(keys), F.array(*map(F.lit, among))))


def with_overrides(page: Column, overrides: Column) -> Column:
    """Query values replaced from a map; parameters the page does not have stay out. A page left alone keeps its spelling."""
    found = pairs(query(page))
    hit = F.exists(found, lambda x: F.map_contains_key(overrides, x["key"]))
    changed = F.transform(found, lambda x: F.struct(x["key"].alias("key"), F.coalesce(F.try_element_at(overrides, x["key"]), x["value"]).alias("value")))
    return F.when(hit, with_query(F.substring_index(page, "?", 1), changed)).otherwise(page)


def spellings(page: Column) -> Column:
    """Distinct spellings under which a page may be listed: as given, without its leading slash, by path, rooted, with numeric
    segments folded."""
    bare = F.regexp_replace(page, "^/+", "")
    base = base_page(page)
    fold = lambda x: F.regexp_replace(x, r"(?<=/)\d+(?=/|$)", PLACEHOLDER)
    return F.array_distinct(F.array(page, bare, base, F.concat(F.lit("/"), bare), F.concat(F.lit("/"), base), fold(base), F.concat(F.lit("/"), fold(base))))


def request_params(url: Column, body: Column) -> Column:
    """Map of query and body parameters; the last of a key wins."""

    def last(both: Column) -> Column:
        keys = F.array_distinct(F.transform(both, lambda x: x["key"]))
        return F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter(both, lambda x: x["key"] == k), -1)["value"]))

    return once(F.concat(pairs(query(url)), pairs(F.coalesce(body, F.lit("")))), last)


#: Query values and words that mark a parameter as a secret.
SECRET = r"(?i)(pass(word|wd)?|pwd|token|csrf|secret|api_?key|session|nonce)"


def recorded_params(params: Column, ignored: list[str] = ()) -> Column:
    """Parameters that may be recorded: no secrets, no ignored names."""
    return F.map_filter(params, lambda k, v: ~F.rlike(k, F.lit(SECRET)) & (~F.lower(k).isin([x.lower() for x in ignored]) if ignored else F.lit(True)))


def redacted(params: Column) -> Column:
    return F.transform_values(params, lambda k, v: F.when(F.rlike(k, F.lit(SECRET)), "<redacted>").otherwise(v))


def operation(params: Column, method: Column) -> Column:
    """The first non-blank of the parameters action, operation, do and mode, else the method."""
    named = once(params, lambda p: F.coalesce(*[F.nullif(F.trim(F.try_element_at(p, F.lit(k))), F.lit("")) for k in ("action", "operation", "do", "mode")]))
    return F.coalesce(named, F.upper(F.coalesce(method, F.lit("GET"))))


def excluded(url: Column, markers: list[str], patterns: list[str]) -> Column:
    """Whether a spelling of a URL holds a marker, case folded, or matches a pattern."""
    forms = [url, F.regexp_replace(path(url), "^/+", ""), strip_query_fragment(url)]
    tests = [F.contains(F.lower(f), F.lit(m.lower())) for m in markers if m for f in forms] + [F.rlike(f, F.lit(f"(?i){p}")) for p in patterns if p for f in forms]
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


#: Pages that are parts of others, by default not worth a request of their own.
DETECTION_EXCLUDES = (
    r"(^|/)(header|footer|nav|navbar|menu|sidebar|top|bottom|form|forms|layout|template|templates|function|functions|config|database|db|common|constants|settings)\.php$",
    r"(^|/)(includes?|inc|lib|libs?|vendor|templates?|layouts?)/",
    r"(^|/)admin/(modules|styles)/",
)
#: File extensions of static assets; entries that stand alone; folders and names of component files.
ASSETS = (".css", ".js", ".jpg", ".jpeg", ".png", ".gif", ".svg", ".ico", ".webp", ".pdf", ".zip", ".rar", ".7z", ".tar", ".gz", ".mp3", ".mp4", ".avi", ".woff", ".woff2", ".ttf", ".eot")
STANDALONE = r"(?i)(^|/)(install|setup|upgrade)(?:\.[A-Za-z0-9]+|/|$)"
COMPONENT = (
    r"(?i)(^|/)(includes?|inc|lib|libs?|vendor|templates?|layouts?|partials?|components?|static|assets|css|js|images?|img|fonts?)/"
    r"|(^|/)(header|footer|nav|navbar|menu|sidebar|top|bottom|form|forms|layout|template|templates|function|functions|config|database|db|common|constants|settings)\.[A-Za-z0-9]+$"
)


def excluded_from_detection(page: Column, patterns: list[str] = ()) -> Column:
    full, base = F.lower(F.regexp_replace(F.regexp_replace(page, "^/+", ""), r"\\", "/")), F.lower(base_page(page))
    out = F.lit(False)
    for p in (*DETECTION_EXCLUDES, *patterns):
        out = out | F.rlike(full, F.lit(f"(?i){p}")) | F.rlike(base, F.lit(f"(?i){p}"))
    return out


def component_like(relative: Column) -> Column:
    return F.rlike(F.regexp_replace(relative, r"\\", "/"), F.lit(COMPONENT))


def link_target(value: Column, current: Column) -> Column:
    """The page a link in the file ``current`` leads to; null for other schemes, assets, anchors and expressions."""
    v = F.trim(value)
    bare = strip_query_fragment(v)
    suffix = F.lower(F.regexp_extract(bare, r"(\.[A-Za-z0-9]+)$", 1))
    folder = F.regexp_extract(current, r"^(.*/)", 1)
    joined = F.when(F.startswith(bare, F.lit("/")), F.regexp_replace(bare, "^/+", "")).otherwise(F.concat(folder, bare))
    out = F.regexp_replace(F.regexp_replace(joined, "/+", "/"), r"^[./]+", "")
    gone = (v == "") | F.startswith(v, F.lit("#")) | F.rlike(v, F.lit(r"(?i)^(https?://|mailto:|tel:|javascript:|data:)")) | (bare == "") | F.rlike(bare, F.lit(r"[<>|*\x00]")) | suffix.isin(*ASSETS)
    return F.when(~gone, F.when(out == "", "./").otherwise(out))


def django_route(route: Column) -> Column:
    """A path() route with its converters folded."""
    return F.regexp_replace(F.regexp_replace(route, r"<[^>]+>", PLACEHOLDER), "^/+", "")


def regex_route(route: Column) -> Column:
    """A regular expression of a route with groups folded and anchors dropped."""
    r = F.regexp_replace(route, r"^\^|\$$", "")
    r = F.regexp_replace(r, r"\((?:\?P<[^>]+>)?[^()]*\)", PLACEHOLDER)
    return F.regexp_replace(F.regexp_replace(r, r"\\(.)", "$1"), "^/+", "")


def brace_route(route: Column) -> Column:
    """A route with {name} or {name:pattern} parameters folded."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(route, r"\{[^}]+\}", PLACEHOLDER), "^/+", ""), "/+", "/")
