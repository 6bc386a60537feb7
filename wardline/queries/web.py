"""URLs, pages and responses."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import html, urls
from ..plans import cascade
from .adapters import CRAWL, RESPONSES, crawl, responses, table
from .registry import query

PATH = r"regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1)"
HOST = r"regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1)"
QUERY = r"regexp_extract(url, '^[^?#]*\?([^#]*)', 1)"


@query(rf"""WITH p AS (SELECT page_id, regexp_replace(regexp_replace({PATH}, '^/+', ''), '/\d+', '/p1', 'g') AS path, list_sort([x FOR x IN string_split({QUERY}, '&') IF x <> '' AND split_part(x, '=', 1) <> 'ref']) AS q FROM pages)
 SELECT page_id, CASE WHEN path = '' THEN './' ELSE path END || CASE WHEN len(q) > 0 THEN '?' || array_to_string([split_part(x, '=', 1) || '=' || CASE WHEN split_part(x, '=', 1) = 'utm_source' THEN split_part(x, '=', 2) ELSE 'p1' END FOR x IN q], '&') ELSE '' END AS page FROM p""")
def canonical_page(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.canonical_page(F.col("url"), F.lit("/"), preserve=["utm_source"], drop=["ref"], path_patterns=[(r"/\d+", "/p1")]).alias("page"))


@query(rf"SELECT page_id, {HOST} = 'blog.ththan.example.net' AND regexp_matches(url, '^https?:') AND starts_with({PATH}, '/e') AS inside FROM pages")
def in_scope(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.in_scope(F.col("url"), F.lit("http://blog.ththan.example.net/app/"), F.lit("/e")).alias("inside"))


@query("SELECT split_part(page_url, '?', 1) AS base, count(*) AS n FROM (SELECT event_type || '?k=' || json_extract_string(props, '$.k') AS page_url FROM events) GROUP BY 1")
def base_page(spark, sf_dir):
    page = F.concat(F.lit("/"), "event_type", F.lit("?k="), F.get_json_object("props", "$.k"))
    return table(spark, sf_dir, "events").groupBy(urls.base_page(page).alias("base")).agg(F.count("*").alias("n"))


@query(rf"""WITH p AS (SELECT page_id, regexp_replace({PATH}, '^/+', '') AS path, list_sort(list_distinct([split_part(x, '=', 1) FOR x IN string_split({QUERY}, '&') IF x <> ''])) AS k FROM (SELECT page_id, regexp_replace(url, '^[a-z]+://[^/]*', '') AS url FROM pages))
 SELECT page_id, split_part(path, '#', 1) || CASE WHEN len(k) > 0 THEN '?' || array_to_string([x || '=%2A' FOR x IN k], '&') ELSE '' END AS page FROM p""")
def vulnerability_page_key(spark, sf_dir):
    page = F.regexp_replace(F.regexp_replace("url", r"^[a-z]+://[^/]*", ""), "#.*$", "")
    return table(spark, sf_dir, "pages").select("page_id", urls.vulnerability_page(page).alias("page"))


@query(r"SELECT page_id, CAST(len(l) AS INT) AS n_links, coalesce(array_to_string(l, ' '), '') AS links FROM (SELECT page_id, regexp_extract_all(html, '(?i)<(?:a\b[^>]*?\bhref|i?frame\b[^>]*?\bsrc)\s*=\s*[\x22\x27]?([^\x22\x27\s>]*)', 1) AS l FROM pages)")
def link_extract(spark, sf_dir):
    links = html.links(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", F.size(links).alias("n_links"), F.array_join(links, " ").alias("links"))


@query(r"""WITH x AS (SELECT page_id, trim(unnest(regexp_extract_all(html, '(?i)\b(?:href|action|formaction|src)\s*=\s*["'']([^"'']+)["'']', 1))) AS t FROM pages),
 y AS (SELECT page_id, t, split_part(split_part(t, '#', 1), '?', 1) AS bare FROM x WHERE t <> '' AND NOT starts_with(t, '#') AND NOT regexp_matches(t, '(?i)^(https?://|mailto:|tel:|javascript:|data:)')),
 z AS (SELECT page_id, regexp_replace(regexp_replace(bare, '/+', '/', 'g'), '^[./]+', '') AS target FROM y WHERE bare <> '' AND NOT regexp_matches(bare, '[<>|*]') AND NOT regexp_matches(lower(bare), '\.(css|js|jpe?g|png|gif|svg|ico|webp|pdf|zip|rar|7z|tar|gz|mp3|mp4|avi|woff2?|ttf|eot)$'))
 SELECT CASE WHEN target = '' THEN './' ELSE target END AS target, count(DISTINCT page_id) AS pages FROM z GROUP BY 1""")
def http_targets(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select("page_id", F.explode(html.http_targets(F.col("html"))).alias("t"))
    target = urls.link_target(F.col("t"), F.lit("index.php"))
    return rows.withColumn("target", target).where(F.col("target").isNotNull()).groupBy("target").agg(F.count_distinct("page_id").alias("pages"))


@query(r"SELECT page_id, md5(c) AS digest, CAST(length(c) AS INT) AS n FROM (SELECT page_id, substr(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script>', '', 'g'), '\s+', ' ', 'g'), 1, 200000) AS c FROM pages)")
def compact_body(spark, sf_dir):
    c = html.compact_body(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", F.md5(c).alias("digest"), F.length(c).alias("n"))


@query(rf"WITH {RESPONSES} SELECT page_id, CAST(len AS INT) AS n FROM q")
def body_length(spark, sf_dir):
    return responses(spark, sf_dir).select("page_id", html.body_length(F.col("text")).alias("n"))


ORACLE = cascade.Oracle(login_markers=["login", "signin", "portal"], deny_markers=["Access denied", "not allowed"], public_pages=["^en/1"], authenticated_pages=["^fr/"], static_confirm=["^(en|de)/"], protected=[("^es/", "que")], write_redirects=["done$"])


@query(rf"WITH {RESPONSES} SELECT page_id, array_to_string(evidence, ' | ') AS evidence FROM e")
def denial_evidence(spark, sf_dir):
    out = cascade.denial(ORACLE, F.col("status_code"), F.col("url"), F.coalesce("headers", F.expr("CAST(map() AS map<string,string>)")), F.col("text"))
    return responses(spark, sf_dir).select("page_id", F.array_join(out, " | ").alias("evidence"))


@query(rf"""WITH {RESPONSES}, z AS (SELECT *, regexp_matches(page, '^en/1') AS pub, regexp_matches(page, '^fr/') AS auth, regexp_matches(page, '^(en|de)/') AS conf, regexp_matches(page, '^es/') AS prot, len(evidence) > 0 AS denied, status_code BETWEEN 300 AND 399 AS redir FROM e)
 SELECT page_id, CASE WHEN pub THEN 'public page' WHEN category <> 'horizontal' AND actor IS NOT NULL AND auth THEN 'page of all signed-in users'
   WHEN squeezed LIKE '%specified thread does not exist%' THEN 'resource does not exist' WHEN prot AND status_code = 200 AND squeezed NOT LIKE '%que%' THEN 'protected content absent' WHEN denied THEN 'denied'
   WHEN method <> 'GET' AND redir AND location LIKE '%done' THEN 'write accepted with configured redirect' WHEN category = 'static_only' AND trim(text) = '' THEN 'empty static page' WHEN category = 'static_only' AND NOT conf THEN 'static page not confirmed'
   WHEN category = 'static_only' AND status_code = 200 THEN 'normal response' WHEN category = 'static_only' THEN 'no normal response' WHEN status_code = 200 AND len < 100 THEN 'nearly empty body' WHEN status_code = 200 THEN 'normal response'
   WHEN method <> 'GET' AND redir THEN 'write accepted with redirect' WHEN redir THEN 'redirected' ELSE 'no normal response' END AS reason,
   CASE WHEN reason IN ('normal response', 'write accepted with configured redirect', 'write accepted with redirect') THEN 'vulnerable' ELSE 'not_vulnerable' END AS status, CASE WHEN reason = 'nearly empty body' THEN 'medium' ELSE 'high' END AS confidence FROM z""")
def response_cascade(spark, sf_dir):
    return cascade.classify(responses(spark, sf_dir), ORACLE).select("page_id", "reason", "status", "confidence")


@query("SELECT doc_id, CASE WHEN lower(text) LIKE '%idiot%' THEN 'idiot' WHEN lower(text) LIKE '%trash%' THEN 'trash' WHEN lower(text) LIKE '%scum%' THEN 'scum' END AS marker FROM documents")
def marker_first_match(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", cascade.first_marker(F.lower("text"), ["Idiot", "trash", "scum"]).alias("marker"))


@query("SELECT event_type, method, CAST(count(*) FILTER (WHERE event_type = 'purchase') AS BIGINT) AS recorded, count(*) AS n FROM (SELECT event_type, CASE WHEN event_type = 'click' THEN 'buy' ELSE 'POST' END AS method FROM events) GROUP BY 1, 2")
def request_labels(spark, sf_dir):
    """Equal requests are counted first and read as one."""
    url = F.concat(F.lit("p.php?mode=&action="), F.when(F.col("event_type") == "click", "buy").otherwise(""))
    body = F.when(F.col("event_type") == "purchase", "password=a&item=2&item=3").otherwise("csrf_token=x")
    requests = table(spark, sf_dir, "events").groupBy("event_type", url.alias("url"), body.alias("body")).agg(F.count("*").alias("n"))
    params = urls.request_params(F.col("url"), F.col("body"))
    kept = urls.recorded_params(params, ["action", "mode"])
    recorded = F.sum(F.when(F.try_element_at(kept, F.lit("item")) == "3", F.col("n")).otherwise(0))
    return requests.groupBy("event_type", urls.operation(params, F.lit("post")).alias("method")).agg(recorded.alias("recorded"), F.sum("n").alias("n"))


@query(rf"""WITH {CRAWL}, p AS (SELECT DISTINCT page FROM c), b AS (SELECT page, split_part(page, '?', 1) AS base FROM p), x AS (SELECT page, unnest(list_distinct([page, base, '/' || page, '/' || base, regexp_replace(base, '/\d+$', '/p1'), '/' || regexp_replace(base, '/\d+$', '/p1')])) AS s FROM b)
 SELECT s AS spelling, count(*) AS pages FROM x GROUP BY s""")
def page_spellings(spark, sf_dir):
    pages = crawl(spark, sf_dir).select("page").distinct()
    return pages.select(F.explode(urls.spellings(F.col("page"))).alias("spelling")).groupBy("spelling").agg(F.count("*").alias("pages"))


@query("SELECT page_id, regexp_matches(url, 'spam-farm|utm_') OR regexp_matches(url, '/\\d+/$') AS out FROM pages")
def excluded_urls(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.excluded(F.col("url"), ["SPAM-farm", "utm_"], [r"/\d+/$"]).alias("out"))


@query("SELECT page_id, CASE WHEN url LIKE '%spam-farm%' THEN 'spam' WHEN url LIKE '%/fr/%' THEN 'french' ELSE regexp_extract(url, '^[a-z]+://[^/]*(/[^?#]*)', 1) END AS visit FROM pages")
def visit_keys(spark, sf_dir):
    from ..operators.access import visit_key

    return table(spark, sf_dir, "pages").select("page_id", visit_key(F.col("url"), urls.path(F.col("url")), [("spam-farm", "spam"), ("/fr/", "french")]).alias("visit"))


@query("SELECT kind, count(*) AS n FROM (SELECT CASE WHEN event_type = 'view' THEN 'user/p1/edit' WHEN event_type = 'click' THEN 'post/p1/p1' ELSE 'shop/p1' END AS kind FROM events) GROUP BY kind")
def route_patterns(spark, sf_dir):
    t = F.col("event_type")
    route = F.when(t == "view", urls.django_route(F.lit("/user/<int:pk>/edit"))).when(t == "click", urls.regex_route(F.lit(r"^post/(?P<year>\d+)/(\w+)$"))).otherwise(urls.brace_route(F.lit("//shop//{item:[a-z]+}")))
    return table(spark, sf_dir, "events").groupBy(route.alias("kind")).agg(F.count("*").alias("n"))
