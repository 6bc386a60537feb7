"""How the driver's tables feed the logical inputs, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crawl(spark, sf_dir: str) -> DataFrame:
    """(role, kind, page, role_ord, method, params, value, ts, event_id): an event is a visit of a role to a page."""
    u = F.col("user_id")
    k = F.get_json_object("props", "$.k")
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("u"), u).alias("role"), F.when(u % 10 == 0, "admin").when(u % 10 <= 6, "user").otherwise("visitor").alias("kind"),
        F.concat("event_type", F.lit("/"), k, F.lit("?d="), F.date_format("ts", "yyyy-MM-dd")).alias("page"), u.cast("int").alias("role_ord"),
        F.when(F.col("event_type").isin("purchase", "signup"), "POST").otherwise("GET").alias("method"), k.alias("k"), "value", "ts", "event_id", "event_type",
    )


CRAWL = """c AS (
  SELECT 'u' || user_id AS role, CASE WHEN user_id % 10 = 0 THEN 'admin' WHEN user_id % 10 <= 6 THEN 'user' ELSE 'visitor' END AS kind,
         event_type || '/' || json_extract_string(props, '$.k') || '?d=' || strftime(ts, '%Y-%m-%d') AS page, CAST(user_id AS INT) AS role_ord,
         CASE WHEN event_type IN ('purchase', 'signup') THEN 'POST' ELSE 'GET' END AS method, json_extract_string(props, '$.k') AS k, value, ts, event_id, event_type
  FROM events)"""

MATRIX = (
    CRAWL
    + """,
v AS (SELECT DISTINCT role, kind, page, role_ord, method, k FROM c),
m AS (SELECT page, list_sort(list(DISTINCT kind)) AS kinds, list_sort(list(DISTINCT role)) AS roles, max(method) AS method,
             list(role ORDER BY role_ord, role) FILTER (WHERE kind = 'admin') AS admins, list(role ORDER BY role_ord, role) FILTER (WHERE kind = 'user') AS users
      FROM v GROUP BY page)"""
)


def matrix(spark, sf_dir: str) -> DataFrame:
    from ..operators.access import access_matrix

    visits = crawl(spark, sf_dir).select("role", "kind", "page", "role_ord", "method", "k").distinct()
    requests = visits.select("role", "page", "method", F.create_map(F.lit("id"), F.col("k")).alias("params"), F.lit(None).cast("string").alias("referer"))
    return access_matrix(visits.select("role", "kind", "page", "role_ord"), requests)


def dependency(spark, sf_dir: str) -> DataFrame:
    """Foreign keys as edges from order to customer, nation and region."""
    t = lambda n: table(spark, sf_dir, n)
    edge = lambda d, a, x, b, y: d.select(F.concat(F.lit(a), x).alias("from"), F.concat(F.lit(b), y).alias("to"))
    return edge(t("orders"), "o", "o_orderkey", "c", "o_custkey").union(edge(t("customer"), "c", "c_custkey", "n", "c_nationkey")).union(edge(t("nation"), "n", "n_nationkey", "r", "n_regionkey"))


DEPENDENCY = """dep AS (
  SELECT 'o' || o_orderkey AS a, 'c' || o_custkey AS b FROM orders UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer
  UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation)"""


def responses(spark, sf_dir: str) -> DataFrame:
    """Captured responses: pages with a status, a category, a method and an actor by their id, and texts of denials."""
    i = F.col("page_id")
    pick = lambda n, values: F.element_at(F.array(*map(F.lit, values)), (i % n + 1).cast("int"))
    text = F.when(i % 11 == 3, F.concat(F.lit("<html>Access DENIED here</html>"), F.substring("html", 1, 0))).when(i % 13 == 5, "<html>short</html>").when(i % 17 == 4, "<script>x</script>").when(i % 19 == 6, "<form action=\"/login\"><input type=password></form>").when(i % 23 == 7, "x\n at org.b.C(D.java:1)\n at com.b.E(F.java:2)\n").when(i % 31 == 9, "at jakarta.servlet.ServletException: no").when(i % 37 == 10, "<form action='/portal'><input name=password></form>").when(i % 29 == 8, F.concat(F.lit("Specified thread does not exist. "), F.col("html"))).otherwise(F.col("html"))
    return table(spark, sf_dir, "pages").select(
        "page_id", F.regexp_replace(F.regexp_extract("url", "^[a-z]+://[^/]*(/[^?#]*)", 1), "^/", "").alias("page"), pick(7, [200, 200, 302, 403, 200, 404, 200]).alias("status_code"),
        pick(4, ["admin_only", "authenticated_only", "static_only", "horizontal"]).alias("category"), pick(3, ["GET", "POST", "GET"]).alias("method"), F.when(i % 2 == 0, "u1").alias("actor"), "url",
        F.when(i % 7 == 2, F.create_map(F.lit("Location"), F.when(i % 5 == 0, "http://h/login").otherwise("http://h/done"))).alias("headers"), text.alias("text"),
    )


RESPONSES = r"""r AS (
  SELECT page_id, regexp_replace(regexp_extract(url, '^[a-z]+://[^/]*(/[^?#]*)', 1), '^/', '') AS page,
         [200, 200, 302, 403, 200, 404, 200][page_id % 7 + 1] AS status_code, ['admin_only', 'authenticated_only', 'static_only', 'horizontal'][page_id % 4 + 1] AS category,
         ['GET', 'POST', 'GET'][page_id % 3 + 1] AS method, CASE WHEN page_id % 2 = 0 THEN 'u1' END AS actor, url,
         CASE WHEN page_id % 7 = 2 THEN CASE WHEN page_id % 5 = 0 THEN 'http://h/login' ELSE 'http://h/done' END END AS location,
         CASE WHEN page_id % 11 = 3 THEN '<html>Access DENIED here</html>' WHEN page_id % 13 = 5 THEN '<html>short</html>' WHEN page_id % 17 = 4 THEN '<script>x</script>'
              WHEN page_id % 19 = 6 THEN '<form action="/login"><input type=password></form>' WHEN page_id % 23 = 7 THEN 'x' || chr(10) || ' at org.b.C(D.java:1)' || chr(10) || ' at com.b.E(F.java:2)' || chr(10) WHEN page_id % 31 = 9 THEN 'at jakarta.servlet.ServletException: no' WHEN page_id % 37 = 10 THEN '<form action=''/portal''><input name=password></form>'
              WHEN page_id % 29 = 8 THEN 'Specified thread does not exist. ' || html ELSE html END AS text
  FROM pages),
q AS (
  SELECT *, length(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?is)<script\b.*?</script>', '', 'g'), '(?is)<style\b.*?</style>', '', 'g'), '(?s)<!--.*?-->', '', 'g'), '^\s+|\s+$', '', 'g')) AS len,
         lower(regexp_replace(regexp_replace(text, '(?is)<script\b.*?</script>', '', 'g'), '\s+', ' ', 'g')) AS squeezed,
         text LIKE '% at org.b.C(D.java:1)%' OR text LIKE 'at jakarta.servlet.ServletException%' AS trace
  FROM r),
e AS (
  SELECT *, [x FOR x IN [
    CASE WHEN status_code IN (401, 403) THEN 'HTTP ' || status_code END,
    CASE WHEN location LIKE '%login%' OR location LIKE '%signin%' OR location LIKE '%portal%' THEN 'denial redirect: ' || location END,
    CASE WHEN lower(url) LIKE '%login%' OR lower(url) LIKE '%signin%' OR lower(url) LIKE '%portal%' THEN 'authentication page: ' || url END,
    CASE WHEN lower(text) LIKE '%access denied%' THEN 'denial marker: access denied' WHEN lower(text) LIKE '%not allowed%' THEN 'denial marker: not allowed' END,
    CASE WHEN text LIKE '<form action="/login">%' OR text LIKE '<form action=''/portal''>%' THEN 'login form in response' END,
    CASE WHEN trace THEN 'exception trace in response body' END,
    CASE WHEN NOT trace AND len = 0 AND status_code = 200 THEN 'empty response body' END] IF x IS NOT NULL] AS evidence
  FROM q)"""
