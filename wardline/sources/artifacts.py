"""Readers and writers of run artifacts: crawls, vectors, findings, snippets, repairs, metrics, source trees, captures."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas

#: Source extensions by language, and folders that hold no source of the application.
EXTENSIONS = {"php": (".php",), "python": (".py",), "go": (".go",), "java": (".java", ".jsp"), "jsp": (".java", ".jsp")}
SKIPPED = (".git", "node_modules", "vendor", "venv", ".venv")


# ---------------------------------------------------------------- configuration (driver side)


@dataclass
class Role:
    name: str
    kind: str


@dataclass
class Config:
    base_url: str
    source_root: str
    language: str
    roles: list[Role]
    sections: dict = field(default_factory=dict)


def resolve_secrets(value):
    """``env:NAME`` strings, at any depth, become the variable's value; an unset one is an error."""
    if isinstance(value, dict):
        return {k: resolve_secrets(v) for k, v in value.items()}
    if isinstance(value, list):
        return [resolve_secrets(v) for v in value]
    if isinstance(value, str) and value.startswith("env:"):
        name = value[4:]
        if name not in os.environ:
            raise ValueError(f"environment variable {name} is not set")
        return os.environ[name]
    return value


def load_config(path: str) -> Config:
    """Read and check a JSON configuration; the source folder is relative to the file."""
    with open(path, encoding="utf-8-sig") as f:
        raw = resolve_secrets(json.load(f))
    target = raw["target"]
    root = os.path.normpath(os.path.join(os.path.dirname(os.path.abspath(path)), target["source_root"]))
    made = Config(target["base_url"], root, target.get("language", "php"), [Role(r["name"], r.get("kind", "user")) for r in raw.get("roles", [])], raw)
    return validated(made)


def validated(config: Config) -> Config:
    names = [r.name for r in config.roles]
    if not names or len(set(names)) != len(names):
        raise ValueError("role names must be given and unique")
    if any(r.kind not in schemas.KINDS for r in config.roles):
        raise ValueError(f"role kinds are {', '.join(schemas.KINDS)}")
    if config.language not in EXTENSIONS:
        raise ValueError(f"unsupported language {config.language}")
    if config.sections.get("crawl", {}).get("mode", "artifacts") != "artifacts":
        raise ValueError("only recorded crawls are read")
    return config


# ---------------------------------------------------------------- readers


def read_crawls(spark: SparkSession, path: str, roles: list[Role] | None = None) -> DataFrame:
    """One row a role; the row order of roles is the configured one, else by name. A kind that differs from the configuration
    fails the job."""
    crawls = spark.read.schema(schemas.ROLE_CRAWL).json(path, multiLine=True).where(~F.coalesce(F.input_file_name(), F.lit("")).endswith(".partial.json"))
    if roles is None:
        from pyspark.sql import Window as W

        return crawls.withColumn("role_ord", F.row_number().over(W.orderBy("role")) - 1)  # one row a role: few
    known = spark.createDataFrame([(r.name, r.kind, i) for i, r in enumerate(roles)], "role string, want string, role_ord int")
    joined = crawls.join(F.broadcast(known), "role")  # the configured roles: a handful
    return joined.where(F.assert_true(joined["kind"] == joined["want"], "a crawl's kind differs from its role's").isNull()).drop("want")


def crawl_nodes(crawls: DataFrame) -> DataFrame:
    return crawls.select("role", "kind", "role_ord", F.explode("nodes").alias("page"))


def crawl_edges(crawls: DataFrame) -> DataFrame:
    return crawls.select("role", F.explode("edges").alias("e")).select("role", F.col("e.from").alias("from"), F.col("e.to").alias("to"))


def crawl_requests(crawls: DataFrame) -> DataFrame:
    return crawls.select("role", F.explode("requests").alias("page", "r")).select("role", "page", F.upper(F.coalesce("r.method", F.lit("GET"))).alias("method"), F.coalesce("r.params", F.expr("map()").cast("map<string,string>")).alias("params"), F.col("r.referer").alias("referer"))


def read_json(spark: SparkSession, path: str, schema) -> DataFrame:
    """Rows of JSON files that hold one array or object each."""
    return spark.read.schema(schema).json(path, multiLine=True)


def write_json(df: DataFrame, path: str) -> None:
    """Whole files or none: Spark's committer renames finished attempts."""
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def read_sources(spark: SparkSession, root: str, language: str, skip: tuple[str, ...] = SKIPPED) -> DataFrame:
    """(path, code) of a source tree: files of the language's extensions, none below a skipped folder. Files are split over
    tasks and decoded there; undecodable bytes are replaced."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    relative = F.regexp_replace(F.replace(F.col("path"), F.lit(spark._jvm.org.apache.hadoop.fs.Path(root).toUri().getPath().rstrip("/") + "/"), F.lit("\n")), r"(?s)^.*\n", "")
    kept = files.select(relative.alias("path"), F.decode("content", "utf-8").alias("code"))
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    return kept.where(suffix.isin(*EXTENSIONS[language]) & ~F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, skip))))


def network_requests(logs: DataFrame, base: str, message: str = "message") -> DataFrame:
    """Requests of a browser's performance log: sent documents, frames, fetches and XHRs over http."""
    schema = "message struct<method: string, params: struct<type: string, request: struct<url: string, method: string, postData: string>>>"
    m = F.from_json(message, schema).message
    rows = logs.withColumn("m", m).where((F.col("m.method") == "Network.requestWillBeSent") & F.col("m.params.type").isin("Document", "Iframe", "Fetch", "XHR"))
    return rows.select(*logs.columns, F.col("m.params.request.url").alias("url"), F.upper(F.col("m.params.request.method")).alias("method"), F.col("m.params.request.postData").alias("body")).where(F.startswith("url", F.lit(base)))


def capture_table(spark: SparkSession, url: str, name: str, **options) -> DataFrame:
    """A table of a live database, over JDBC."""
    return spark.read.format("jdbc").options(url=url, dbtable=name, **options).load()


def scalar(spark: SparkSession, sql: str) -> str:
    """First column of the first row as text, empty without a row or value."""
    row = spark.sql(sql).limit(1).collect()
    return "" if not row or row[0][0] is None else str(row[0][0])


def servlet_routes(web_xml: DataFrame) -> DataFrame:
    """(path, url, class) of web.xml texts (path, code): servlet names joined with their mappings inside each file."""
    tag = lambda name: rf"(?s)<{name}>\s*(.*?)\s*</{name}>"
    block = lambda name: F.explode(F.regexp_extract_all("code", F.lit(rf"(?s)<{name}>.*?</{name}>"), F.lit(0)))
    one = lambda c, name: F.regexp_extract(c, tag(name), 1)
    servlets = web_xml.select("path", block("servlet").alias("b")).select("path", one("b", "servlet-name").alias("servlet"), one("b", "servlet-class").alias("class"))
    mapped = web_xml.select("path", block("servlet-mapping").alias("b")).select("path", one("b", "servlet-name").alias("servlet"), F.explode(F.regexp_extract_all("b", F.lit(tag("url-pattern")), F.lit(1))).alias("url"))
    return mapped.join(servlets, ["path", "servlet"]).select("path", F.regexp_replace("url", "^/+", "").alias("url"), "class")


#: Literals that speak of a denial by their text, and keys that name one.
DENIAL_WORDS = (
    r"(?i)(?:do not have permission|don't have permission|do not have access|don't have access|must be logged in|not logged in|please enter your username and password|"
    r"invalid administration session|username and password combination|access denied|not authorized|permission denied|no permission|forbidden|login failed|email or password|username or password|"
    r"direct initialization of this file is not allowed|hacking attempt|you are not authorized|bad referer|invalid username or password|你没有权限|没有权限|无权访问|未授权|请登录|需要登录|登录失败|用户名或密码)"
)
#: A literal between quotes of one kind; one that ends a program may hold the other kind.
_LITERAL = r"([\"'])([^\"']{3,240})\1"
_ENDING = r"(?is)(?:\b(?:die|exit)\s*\(\s*|\becho\s+)([\"'])((?:(?!\1).)*)\1"


def denial_markers(sources: DataFrame) -> DataFrame:
    """(marker, folded): literals of (path, code) that announce a denial, one for each folded text, the first by path and place."""
    from ..functions.html import denial_message

    found = F.concat(*[F.regexp_extract_all("code", F.lit(p), F.lit(2)) for p in (_ENDING, f"(?s){_LITERAL}")])
    rows = sources.select("path", F.posexplode(found).alias("pos", "raw")).withColumn("marker", denial_message(F.col("raw"))).where(F.rlike("marker", F.lit(DENIAL_WORDS)))
    return rows.groupBy(F.lower("marker").alias("folded")).agg(F.min_by("marker", F.struct("path", "pos")).alias("marker"))


def schema_fields(dumps: DataFrame) -> DataFrame:
    """(path, table, field, enum_values) of the CREATE TABLE statements of SQL texts (path, code): one row for each quoted column."""
    table = r"(?is)create\s+table\s+(?:if\s+not\s+exists\s+)?[`\"]?([A-Za-z_]\w*)[`\"]?\s*\((.*?)\)\s*(?:engine|;)"
    each = dumps.select("path", F.explode(F.regexp_extract_all("code", F.lit(table), F.lit(0))).alias("b"))
    lines = each.select("path", F.regexp_extract("b", table, 1).alias("table"), F.explode(F.split(F.regexp_extract("b", table, 2), r"\r?\n")).alias("line"))
    column = r"(?i)^\s*[`\"]([A-Za-z_]\w*)[`\"]\s+(.+)$"
    field, definition = F.regexp_extract("line", column, 1), F.regexp_extract("line", column, 2)
    enums = F.regexp_extract_all(F.regexp_extract(definition, r"(?is)\benum\s*\((.*?)\)", 1), F.lit(r"'((?:\\'|[^'])*)'"), F.lit(1))
    return lines.where(field != "").select("path", "table", field.alias("field"), enums.alias("enum_values"))


def safe_path(relative):
    """A relative path with its dot segments taken out; null where it leads out of the root, is absolute or empty."""
    parts = F.filter(F.split(F.replace(relative, F.lit("\\"), F.lit("/")), "/"), lambda x: ~x.isin("", "."))
    start = F.struct(F.expr("CAST(array() AS array<string>)").alias("kept"), F.lit(True).alias("inside"))
    step = lambda a, x: F.struct(F.when(x == "..", F.slice(a["kept"], 1, F.greatest(F.size(a["kept"]) - 1, F.lit(0)))).otherwise(F.concat(a["kept"], F.array(x))).alias("kept"), (a["inside"] & ~((x == "..") & (F.size(a["kept"]) == 0))).alias("inside"))
    walked = F.aggregate(parts, start, step)
    return F.when(walked["inside"] & (F.size(walked["kept"]) > 0) & ~F.startswith(relative, F.lit("/")), F.array_join(walked["kept"], "/"))
