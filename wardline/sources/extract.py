"""Facts from source texts (path, code): dependency edges and routes.

PHP, Java and Go are read by pattern, Python by its own parser in Arrow batches. Grammars that are not installed here are
not imitated: what needs a full syntax tree enters the engine as record tables (see ``operators.entities.validate``).
"""

from __future__ import annotations

import ast
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls
from ..operators.entities import first_match
from ..operators.graph import checkpointed

#: Shares of the files that import one package, so that a package of all files is not joined in one task.
SHARES = 8


def spread(sources: DataFrame) -> DataFrame:
    """The files dealt over tasks by path. A table of many short files is few bytes, hence few tasks, and parsing costs far more
    than reading; the number is explicit, since by bytes the tasks would be put together again."""
    return sources.repartition(int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path")


def folder(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*/)", 1)


def normalised(path: Column) -> Column:
    """Without empty and single-dot segments; a double dot takes the segment before it along."""
    parts = F.filter(F.split(path, "/"), lambda p: ~p.isin("", "."))
    return F.array_join(F.aggregate(parts, F.expr("CAST(array() AS array<string>)"), lambda a, p: F.when(p == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.array_append(a, p))), "/")


def _listed(sources: DataFrame, found: Column) -> DataFrame:
    return spread(sources).select("path", F.explode(F.array_distinct(found)).alias("target"))


def php_includes(sources: DataFrame) -> DataFrame:
    """(path, target) of include and require statements with a literal; a leading __DIR__ or dirname goes."""
    call = r"(?i)\b(?:include|require)(?:_once)?\s*\(?\s*(?:(?:__DIR__|dirname\s*\(\s*__FILE__\s*\))\s*\.\s*)?[\"']([^\"'$]+)[\"']"
    return _listed(sources, F.regexp_extract_all("code", F.lit(call), F.lit(1)))


def java_imports(sources: DataFrame) -> DataFrame:
    """(path, target) of imports, as a path without extension, and of JSP includes, as given."""
    imports = F.transform(F.regexp_extract_all("code", F.lit(r"(?m)^\s*import\s+(?:static\s+)?([\w.]+)\s*;"), F.lit(1)), lambda x: F.concat(F.replace(x, F.lit("."), F.lit("/")), F.lit(".java")))
    pages = F.regexp_extract_all("code", F.lit(r"(?i)<(?:%@\s*include\s+file|jsp:include\s+page)\s*=\s*[\"']([^\"'?]+)"), F.lit(1))
    return _listed(sources, F.concat(imports, pages))


def go_imports(sources: DataFrame) -> DataFrame:
    """(path, target) of imported packages, single or in a block."""
    block = F.array_join(F.regexp_extract_all("code", F.lit(r"(?s)\bimport\s*\((.*?)\)"), F.lit(1)), "\n")
    quoted = F.regexp_extract_all(block, F.lit(r"\"([^\"]+)\""), F.lit(1))
    return _listed(sources, F.concat(quoted, F.regexp_extract_all("code", F.lit(r"(?m)^\s*import\s+(?:\w+\s+)?\"([^\"]+)\""), F.lit(1))))


def resolved_edges(found: DataFrame, files: DataFrame) -> DataFrame:
    """(from, to) of relative targets: beside the file first, then from the root. ``files`` has path."""
    rows = found.distinct().select(F.struct("path", "target").alias("id"), "path", F.array(normalised(F.concat(folder(F.col("path")), "target")), normalised(F.col("target"))).alias("candidates"))
    known = files.select(F.col("path").alias("spelling"), F.col("path").alias("to")).hint("merge")
    return first_match(rows, known, "id", "candidates", "to").where("`to` IS NOT NULL").select(F.col("path").alias("from"), "to").distinct()


def package_edges(found: DataFrame, files: DataFrame) -> DataFrame:
    """(from, to) of packages: every file of the folder whose path ends a package's. Folders meet packages by their tails.

    A file lies in one folder, so that distinct tails and distinct files give distinct edges: these are never compared. Both
    sides are dealt by an explicit number, as edges are many times their bytes, and importers in shares."""
    n = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = files.select(F.col("path").alias("to"), F.regexp_replace(folder(F.col("path")), "/$", "").alias("dir")).where("dir <> ''").distinct()
    at = at.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1)))).repartition(n, "dir", "share")
    tails = found.select(F.col("path").alias("from"), F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("target", "/"))), lambda k: F.array_join(F.slice(F.split("target", "/"), -k, k), "/"))).alias("dir")).distinct()
    tails = tails.withColumn("share", F.pmod(F.hash("from"), F.lit(SHARES))).repartition(n, "dir", "share")
    return tails.join(at.hint("merge"), ["dir", "share"]).select("from", "to").where("`from` <> `to`")


def nested_routes(sources: DataFrame) -> DataFrame:
    """(path, url, handler) of Go routers with nested groups: a route's prefix is that of the groups whose braces are open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import re

        token = re.compile(r"\.(Route|Group|Mount)\s*\(\s*(?:\"([^\"]*)\")?|\.(Get|Post|Put|Patch|Delete|GET|POST|PUT|PATCH|DELETE|Handle|HandleFunc)\s*\(\s*\"([^\"]*)\"\s*,\s*([\w.]+)|[{}]|\"(?:[^\"\\]|\\.)*\"|`[^`]*`|//[^\n]*")
        for b in batches:
            rows = []
            for path, code in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                depth, prefixes, waiting = 0, [], None
                for m in token.finditer(code or ""):
                    if m[1]:
                        waiting = m[2] or ""
                    elif m[3]:
                        rows.append((path, "".join(p for _, p in prefixes) + m[4], m[5]))
                    elif m[0] == "{":
                        depth += 1
                        if waiting is not None:
                            prefixes.append((depth, waiting))
                            waiting = None
                    elif m[0] == "}":
                        if prefixes and prefixes[-1][0] == depth:
                            prefixes.pop()
                        depth -= 1
            yield pa.record_batch([pa.array([r[c] for r in rows], pa.string()) for c in range(3)], ["path", "url", "handler"])

    return spread(sources.select("path", "code")).mapInArrow(run, "path string, url string, handler string").withColumn("url", urls.brace_route(F.col("url")))


#: Nodes without facts and with none below them, and fields that hold no others: most of a tree, never visited.
_PLAIN = frozenset((ast.Name, ast.Constant, ast.alias, ast.Pass, ast.Break, ast.Continue, ast.Global, ast.Nonlocal, type(None), str, int))
_BELOW = {k: tuple(f for f in k._fields if f not in ("ctx", "op", "ops", "id", "attr", "type_comment", "type_ignores")) for k in vars(ast).values() if isinstance(k, type) and issubclass(k, ast.AST)}
#: What a tuple's second item may be.
_HANDLERS = (ast.Name, ast.Attribute, ast.Call)


def _python_facts(path: str, code: str) -> list[tuple[str, str, str, str]]:
    """(path, kind, name, value): imports as candidate files, routes with their handlers; nothing of a file that does not parse."""
    try:
        tree = ast.parse(code)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    package = path.split("/")[:-1]
    out, met = [], deque([tree])
    text = lambda n: n.value if isinstance(n, ast.Constant) and isinstance(n.value, str) else None
    while met:
        node = met.popleft()
        kind = type(node)
        for field in _BELOW[kind]:
            below = getattr(node, field, None)
            if type(below) is list:
                for x in below:
                    if type(x) not in _PLAIN:
                        met.append(x)
            elif type(below) not in _PLAIN:
                met.append(below)
        if kind is ast.Import:
            out += [(path, "import", a.asname or a.name, a.name.replace(".", "/")) for a in node.names]
        elif kind is ast.ImportFrom:
            base = package[: len(package) - node.level + 1] if node.level else []
            module = [*base, *(node.module or "").split(".")] if node.module else base
            for a in node.names:
                out += [(path, "import", a.asname or a.name, "/".join([*module, a.name])), (path, "import", a.asname or a.name, "/".join(module))]
        elif kind is ast.FunctionDef or kind is ast.AsyncFunctionDef:
            for d in node.decorator_list:
                if isinstance(d, ast.Call) and isinstance(d.func, ast.Attribute) and d.func.attr in ("route", "get", "post", "put", "delete", "patch") and d.args and (url := text(d.args[0])) is not None:
                    out.append((path, "route", url, node.name))
        elif kind is ast.Call:
            if getattr(node.func, "id", getattr(node.func, "attr", "")) in ("path", "re_path", "url") and len(node.args) > 1 and (url := text(node.args[0])) is not None:
                out.append((path, getattr(node.func, "id", "path"), url, ast.unparse(node.args[1])))
        elif kind is ast.Tuple:
            if len(node.elts) > 1 and (url := text(node.elts[0])) is not None and isinstance(node.elts[1], _HANDLERS):
                out.append((path, "tuple", url, ast.unparse(node.elts[1])))
    return out


def python_facts(sources: DataFrame) -> DataFrame:
    """(path, kind, name, value) of Python files: ``import`` rows (bound name, file without extension) and route rows (``route``,
    ``path``, ``re_path``, ``url``, ``tuple``: pattern, handler), with their order in the file as ``at``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(*r, i) for p, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for i, r in enumerate(_python_facts(p or "", c or ""))]
            yield pa.record_batch([pa.array([r[c] for r in rows], pa.string() if c < 4 else pa.int32()) for c in range(5)], ["path", "kind", "name", "value", "at"])

    return spread(sources.select("path", "code")).mapInArrow(run, "path string, kind string, name string, value string, at int")


def python_edges(facts: DataFrame, files: DataFrame) -> DataFrame:
    """(from, to) of imports: the module's file, or its package's __init__."""
    imports = facts.where("kind = 'import' AND value <> ''").select("path", "value").distinct()
    known = files.select(F.regexp_replace("path", r"(/__init__)?\.py$", "").alias("value"), F.col("path").alias("to"))
    return imports.join(known.hint("merge"), "value").select(F.col("path").alias("from"), "to").where("`from` <> `to`").distinct()


def python_routes(facts: DataFrame) -> DataFrame:
    """(path, url, handler) with parameters folded."""
    plain = F.regexp_replace(urls.django_route(F.col("name")), "^/+", "")
    url = F.when(F.col("kind").isin("re_path", "url"), urls.regex_route(F.col("name"))).otherwise(plain)
    return facts.where("kind NOT IN ('import', 'tuple')").select("path", url.alias("url"), F.col("value").alias("handler"))


def view_sources(facts: DataFrame, files: DataFrame) -> DataFrame:
    """(path, url, source): the file that answers a route. Of a dotted handler, or of what is called to make one, the longest
    beginning that the file imports leads to the imported module's file, of a package's name to its own module first; a
    decorated function, and a handler that leads nowhere, are of the route's own file. A route in a plain tuple is a pattern
    that looks like one, and counts only with a file. Of equal urls of a file a tuple goes before a call, a call before a
    decorator, then the last.

    Files are parsed once. Facts are many times the bytes they are estimated at: no side is sent to all tasks."""
    facts = checkpointed(facts.where("kind <> 'import' OR value <> ''"))
    plain = F.regexp_replace(urls.django_route(F.col("name")), "^/+", "")
    url = F.when(F.col("kind").isin("re_path", "url", "tuple"), urls.regex_route(F.col("name"))).otherwise(plain)
    routes_ = facts.where(r"kind <> 'import' AND (kind <> 'tuple' OR name RLIKE '^\\s*\\^|\\$\\s*$|/')").select("path", "kind", "at", url.alias("url"), F.split(F.regexp_extract("value", r"^[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)*", 0), r"\.").alias("steps"))
    named = routes_.where("kind <> 'route'").select("path", "at", F.posexplode(F.transform(F.sequence(F.lit(1), F.size("steps")), lambda k: F.array_join(F.slice("steps", F.lit(1), k), "."))).alias("n", "name"))
    known = files.select(F.regexp_replace("path", r"(/__init__)?\.py$", "").alias("value"), F.col("path").alias("to"))
    imports = facts.where("kind = 'import'").select("path", "name", "value").distinct().join(known.hint("merge"), "value")
    best = named.join(imports.hint("merge"), ["path", "name"]).groupBy("path", "at").agg(F.max_by("to", F.struct("n", F.length("value").alias("long"), "to")).alias("found"))
    met = routes_.join(best.hint("merge"), ["path", "at"], "left").where("kind <> 'tuple' OR found IS NOT NULL").where("coalesce(url, '') <> ''")
    rank = F.struct(F.when(F.col("kind") == "tuple", 2).when(F.col("kind") == "route", 0).otherwise(1).alias("kind"), "at")
    return met.groupBy("path", "url").agg(F.max_by(F.coalesce("found", "path"), rank).alias("source"))


def java_routes(sources: DataFrame) -> DataFrame:
    """(path, url, handler) of servlets by annotation: each pattern of ``value`` or ``urlPatterns``, with the class below it."""
    servlet = F.lit(r"@WebServlet\s*\(((?:[^()]|\([^()]*\))*)\)\s*(?:(?:@\w+(?:\([^()]*\))?|public|final|abstract)\s+)*class\s+(\w+)")
    found = F.arrays_zip(F.regexp_extract_all("code", servlet, F.lit(1)).alias("given"), F.regexp_extract_all("code", servlet, F.lit(2)).alias("handler"))
    rows = sources.select("path", F.explode(found).alias("x")).select("path", "x.given", "x.handler")
    plain = F.regexp_replace("given", r"@\w+\s*\([^()]*\)", "")
    patterns = F.regexp_replace(plain, r"\b(?!(?:value|urlPatterns)\b)\w+\s*=\s*(?:\"[^\"]*\"|\{[^}]*\}|\w+)", "")
    return rows.select("path", F.explode(F.array_distinct(F.regexp_extract_all(patterns, F.lit(r"\"([^\"]*)\""), F.lit(1)))).alias("url"), "handler").withColumn("url", urls.brace_route(F.col("url")))


def routes(sources: DataFrame) -> DataFrame:
    """(path, url, handler) of a tree in several languages: each file by the rules of its extension; others have none."""
    of = lambda ending: sources.where(F.lower("path").endswith(ending))
    return python_routes(python_facts(of(".py"))).unionByName(nested_routes(of(".go"))).unionByName(java_routes(of(".java")))


def sql_predicates(statements: DataFrame) -> DataFrame:
    """(id, pos, table, field) of the placeholders in WHERE clauses of SQL texts (id, sql), by place."""
    name = F.lower(F.regexp_extract("sql", r"(?i)\b(?:from|update|into)\s+[`\"]?(\w+)", 1))
    where = F.regexp_extract("sql", r"(?is)\bwhere\b(.*)$", 1)
    fields = F.regexp_extract_all(where, F.lit(r"(?i)[`\"]?(?:\w+\.)?(\w+)[`\"]?\s*(?:=|<>|!=|like|in\s*\()\s*(?:\?|%s|\$\d+|:\w+)"), F.lit(1))
    return statements.select("id", name.alias("table"), F.posexplode(fields).alias("pos", "field"))
