"""Expressions on code, names and small texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalized_code(code: Column) -> Column:
    """LF line ends, lines trimmed at the right, outer white space dropped."""
    lines = F.regexp_replace(F.regexp_replace(F.coalesce(code, F.lit("")), r"\r\n?", "\n"), r"(?m)[ \t\f\x0B]+$", "")
    return F.regexp_replace(lines, r"(?s)^\s+|\s+$", "")


def normalized_name(name: Column) -> Column:
    """Case folded, double quotes as single ones, without white space and leading dollars."""
    return F.regexp_replace(F.regexp_replace(F.replace(F.lower(F.coalesce(name, F.lit(""))), F.lit('"'), F.lit("'")), r"\s+", ""), r"^\$+", "")


def name_variants(name: Column) -> Column:
    """The normalised name, and for plain dotted names the last part."""
    n = normalized_name(name)
    last = normalized_name(F.substring_index(n, ".", -1))
    dotted = F.contains(n, F.lit(".")) & ~F.contains(n, F.lit("[")) & ~F.contains(n, F.lit("->"))
    return F.array_sort(F.array_distinct(F.filter(F.when(dotted, F.array(n, last)).otherwise(F.array(n)), lambda x: x != "")))


def semantic_key(name: Column) -> Column:
    """What parameters are one by: the last dotted part, but whole for indexes, arrows and the request's user."""
    n = normalized_name(name)
    whole = F.contains(n, F.lit("[")) | F.contains(n, F.lit("->")) | (n == "request.user") | F.startswith(n, F.lit("request.user.")) | ~F.contains(n, F.lit("."))
    return F.when(whole, n).otherwise(normalized_name(F.substring_index(n, ".", -1)))


def simple_function_name(name: Column) -> Column:
    """The last part after ::, -> and dots."""
    for mark in ("::", "->", "."):
        name = F.substring_index(name, mark, -1)
    return F.trim(name)


def state_gate(condition: Column) -> Column:
    """(variable, value) of a condition on one flag: $x, !$x, $x == true and the like; null otherwise."""
    plain = F.regexp_extract(condition, r"^\s*(!?)\s*(\$\w+)\s*$", 2)
    negated = F.regexp_extract(condition, r"^\s*(!?)\s*(\$\w+)\s*$", 1) == "!"
    compared = r"(?i)^\s*(\$\w+)\s*(===?|!==?)\s*(true|false|1|0)\s*$"
    name, op, value = (F.regexp_extract(condition, compared, i) for i in (1, 2, 3))
    truth = F.lower(value).isin("true", "1") == F.startswith(op, F.lit("="))
    return F.when(plain != "", F.struct(plain.alias("name"), (~negated).alias("value"))).when(name != "", F.struct(name.alias("name"), truth.alias("value")))


def if_framework(language: Column, condition: Column, statements: Column) -> Column:
    """The bare branch of a check: its condition and the statements that end it."""
    head = F.when(language == "python", F.concat(F.lit("if "), condition, F.lit(":\n"))).when(language == "go", F.concat(F.lit("if "), condition, F.lit(" {\n"))).otherwise(F.concat(F.lit("if ("), condition, F.lit(") {\n")))
    body = F.array_join(F.transform(statements, lambda s: F.concat(F.lit("    "), F.trim(s))), "\n")
    return F.concat(head, body, F.when(language == "python", "").otherwise("\n}"))


#: Texts that announce a denial, by language.
DENIAL_TEXT = {
    "php": r"(?i)access\s+denied|permission\s+denied|unauthori[sz]ed|forbidden|don't\s+have\s+access|must\s+be\s+logged|not\s+allowed|login\s+required|authentication\s+required",
    "java": r"(?i)\b(?:access|permission|authentication|authorization)\s+(?:denied|required|failed)\b|\b(?:forbidden|unauthori[sz]ed|securityexception|accessdenied|login|log[_ ]?in|sign[_ ]?in)\b",
    "python": r"(?i)\b(?:access|permission|authentication|authorization)\s+(?:denied|required|failed)\b|\b(?:forbidden|unauthori[sz]ed|not[_ ]authenticated|not[_ ]authorized)\b|\b(?:login|log[_ ]?in|sign[_ ]?in)\b",
    "go": r"(?i)\b(?:access|permission|authentication|authorization)\s+(?:denied|required|failed)\b|\b(?:forbidden|unauthori[sz]ed|login|log[_ ]?in|sign[_ ]?in)\b",
}
#: Names of calls that deny, and of those that do so whatever their arguments say.
DENIAL_CALL = {
    "python": r"(?i)(?:^|\.)(?:abort|redirect|permissiondenied|http404|httpresponseforbidden|forbidden|unauthorized|deny|exit|quit)$",
    "go": r"(?i)(?:^|\.)(?:Error|Redirect|Abort|AbortWithStatus|AbortWithStatusJSON|Forbidden|Unauthorized|Panic|Fatal|Fatalf)$",
}
PLAIN_DENIAL = {
    "python": r"(?i)(?:^|\.)(?:PermissionDenied|HttpResponseForbidden|Forbidden|Unauthorized|Deny)$",
    "go": r"(?i)(?:^|\.)(?:Forbidden|Unauthorized|AbortWithStatus(?:JSON)?)$",
}
#: Statements that deny by themselves, as (kind, pattern), and those that do so with a text of denial.
_GATE = r"(?:login|log[_-]?in|signin|auth|denied|forbidden|unauthor)"
DENYING = {
    "php": (
        ("", r"(?i)\b(?:mysql|mysqli|pg|sqlite)[A-Za-z_]*_?error\s*\("),
        ("redirect", rf"(?is)\bheader\s*\([^)]*location\s*:[^)]*{_GATE}"),
        ("redirect", rf"(?is)(?:<meta[^>]+http-equiv\s*=\s*['\"]?refresh|window\.location|location\.href).*{_GATE}"),
        ("http_denial", r"(?i)\bhttp_response_code\s*\(\s*40[13]\s*\)"),
        ("redirect", r"(?is)\b(?:http_redirect|wp_redirect|dvwaredirect)\s*\([^;]*(?:login|auth|denied|forbidden|unauthor)"),
        ("denial_output", DENIAL_TEXT["php"]),
        ("exception", r"(?is)^\s*throw\b.*(?:permission|forbidden|unauthori[sz]ed|access|security|auth)"),
    ),
    "java": (("http_denial", r"(?i)\b(?:sendError|setStatus)\s*\(\s*(?:40[13]|HttpServletResponse\.SC_(?:UNAUTHORIZED|FORBIDDEN))"),),
    "python": (("http_denial", r"(?i)\b(?:status(?:_code)?\s*=\s*40[13]|HTTPStatus\.(?:UNAUTHORIZED|FORBIDDEN))\b"), ("http_denial", r"(?i)^[^(]*\babort\s*\(\s*40[13]")),
    "go": (("http_denial", r"\b(?:StatusForbidden|StatusUnauthorized|StatusProxyAuthRequired)\b"),),
}
DENYING_WITH_TEXT = {
    "php": (),
    "java": (("exception", r"^\s*throw\b"), ("execution_termination", r"\bSystem\s*\.\s*exit\s*\("), ("redirect", r"\bsendRedirect\s*\("), ("redirect", r"\.forward\s*\(")),
    "python": (("exception", r"^\s*raise\b"),),
    "go": (),
}
#: Statements that end a branch, which deny where the context matches a configured pattern.
ENDING = {
    "php": r"(?is)\b(?:die|exit)\s*(?:\(|;)|\breturn\s+[^;]+;|\b(?:header|http_redirect|wp_redirect|dvwaredirect)\s*\(|<meta[^>]+http-equiv\s*=\s*['\"]?refresh|window\.location|location\.href|^\s*throw\b",
    "java": r"(?is)^\s*(?:return|throw)\b|\b(?:sendRedirect|sendError|forward|System\s*\.\s*exit)\s*\(",
    "python": r"(?is)^\s*(?:return|raise)\b|\b(?:redirect|abort|exit|quit)\s*\(",
    "go": r"(?i)^\s*return\b",
}


def termination_kind(language: Column, code: Column, configured: tuple[str, ...] = (), context: Column | None = None) -> Column:
    """How a statement denies access, or null: the first rule of its language that fits. A failure of the database is none.

    ``configured`` patterns count as denials in the statement itself, and in ``context`` where the statement ends the branch.
    """
    test = lambda c, p: F.rlike(c, F.lit(p))
    called = F.regexp_extract(code, r"\b([A-Za-z_]\w*(?:\.[A-Za-z_]\w*)*)\s*\(", 1)
    listed = lambda c: F.exists(F.array(*map(F.lit, configured)), lambda p: F.rlike(c, F.concat(F.lit("(?is)"), p))) if configured else F.lit(False)
    out = F.lit(None).cast("string")
    for name, text in DENIAL_TEXT.items():
        rules = [(test(code, p) & test(code, text), kind) for kind, p in DENYING_WITH_TEXT[name]]
        plain = [(test(code, p), kind) for kind, p in DENYING[name]]
        rules = rules + plain if name == "java" else plain + rules
        if name in DENIAL_CALL:
            denies = test(called, DENIAL_CALL[name]) & (test(called, PLAIN_DENIAL[name]) | test(code, text))
            redirect = F.contains(F.lower(code), F.lit("redirect")) if name == "python" else F.endswith(F.lower(called), F.lit("redirect"))
            rules += [(denies & redirect, "redirect"), (denies, "denial")]
        if name == "python":
            rules.append((test(code, r"(?i)\b(?:sys\.)?(?:exit|quit)\s*\(") & test(code, text), "execution_termination"))
        ends = test(code, ENDING[name]) | (test(called, DENIAL_CALL["go"]) if name == "go" else F.lit(False))
        rules += [(listed(code), "configured_denial"), (listed(context) & ends if context is not None else F.lit(False), "configured_denial")]
        own = F.lit(None).cast("string")
        for fits, kind in reversed(rules):
            own = F.when(fits, F.lit(kind or None).cast("string")).otherwise(own)
        out = F.when(language == name, own).otherwise(out)
    return out


def returns_boolean(expression: Column) -> Column:
    return F.rlike(F.trim(expression), F.lit(r"(?i)^(?:true|false|!.+|isset\s*\(.*\)|empty\s*\(.*\)|.+(?:===?|!==?|<=?|>=?|&&|\|\|).+)$"))


def boolean_return(statement: Column) -> Column:
    """Whether a return statement's value is a boolean by its form: a literal, a test for presence, or a comparison."""
    value = F.trim(F.regexp_replace(F.regexp_replace(F.trim(statement), r";+\s*$", ""), r"(?i)^return", ""))
    return F.rlike(value, F.lit(r"(?is)^[(\s]*(?:true|false)[)\s]*$|^[(\s]*(?:!\s*)?(?:isset|empty)\s*\(|===?|!==?|<=|>=|<|>"))


def synthetic_value(name: Column, kind: Column) -> Column:
    """A value for a form field by its type and name; else a text from the name's hash."""
    n = F.lower(name)
    tail = F.substring(F.sha2(n, 256), 1, 8)
    return (
        F.when(F.rlike(n, F.lit("mail")) | (kind == "email"), F.concat(F.lit("user_"), tail, F.lit("@example.com")))
        .when(kind == "number", "1").when(kind == "date", "2024-01-01").when(kind.isin("checkbox", "radio"), "on")
        .when(F.rlike(n, F.lit("url|link|website")) | (kind == "url"), "http://example.com/")
        .when(F.rlike(n, F.lit("phone|tel")) | (kind == "tel"), "5550100")
        .otherwise(F.concat(F.lit("text_"), tail))
    )


def digest(text: Column) -> Column:
    """Twelve hex digits that name an artifact."""
    return F.substring(F.sha2(text, 256), 1, 12)


def json_of_answer(answer: Column) -> Column:
    """The JSON of a model's answer: without a code fence, else between the outer braces; null if neither parses."""
    bare = F.trim(F.regexp_replace(F.trim(answer), r"(?s)^```(?:json)?\s*|\s*```$", ""))
    inner = F.regexp_extract(bare, r"(?s)(\{.*\})", 1)
    valid = lambda c: F.when(F.try_parse_json(c).isNotNull(), c)
    return F.coalesce(valid(bare), valid(inner))


PAGE_TYPES = {"admin_only": "administrator page", "authenticated_only": "page of signed-in users", "horizontal": "page of one user's data", "vertical": "operation of administrators", "static_only": "page without navigation"}
GOALS = {"admin_only": "let administrators in alone", "authenticated_only": "ask for a session", "horizontal": "check who owns the record", "vertical": "check the role before the operation", "static_only": "close the page to visitors"}


def looked_up(category: Column, names: dict[str, str], default: str = "unknown") -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), category), F.lit(default))


def vulnerability_type(category: Column) -> Column:
    return F.when(category == "horizontal", "HPE").otherwise("VPE")


def ordered_unique(values: Column) -> Column:
    return F.array_distinct(F.filter(values, lambda x: x.isNotNull() & (x != "")))


def rendered(template: Column, values: Column) -> Column:
    """{{name}} replaced from a map; unknown names stay."""
    return F.aggregate(F.map_entries(values), template, lambda t, e: F.replace(t, F.concat(F.lit("{{"), e["key"], F.lit("}}")), F.coalesce(e["value"], F.lit(""))))


def unresolved(template: Column) -> Column:
    """Names of {name} that a rendered text still has."""
    return F.array_distinct(F.regexp_extract_all(template, F.lit(r"\{(\w+)\}"), F.lit(1)))
