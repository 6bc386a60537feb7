"""Explicit schemas of the inputs; nothing is inferred, since pages are keys of JSON objects."""

from __future__ import annotations

REQUEST = "struct<method: string, params: map<string,string>, referer: string>"
ROLE_CRAWL = f"role string, kind string, nodes array<string>, edges array<struct<`from`: string, `to`: string>>, requests map<string, {REQUEST}>"
VECTOR = f"category string, page string, authorized_roles array<string>, request {REQUEST}, identity_parameters array<string>, page_overrides array<string>, ord int"
FINDING = "category string, page string, actor string, status string, confidence string, method string, http_status int, evidence array<string>, error string"
RESPONSE = "vector_ord int, actor string, status_code int, url string, headers map<string,string>, text string"
SNIPPET = "path string, kind string, start_line int, end_line int, code string, if_framework string, function string, condition string, parameter_ids array<string>, function_ids array<string>"
STATIC_EDGE = "`from` string, `to` string, kind string"
ATTEMPT = "struct<attempt: int, output: string, syntax_compile_ok: boolean, exploit_blocked: boolean, regression_passed: boolean, successful: boolean, message: string>"
REPAIR = (
    "category string, page string, source string, output string, status string, message string, attempts int, patches_generated int, syntax_compile_ok int, exploit_blocked int, regression_passed int, "
    f"database_validation_applied int, database_validation_passed int, successful boolean, attempt_details array<{ATTEMPT}>, "
    "coverage struct<covered_vulnerable_findings: int, aggregated_attack_vectors: int, validated_operations: array<string>>"
)
METRICS = (
    "app string, hsng_construction_seconds double, detection_seconds double, access_control_snippets_extraction_seconds double, llm_inference_seconds double, tokens_in int, tokens_out int, tokens_total int, "
    "api_cost_usd double, api_cost_pricing_configured boolean, llm_requests int, total_seconds double"
)
ENTITY = "app string, language string, entity_type string, name string, source string, kind string, files array<string>, rationale string, start_line int, end_line int"
KINDS = ("admin", "user", "visitor")
