"""Ordered reports against a render in the driver."""

from wardline.operators import rendering

FINDING = "category string, page string, actor string, status string, confidence string, evidence array<string>, ord int, http_status int, error string"


def rendered(rows):
    """The findings report, line by line."""
    sections = {1: [r for r in rows if r[3] == "vulnerable"], 2: [r for r in rows if r[3] != "vulnerable"]}
    out = [f"# Findings\n\n- Confirmed: {len(sections[1])}\n- Not confirmed: {len(sections[2])}\n"]
    for number, title in ((1, "Confirmed"), (2, "Not confirmed")):
        out.append(f"## {title}\n" + ("" if sections[number] else "\nNone.\n"))
        for category, page in sorted({r[:2] for r in sections[number]}):
            some = sorted((r for r in sections[number] if r[:2] == (category, page)), key=lambda r: r[6])
            once = lambda i: ", ".join(dict.fromkeys(str(r[i]) for r in some if r[i] is not None))  # noqa: B023, E731
            lines = [f"- Category: {category}", f"- Actors: {once(2)}"] + ([f"- HTTP status: {once(7)}"] if once(7) else []) + [f"- Confidence: {', '.join(sorted({r[4] for r in some}))}"]
            lines += [f"- Evidence: {e}" for e in sorted({e for r in some for e in r[5]})] + [f"- Error: {e}" for e in sorted({r[8] for r in some if r[8]})]
            out.append(f"### `{page}`\n\n" + "\n".join(lines) + "\n")
    return out


def findings(n):
    return [(f"c{i % 3}", f"p{i % 40:02}", f"u{i * 7 % 5}", "vulnerable" if i % 4 else "not_vulnerable", ["high", "medium"][i % 2], [f"e{i % 6}", "e0"], i, 200 + i % 3 if i % 5 else None, ["", None, f"x{i % 4}"][i % 3]) for i in range(n)]


def test_findings_report_by_ranges(spark, tmp_path):
    for n in (0, 1, 300):
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", str(n < 300).lower())  # small ranges would be joined
        rows = findings(n)
        report = rendering.findings_sections(spark.createDataFrame(rows, FINDING))
        got = rendering.numbered(report, rendering.ORDER).collect()
        assert [r.markdown for r in sorted(got, key=lambda r: r.row)] == rendered(rows)
        assert sorted(r.row for r in got) == list(range(1, len(got) + 1))
        rendering.written(report, rendering.ORDER, f"{tmp_path}/{n}")
        files = sorted((tmp_path / str(n)).glob("part-*"))
        assert "".join(f.read_text() for f in files) == "".join(t + "\n" for t in rendered(rows)) and (n < 300 or len(files) > 1)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_repair_report(spark):
    item = "item int, attempts int, patches_generated int, syntax_ok int, exploit_blocked int, regression_passed int, database_applied int, database_passed int, successful boolean, covered_findings int, attack_vectors int, ord int, page string, category string, status string, message string"
    items = [(1, 2, 2, 2, 1, 1, 0, 0, True, None, None, 0, "a.php", "admin_only", "done", "fine"), (2, 1, 1, 1, 0, 0, 0, 0, False, None, None, 1, "b.php", "vertical", "failed", None)]
    attempts = [(1, 2, True, True, "second"), (1, 1, True, False, "first"), (2, 1, True, False, None)]
    out = rendering.repair_sections(spark.createDataFrame(items, item), spark.createDataFrame(attempts, "item int, attempt int, has_output boolean, successful boolean, message string"))
    text = [r.markdown for r in sorted(rendering.numbered(out, ["section", "ord"]).collect(), key=lambda r: r.row)]
    assert "- Repair items: 2\n- Attempts: 3\n" in text[0] and "Covered" not in text[0] and text[0].endswith("## Details\n")
    assert text[1] == "### `a.php`\n\n- Category: admin_only\n- Status: done\n- Successful: true\n- Message: fine\n  - Attempt 1: failed; first\n  - Attempt 2: successful; second\n"
    assert text[2].endswith("- Message: \n  - Attempt 1: failed\n")
    none = rendering.repair_sections(spark.createDataFrame([], item), spark.createDataFrame([], "item int, attempt int, has_output boolean, successful boolean, message string")).collect()
    assert len(none) == 1 and none[0].markdown.endswith("No repairs.\n")
