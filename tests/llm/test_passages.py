"""Fuzzy passages: recall over edit rates, the query's rows against planted passages, odd tables."""

import random

import pytest
from llm_data import words
from wardline.llm import substring


def edited(rng, passage, rate, kinds):
    out = []
    for w in passage:
        kind = rng.choice(kinds) if rng.random() < rate else "keep"
        out += {"keep": [w], "replace": words(rng, 1), "insert": [w, *words(rng, 1)], "drop": []}[kind]
    return out


def pairs(rng, n, rate, kinds, size=100):
    """Documents in pairs, of which the second holds an edited passage of the first; bounds of it by id."""
    rows, bounds = [], {}
    for i in range(n):
        passage = words(rng, size)
        changed, before = edited(rng, passage, rate, kinds), rng.randrange(20, 120)
        rows += [(i, " ".join(words(rng, 90) + passage + words(rng, 60))), (1000 + i, " ".join(words(rng, before) + changed + words(rng, 80)))]
        bounds[1000 + i] = (before, before + len(changed))
    return rows, bounds


def found(rows, bounds):
    """Documents with 0.8 of their passage's words found, and words found outside of passages."""
    covered = {}
    for r in rows:
        covered.setdefault(r.doc_id, set()).update(range(r.start_word, r.end_word))
    right = sum(len(covered.get(i, set()) & set(range(a, b))) >= 0.8 * (b - a) for i, (a, b) in bounds.items())
    return right, sum(len(c - set(range(*bounds.get(i, (0, 0))))) for i, c in covered.items())


@pytest.mark.parametrize(("rate", "kinds"), [(0.0, ["replace"]), (0.05, ["replace", "insert", "drop"]), (0.10, ["replace"]), (0.10, ["replace", "insert", "drop"])])
def test_recall_over_edit_rates(spark, rate, kinds):
    rows, bounds = pairs(random.Random(8), 60, rate, kinds)
    right, beside = found(substring.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect(), bounds)
    assert right >= 0.9 * len(bounds) and beside <= 2 * len(bounds)


def test_query_finds_planted_passages_and_no_others(spark, tmp_path):
    rng = random.Random(9)
    rows, bounds = pairs(rng, 30, 0.02, ["replace"])
    many = words(rng, 70)
    rows += [(5000 + i, " ".join(words(rng, 40) + many + words(rng, 40))) for i in range(80)]
    bounds |= {5000 + i: (40, 110) for i in range(1, 80)}
    rows += [(9000 + i, " ".join(words(rng, 200))) for i in range(40)] + [(9100, None), (9101, ""), (9102, "one two"), (None, rows[0][1])]
    spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, odoc string").write.parquet(str(tmp_path / "documents.parquet"))
    got = substring.op7_query(spark, str(tmp_path)).collect()
    right, beside = found(got, bounds)
    assert right == len(bounds) and beside <= len(bounds) and all(r.other_doc_id < r.doc_id for r in got)
    assert {r.doc_id for r in got if r.other_doc_id == 5000} == set(range(5001, 5080)) and {r.doc_id for r in got} == set(bounds)


def test_query_without_rows(spark, no_docs, tmp_path):
    no_docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert substring.op7_query(spark, str(tmp_path)).count() == 0


def test_bridges():
    near = [(10, 40, 29, 110, 140), (46, 80, 33, 147, 181)]
    assert substring.bridged(near) == [(10, 80, 62)]
    assert len(substring.bridged([near[0], (46, 80, 33, 300, 334)])) == 2  # far apart in the other text
    assert len(substring.bridged([(10, 22, 12, 0, 12), (34, 46, 12, 24, 36)])) == 2  # less than IDENTITY in all
