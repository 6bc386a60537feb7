"""The Jaccard join against brute force."""

import random
import re

import numpy as np
from llm_data import words
from pyspark.sql import functions as F
from wardline.llm import signature


def brute(rows, k, num, den):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        s = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
        sets.setdefault(i, []).append(s)
    ids = sorted(i for i in sets if i is not None)
    comp = {i: i for i in ids}

    def find(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for x in ids:
        for y in ids:
            if x < y and any(a and b and den * len(a & b) >= num * len(a | b) for a in sets[x] for b in sets[y]):
                a, b = sorted((find(x), find(y)))
                comp[b] = a
    return sorted((str(i), len(s), str(None if i is None else find(i))) for i, some in sets.items() for s in some)


def check(spark, rows, k=4, num=85, den=100):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = signature.jaccard_components(df, k, num, den).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == brute(rows, k, num, den)


def corpus(seed):
    rng = random.Random(seed)
    rows, common = [], words(rng, 30)
    for f in range(6):
        base = words(rng, rng.randrange(5, 150))
        for _ in range(rng.randrange(1, 9)):
            w = list(base)
            for _ in range(rng.randrange(0, 4)):
                w[rng.randrange(len(w))] = f"edit{rng.randrange(9)}"
            rows.append((len(rows), " ".join(w + (common if f % 2 else []))))
    return rows


def test_random_families(spark):
    for seed in range(3):
        check(spark, corpus(seed))


def test_cut_blocks(spark, monkeypatch):
    """Blocks dealt over many parts, with chunks compared across components."""
    monkeypatch.setattr(signature, "PART_SETS", 3)
    monkeypatch.setattr(signature, "CHUNK", 2)
    check(spark, corpus(11))


def test_odd_rows(spark, odd_docs, no_docs):
    odd_docs = odd_docs.union(odd_docs.limit(1).withColumn("doc_id", F.lit(3).cast("long")).withColumn("text", F.lit("another text of an id that is there already")))
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    got = signature.jaccard_components(odd_docs, 4, 85, 100).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == brute(rows, 4, 85, 100)
    assert signature.jaccard_components(no_docs).count() == 0


def test_tree_prunes_and_is_exact():
    rng = np.random.default_rng(3)
    pool = rng.integers(1, 2**63, 5000, dtype=np.uint64)
    sets = []
    for _ in range(40):
        base = rng.choice(pool, 80, replace=False)
        for _ in range(3):
            s = base.copy()
            s[rng.integers(0, 80, 6)] = rng.choice(pool, 6)
            sets.append(np.unique(s))
    tree = signature.SignatureTree(sets, 85, 100)
    root = tree.build(list(range(len(sets))))
    tree.join(root, root)
    want = {(i, j) for i in range(len(sets)) for j in range(i) if len(x := np.intersect1d(sets[i], sets[j])) * 185 >= 85 * (len(sets[i]) + len(sets[j]))}
    up = list(range(len(sets)))
    for i, j in want:
        a, b = up[i], up[j]
        up = [min(a, b) if x in (a, b) else x for x in up]
    assert [up.index(x) for x in up] == [[tree.find(j) for j in range(len(sets))].index(tree.find(i)) for i in range(len(sets))]
    assert tree.compared < len(sets) ** 2 / 20


def test_rows_that_repeat_an_id_are_one_node(spark):
    a, b, c = (" ".join(words(random.Random(s), 40)) for s in (1, 2, 3))
    check(spark, [(3, a), (5, a), (2, b), (5, b)])
    check(spark, [(1, a), (2, b), (5, a), (5, b)])
    check(spark, [(7, a), (7, b), (7, b), (7, c), (9, c), (1, b), (4, a), (None, a)])


def test_scratch_tables_go(spark):
    """Only what the result still reads is left in shared storage."""
    from wardline.llm import common

    before = len(common.opened())
    got = signature.jaccard_components(spark.createDataFrame(corpus(2), "doc_id long, text string"), 4, 85, 100)
    names = [p for p in common.opened()[before:]]
    size = got.count()
    assert size and len(names) < 25
