"""Runs of repeated words against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from wardline.llm import periodic
from wardline.llm.common import Words, text_buffer


def brute(s, least=6, exponent=4):
    """All maximal stretches of each period, by definition; the smallest period of each stretch."""
    n, out = len(s), {}
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            if s[i] != s[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and s[j] == s[j + q]:
                j += 1
            if j + q - i >= max(least, exponent * q):
                out.setdefault((i, j + q - i), q)
            i = j
    return sorted((a, n_, q) for (a, n_), q in out.items())


def digest(doc_id, text):
    """The contract's row of one document, by brute force."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute(words)
    gone = {i for a, size, q in runs for i in range(a + q, a + size)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha("".join(f"{a},{b},{c}\n" for a, b, c in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def periodic_text(rng, n, letters):
    out = []
    while len(out) < n:
        kind = rng.random()
        if kind < 0.5:
            out += [rng.choice("abcdef") for _ in range(rng.randrange(1, 20))]
        else:
            unit = [rng.choice(letters) for _ in range(rng.randrange(1, 6))]
            out += (unit * 9)[: rng.randrange(1, 9 * len(unit))]
    return out[:n]


@pytest.mark.parametrize("letters", ["ab", "abcd", "abcdefghij"])
def test_repetitions_equal_brute_force(letters):
    rng = random.Random(len(letters))
    for _ in range(60):
        s = periodic_text(rng, rng.randrange(0, 140), letters)
        numbers = np.array([ord(c) for c in s], np.int64)
        assert periodic.repetitions(numbers) == brute(s)
        assert periodic.repetitions(numbers, 10, 5) == brute(s, 10, 5)


def test_a_wrong_hash_decides_nothing(monkeypatch):
    rng = random.Random(3)
    monkeypatch.setattr(periodic._Text, "alike", lambda self, x, y, d: np.ones(len(x), bool))
    s = ["x", "y"] * 8 + [rng.choice("abc") for _ in range(9)]
    got = periodic.repetitions(np.array([ord(c) for c in s], np.int64))
    assert set(got) <= set(brute(s))


def test_overlap():
    assert periodic.overlap(6, 4) == 5 and periodic.overlap(20, 4) == 15
    with pytest.raises(ValueError):
        periodic.repetitions(np.zeros(9, np.int64), 6, 3)


def test_masked_rows_lose_no_run():
    import pyarrow as pa

    rng = random.Random(7)
    texts = [" ".join(periodic_text(rng, rng.randrange(0, 90), "abc")) for _ in range(80)] + [None, "", " \n", "a a a a a a", "b " * 5]
    buf, offsets = text_buffer(pa.array(texts))
    want = [(r, *run) for r, t in enumerate(texts) for run in brute((t or "").split())]
    assert periodic.runs_of(Words(buf, offsets, lower=False)) == sorted(want)


def test_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(11)
    rows = [(i, " ".join(periodic_text(rng, rng.randrange(0, 160), "abcde")), "en") for i in range(250)]
    rows += [(None, None, None), (None, "a a a a a a a", None), (500, None, "x"), (501, "", "x"), (502, "\t \n", "x"), (rows[3][0], rows[3][1], "x"), (rows[3][0], rows[3][1], "x"), (503, "A a " * 9, "x"), (504, "é ü " * 12 + "你好", "x"), (505, "x " * 3000 + "y z " * 2000, "x")]
    spark.createDataFrame(rows, "doc_id long, text string, runs string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(map(tuple, periodic.op11_query(spark, str(tmp_path)).collect()), key=str)
    quick = [r for r in rows if not r[1] or len(r[1]) < 5000]
    assert [g for g in got if g[0] != 505] == sorted((digest(i, t) for i, t, _ in quick), key=str)
    long = [g for g in got if g[0] == 505][0]
    assert long[1] == (2 if zlib.crc32(b"505") % 10 else 1) and long[3] == 4000


def test_no_rows(spark, no_docs, odd_docs):
    assert periodic.periodic_runs(no_docs).count() == 0
    assert periodic.periodic_runs(odd_docs).count() == odd_docs.count()
    kept = {r.id: r for r in periodic.periodic_runs(odd_docs).collect()}
    assert kept[12].runs == [] and kept[4].collapsed == "" and kept[9].collapsed == "one two"
