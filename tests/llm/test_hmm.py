"""The hidden Markov language model against sums over all paths, plain recursions and held-out texts."""

import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from wardline.llm import hmm
from wardline.llm.common import stored

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lowered(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def small_model(rng, classes=4, states=2):
    positive = lambda *shape: rng.random(shape) + 0.1
    start, change = positive(states), positive(states, states)
    prior = positive(classes)
    prior /= prior.sum()
    emit = positive(classes, states)
    emit /= emit.sum(0)
    return hmm.Model(start / start.sum(), change / change.sum(1, keepdims=True), emit / prior[:, None], np.full(states, 1 / states)), prior


def by_paths(model, seq, start):
    """Likelihood and expected counts by every path."""
    states = len(model.start)
    total, seen = 0.0, hmm.Expected(len(model.ratio), states)
    for path in itertools.product(range(states), repeat=len(seq)):
        p = start[path[0]] * math.prod(model.change[a, b] for a, b in itertools.pairwise(path)) * math.prod(model.ratio[c, z] for c, z in zip(seq, path, strict=True))
        total += p
        seen.start[path[0]] += p
        for c, z in zip(seq, path, strict=True):
            seen.emit[c, z] += p
        for a, b in itertools.pairwise(path):
            seen.change[a, b] += p
    return total, seen


def test_forward_and_backward_equal_all_paths():
    rng = np.random.default_rng(5)
    model, _ = small_model(rng)
    seqs = [rng.integers(0, 4, n) for n in (1, 2, 5, 7, 7)]
    opens = [True, True, False, True, False]
    assert np.allclose(np.exp(hmm.likelihoods(seqs, model)), [by_paths(model, s, model.start)[0] for s in seqs])
    got = hmm.Expected(4, 2)
    got.add(model, seqs, opens)
    want, gain = hmm.Expected(4, 2), 0.0
    for s, o in zip(seqs, opens, strict=True):
        total, seen = by_paths(model, s, model.start if o else model.middle)
        gain += math.log(total)
        want.emit += seen.emit / total
        want.change += seen.change / total
        want.start += seen.start / total * o
    assert np.allclose(got.emit, want.emit, atol=1e-4) and np.allclose(got.change, want.change, atol=1e-4) and np.allclose(got.start, want.start, atol=1e-4)
    assert abs(got.gain - gain) < 1e-3 and got.tokens == sum(map(len, seqs))
    again = hmm.Expected.read(pa.Table.from_batches([got.rows()]), 4, 2)
    assert np.allclose(again.emit, got.emit) and np.allclose(again.change, got.change) and again.gain == got.gain


def test_long_sequences_neither_vanish_nor_differ_in_company():
    rng = np.random.default_rng(6)
    model, _ = small_model(rng)
    long = rng.integers(0, 4, 30_000)
    got = hmm.likelihoods([np.array([1]), long, np.array([2, 3])], model)
    assert np.isfinite(got).all() and math.isclose(got[1], hmm.likelihoods([long], model)[0], rel_tol=1e-12)


def bilingual(rng, n):
    tongues = [[x + y + end for x in "bcdfg" for y in "aeiou" for end in ends] for ends in (("th", "ing"), ("eau", "oux"))]
    out = []
    for i in range(n):
        words = tongues[i % 2]
        out.append((i, " ".join(rng.choice(words).title() if rng.random() < 0.1 else rng.choice(words) for _ in range(rng.randrange(1, 90)))))
    return out


def corpus(spark, tmp_path, rows):
    spark.createDataFrame([(*r, "k", 3) for r in rows], "doc_id long, text string, key string, n int").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


def base_rows(rows):
    """(n_tokens, n_known, train_tokens, base_score) by definition."""
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    tokens = [[*WORD.findall(lowered(t)), None] for _, t in rows]
    c = Counter(w for (i, _), ws in zip(rows, tokens, strict=True) if not held(i) for w in ws)
    n, v = sum(c.values()), len(c)
    return [(i, held(i), len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), 6)) for (i, _), ws in zip(rows, tokens, strict=True)]


def test_query(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(hmm, "HEAD", 30)
    rng = random.Random(2)
    rows = bilingual(rng, 400) + [(None, None), (None, "Bath"), (1000, ""), (1001, " \n\t"), (1002, "unseen words ÉÈ é"), (3, "bath " * 4000), (5, "x"), (5, "x")]
    got = hmm.op12_query(spark, corpus(spark, tmp_path, rows)).collect()
    assert sorted((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got if r.doc_id is not None) == sorted(x for x in base_rows(rows) if x[0] is not None)
    assert len(got) == len(rows) and all(math.isfinite(r.score) and r.score < 0 for r in got)
    tested = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 400]
    assert sum(r.score - r.base_score for r in tested) / sum(r.n_tokens for r in tested) > 0.2  # two languages, half the words each


@pytest.mark.parametrize("head", [2, 20, hmm.HEAD])
def test_probabilities_sum_to_one_and_score_is_their_product(spark, tmp_path, head):
    rows = bilingual(random.Random(4), 120)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    vocabulary = hmm.Vocabulary(docs, head=head)
    coded = vocabulary.encode(docs)
    model, gains = hmm.baum_welch(coded, vocabulary.prior, states=3, shares=1, rounds=6)
    assert gains == sorted(gains)
    assert np.allclose(vocabulary.prior @ model.ratio, 1) and np.allclose(model.change.sum(1), 1)
    counts = {r.word: r for r in vocabulary.counts.collect()}
    head_of = {int(h): k + 1 for k, h in enumerate(vocabulary.hashes)}
    cls = {w: 0 if w == hmm.END else head_of.get(w, len(head_of) + 1 + r.tail) for w, r in counts.items()}
    each = np.zeros(3)  # of all known words, and one unseen of every tail class
    for w, r in counts.items():
        each += (r.n + 0.1) / vocabulary.total * model.ratio[cls[w]]
    each += (0.1 / vocabulary.total * model.ratio[len(head_of) + 1 :]).sum(0)
    assert np.allclose(each, 1)
    got = {r.id: r.score for r in hmm.score(coded, vocabulary, model).collect()}
    for r in coded.limit(20).collect():
        seq = np.frombuffer(r.classes, hmm._kind(vocabulary.size))
        tails = {len(head_of) + 1 + counts[w].tail: [] for w in r.words}
        for w, times in zip(r.words, r.times, strict=True):
            tails[len(head_of) + 1 + counts[w].tail] += [math.log10(counts[w].n + 0.1)] * times
        logs = sum(map(sum, tails.values())) + sum(math.log10((vocabulary.ends if c == 0 else vocabulary.n[c - 1]) + 0.1) for c in seq if c <= len(head_of))
        want = logs - len(seq) * math.log10(vocabulary.total) + hmm.likelihoods([seq], model)[0] / math.log(10)
        assert math.isclose(got[r.id], want, rel_tol=1e-9)


def test_counts_do_not_depend_on_partitions(spark):
    rows = bilingual(random.Random(9), 200)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    vocabulary = hmm.Vocabulary(docs, head=40)
    coded = vocabulary.encode(docs)
    model = hmm.Model.first(vocabulary.size, vocabulary.prior, 4)
    one, many = hmm.expected(coded.coalesce(1), model), hmm.expected(coded.repartition(7), model)
    assert np.allclose(one.emit, many.emit, atol=1e-2) and np.allclose(one.change, many.change, atol=1e-2) and one.tokens == many.tokens
    assert one.tokens == vocabulary.tokens and abs(one.emit.sum() - one.tokens) < 1


def test_no_rows_and_odd_rows(spark, tmp_path, no_docs, odd_docs):
    vocabulary = hmm.Vocabulary(no_docs)
    model, gains = hmm.baum_welch(vocabulary.encode(no_docs), vocabulary.prior)
    assert gains == [] and hmm.score(vocabulary.encode(no_docs), vocabulary, model).count() == 0
    got = hmm.score(vocabulary.encode(odd_docs), vocabulary, model).collect()
    assert len(got) == odd_docs.count() and all(r.n_known == 0 and math.isclose(r.base_score, 0, abs_tol=1e-9) for r in got)
    vocabulary = hmm.Vocabulary(odd_docs)
    assert stored(vocabulary.encode(odd_docs), "again").count() == odd_docs.count()
