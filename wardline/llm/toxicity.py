"""Toxicity scores: gradient-boosted trees over dense features of the text, calibrated by isotonic regression.

Lexicon and trees are learned from a bounded sample of labelled rows (``TRAIN_ROWS``, those of smallest hash); words
and five-letter stems enter the lexicon by their log odds, since insults come inflected. Trees and calibration learn
from features whose lexicon has not seen the row's fold, as it has not seen a new text. Scoring is one narrow pass
over all whole texts with the model, a few hundred kB, in the closure.

Defined results: a null text scores as an empty one; null labels are not learned from; without a row of each label
every score is the share of label 1 (0 where there is none); repeated rows give repeated rows; a null id is kept and is
held out if the checksum of an empty string is; only the named columns are read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import stored, table

TRAIN_ROWS = 20_000
LEXICON_TERMS = 1500
FOLDS = 4
STEM = 5

_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)?")
_MASKED = re.compile(r"[^\W\d_]+[0-9@$*#%!+]+[^\W\d_]+")
_RUN = re.compile(r"([^\W\d_])\1\1")
#: Digits and signs that stand for letters.
_PLAIN = str.maketrans("0134579@$!+", "oieastgasit")
#: Pronouns of address in the corpus languages.
_YOU = frozenset("you your yours yourself u ur thou thee du dich dir dein deine deiner deinem deinen ihr euch sie tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vos os".split())

NAMES = ["log_words", "word_density", "word_count", "stem_density", "stem_count", "longest_hit_run", "you_density", "you_near_hit", "capital_share", "capital_words", "exclaim", "question", "punctuation", "symbols", "digits", "masked_rate", "masked_hits", "letter_runs", "mean_word", "line_rate", "distinct_share", "hit_share_of_distinct", "first_hit", "last_hit"]


def held_out(id_col: str = "doc_id"):
    """Rows no model of these labels has seen: crc32 of the id as text, modulo 5, is 0."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def features(text: str, words: frozenset, stems: frozenset) -> list[float]:
    low = text.lower()
    tokens = _WORD.findall(low)
    n = max(1, len(tokens))
    size = max(1, len(text))
    hits = [i for i, w in enumerate(tokens) if w in words]
    stemmed = [i for i, w in enumerate(tokens) if w[:STEM] in stems]
    at = sorted({*hits, *stemmed})
    you = [i for i, w in enumerate(tokens) if w in _YOU]
    near = 0
    if at and you:
        pos = np.searchsorted(at, you)
        a = np.array([-(10**9), *at, 10**9])
        near = int((np.minimum(np.array(you) - a[pos], a[pos + 1] - np.array(you)) <= 4).sum())
    masked = _MASKED.findall(low)
    masked_hits = sum((p := m.translate(_PLAIN)) in words or p[:STEM] in stems for m in masked)
    run = longest = 0
    for i, j in zip(at, at[1:], strict=False):
        run = run + 1 if j - i <= 6 else 0
        longest = max(longest, run)
    distinct = len(set(tokens))
    raw = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), minlength=128) if text else np.zeros(128, np.int64)
    upper = sum(map(str.isupper, text)) if not text.isascii() else int(raw[65:91].sum())
    return [
        float(np.log1p(len(tokens))), len(hits) / n, min(len(hits), 50), len(stemmed) / n, min(len(stemmed), 50), longest, len(you) / n, near / n, upper / size,
        sum(w.isupper() and len(w) > 1 for w in text.split()) / n, raw[33] / size, raw[63] / size, float(raw[[44, 46, 58, 59, 40, 41, 34, 39, 45]].sum()) / size, float(raw[[35, 36, 37, 38, 42, 43, 64, 94, 95, 126]].sum()) / size,
        float(raw[48:58].sum()) / size, len(masked) / n, masked_hits / n, len(_RUN.findall(low)) / n, sum(map(len, tokens)) / n, raw[10] / n, distinct / n,
        len({tokens[i] for i in at}) / max(1, distinct), at[0] / n if at else 1.0, at[-1] / n if at else 0.0,
    ]


# ---------------------------------------------------------------- model


class BoostedTrees:
    """Log-loss trees of fixed depth over quantile bins; a node is (feature, bin), leaves hold the step."""

    def __init__(self, trees: int = 120, depth: int = 4, rate: float = 0.12, ridge: float = 2.0, least: int = 8, bins: int = 48):
        self.trees, self.depth, self.rate, self.ridge, self.least, self.bins = trees, depth, rate, ridge, least, bins

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, c, "left") for e, c in zip(self.edges, x.T, strict=True)], 1).astype(np.int32)

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins)[1:-1], method="lower")) for c in x.T]
        b = self._binned(x)
        base = float(np.clip(y.mean(), 1e-6, 1 - 1e-6))
        self.start = float(np.log(base / (1 - base)))
        score = np.full(len(y), self.start)
        self.nodes: list[list[tuple[int, int]]] = []
        self.leaves: list[np.ndarray] = []
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-score))
            grad, hess = y - p, np.maximum(p * (1 - p), 1e-9)
            at, splits = np.zeros(len(y), np.int64), []
            for level in range(self.depth):
                width = 1 << level
                best, choice = np.zeros(width), [(-1, 0)] * width
                for f in range(x.shape[1]):
                    key = at * self.bins + b[:, f]
                    total = [np.bincount(key, w, width * self.bins).reshape(width, self.bins) for w in (grad, hess, np.ones(len(y)))]
                    left = [t.cumsum(1) for t in total]
                    all_ = [t[:, -1:] for t in left]
                    right = [a - t for a, t in zip(all_, left, strict=True)]
                    gain = left[0] ** 2 / (left[1] + self.ridge) + right[0] ** 2 / (right[1] + self.ridge) - all_[0] ** 2 / (all_[1] + self.ridge)
                    gain[(left[2] < self.least) | (right[2] < self.least)] = 0
                    top = gain.argmax(1)
                    for node in range(width):
                        if gain[node, top[node]] > best[node] + 1e-9:
                            best[node], choice[node] = gain[node, top[node]], (f, int(top[node]))
                splits += choice
                at = 2 * at + self._right(b, choice, at)
            g, h = (np.bincount(at, w, 1 << self.depth) for w in (grad, hess))
            leaf = self.rate * g / (h + self.ridge)
            self.nodes.append(splits)
            self.leaves.append(leaf)
            score += leaf[at]
        return self

    @staticmethod
    def _right(b: np.ndarray, choice: list[tuple[int, int]], at: np.ndarray) -> np.ndarray:
        f, cut = (np.array(c)[at] for c in zip(*choice, strict=True))
        return (f >= 0) & (b[np.arange(len(b)), np.maximum(f, 0)] > cut)

    def raw(self, x: np.ndarray) -> np.ndarray:
        b = self._binned(x)
        score = np.full(len(x), self.start)
        for splits, leaf in zip(self.nodes, self.leaves, strict=True):
            at = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                at = 2 * at + self._right(b, splits[(1 << level) - 1 : (2 << level) - 1], at)
            score += leaf[at]
        return score


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators; the knots (mean score, share of label 1) of its blocks, each share drawn to the mean by one row."""
    order = np.argsort(score, kind="stable")
    mean = float(y.mean())
    blocks: list[list[float]] = []  # rows, positives, sum of scores
    for s, v in zip(score[order].tolist(), y[order].tolist(), strict=True):
        blocks.append([1, v, s])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    n, pos, total = np.array(blocks).T
    share = np.maximum.accumulate((pos + mean) / (n + 1))
    return total / n, share


class Model:
    """Lexicon, trees and calibration. ``score`` keeps a trace of the raw score, so that plateaus still rank."""

    def __init__(self, words: frozenset, stems: frozenset):
        self.words, self.stems, self.trees, self.flat = words, stems, None, 0.0

    def matrix(self, texts: list[str]) -> np.ndarray:
        return np.array([features(t, self.words, self.stems) for t in texts], np.float64).reshape(len(texts), len(NAMES))

    def fit(self, x: np.ndarray, y: np.ndarray, fold: np.ndarray) -> Model:
        """Features by a lexicon of the other folds, labels and folds of the rows."""
        self.flat = float(y.mean()) if len(y) else 0.0
        if len(y) < 4 * FOLDS or not 0 < y.sum() < len(y):
            return self
        out = np.zeros(len(y))
        for k in np.unique(fold):
            some = y[fold != k]
            if not 0 < some.sum() < len(some):
                return self
            out[fold == k] = BoostedTrees().fit(x[fold != k], some).raw(x[fold == k])
        self.knots = isotonic(out, y)
        self.trees = BoostedTrees().fit(x, y)
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.full(len(x), self.flat)
        raw = self.trees.raw(x)
        return np.clip(0.999 * np.interp(raw, *self.knots) + 0.001 / (1 + np.exp(-raw)), 0, 1)


# ---------------------------------------------------------------- Spark


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter = Counter()
    for b in batches:
        for text, y, fold in zip(*(c.to_pylist() for c in b.columns), strict=True):
            words = {w for w in _WORD.findall(text.lower()) if len(w) > 2}
            seen.update(("w", w, y, fold) for w in words)
            seen.update(("s", s, y, fold) for s in {w[:STEM] for w in words if len(w) >= STEM})
    rows = [(*key, n) for key, n in seen.items()]
    if rows:
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TERM, strict=True)], ["kind", "term", "y", "fold", "n"])


_TERM = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int64()]


def _lexicon(terms: DataFrame, rows: dict[int, tuple[int, int]], left_out: int | None = None) -> tuple[frozenset, frozenset]:
    """Words and stems that tell label 1, counted outside one fold; ``rows`` has the rows of each label by fold."""
    use = [k for k in range(FOLDS) if k != left_out]
    neg, pos = (sum(rows.get(k, (0, 0))[y] for k in use) for y in (0, 1))
    if not (pos and neg):
        return frozenset(), frozenset()
    n = [sum((F.col(f"n{y}{k}") for k in use), F.lit(0)) for y in (0, 1)]
    odds = F.log((F.col("pos") + 0.5) / (pos + 1)) - F.log((F.col("neg") + 0.5) / (neg + 1))
    some = terms.select("kind", "term", n[0].alias("neg"), n[1].alias("pos")).where(F.col("pos") >= max(3, pos // 300)).withColumn("odds", odds)
    top = some.where("odds > 1.8").orderBy(F.desc(F.col("odds") * F.sqrt("pos")), "kind", "term").limit(LEXICON_TERMS).collect()
    return frozenset(r["term"] for r in top if r["kind"] == "w"), frozenset(r["term"] for r in top if r["kind"] == "s")


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Learn from at most ``rows`` labelled documents outside the held-out fold; only aggregates, at most ``LEXICON_TERMS``
    terms and ``rows`` feature vectors reach the driver."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).alias("id")).agg(F.max((F.col(label_col) > 0).cast("int")).alias("y"))
    sample = known.orderBy(F.xxhash64("id"), "id").limit(rows)
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    some = docs.select(docs[id_col].alias("id"), text.alias("text")).join(F.broadcast(sample), "id").select("text", "y", F.xxhash64("text").alias("h"))
    # ``rows`` bounds the sample and so this broadcast; copies of a text teach once
    some = some.groupBy("h").agg(F.first("text").alias("text"), F.max("y").alias("y"))
    some = stored(some.withColumn("fold", F.pmod("h", F.lit(FOLDS)).cast("int")), "train")
    rows_of = {r["fold"]: (r["neg"], r["pos"]) for r in some.groupBy("fold").agg(F.sum(1 - F.col("y")).alias("neg"), F.sum("y").alias("pos")).collect()}
    found = some.select("text", "y", "fold").mapInArrow(_terms, "kind string, term string, y int, fold int, n long")
    counts = [F.coalesce(F.sum(F.when((F.col("y") == y) & (F.col("fold") == k), F.col("n"))), F.lit(0)).alias(f"n{y}{k}") for y in (0, 1) for k in range(FOLDS)]
    terms = stored(found.groupBy("kind", "term").agg(*counts).where(sum((F.col(f"n1{k}") for k in range(FOLDS)), F.lit(0)) >= 3), "terms")
    by_fold = [_lexicon(terms, rows_of, k) for k in range(FOLDS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [features(t, *by_fold[k]) for t, k in zip(b.column(1).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield pa.record_batch([b.column(0), b.column(2), b.column(3), pa.array(x, pa.list_(pa.float64()))], ["h", "y", "fold", "x"])

    got = some.select("h", "text", "y", "fold").mapInArrow(run, "h long, y int, fold int, x array<double>").toArrow().sort_by("h")
    y = got["y"].to_numpy().astype(np.float64)
    x = np.array(got["x"].combine_chunks().flatten() if len(y) else [], np.float64).reshape(len(y), len(NAMES))
    return Model(*_lexicon(terms, rows_of)).fit(x, y, got["fold"].to_numpy())


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """(id, score), or with ``keep`` all input columns as struct ``row`` and score."""
    kept = F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row") if keep else docs[id_col].alias("id")
    src = docs.select(kept, docs[text_col].cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = model.matrix([t or "" for t in b.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(x), pa.float64())], [b.schema.names[0], "score"])

    return src.mapInArrow(run, StructType([src.schema[0], StructField("score", DoubleType())]))


def op3_query(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    out = score(docs, model).withColumnRenamed("id", "doc_id")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
