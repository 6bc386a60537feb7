"""A hidden Markov language model: latent states by Baum-Welch, exact likelihood by the scaled forward recursion.

Words are counted over all training texts. The ``HEAD`` most frequent are classes of their own, the others share
``TAIL`` classes by their last bytes, which tell inflection and language; a word of a class comes with its share of the
class's smoothed count. A state emits classes, so that the model is ``STATES`` x (HEAD + TAIL) numbers whatever the
corpus, while the counts behind it grow with it. Each round of Baum-Welch runs forward and backward over windows in
every partition and sums expected counts by class in Spark; after rounds over disjoint shares of the texts, which only
set the states apart, ``ROUNDS`` rounds cover all of them. A text is scored whole, from its first word to the end
token. Counts of words beyond the head are met by a join on the word; only the head is broadcast.

Defined results: a null, empty or blank text is the end token alone; words count as equal by 64-bit hashes of their bytes
after A-Z are lower-cased; rows that repeat are scored each, and learned from each; a null id is held out if the checksum
of an empty string is; without training texts all words are unseen ones; an empty table has no rows; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Words, slices, stored, table, text_buffer

STATES, HEAD, TAIL, SUFFIX = 12, 49_152, 16_384, 3
SHARES, ROUNDS, WINDOW, GROUP = 6, 2, 512, 1 << 19
ADDED, PULL = 0.1, 500.0
#: Stands for the end of a text among the words' hashes; its class is 0.
END = -0x6E5F3D2B1A907C43
_FLUSH = 1 << 19


def held_out(id_col: str = "doc_id") -> Column:
    """Rows not learned from: crc32 of the id as text, modulo 10, is 0."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 10 == 0


# ---------------------------------------------------------------- words


def _words(col: pa.Array) -> Iterator[tuple[int, int, Words, np.ndarray, np.ndarray]]:
    """Row ranges with their words, hashes as signed integers and tail classes (numbers below TAIL)."""
    buf, offsets = text_buffer(col)
    for i, j in slices(offsets):
        part = offsets[i : j + 1]
        piece = buf[part[0] : part[-1]]
        w = Words(piece, part - part[0])
        suffix = Words.span_hash(piece, np.maximum(w.start, w.end - SUFFIX), w.end, np.ones(len(w.start), bool))
        yield i, j, w, w.hash.view(np.int64), (suffix % np.uint64(TAIL)).astype(np.int32)


def _summed(hashes: np.ndarray, tails: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.argsort(hashes, kind="stable")
    hashes, tails, n = hashes[order], tails[order], n[order]
    at = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1])) if len(hashes) else np.zeros(0, np.int64)
    return hashes[at], tails[at], np.add.reduceat(n, at) if len(at) else n


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, tail, n) of all texts: hash, tail class and number of each distinct token, the end token among them."""

    def run(batches):
        held, rows = [], 0

        def out():
            h, t, n = _summed(*(np.concatenate(x) for x in zip(*held, strict=True)))
            return (h, t, n), pa.record_batch([pa.array(h), pa.array(t), pa.array(n)], ["word", "tail", "n"])

        for b in batches:
            for i, j, _, h, t in _words(b.column(0)):
                one = np.append(h, END), np.append(t, np.int32(-1)), np.append(np.ones(len(h), np.int64), j - i)
                held.append(_summed(*one))
                rows += len(held[-1][0])
                if rows > 2 * _FLUSH:
                    merged, batch = out()
                    held, rows = [merged], len(merged[0])
                    if rows > _FLUSH:
                        yield batch
                        held, rows = [], 0
        if held:
            yield out()[1]

    some = docs.select(docs[f"`{text_col}`"].cast("string").alias("text")).mapInArrow(run, "word long, tail int, n long")
    return some.groupBy("word").agg(F.min("tail").alias("tail"), F.sum("n").alias("n"))


class Vocabulary:
    """Counts of training tokens: the table of all, and the head and the sums of tail classes, at most HEAD + TAIL rows."""

    def __init__(self, docs: DataFrame, text_col: str = "text", head: int = HEAD):
        self.counts = stored(word_counts(docs, text_col), "words")
        self.tokens, self.distinct = self.counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
        words = self.counts.where(F.col("word") != END)
        top = words.orderBy(F.desc("n"), "word").limit(head - 1).toArrow()
        ends = self.counts.where(F.col("word") == END).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        tails = words.groupBy("tail").agg(F.sum("n").alias("n"), F.count("*").alias("v")).toArrow()
        hashes, tail, n = (top[c].to_numpy() for c in ("word", "tail", "n"))
        order = np.argsort(hashes)
        self.hashes, self.n = hashes[order], n[order]
        self.ends, self.size = ends, len(hashes) + 1 + TAIL  # classes: the end, the head by hash, the tails
        rest, kinds = np.zeros(TAIL), np.zeros(TAIL)
        at = tails["tail"].to_numpy()
        rest[at], kinds[at] = tails["n"].to_numpy(), tails["v"].to_numpy()
        np.subtract.at(rest, tail, n)
        np.subtract.at(kinds, tail, 1)
        mass = np.concatenate([[ends + ADDED], self.n + ADDED, rest + ADDED * (kinds + 1)])
        self.total = float(mass.sum())
        self.prior = mass / self.total
        self.base_total = self.tokens + ADDED * (self.distinct + 1)

    def encode(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """(key, id, held, n_tokens, known, logs, classes, words, times) of each row, stored: the classes of its tokens,
        the sum of log10(c + 0.1) of end and head words, and the other words with their numbers."""
        spark = docs.sparkSession
        shared = spark.sparkContext.broadcast((self.hashes, self.n, self.ends))
        src = docs.select(docs[f"`{id_col}`"].alias("id"), docs[f"`{text_col}`"].cast("string").alias("text"))
        src = src.select(F.monotonically_increasing_id().alias("key"), "id", held_out("id").alias("held"), "text")

        def run(batches):
            hashes, n, ends = shared.value
            first_tail = len(hashes) + 1
            logs = np.log10(np.append(n, 0) + ADDED)
            for b in batches:
                for i, j, w, h, t in _words(b.column(3)):
                    at = np.searchsorted(hashes, h)
                    inside = np.append(hashes, 0)[at] == h
                    inside &= at < len(hashes)
                    cls = np.where(inside, at + 1, first_tail + t).astype("<u2" if first_tail + TAIL <= 1 << 16 else "<u4")
                    row = np.repeat(np.arange(w.rows), w.count)
                    head = np.bincount(row, np.where(inside, logs[at], 0.0), w.rows) + np.log10(ends + ADDED)
                    known = np.bincount(row, inside, w.rows).astype(np.int64) + (ends > 0)
                    ends_at = np.cumsum(w.count)
                    coded = np.insert(cls, ends_at, 0)
                    width = coded.itemsize
                    bounds = np.append(0, ends_at + np.arange(1, w.rows + 1)) * width
                    rest = np.flatnonzero(~inside)
                    order = np.lexsort((h[rest], row[rest]))
                    r, x = row[rest][order], h[rest][order]
                    new = np.flatnonzero(np.append(True, (r[1:] != r[:-1]) | (x[1:] != x[:-1]))) if len(r) else np.zeros(0, np.int64)
                    times = np.diff(np.append(new, len(r))).astype(np.int32)
                    lists = pa.array(np.searchsorted(r[new], np.arange(w.rows + 1)).astype(np.int32))
                    yield pa.RecordBatch.from_arrays(
                        [
                            *(c.slice(i, j - i) for c in b.columns[:3]), pa.array((w.count + 1).astype(np.int64)), pa.array(known), pa.array(head),
                            pa.Array.from_buffers(pa.large_binary(), w.rows, [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(coded))]).cast(pa.binary()),
                            pa.ListArray.from_arrays(lists, pa.array(x[new])), pa.ListArray.from_arrays(lists, pa.array(times)),
                        ],
                        ["key", "id", "held", "n_tokens", "known", "logs", "classes", "words", "times"],
                    )

        kind = src.schema["id"].dataType.simpleString()
        out = stored(src.mapInArrow(run, f"key long, id {kind}, held boolean, n_tokens long, known long, logs double, classes binary, words array<long>, times array<int>"), "coded")
        shared.destroy()
        return out


# ---------------------------------------------------------------- model


class Model:
    """Start, change and emission of the states; ``ratio[class, state]`` is the emission against the class's prior."""

    def __init__(self, start: np.ndarray, change: np.ndarray, ratio: np.ndarray, middle: np.ndarray):
        self.start, self.change, self.ratio, self.middle = start, change, ratio, middle

    @staticmethod
    def first(classes: int, prior: np.ndarray, states: int = STATES, seed: int = 7) -> Model:
        rng = np.random.default_rng(seed)
        ratio = np.exp(rng.normal(0, 0.5, (classes, states)))
        ratio /= prior @ ratio
        even = np.full(states, 1 / states)
        return Model(even, np.eye(states) * 0.8 + 0.2 / states, ratio, even)

    @staticmethod
    def of(seen: Expected, prior: np.ndarray) -> Model:
        """The parameters that expected counts give, emissions drawn to the prior by PULL tokens a state."""
        start = seen.start + 0.1
        change = seen.change + 0.1
        inside = seen.emit.sum(0)
        ratio = (seen.emit / prior[:, None] + PULL) / (inside + PULL)
        return Model(start / start.sum(), change / change.sum(1, keepdims=True), ratio, (inside + 0.1) / (inside + 0.1).sum())


class Expected:
    """Expected counts of starts, changes and emissions, log-likelihood against the prior, and tokens."""

    def __init__(self, classes: int, states: int):
        self.start, self.change, self.emit = np.zeros(states), np.zeros((states, states)), np.zeros((classes, states))
        self.gain = self.tokens = 0.0

    def add(self, model: Model, windows: list[np.ndarray], opens: list[bool]) -> None:
        """Forward and backward over windows of classes; those that do not open a text begin in the states' average."""
        order = sorted(range(len(windows)), key=lambda i: -len(windows[i]))
        size = np.array([len(windows[i]) for i in order])
        opens_ = np.array([opens[i] for i in order])
        steps, states = int(size[0]), len(model.start)
        active = np.searchsorted(-size, -np.arange(steps), "left")  # windows longer than t
        laid = np.concatenate([[0], np.cumsum(active)])
        flat = np.concatenate([windows[i] for i in order]).astype(np.int64)
        column = np.repeat(np.arange(len(size)), size)
        step = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
        cls = np.empty(len(flat), np.int64)
        cls[laid[step] + column] = flat  # step by step
        ratio, change = model.ratio, model.change.astype(np.float32)
        alpha, scale = np.empty((len(flat), states), np.float32), np.empty(len(flat), np.float32)
        a = np.where(opens_[:, None], model.start, model.middle).astype(np.float32)
        for t in range(steps):
            x, y = laid[t], laid[t + 1]
            a = (a if t == 0 else a[: y - x] @ change) * ratio[cls[x:y]]
            s = a.sum(1)
            a /= s[:, None]
            alpha[x:y], scale[x:y] = a, s
        self.gain += float(np.log(scale.astype(np.float64)).sum())
        self.tokens += len(flat)
        b = np.ones((active[-1], states), np.float32)
        change_seen = np.zeros_like(change)
        for t in range(steps - 1, -1, -1):
            x, y = laid[t], laid[t + 1]
            if t < steps - 1:
                after = ratio[cls[y : laid[t + 2]]] * b / scale[y : laid[t + 2], None]
                change_seen += alpha[x : x + len(after)].T @ after
                b = np.ones((y - x, states), np.float32)
                b[: len(after)] = after @ change.T
            alpha[x:y] *= b
        self.change += change_seen * change
        self.start += alpha[: active[0]][opens_[: active[0]]].sum(0, dtype=np.float64)
        by = np.argsort(cls.astype(np.uint16) if len(self.emit) <= 1 << 16 else cls, kind="stable")
        at = np.flatnonzero(np.append(True, np.diff(cls[by]) != 0))
        self.emit[cls[by][at]] += np.add.reduceat(alpha[by], at, axis=0)

    def rows(self) -> pa.RecordBatch:
        """(at, v): the classes seen, then the changes, the starts, and gain and tokens."""
        states = len(self.start)
        seen = np.flatnonzero(self.emit.any(1))
        ends = np.zeros((1, states))
        ends[0, 0], ends[0, 1] = self.gain, self.tokens
        v = np.concatenate([self.emit[seen], self.change, self.start[None], ends])
        at = np.concatenate([seen, len(self.emit) + np.arange(states + 2)]).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(at), *(pa.array(np.ascontiguousarray(c)) for c in v.T)], ["at", *(f"v{i}" for i in range(states))])

    @staticmethod
    def read(rows: pa.Table, classes: int, states: int) -> Expected:
        out = Expected(classes, states)
        at = rows["at"].to_numpy()
        v = np.stack([rows[f"v{i}"].to_numpy() for i in range(states)], 1) if len(at) else np.zeros((0, states))
        whole = np.zeros((classes + states + 2, states))
        whole[at] = v
        out.emit, out.change, out.start = whole[:classes], whole[classes : classes + states], whole[classes + states]
        out.gain, out.tokens = whole[-1, :2]
        return out


def _windows(batches, kind: str) -> Iterator[tuple[list[np.ndarray], list[bool]]]:
    """Windows of at most WINDOW tokens over all texts, some GROUP tokens at a time."""
    windows, opens, n = [], [], 0
    for b in batches:
        for raw in b.column(0):
            seq = np.frombuffer(raw.as_buffer(), kind)
            for i in range(0, len(seq), WINDOW):
                windows.append(seq[i : i + WINDOW])
                opens.append(i == 0)
                n += len(windows[-1])
                if n >= GROUP:
                    yield windows, opens
                    windows, opens, n = [], [], 0
    if windows:
        yield windows, opens


def _kind(classes: int) -> str:
    return "<u2" if classes <= 1 << 16 else "<u4"


def expected(coded: DataFrame, model: Model) -> Expected:
    """One round of Baum-Welch: expected counts of every partition, summed by class; classes + STATES + 2 rows come back."""
    classes, states = model.ratio.shape
    shared = coded.sparkSession.sparkContext.broadcast(Model(model.start, model.change, model.ratio.astype(np.float32), model.middle))
    kind = _kind(classes)

    def run(batches):
        seen = Expected(classes, states)
        for windows, opens in _windows(batches, kind):
            seen.add(shared.value, windows, opens)
        if seen.tokens:
            yield seen.rows()

    names = [f"v{i}" for i in range(states)]
    parts = coded.select("classes").mapInArrow(run, "at int, " + ", ".join(f"{n} double" for n in names))
    out = parts.groupBy("at").agg(*[F.sum(n).alias(n) for n in names]).toArrow()
    shared.destroy()
    return Expected.read(out, classes, states)


def baum_welch(coded: DataFrame, prior: np.ndarray, states: int = STATES, shares: int = SHARES, rounds: int = ROUNDS) -> tuple[Model, list[float]]:
    """The model of coded training texts, and the gain over the prior, in log10 a token, before each round."""
    model, gains = Model.first(len(prior), prior, states), []
    some = [coded.where(F.pmod(F.xxhash64("key"), F.lit(shares)) == k) for k in range(shares)] if shares > 1 else []
    for use in [*some, *[coded] * rounds]:
        seen = expected(use, model)
        if seen.tokens:
            model = Model.of(seen, prior)
            gains.append(seen.gain / seen.tokens / np.log(10))
    return model, gains


def likelihoods(texts: list[np.ndarray], model: Model) -> np.ndarray:
    """Natural log-likelihood of whole sequences of classes against the prior, by the scaled forward recursion."""
    order = np.argsort([-len(x) for x in texts], kind="stable")
    size = np.array([len(texts[i]) for i in order])
    flat = np.concatenate([texts[i] for i in order]).astype(np.int64)
    begin = np.cumsum(size) - size
    active = np.searchsorted(-size, -np.arange(int(size[0])), "left")
    total, a = np.zeros(len(size)), np.tile(model.start, (len(size), 1))
    for t, n in enumerate(active.tolist()):
        a = (a if t == 0 else a[:n] @ model.change) * model.ratio[flat[begin[:n] + t]]
        s = a.sum(1)
        a /= s[:, None]
        total[:n] += np.log(s)
    out = np.empty(len(size))
    out[order] = total
    return out


def unigram(coded: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(key, id, held, n_tokens, n_known, logs): known tokens and the sum of log10(c + 0.1) of each text. Words beyond the head
    meet their counts by a join, a row for each text and word."""
    rare = coded.where(F.size("words") > 0).select("key", F.explode(F.arrays_zip("words", "times")).alias("x")).select("key", F.col("x.words").alias("word"), F.col("x.times").alias("times"))
    c = F.coalesce(F.col("n"), F.lit(0))
    rare = rare.join(vocabulary.counts.select("word", "n"), "word", "left").groupBy("key").agg(F.sum(F.col("times") * F.log10(c + ADDED)).alias("more"), F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("met"))
    rows = coded.select("key", "id", "held", "n_tokens", "known", "logs").join(rare, "key", "left")
    return rows.select("key", "id", "held", "n_tokens", (F.col("known") + F.coalesce("met", F.lit(0))).cast("long").alias("n_known"), (F.col("logs") + F.coalesce("more", F.lit(0.0))).alias("logs"))


def base_score(vocabulary: Vocabulary) -> Column:
    """The log10 probability of a text by word counts alone, of the columns of ``unigram``."""
    return F.col("logs") - F.col("n_tokens") * float(np.log10(vocabulary.base_total))


def score(coded: DataFrame, vocabulary: Vocabulary, model: Model) -> DataFrame:
    """(id, held, n_tokens, n_known, base_score, score): log10 probabilities of whole texts by word counts and by the model."""
    shared = coded.sparkSession.sparkContext.broadcast(model)
    kind = _kind(vocabulary.size)

    def run(batches):
        keys, texts, n = [], [], 0

        def out():
            return pa.record_batch([pa.array(np.concatenate(keys)), pa.array(likelihoods(texts, shared.value) / np.log(10))], ["key", "gain"])

        for b in batches:
            keys.append(b.column(0).to_numpy(zero_copy_only=False))
            texts += [np.frombuffer(x.as_buffer(), kind) for x in b.column(1)]
            n += sum(map(len, texts[-b.num_rows :]))
            if n >= GROUP:
                yield out()
                keys, texts, n = [], [], 0
        if texts:
            yield out()

    gain = coded.select("key", "classes").mapInArrow(run, "key long, gain double")
    rows = unigram(coded, vocabulary).join(gain, "key")
    whole = (F.col("logs") - F.col("n_tokens") * float(np.log10(vocabulary.total)) + F.col("gain")).alias("score")
    return rows.select("id", "held", "n_tokens", "n_known", base_score(vocabulary).alias("base_score"), whole)


def op12_query(spark, sf_dir):
    """Scores of all documents by word counts and by a hidden Markov model of those not held out."""
    docs = table(spark, sf_dir, "documents")
    vocabulary = Vocabulary(docs.where(~held_out()))
    coded = vocabulary.encode(docs)
    model, _ = baum_welch(coded.where("NOT held"), vocabulary.prior)
    out = score(coded, vocabulary, model)
    return out.select(F.col("id").alias("doc_id"), F.col("held").alias("held_out"), "n_tokens", "n_known", F.lit(vocabulary.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def unigram_query(spark, sf_dir):
    """The part of op12's rows that SQL can check."""
    docs = table(spark, sf_dir, "documents")
    vocabulary = Vocabulary(docs.where(~held_out()))
    out = unigram(vocabulary.encode(docs), vocabulary)
    return out.select(F.col("id").alias("doc_id"), F.col("held").alias("held_out"), "n_tokens", "n_known", F.lit(vocabulary.tokens).cast("long").alias("train_tokens"), F.round(base_score(vocabulary), 3).alias("base_score"))


UNIGRAM_SQL = r"""
WITH k AS (SELECT DISTINCT doc_id, coalesce(CAST(doc_id AS VARCHAR), '') AS key FROM documents),
bits AS (
  SELECT doc_id, list_transform(range(0, 8 * length(key)), lambda i: CAST((ascii(substr(key, CAST(i // 8 + 1 AS BIGINT), 1)) >> CAST(i % 8 AS INT)) & 1 AS BIGINT)) AS b FROM k),
h AS (
  SELECT doc_id, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), b), lambda a, x: CASE WHEN xor(a, x) & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END), 4294967295) % 10 = 0 AS held FROM bits),
d AS (
  SELECT row_number() OVER () AS r, doc_id, held, list_append(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), '') AS ws
  FROM documents JOIN h USING (doc_id)),
t AS (SELECT r, doc_id, held, unnest(ws) AS w FROM d),
c AS (SELECT w, count(*) AS n FROM t WHERE NOT held GROUP BY w),
v AS (SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS tokens, count(*) AS kinds FROM c)
SELECT t.doc_id, t.held AS held_out, count(*) AS n_tokens, count(c.n) AS n_known, any_value(tokens) AS train_tokens,
       round(sum(log10(coalesce(c.n, 0) + 0.1)) - count(*) * log10(any_value(tokens) + 0.1 * (any_value(kinds) + 1)), 3) AS base_score
FROM t LEFT JOIN c USING (w) CROSS JOIN v GROUP BY t.r, t.doc_id, t.held
"""
