"""Runs of repeated words: maximal stretches of at least ``least`` words and ``exponent`` periods.

A run of period q and length L holds each of its words in a block of L - q words that occurs again q words on, so with
k the least such overlap, a word that lies in no k-gram repeated in its own document is in no run. Repeated k-grams mask
the words first; the segments that survive go, laid end to end between words that occur once, through the division of
Main and Lorentz: at the middle of each block every period is tried to the right and to the left of it, two periods by
hash at once, and what agrees is extended both ways. A stretch found by several periods counts by the smallest. Each run
is compared word by word in the end, so that hashes of positions decide nothing alone; words count as equal by 64-bit
hashes. A text is one row of one task; no shuffle, and time in proportion to n log n of the surviving words.

Defined results: a null, empty or blank text has no words and no runs; equal rows give equal rows; a null id stays;
other columns are ignored, whatever their names. ``exponent`` is 4 at least: of such a run two periods lie on one side
of every middle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from . import common
from .common import Words, slices, table, text_buffer

LEAST, EXPONENT = 6, 4
_PAIRS = 1 << 19
_ROW = np.uint64(0x9E6C63D0876A9A4B)
RUN = StructType([StructField(c, LongType()) for c in ("start", "length", "period")])


def overlap(least: int, exponent: int) -> int:
    """Words that the first and the second occurrence of a run's repeated block have at least."""
    return min(max(least, exponent * q) - q for q in range(1, least + 1))


def repeated(w: Words, k: int) -> np.ndarray:
    """Words in a k-gram that occurs more than once in its own row."""
    marks = np.zeros(len(w.hash) + 1, np.int64)
    grams, inside = w.shingles(k)
    at = np.flatnonzero(inside)
    if len(at):
        row = np.repeat(np.arange(w.rows, dtype=np.uint64), w.count)[at]
        key = common.mix(grams[at] + row * _ROW)
        order = np.argsort(key, kind="stable")
        same = key[order[1:]] == key[order[:-1]]
        twice = np.zeros(len(at), bool)
        twice[order[1:]] = same
        twice[order[:-1]] |= same
        marks[at[twice]] += 1
        marks[at[twice] + k] -= 1
    return np.cumsum(marks[:-1]) > 0


class _Text:
    """Word numbers with hashes of all their stretches."""

    def __init__(self, s: np.ndarray):
        self.s, self.n = s, len(s)
        self.power, self.inverse = common._powers(self.n + 1)
        self.total = np.zeros(self.n + 1, np.uint64)
        np.cumsum(common.mix(s.astype(np.uint64) * _ROW + np.uint64(1)) * self.power[: self.n], out=self.total[1:])

    def alike(self, x: np.ndarray, y: np.ndarray, length: np.ndarray) -> np.ndarray:
        return (self.total[x + length] - self.total[x]) * self.inverse[x] == (self.total[y + length] - self.total[y]) * self.inverse[y]

    def _longest(self, most: np.ndarray, alike) -> np.ndarray:
        low, high = np.zeros(len(most), np.int64), most.copy()
        while (low < high).any():
            mid = (low + high + 1) // 2
            ok = alike(mid)
            low, high = np.where(ok, mid, low), np.where(ok, high, mid - 1)
        return low

    def ahead(self, x: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Words from x on that agree with those q further."""
        return self._longest(self.n - x - q, lambda d: self.alike(x, x + q, d))

    def behind(self, x: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Words before x that agree with those q further."""
        return self._longest(x.copy(), lambda d: self.alike(x - d, x - d + q, d))

    def exact(self, base: int, start: int, end: int, q: int) -> tuple[int, int] | None:
        """The stretch of period q around two periods from ``base`` on, by the words themselves."""
        s = self.s
        if np.array_equal(s[start : end - q], s[start + q : end]) and (start == 0 or s[start - 1] != s[start - 1 + q]) and (end == self.n or s[end] != s[end - q]):
            return start, end
        differ = np.flatnonzero(s[:-q] != s[q:])
        i = int(np.searchsorted(differ, base))
        start, end = int(differ[i - 1]) + 1 if i else 0, int(differ[i]) + q if i < len(differ) else self.n
        return (start, end) if end >= base + 2 * q else None


def repetitions(s: np.ndarray, least: int = LEAST, exponent: int = EXPONENT, longest: int | None = None) -> list[tuple[int, int, int]]:
    """(start, length, smallest period) of the maximal repetitions of a sequence of numbers, in order. ``longest`` may
    bound the length of a run, where the caller knows one."""
    if exponent < 4:
        raise ValueError("exponent is 4 at least")
    text, found, block = _Text(s), [], 2
    longest = len(s) if longest is None else longest
    while block // 2 < text.n:
        middles, most = np.arange(block // 2, text.n, block), min(block, longest) // exponent
        step = max(1, _PAIRS // max(1, most))
        for i in range(0, len(middles) if most else 0, step):
            some = middles[i : i + step]
            for j in range(1, most + 1, _PAIRS):
                periods = np.arange(j, min(j + _PAIRS, most + 1))
                m, q = np.repeat(some, len(periods)), np.tile(periods, len(some))
                for base in (m, m - 2 * q):
                    fits = (base >= 0) & (base + 2 * q <= text.n)
                    b, p = base[fits], q[fits]
                    hit = text.alike(b, b + p, p)
                    b, p = b[hit], p[hit]
                    if len(b):
                        start, end = b - text.behind(b, p), b + 2 * p + text.ahead(b + p, p)
                        long = end - start >= np.maximum(least, exponent * p)
                        found.append(np.stack([start, end, p, b], 1)[long])
        block *= 2
    if not found:
        return []
    rows = np.concatenate(found)
    rows = rows[np.lexsort(rows.T[[3, 2, 1, 0]])]
    rows = rows[np.append(True, (rows[1:, :2] != rows[:-1, :2]).any(1))] if len(rows) else rows
    runs = {}
    for start, end, q, base in rows.tolist():
        got = text.exact(base, start, end, q)
        if got and got[1] - got[0] >= max(least, exponent * q):
            runs[got] = min(q, runs.get(got, q))
    return sorted((a, e - a, q) for (a, e), q in runs.items())


def runs_of(w: Words, least: int = LEAST, exponent: int = EXPONENT) -> list[tuple[int, int, int, int]]:
    """(row, start in the row, length, period) of all runs of some rows, in order."""
    live = repeated(w, min(overlap(least, exponent), len(common._STEP)))
    first = np.zeros(len(live), bool)
    first[w.first[:-1][w.count > 0]] = True
    before = np.append(False, live[:-1]) & ~first
    begin = np.flatnonzero(live & ~before)
    after = np.append(live[1:] & ~first[1:], False)
    end = np.flatnonzero(live & ~after) + 1
    keep = end - begin >= least
    begin, end = begin[keep], end[keep]
    if not len(begin):
        return []
    size = end - begin
    _, ids = np.unique(np.concatenate([w.hash[a:b] for a, b in zip(begin.tolist(), end.tolist(), strict=True)]), return_inverse=True)
    place = np.cumsum(size + 1) - size - 1  # of each segment, a word of its own behind each
    laid = np.empty(int((size + 1).sum()), np.int64)
    laid[place + size] = len(ids) + np.arange(len(size))
    laid[np.arange(int(size.sum())) + np.repeat(np.arange(len(size)), size)] = ids
    out = []
    for start, length, q in repetitions(laid, least, exponent, int(size.max())):
        k = int(np.searchsorted(place, start, "right")) - 1
        word = int(begin[k]) + start - int(place[k])
        row = int(np.searchsorted(w.first, word, "right")) - 1
        out.append((row, word - int(w.first[row]), length, q))
    return sorted(out)


def _joined(buf: np.ndarray, w: Words, kept: np.ndarray) -> pa.Array:
    """The kept words of each row, joined by one space."""
    start, size = w.start[kept], w.end[kept] - w.start[kept]
    rows = np.add.reduceat(np.append(kept, False), np.minimum(w.first[:-1], len(kept)), dtype=np.int64) if w.rows else np.zeros(0, np.int64)
    rows = np.where(w.count > 0, rows, 0)
    last = np.cumsum(rows)
    gap = np.ones(len(start), np.int64)
    gap[last[rows > 0] - 1] = 0
    out = np.cumsum(size + gap) - size - gap
    total = int((size + gap).sum())
    data = np.full(total, 0x20, np.uint8)
    inner = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    data[np.repeat(out, size) + inner] = buf[np.repeat(start, size) + inner]
    offsets = np.append(0, np.append(out, total)[last]).astype(np.int64)
    return pa.Array.from_buffers(pa.large_string(), w.rows, [None, pa.py_buffer(offsets), pa.py_buffer(data)]).cast(pa.string())


def _some(col: pa.Array, least: int, exponent: int):
    buf, offsets = text_buffer(col)
    for i, j in slices(offsets):
        part = offsets[i : j + 1]
        piece = buf[part[0] : part[-1]]
        w = Words(piece, part - part[0], lower=False)
        runs = runs_of(w, least, exponent)
        drop = np.zeros(len(w.hash) + 1, np.int64)
        for row, start, length, q in runs:
            at = int(w.first[row]) + start
            drop[at + q] += 1
            drop[at + length] -= 1
        kept = np.cumsum(drop[:-1]) == 0
        each = np.array(runs, np.int64).reshape(-1, 4)
        lists = np.searchsorted(each[:, 0], np.arange(w.rows + 1)).astype(np.int32)
        structs = pa.StructArray.from_arrays([pa.array(each[:, c]) for c in (1, 2, 3)], ["start", "length", "period"])
        yield i, j, pa.array(w.count.astype(np.int64)), pa.ListArray.from_arrays(pa.array(lists), structs), _joined(piece, w, kept)


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, exponent: int = EXPONENT) -> DataFrame:
    """(id, n_words, runs, collapsed): the runs of each whole text by start, then period, and the text without the words
    that a run has after its first period."""
    src = docs.select(docs[f"`{id_col}`"].alias("id"), docs[f"`{text_col}`"].cast("string").alias("text"))

    def run(batches):
        for b in batches:
            for i, j, n, found, collapsed in _some(b.column(1), least, exponent):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), n, found, collapsed], ["id", "n_words", "runs", "collapsed"])

    return src.mapInArrow(run, StructType([src.schema[0], StructField("n_words", LongType()), StructField("runs", ArrayType(RUN)), StructField("collapsed", StringType())]))


def damaged(docs: DataFrame) -> DataFrame:
    """(doc_id, text): every tenth document by the checksum of its id repeats p words from word a on to its end."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    hit = docs.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, words).alias("w"))
    hit = hit.select("*", F.expr("h div 10").alias("g"), F.size("w").alias("n"))
    hit = hit.select("*", F.when(F.col("n") > 0, (F.col("g") % F.col("n")).cast("int")).alias("a"))
    hit = hit.select("*", F.expr("CAST(1 + (n - a) div (3 + g % 8) AS INT)").alias("p"))
    again = "concat(slice(w, 1, a), slice(flatten(array_repeat(slice(w, a + 1, p), CAST(ceil((n - a) / p) AS INT))), 1, n - a))"
    return hit.select("doc_id", F.when(F.col("a").isNull(), F.col("text")).otherwise(F.array_join(F.expr(again), " ")).alias("text"))


def op11_query(spark, sf_dir):
    """Runs of all documents, a tenth of them made periodic, and digests of runs and collapsed texts."""
    found = periodic_runs(damaged(table(spark, sf_dir, "documents")))
    line = F.transform("runs", lambda r: F.concat_ws(",", *[r[c].cast("string") for c in RUN.names]))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    found = found.select("id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.array_join(F.transform(line, lambda x: F.concat(x, F.lit("\n"))), "").alias("lines"), "collapsed")
    return found.select(
        F.col("id").alias("doc_id"), "n_runs", (-F.col("best.start")).alias("start"), "best.length", (-F.col("best.period")).alias("period"), F.expr("(1000 * best.length) div -best.period").alias("exponent_milli"),
        F.sha2("lines", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
