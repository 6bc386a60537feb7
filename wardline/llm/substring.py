"""Fuzzy repeated passages by collinear chaining of shared k-mer seeds.

1. Minimisers of each text's k-word windows are seeds: two texts that share k + window - 1 words in a row share one.
2. The first text that has a seed, by id, owns it; all others match with the owner only, so that a passage of m
   documents gives m - 1 matches and not m squared.
3. Matches of two texts are chained in order of both with gap costs, each with the best chain end within the longest gap,
   which a Fenwick tree with expiring entries finds. Documents whose chains cannot add up to a passage are left.
4. Owners' slices around chains, by blocks of words, come once each and meet the chains; chains are aligned word by
   word: substitutions and gaps between seeds are scored and both ends extended until the score falls off.
5. Aligned spans that lie close together in both texts are one if it is as equal as a span must be; spans of a document
   that touch are one passage; those of ``least`` words or more count.

Defined results: null and empty texts and those below k words have no passages; rows with a null id and rows that repeat
an id are not compared with each other; the occurrence in the smallest id stays; repeats inside one document are left;
an empty table gives an empty result; further columns are kept by ``cut`` whatever their names.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import Counter, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import Words, maybe_in, not_in, parts, runs, slices, slots_of, stored, table, text_buffer

K, WINDOW, LEAST = 6, 8, 50
#: Gap cost of each word skipped in either text; the longest gap inside a chain; words around a chain for alignment.
GAP, MOST_GAP, MARGIN, BLOCK = 0.2, 40, 32, 32
#: Alignment: gain of equal words, cost of others, and the loss at which an extension ends; least share of equal words.
EQUAL, OTHER, DROP, IDENTITY = 1, 2, 8, 0.8
#: Words between two spans of one pair of texts that do not part them.
BRIDGE = 12


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))


def _minimisers(h: np.ndarray, window: int) -> np.ndarray:
    """Positions of the least hash in every window; the first of equals."""
    if len(h) <= window:
        return np.array([int(h.argmin())]) if len(h) else np.zeros(0, np.int64)
    at = np.lib.stride_tricks.sliding_window_view(h, window).argmin(1) + np.arange(len(h) - window + 1)
    return np.unique(at)


def _thinned(row: np.ndarray, seed: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Indexes of the first seed of each kind in every half MARGIN of words of a row: words that repeat at once have the same
    seed all along, and alignment reaches from each to the next that is kept."""
    order = np.lexsort((at, seed, row))
    r, s, b = row[order], seed[order], at[order] // (MARGIN // 2)
    return np.sort(order[np.append(True, (r[1:] != r[:-1]) | (s[1:] != s[:-1]) | (b[1:] != b[:-1]))]) if len(order) else order


def seeds(src: DataFrame, k: int = K, window: int = WINDOW) -> DataFrame:
    """(seed, doc_id, pos) of the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, offsets = text_buffer(b.column(1))
            ids = b.column(0).to_numpy(zero_copy_only=False)
            for i, j in slices(offsets):
                part = offsets[i : j + 1]
                w = Words(buf[part[0] : part[-1]], part - part[0])
                h, _ = w.shingles(k)
                pos = [_minimisers(h[a : a + n - k + 1], window) if n >= k else np.zeros(0, np.int64) for a, n in zip(w.first[:-1].tolist(), w.count.tolist(), strict=True)]
                size = [len(p) for p in pos]
                at = np.concatenate(pos) if pos else np.zeros(0, np.int64)
                row = np.repeat(np.arange(w.rows), size)
                seed = h[at + w.first[row]] if len(at) else np.zeros(0, np.uint64)
                once = _thinned(row, seed, at)
                yield pa.record_batch([pa.array(seed[once].view(np.int64)), pa.array(ids[i:j][row[once]]), pa.array(at[once].astype(np.int32))], ["seed", "doc_id", "pos"])

    return src.where("doc_id IS NOT NULL").mapInArrow(run, "seed long, doc_id long, pos int")


# ---------------------------------------------------------------- chaining


class WindowTree:
    """A Fenwick tree of maxima over positions 1 to n in which older entries expire.

    A node keeps its entries (value, index) as a queue of falling values and rising indexes: what a later entry beats is
    dropped when that one comes, and what has expired is dropped from the front when the node is asked.
    """

    def __init__(self, n: int):
        self.n = n
        self.node: list[deque | None] = [None] * (n + 1)
        self.leaf: list[deque | None] = [None] * (n + 1)

    @staticmethod
    def _push(queues: list[deque | None], at: int, entry: tuple[float, int]) -> None:
        queue = queues[at]
        if queue is None:
            queues[at] = deque((entry,))
            return
        while queue and queue[-1][0] <= entry[0]:
            queue.pop()
        queue.append(entry)

    def add(self, at: int, value: float, index: int) -> None:
        entry = (value, index)
        self._push(self.leaf, at, entry)
        while at <= self.n:
            self._push(self.node, at, entry)
            at += at & -at

    def best(self, low: int, high: int, oldest: int) -> tuple[float, int] | None:
        """The largest entry at positions low to high whose index is ``oldest`` or later; the latest of equals."""
        found = None
        while high >= low:
            step = high & -high
            queue, after = (self.node[high], high - step) if high - step >= low - 1 else (self.leaf[high], high - 1)
            if queue:
                while queue and queue[0][1] < oldest:
                    queue.popleft()
                if queue and (found is None or queue[0] > found):
                    found = queue[0]
            high = after
        return found


def _scores(a: list[int], b: list[int], k: int, gap: float, reach: int, score: list[float], before: list[int], low: int, high: int) -> None:
    """Scores and predecessors of the matches ``low`` to ``high``, which no others reach, by a tree over their owner positions."""
    places = sorted(set(b[low:high]))
    rank = {x: i + 1 for i, x in enumerate(places)}
    tree = WindowTree(len(places))
    put = oldest = low
    for i in range(low, high):
        while a[put] < a[i]:
            tree.add(rank[b[put]], score[put] + gap * (a[put] + b[put]), put)
            put += 1
        while a[i] - a[oldest] > reach:
            oldest += 1
        found = tree.best(bisect_left(places, b[i] - reach) + 1, rank[b[i]] - 1, oldest)
        score[i] = float(k)
        if found:
            gain = found[0] - gap * (a[i] + b[i])
            if gain > 0:
                score[i] += gain
                before[i] = found[1]


def chains(a: list[int], b: list[int], k: int = K, gap: float = GAP, most_gap: int = MOST_GAP) -> list[list[int]]:
    """Chains of matches (a[i], b[i]), sorted by a then b, as lists of indexes; every match is in one at most.

    score(i) = k + max(0, max over j before i in both texts, by most_gap + k words at most, of score(j) - gap * (words from
    j to i in both)). Matches come in order of the document; a Fenwick tree over the owner's positions gives the best
    predecessor among those within reach.
    """
    reach, n = most_gap + k, len(a)
    da, db = np.diff(a), np.diff(b)
    if n and ((da == db) & (da > 0) & (2 * gap * da < k) & (da <= reach)).all():
        return [list(range(n))]  # on one diagonal each is best chained with the one before
    score, before = [0.0] * n, [-1] * n
    cuts = [0, *(np.flatnonzero(da > reach) + 1).tolist(), n]
    for low, high in zip(cuts, cuts[1:], strict=False):
        _scores(a, b, k, gap, reach, score, before, low, high)
    used, out = [False] * n, []
    for i in sorted(range(n), key=lambda x: (-score[x], x)):
        chain = []
        j = i
        while j >= 0 and not used[j]:
            used[j] = True
            chain.append(j)
            j = before[j]
        if chain:
            out.append(chain[::-1])
    return out


def _reach(spans: list[tuple[int, int]], slack: list[int], least: int) -> list[bool]:
    """Which spans, each drawn out by its ``slack`` on both sides, are in a union of ``least`` words or more."""
    drawn = [(x - s, y + s) for (x, y), s in zip(spans, slack, strict=True)]
    order = sorted(range(len(spans)), key=drawn.__getitem__)
    keep, group, low, high = [False] * len(spans), [], 0, -1
    for i in [*order, -1]:
        if i >= 0 and group and drawn[i][0] <= high:
            group.append(i)
            high = max(high, drawn[i][1])
            continue
        if group and high - low >= least:
            for g in group:
                keep[g] = True
        if i >= 0:
            group, (low, high) = [i], drawn[i]
    return keep


def _uncovered(found: list[tuple[int, list[int], list[int]]], k: int) -> list[tuple[int, list[int], list[int]]]:
    """Chains (owner, a, b) without those of one seed that lie where a longer chain of any owner does: they add no words."""
    firsts: list[int] = []
    ends: list[int] = []
    for x, y in sorted((a[0], a[-1] + k) for _, a, _ in found if len(a) > 1):
        if ends and x <= ends[-1]:
            ends[-1] = max(ends[-1], y)
        else:
            firsts.append(x)
            ends.append(y)
    out = []
    for f in found:
        i = bisect_right(firsts, f[1][0]) - 1
        if len(f[1]) > 1 or i < 0 or f[1][0] + k > ends[i]:
            out.append(f)
    return out


def _chain_runs(k: int, window: int, least: int):
    # alignment may draw a chain out: far where its owner has more seeds here, as a passage with edits has; else a window
    far, near = max(k + window, (least - k - 1) // 2), window

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "odoc", "a", "b", "low", "high"]
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.int32()]
        rows: list[tuple] = []
        for t in runs(batches, ["doc_id"]):
            doc = t.column("doc_id")[0].as_py()
            odocs, pos, opos = (t.column(c).to_numpy() for c in ("odoc", "pos", "opos"))
            cuts = [0, *(np.flatnonzero(np.diff(odocs)) + 1).tolist(), len(odocs)]
            found = []
            for x, y in zip(cuts, cuts[1:], strict=False):
                a, b = pos[x:y].tolist(), opos[x:y].tolist()
                found += [(int(odocs[x]), [a[i] for i in c], [b[i] for i in c]) for c in chains(a, b, k)]
            found = _uncovered(found, k)
            of = Counter()
            for o, a, _ in found:
                of[o] += len(a)
            keep = _reach([(a[0], a[-1] + k) for _, a, _ in found], [far if of[o] > 1 else near for o, _, _ in found], least)
            for (o, a, b), good in zip(found, keep, strict=True):
                if good:
                    low = max(0, (b[0] - MARGIN) // BLOCK * BLOCK)
                    rows.append((doc, o, np.array(a, "<i4").tobytes(), np.array(b, "<i4").tobytes(), low, -(-(b[-1] + k + MARGIN) // BLOCK) * BLOCK))
            if len(rows) > 2000:
                yield pa.record_batch([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                rows = []
        if rows:
            yield pa.record_batch([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return run


# ---------------------------------------------------------------- alignment


def _straight(x: np.ndarray, y: np.ndarray) -> tuple[int, int]:
    """Words of the best common start of x and y on one diagonal, ended by a loss of DROP, and how many of them are equal."""
    n = min(len(x), len(y))
    if not n:
        return 0, 0
    same = x[:n] == y[:n]
    score = np.cumsum(np.where(same, EQUAL, -OTHER))
    best = np.maximum.accumulate(np.maximum(score, 0))
    stop = np.flatnonzero(best - score >= DROP)
    end = int(stop[0]) if len(stop) else n
    if not end or score[:end].max() <= 0:
        return 0, 0
    end = int(score[:end].argmax()) + 1
    return end, int(same[:end].sum())


#: Words skipped in either text where an extension goes on, the cheapest first, if FOOT words agree behind them.
SKIP, FOOT = 4, 3
_SHIFTS = sorted(((i, j) for i in range(SKIP + 1) for j in range(SKIP + 1) if i or j), key=lambda s: (max(s), s[0] + s[1]))


def _extend(x: np.ndarray, y: np.ndarray) -> tuple[int, int, int]:
    """Words of the best common start of x and of y, and how many of them are equal: along diagonals, with steps over words
    that one of them has more as long as what follows gains more than the step costs."""
    i, same = _straight(x, y)
    j = i
    while True:
        u, v = x[i : i + SKIP + FOOT].tolist(), y[j : j + SKIP + FOOT].tolist()
        for di, dj in _SHIFTS:
            foot = u[di : di + FOOT]
            if len(foot) == FOOT and foot == v[dj : dj + FOOT]:
                n, equal = _straight(x[i + di :], y[j + dj :])
                if (EQUAL + OTHER) * equal - OTHER * n > OTHER * max(di, dj):
                    i, j, same = i + di + n, j + dj + n, same + equal
                    break
        else:
            return i, j, same


def _common(x: list[int], y: list[int]) -> int:
    """Length of the longest common subsequence of two short pieces."""
    row = [0] * (len(y) + 1)
    for u in x:
        last = 0
        for j, v in enumerate(y):
            keep = row[j + 1]
            row[j + 1] = last + 1 if u == v else max(row[j + 1], row[j])
            last = keep
    return row[-1]


def align(doc: np.ndarray, other: np.ndarray, low: int, a: list[int], b: list[int], k: int = K) -> list[tuple[int, int, int, int, int]]:
    """(first word, end, equal words, first word and end in the owner) of a chain's passages in ``doc``; ``other`` is the
    owner's slice from word ``low``.

    A chain falls apart where a gap costs more than it brings; outer ends are extended as far as the score holds.
    """
    b = [x - low for x in b]
    pieces, first, equal = [], 0, k
    for i in range(1, len(a)):
        da, db = a[i] - a[i - 1], b[i] - b[i - 1]
        if da == db:
            same = int((doc[a[i - 1] + k : a[i] + k] == other[b[i - 1] + k : b[i] + k]).sum())
            if da > k and 4 * same < 3 * da:  # words that came and went in between
                same = max(same, k + _common(doc[a[i - 1] + k : a[i]].tolist(), other[b[i - 1] + k : b[i]].tolist()))
        elif min(da, db) <= k:
            same = min(da, db)
        else:
            same = k + _common(doc[a[i - 1] + k : a[i]].tolist(), other[b[i - 1] + k : b[i]].tolist())
        if EQUAL * same < OTHER * (max(da, db) - same):
            pieces.append((first, i - 1, equal))
            first, equal = i, k
        else:
            equal += same
    pieces.append((first, len(a) - 1, equal))
    out = []
    for x, y, equal in pieces:
        end, oend = a[y] + k, b[y] + k
        left, oleft, before = _extend(doc[: a[x]][::-1], other[: b[x]][::-1])
        right, oright, after = _extend(doc[end:], other[oend:])
        equal += before + after
        if equal >= IDENTITY * (end + right - a[x] + left):
            out.append((a[x] - left, end + right, equal, low + b[x] - oleft, low + oend + oright))
    return out


def bridged(spans: list[tuple[int, int, int, int, int]]) -> list[tuple[int, int, int]]:
    """(first, end, equal) of the spans that a document shares with one other, as ``align`` gives them; neighbours with at most
    BRIDGE words between them in both texts are one span, if it is as equal as a span must be."""
    out: list[list[int]] = []
    for first, end, equal, ofirst, oend in sorted(spans):
        last = out[-1] if out else None
        if last and 0 <= first - last[1] <= BRIDGE and abs(ofirst - last[4]) <= BRIDGE and last[2] + equal >= IDENTITY * (end - last[0]):
            last[1], last[2], last[4] = end, last[2] + equal, oend
        else:
            out.append([first, end, equal, ofirst, oend])
    return [tuple(s[:3]) for s in out]


def merge(spans: list[tuple[int, int, int, int]], least: int) -> list[list[tuple[int, int, int, int]]]:
    """Spans (first, end, equal, other) that touch, by passage of ``least`` words or more."""
    out: list[list] = []
    high = -1
    for s in sorted(spans):
        if out and s[0] <= high:
            out[-1].append(s)
        else:
            out.append([s])
            high = s[1]
        high = max(high, s[1])
    return [p for p in out if max(x[1] for x in p) - p[0][0] >= least]


def by_owner(passage: list[tuple[int, int, int, int]]) -> list[dict]:
    """One entry for each document that the spans of a passage were found in: their reach, equal words (those of spans that
    overlap count once each), and the passage's own bounds."""
    low, high = passage[0][0], max(s[1] for s in passage)
    out: dict[int, dict] = {}
    for first, end, equal, other in passage:
        x = out.setdefault(other, {"first": first, "end": end, "equal": 0, "other": other, "low": low, "high": high})
        x["first"], x["end"], x["equal"] = min(x["first"], first), max(x["end"], end), x["equal"] + equal
    return list(out.values())


# ---------------------------------------------------------------- Spark


def _slices(src: DataFrame, asked: DataFrame) -> DataFrame:
    """(odoc, low, high, words): 32-bit hashes of the asked word ranges of documents, each once. A row that repeats an id counts once."""
    texts = maybe_in(src, F.col("doc_id"), stored(slots_of(asked, "odoc"), "owner_slots"))
    wanted = asked.groupBy("odoc").agg(F.sort_array(F.collect_set(F.struct("low", "high"))).alias("ranges"))
    joined = wanted.join(texts, F.col("doc_id") == F.col("odoc")).select("odoc", "text", "ranges")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, offsets = text_buffer(b.column(1))
            rows = []
            for i, (o, ranges) in enumerate(zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True)):
                w = Words(buf[offsets[i] : offsets[i + 1]], offsets[i : i + 2] - offsets[i])
                words = w.hash.astype(np.uint32)
                rows += [(o, r["low"], r["high"], words[r["low"] : r["high"]].tobytes()) for r in ranges]
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary()]
            yield pa.record_batch([pa.array([r[c] for r in rows], t) for c, t in enumerate(kinds)], ["odoc", "low", "high", "words"])

    return joined.mapInArrow(run, "odoc long, low int, high int, words binary")


def _align_run(k: int, least: int, out: StructType):
    """Of each document's rows (doc_id, kind, ...), its texts (kind 0) before its chains (kind 1), the texts with their passages:
    a list of (first, end, equal, other, low, high), and what is left of the text if there are any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [f.type for f in to_arrow_schema(out)]
        for t in runs(batches, ["doc_id"]):
            kind = t.column("kind").to_numpy()
            own, chained = t.filter(pa.array(kind == 0)), t.filter(pa.array(kind == 1))
            if not own.num_rows:
                continue
            odocs, low = chained.column("odoc").to_pylist(), chained.column("low").to_pylist()
            a, b = ([np.frombuffer(x, "<i4").tolist() for x in chained.column(c).to_pylist()] for c in ("a", "b"))
            others = [np.frombuffer(x, np.uint32) for x in chained.column("words").to_pylist()]
            buf, offsets = text_buffer(own.column("text"))
            found, texts = [], []
            for i in range(own.num_rows):
                data = buf[offsets[i] : offsets[i + 1]]
                w = Words(data, offsets[i : i + 2] - offsets[i])
                words = w.hash.astype(np.uint32)
                of: dict[int, list] = {}
                for o, x, y, from_, other in zip(odocs, a, b, low, others, strict=True):
                    if x[-1] + k <= len(words):  # else of another text of this id
                        of.setdefault(o, []).extend(align(words, other, from_, x, y, k))
                passages = merge([(*g, o) for o, found_ in of.items() for g in bridged(found_)], least)
                found.append([x for p in passages for x in by_owner(p)])
                at, left = 0, []
                for p in passages:
                    left.append(data[at : w.start[p[0][0]]].tobytes())
                    end = max(s[1] for s in p)
                    at = int(w.start[end]) if end < len(w.start) else len(data)
                left.append(data[at:].tobytes())
                texts.append(b"".join(left).decode("utf-8", "replace") if passages else None)
            cols = [own.column("row").combine_chunks(), own.column("doc_id").combine_chunks(), pa.array(found, kinds[2]), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, ["row", "doc_id", "spans", "cut"])

    return run


SPANS = "spans array<struct<first: int, end: int, equal: int, other: long, low: int, high: int>>, cut string"


def find(docs: DataFrame, k: int = K, window: int = WINDOW, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> tuple[DataFrame, DataFrame]:
    """(with, without): documents that may have passages, with ``spans`` and the text without them as ``cut`` (null if it
    stays whole), and those that have none. Rows are (doc_id), or with ``keep`` all input columns as struct ``row``."""
    src = _source(docs, id_col, text_col)
    all_seeds = seeds(src, k, window)
    owners = all_seeds.groupBy("seed").agg(F.min(F.struct("doc_id", "pos")).alias("x"), F.max("doc_id").alias("last")).where("x.doc_id < last")
    owners = stored(owners.select("seed", F.col("x.doc_id").alias("odoc"), F.col("x.pos").alias("opos")), "owners")
    matches = all_seeds.join(owners, "seed").where("doc_id > odoc").select("doc_id", "odoc", "pos", "opos")
    n = parts(docs.sparkSession)
    sorted_ = matches.repartition(n, "doc_id").sortWithinPartitions("doc_id", "odoc", "pos", "opos")
    found = stored(sorted_.mapInArrow(_chain_runs(k, window, least), "doc_id long, odoc long, a binary, b binary, low int, high int"), "chains")
    asked = found.select("odoc", "low", "high").distinct()
    cut = stored(_slices(src, stored(asked, "asked")), "slices")
    slots = stored(slots_of(found, "doc_id"), "slots")
    whole = F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row") if keep else F.lit(True).alias("row")
    rows = docs.select(whole, docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    texts = maybe_in(rows, F.col("doc_id"), slots).withColumn("kind", F.lit(0))
    chained = found.join(cut, ["odoc", "low", "high"]).select("doc_id", "odoc", "a", "b", "low", "words", F.lit(1).alias("kind"))
    both = texts.unionByName(chained, allowMissingColumns=True).repartition(n, "doc_id").sortWithinPartitions("doc_id", "kind", "odoc", "low")
    schema = StructType([*rows.select("row", "doc_id").schema, *StructType.fromDDL(SPANS)])
    aligned = both.mapInArrow(_align_run(k, least, schema), schema)
    none = not_in(rows, F.col("doc_id"), slots).select("row", "doc_id")
    return aligned, none


def passages(docs: DataFrame, **options) -> DataFrame:
    """One row for each document, passage and earlier document it is found in: words [start_word, end_word) of the document's
    ``[passage_start, passage_end)``, and how many of them are equal."""
    with_, _ = find(docs, **options)
    each = with_.select("doc_id", F.explode("spans").alias("s"))
    word = lambda c, name: F.col(f"s.{c}").cast("long").alias(name)
    return each.select("doc_id", word("other", "other_doc_id"), word("first", "start_word"), word("end", "end_word"), word("equal", "equal_words"), word("low", "passage_start"), word("high", "passage_end"))


def cut(docs: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The documents without their repeated passages; those of which nothing is left go, a clean document stays as it is."""
    with_, none = find(docs, text_col=text_col, keep=True, **options)
    text = F.coalesce("cut", F.col(f"row.`{text_col}`"))
    changed = with_.where(r"cut IS NULL OR cut RLIKE '[^\\x20\\x09-\\x0D]'").select(*[(text if c == text_col else F.when(F.col("cut").isNotNull(), F.length("cut").cast("long")).otherwise(F.col("row.n_chars")) if c == "n_chars" else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
    return changed.union(none.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns]))


def op7_query(spark, sf_dir):
    return passages(table(spark, sf_dir, "documents"))
