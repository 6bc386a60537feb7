"""Packing documents into fixed-length token sequences with the sum-of-squares rule.

Texts become token ids in Arrow batches; distinct words are encoded once per worker. A document's ids are cut at
multiples of the sequence length, so that whole sequences fill themselves, and what remains is placed online: N(h)
counts the open sequences of fill level h in a level array, and a remainder goes where the sum of N(h)^2 afterwards
is least. Parts of the input are packed by themselves; the items of sequences they leave open are then packed again in
ever fewer parts, so that padding does not grow with the number of parts.

Defined results: a null or empty text is the end id alone; repeated rows (and ids) are documents of their own; a null
id is kept; an empty table gives an empty result; only the named columns are read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, slices, stored, table, text_buffer

CAPACITY = 4096
END_ID = 2
#: Pieces that a worker remembers, in some 25 bytes each; beyond, it forgets all. Longer texts are encoded so many at a time.
MOST_KNOWN = 2_000_000
#: Items that one part of a packing round holds, about.
PART_ITEMS = 20_000
#: Share of a sequence from which it is left as it is.
NEARLY_FULL = 0.98


#: Classes of ASCII bytes; a word with any other byte, or an apostrophe, is encoded whole.
_WHOLE, _LETTER, _DIGIT, _SIGN = 0, 1, 2, 3
_CLASS = np.zeros(256, np.uint8)
_CLASS[0x21:0x7F] = _SIGN
_CLASS[ord("0") : ord("9") + 1] = _DIGIT
_CLASS[ord("a") : ord("z") + 1] = _CLASS[ord("A") : ord("Z") + 1] = _LETTER
_CLASS[ord("'")] = _WHOLE


class Known:
    """Ids by hash: sorted arrays, a large one and one of recent entries that is merged in now and then."""

    def __init__(self) -> None:
        self.parts = [(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32))] * 2
        self.ids, self.used = np.zeros(1 << 20, np.uint16), 0

    def __len__(self) -> int:
        return sum(len(p[0]) for p in self.parts)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First id and number of ids of sorted distinct hashes; -1 where unknown."""
        begin, size = np.full(len(h), -1, np.int64), np.zeros(len(h), np.int32)
        for keys, begins, sizes in self.parts:
            if len(keys):
                at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                hit = keys[at] == h
                begin[hit], size[hit] = begins[at[hit]], sizes[at[hit]]
        return begin, size

    def add(self, h: np.ndarray, ids: list[list[int]]) -> None:
        size = np.fromiter(map(len, ids), np.int32, len(ids))
        total = int(size.sum())
        while len(self.ids) < self.used + total:
            self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
        self.ids[self.used : self.used + total] = np.fromiter(chain.from_iterable(ids), np.uint16, total)
        new = h, self.used + np.cumsum(size) - size, size
        self.used += total
        self.parts[1] = self._merged(self.parts[1], new)
        if len(self.parts[1][0]) > 1 << 16:
            self.parts = [self._merged(*self.parts), (h[:0], new[1][:0], size[:0])]

    @staticmethod
    def _merged(x: tuple, y: tuple) -> tuple:
        keys = np.concatenate((x[0], y[0]))
        by = np.argsort(keys, kind="stable")
        return keys[by], np.concatenate((x[1], y[1]))[by], np.concatenate((x[2], y[2]))[by]


class PieceEncoder:
    """Ids of texts, put together from the ids of their pieces.

    For tokenizers such as word_bpe_49k.json, which lower-case, split at white space and then into letters, single digits
    and other signs, and have fewer than 65,536 ids. ASCII words are split here, so that few distinct pieces remain; a word with another byte
    or an apostrophe, or with what may be a special string, is left whole to the full tokenizer.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.full = Tokenizer.from_file(path)
        self.plain = Tokenizer(self.full.model)
        self.plain.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.known = Known()

    def _pieces(self, data: np.ndarray, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """First byte, end and wholeness of each piece, and pieces before each word (and after the last)."""
        kind = _CLASS[data]
        odd = np.concatenate(([0], np.cumsum(kind == _WHOLE)))
        whole = odd[w.end] > odd[w.start]
        if b"<|" in (raw := data.tobytes()):
            at = raw.find(b"<|")
            while at >= 0:
                whole[np.searchsorted(w.start, at, "right") - 1] = True
                at = raw.find(b"<|", at + 1)
        split = np.zeros(len(data) + 1, bool)
        split[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
        inside = np.zeros(len(data) + 1, np.int8)  # bytes of words that are split
        inside[w.start[~whole]] += 1
        inside[w.end[~whole]] -= 1
        split &= np.cumsum(inside, dtype=np.int8).astype(bool)
        split[w.start] = True
        start = np.flatnonzero(split)
        first = np.searchsorted(start, w.start)
        end = np.append(start[1:], 0)
        last = np.append(first[1:], len(start)) - 1
        end[last] = w.end
        part = np.zeros(len(start), bool)
        part[first[whole]] = True
        return start, end, part, np.append(first, len(start))

    def _ids(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, whole: np.ndarray) -> list[list[int]]:
        """Ids of some pieces by the tokenizer."""
        raw = data.tobytes()
        texts = [raw[x:y] for x, y in zip(start.tolist(), end.tolist(), strict=True)]
        plain, rest = np.flatnonzero(~whole).tolist(), np.flatnonzero(whole).tolist()
        ids: list[list[int]] = [[]] * len(texts)
        for k, e in zip(plain, self.plain.encode_batch_fast([texts[k].decode("ascii").lower() for k in plain], add_special_tokens=False), strict=True):
            ids[k] = e.ids
        for k, e in zip(rest, self.full.encode_batch_fast([texts[k].decode("utf-8", "replace") for k in rest], add_special_tokens=False), strict=True):
            ids[k] = e.ids
        return ids

    def _some(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces, one after the other, and how many each has; MOST_KNOWN pieces at most, so that all can be known."""
        h = Words.span_hash(data, start, end, ~whole)
        unique, at, inverse = np.unique(h, return_index=True, return_inverse=True)
        begin, size = self.known.find(unique)
        if len(self.known) + int((begin < 0).sum()) > MOST_KNOWN:
            self.known = Known()
            begin, size = self.known.find(unique)
        new = np.flatnonzero(begin < 0)
        if len(new):
            pick = at[new]
            self.known.add(unique[new], self._ids(data, start[pick], end[pick], whole[pick]))
            begin, size = self.known.find(unique)
        begin, size = begin[inverse], size[inverse].astype(np.int64)
        total = np.cumsum(size)
        return self.known.ids[np.arange(int(size.sum())) + np.repeat(begin - (total - size), size)], size

    def encode(self, buf: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
        """Ids of each row."""
        for i, j in slices(offsets):
            bounds = offsets[i : j + 1] - offsets[i]
            data = buf[offsets[i] : offsets[j]]
            w = Words(data, bounds, lower=False)
            start, end, whole, before = self._pieces(data, w)
            got = [self._some(data, *(x[p : p + MOST_KNOWN] for x in (start, end, whole))) for p in range(0, len(start), MOST_KNOWN)]
            flat = np.concatenate([g[0] for g in got]) if got else np.zeros(0, np.uint16)
            total = np.concatenate(([0], np.cumsum(np.concatenate([g[1] for g in got])))) if got else np.zeros(1, np.int64)
            cut = total[before[w.first]]
            for r in range(w.rows):
                yield flat[cut[r] : cut[r + 1]]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens): every document's ids and the end id, cut at multiples of ``capacity``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = PieceEncoder(tokenizer)  # of this task: workers outlive it, and should not hold what it learned
        end = np.array([end_id], "<u4")
        for b in batches:
            buf, offsets = text_buffer(b.column(1))
            rows: list[tuple] = []
            for doc, ids in zip(b.column(0).to_pylist(), encoder.encode(buf, offsets), strict=True):
                ids = np.concatenate((ids, end), dtype="<u4")
                rows += [(doc, s, min(capacity, len(ids) - s), zlib.crc32(ids[s : s + capacity].tobytes()), len(ids)) for s in range(0, len(ids), capacity)]
            yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 5, ["id", "start", "length", "ids_crc32", "doc_tokens"])

    src = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text"))
    return src.mapInArrow(run, "id long, start long, length long, ids_crc32 long, doc_tokens long")


class LevelArray:
    """Open sequences by fill level."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.count = np.zeros(capacity + 1, np.int64)
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.made = 0
        self.full: list[tuple[int, int]] = []

    def place(self, size: int) -> tuple[int, int]:
        """Sequence and offset for an item. Moving a sequence from h to h + size changes the sum by
        2 N(h + size) - 2 N(h) + 2, a new one by 2 N(size) + 1, and one that fills up by 1 - 2 N(h); ties go to the fullest."""
        c, n = self.capacity, self.count
        if size >= c:
            self.made += 1
            self.full.append((self.made - 1, size))
            return self.made - 1, 0
        change = 2 * n[size:] - 2 * n[: c + 1 - size] + 2
        change[-1] = 1 - 2 * n[c - size]
        change[n[: c + 1 - size] == 0] = np.iinfo(np.int64).max
        change[0] = 2 * n[size] + 1
        h = len(change) - 1 - int(np.argmin(change[::-1]))
        if h:
            self.count[h] -= 1
            seq = self.open[h].pop()
        else:
            self.made += 1
            seq = self.made - 1
        if h + size < c:
            self.count[h + size] += 1
            self.open[h + size].append(seq)
        else:
            self.full.append((seq, c))
        return seq, h


def _pack_part(capacity: int):
    """Pack (key, length) rows of a sorted part; gives each its sequence and offset, and the sequence's fill in the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        levels = LevelArray(capacity)
        seqs, offs, held = [], [], []
        for b in batches:
            held.append(b)
            for n in b.column("length").to_pylist():
                s, o = levels.place(n)
                seqs.append(s)
                offs.append(o)
        fill = np.full(levels.made, capacity, np.int64)
        for h, some in enumerate(levels.open):
            fill[some] = h
        seq = np.array(seqs, np.int64)
        off = np.array(offs, np.int64)
        at = 0
        for b in held:
            s, o = seq[at : at + b.num_rows], off[at : at + b.num_rows]
            at += b.num_rows
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s + (part << 32)), pa.array(o), pa.array(fill[s] if len(s) else s)], [*b.schema.names, "seq", "off", "fill"])

    return run


def pack(items: DataFrame, capacity: int = CAPACITY, part_items: int = PART_ITEMS, most_rounds: int = 6) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to (id, start, length, ids_crc32, doc_tokens) rows.

    Parts are dealt by a hash of the row and sorted, so a task run again packs the same way; a part's memory is its small
    rows. The items of sequences that stay below NEARLY_FULL are packed once more in as many parts as they need, until
    that is one.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema)
    order, sealed = ["h", *items.columns], []
    rest, p = items, 0
    for number in range(most_rounds):
        n = rest.count()
        if not n and number:
            break
        last, p = p, max(1, math.ceil(n / part_items))
        dealt = rest.withColumn("h", F.xxhash64(*items.columns)).repartition(p, "h").sortWithinPartitions(*order)
        packed = stored(dealt.mapInArrow(_pack_part(capacity), f"{schema}, h long, seq long, off long, fill long"), "packed")
        rest = packed.where(F.col("fill") < NEARLY_FULL * capacity).select(*items.columns)
        final = p == 1 or p == last or number == most_rounds - 1
        # the round is in the bits above the part's
        sequence = F.col("seq") + F.lit(number << 56)
        sealed.append((packed if final else packed.where(F.col("fill") >= NEARLY_FULL * capacity)).select(*items.columns, sequence.alias("sequence_id"), F.col("off").alias("offset")))
        if final:
            break
    return reduce(DataFrame.union, sealed)


def op6_query(spark, sf_dir):
    import public_tokenizers

    items = stored(pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")), "pieces")
    return pack(items).withColumnRenamed("id", "doc_id")
