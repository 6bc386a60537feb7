"""Repair of conversation structure by the cheapest edits.

A conversation's rows, in order of turn, are to have role initials ``(s?(ua)+)?``. Each row is kept, re-roled or deleted,
and turns without text may come in between. (rows taken, last initial) are the nodes of a graph whose arcs are the edits.
Minimum costs forward from the start and backward from the end tell the arcs on cheapest paths, the tight ones, which form
a DAG; from the start, the set of nodes reached by the least letters so far takes the least letter of its tight arcs.

Rows are dealt by ranges of (conversation, turn, role, text) and laid into chunks of bounded size, so that no
conversation need fit a task. One that lies in one chunk is repaired there. For the others a chunk is a min-plus matrix
between four nodes, which two passes in order, of one such row a chunk, turn into costs at its edges; a third passes on the
node that the least letters reach. Copies of a row travel as one row and a count. Only the digest of a repaired text reads
a conversation in one place, chunk by chunk.

Defined results: a null role or text is one space; a null conversation id is a conversation, a null turn comes first and
counts for no gap; rows of one turn go by role, then text; a row without a role can only be re-roled or deleted; an empty
table has no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import WORD_CLASS, stored, table

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
BLANK, DUPLICATE, CUT = 1, 2, 3
CHUNK_ROWS, CHUNK_BYTES = 2048, 4 << 20
INF = 1 << 60

#: Nodes by the last initial: 0 none, 1 system, 2 user, 3 assistant. 0 and 3 may end a conversation.
_NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
_FILL = {0: "user", 1: "user", 2: "assistant", 3: "user"}
_TO = [_NEXT[q, _FILL[q][0]] for q in range(4)]
_ACCEPT = [0, INF, INF, 0]
_LEGAL = {"su", "ua", "au"}
_WORD = re.compile(rf"[^{WORD_CLASS}]")


class Row:
    """One row and its copies: role, text, fault of the first of them, how many there are."""

    __slots__ = ("arcs", "copies", "fault", "role", "text")

    def __init__(self, role: str, text: str, fault: int, copies: int):
        self.role, self.text, self.fault, self.copies = role, text, fault, copies
        self.arcs: list[list[tuple[str, int, int]]] = []
        for q in range(4):
            arcs = [("D", DELETE, q)]
            if fault not in (BLANK, DUPLICATE):
                more = TRUNCATED if fault == CUT else 0
                if (q, role[:1]) in _NEXT:
                    arcs.append(("K", KEEP + more, _NEXT[q, role[:1]]))
                arcs.append(("R", REROLE + more, _TO[q]))
            self.arcs.append(arcs)


def _with_inserts(b: list[int]) -> list[int]:
    two = min(b[2], INSERT + b[3])
    three = min(b[3], INSERT + two)
    return [min(b[0], INSERT + two), min(b[1], INSERT + two), two, three]


def backward(rows: list[Row], end: list[int] | None) -> list[list[int]]:
    """Least costs from each node before each row to the end; ``end`` has those behind the last row, None if nothing follows."""
    out = [_with_inserts(_ACCEPT) if end is None else end]
    for row in reversed(rows):
        b, again = out[-1], DELETE * (row.copies - 1)
        out.append(_with_inserts([again + min(c + b[to] for _, c, to in row.arcs[q]) for q in range(4)]))
    return out[::-1]


def forward(rows: list[Row], start: list[int], last: bool) -> list[list[int]]:
    """Least costs from the start to each node before each row and behind the last one; inserts there only if nothing follows."""
    out = [start]
    for i in range(len(rows) + 1):
        f = list(out[-1])
        if i < len(rows) or last:
            f[2] = min(f[2], INSERT + min(f[0], f[1], f[3]))
            f[3] = min(f[3], INSERT + f[2])
            out[-1] = f
        if i < len(rows):
            after, again = [INF] * 4, DELETE * (rows[i].copies - 1)
            for q in range(4):
                for _, c, to in rows[i].arcs[q]:
                    after[to] = min(after[to], f[q] + c + again)
            out.append(after)
    return out


def walk(rows: list[Row], f: list[list[int]], b: list[list[int]], total: int, frontier: set[int], last: bool) -> tuple[str, list[tuple[str, str]], set[int]]:
    """Least letters along tight arcs, the repaired (role, text) and the nodes reached. A letter leads from a node to one
    other, so that the frontier of one start stays one node and tells the roles."""
    letters: list[str] = []
    turns: list[tuple[str, str]] = []
    i = 0
    while i < len(rows) or last:
        tight = []
        for q in frontier:
            if i < len(rows):
                again = DELETE * (rows[i].copies - 1)
                tight += [(x, q, to) for x, c, to in rows[i].arcs[q] if f[i][q] + c + again + b[i + 1][to] == total]
            if f[i][q] + INSERT + b[i][_TO[q]] == total:
                tight.append(("I", q, _TO[q]))
        if not tight:
            break
        letter = min(x for x, _, _ in tight)
        q = min(q for x, q, _ in tight if x == letter)
        frontier = {to for x, _, to in tight if x == letter}
        letters.append(letter)
        if letter == "I":
            turns.append((_FILL[q], ""))
            continue
        if letter != "D":
            turns.append((rows[i].role if letter == "K" else _FILL[q], rows[i].text))
        if rows[i].copies > 1:
            letters.append("D" * (rows[i].copies - 1))  # the least letter, wherever the other edits may go
        i += 1
    return "".join(letters), turns, frontier


def repair(rows: list[Row]) -> tuple[int, str, list[tuple[str, str]]]:
    """(cost, letters, repaired turns) of a whole conversation."""
    b = backward(rows, None)
    f = forward(rows, [0, INF, INF, INF], True)
    letters, turns, _ = walk(rows, f, b, b[0][0], {0}, True)
    return b[0][0], letters, turns


# ---------------------------------------------------------------- Spark: rows and chunks


def _prepared(turns: DataFrame, conv: str, turn: str, role: str, text: str, copies: str | None) -> DataFrame:
    """Distinct rows with their number; a conversation without rows has one of number 0."""
    space = lambda c: F.coalesce(turns[f"`{c}`"].cast("string"), F.lit(" "))
    n = (turns[f"`{copies}`"] if copies else F.lit(1)).cast("long")
    some = turns.select(turns[f"`{conv}`"].alias("conv"), turns[f"`{turn}`"].cast("long").alias("turn"), space(role).alias("role"), space(text).alias("text"), n.alias("copies"))
    none = F.col("copies") == 0
    some = some.select("conv", *[F.when(~none, F.col(c)).alias(c) for c in ("turn", "role", "text")], "copies")
    some = some.groupBy("conv", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    return stored(some.withColumn("h", F.md5("text")), "turns")


_CHUNK = "conv {0}, part int, seq long, whole boolean, turn array<long>, role array<string>, text array<string>, copies array<long>, seen array<boolean>"


def _chunks(rows: DataFrame) -> DataFrame:
    """Rows in order as chunks of bounded size; ``whole`` where a conversation is known to be one chunk."""
    live = rows.where("copies > 0")
    order = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    again = live.groupBy("conv", "role", "h").agg(F.min(order).alias("first"), F.count("*").alias("n")).where("n > 1")
    again = again.select(F.col("conv").alias("conv_"), F.col("role").alias("role_"), F.col("h").alias("h_"), "first")
    same = F.expr("conv <=> conv_ AND role <=> role_ AND h <=> h_")
    met = rows.join(again, same, "left").select("conv", "turn", "role", "text", "copies", F.coalesce(order > F.col("first"), F.lit(False)).alias("seen"))
    dealt = met.withColumn("head", F.substring("text", 1, 128)).repartitionByRange("conv", "turn", "role", "head")
    dealt = dealt.sortWithinPartitions("conv", "turn", "role", "text").select("conv", F.spark_partition_id().alias("part"), "turn", "role", "text", "copies", "seen")
    kind = rows.schema["conv"].dataType.simpleString()
    schema = _CHUNK.format(kind)
    names = ["turn", "role", "text", "copies", "seen"]

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # rows of the chunk being filled
        size = seq = before = waiting = 0  # its size, its number, chunks of its conversation before it; size of ready chunks
        first = True  # its conversation is the partition's first: it may have begun in an earlier one
        conv = part = None
        ready: list[dict] = []

        def close(whole: bool):
            nonlocal waiting
            waiting += size
            ready.append({"conv": conv, "part": part, "seq": seq, "whole": whole, **dict(zip(names, map(list, zip(*held, strict=True)), strict=True))})

        for batch in batches:
            cols = [c.to_pylist() for c in batch.columns]
            for key, p, *row in zip(*cols, strict=True):
                if held and key != conv:
                    close(not first and not before)
                    held, size, seq, before, first = [], 0, seq + 1, 0, False
                elif held and (len(held) >= CHUNK_ROWS or size >= CHUNK_BYTES):
                    close(False)
                    held, size, seq, before = [], 0, seq + 1, before + 1
                conv, part = key, p
                held.append(tuple(row))
                size += len(row[2] or "")
                if len(ready) >= CHUNK_ROWS or waiting >= CHUNK_BYTES:
                    yield pa.RecordBatch.from_pylist(ready, arrow)
                    ready, waiting = [], 0
        if held:
            close(False)
        if ready:
            yield pa.RecordBatch.from_pylist(ready, arrow)

    return stored(dealt.mapInArrow(run, schema), "chunks")


def _rows(chunk: dict) -> list[Row]:
    out = []
    for role, text, copies, seen in zip(chunk["role"], chunk["text"], chunk["copies"], chunk["seen"], strict=True):
        if copies:
            last = next((c for c in reversed(text) if _WORD.match(c)), None)
            out.append(Row(role, text, BLANK if last is None else DUPLICATE if seen else CUT if last not in ".!?" else 0, copies))
    return out


_COUNTS = ["low", "high", "turns", "first_turn", "last_turn", "blank", "duplicate", "truncated", "illegal"]


def _counts(chunk: dict, rows: list[Row]) -> dict:
    """What adds up over chunks, and the ends that tell what lies between two of them."""
    turns = [t for t, n in zip(chunk["turn"], chunk["copies"], strict=True) if n and t is not None]
    initials = [r.role[:1] for r in rows]
    return {
        "low": turns[0] if turns else None, "high": turns[-1] if turns else None, "turns": len(set(turns)), "first_turn": turns[0] if turns else None, "last_turn": turns[-1] if turns else None,
        "blank": sum(r.copies for r in rows if r.fault == BLANK), "duplicate": sum(r.copies if r.fault == DUPLICATE else r.copies - 1 for r in rows if r.fault != BLANK), "truncated": sum(r.fault == CUT for r in rows),
        "illegal": sum(r.copies - 1 for r in rows) + sum(a + b not in _LEGAL for a, b in zip(initials, initials[1:], strict=False)),
        "head": initials[0] if rows else None, "tail": initials[-1] if rows else None,
    }


def _merged(a: dict | None, b: dict) -> dict:
    """Counts of two neighbouring parts of a conversation, as of one."""
    if a is None:
        return b
    out = {k: a[k] + b[k] for k in ("turns", "blank", "duplicate", "truncated", "illegal")}
    out["turns"] -= a["last_turn"] is not None and a["last_turn"] == b["first_turn"]
    out["illegal"] += a["tail"] is not None and b["head"] is not None and a["tail"] + b["head"] not in _LEGAL
    out["low"] = out["first_turn"] = b["low"] if a["low"] is None else a["low"]
    out["high"] = out["last_turn"] = a["high"] if b["high"] is None else b["high"]
    out["head"] = b["head"] if a["head"] is None else a["head"]
    out["tail"] = a["tail"] if b["tail"] is None else b["tail"]
    return out


def _result(conv, counts: dict, cost: int, audit: str, digest: str) -> dict:
    gaps = 0 if counts["low"] is None else counts["high"] - counts["low"] + 1 - counts["turns"]
    return {"conv": conv, "gaps": gaps, **{k: counts[k] for k in ("blank", "duplicate", "truncated", "illegal")}, "cost": cost, "audit": audit, "repaired_sha256": digest}


_RESULT = "conv {0}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _map(df: DataFrame, schema: str, work, flush: int = 512) -> DataFrame:
    """Rows as dicts through a generator, batch by batch."""

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for x in work(r for b in batches for r in b.to_pylist()):
            out.append(x)
            if len(out) >= flush:
                yield pa.RecordBatch.from_pylist(out, arrow)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, arrow)

    return df.mapInArrow(run, schema)


def _said(turns: list[tuple[str, str]]) -> str:
    return "\n".join(f"{role}:{text}" for role, text in turns)


def _alone(chunks: DataFrame, kind: str) -> DataFrame:
    def work(rows):
        for chunk in rows:
            some = _rows(chunk)
            cost, audit, turns = repair(some)
            yield _result(chunk["conv"], _counts(chunk, some), cost, audit, hashlib.sha256(_said(turns).encode()).hexdigest())

    return _map(chunks.where("whole"), _RESULT.format(kind), work)


# ---------------------------------------------------------------- Spark: conversations over chunks


def _in_order(df: DataFrame, descending: bool = False) -> DataFrame:
    """The chunk rows of each conversation in one partition, in order; they pass one at a time."""
    order = [F.col("part"), F.col("seq")]
    return df.repartition("conv").sortWithinPartitions("conv", *[c.desc() if descending else c for c in order])


def _across(chunks: DataFrame, kind: str) -> DataFrame:
    key = f"conv {kind}, part int, seq long"
    open_ = stored(chunks.where("NOT whole").drop("whole"), "open")

    def matrices(rows):
        for chunk in rows:
            some = _rows(chunk)
            m = [forward(some, [0 if q == k else INF for k in range(4)], False)[-1] if some else [0 if q == k else INF for k in range(4)] for q in range(4)]
            yield {"conv": chunk["conv"], "part": chunk["part"], "seq": chunk["seq"], "m": [min(x, INF) for r in m for x in r]}

    def from_the_end(rows):
        conv, b, fresh = None, [], True
        for r in rows:
            if fresh or r["conv"] != conv:
                conv, b, fresh = r["conv"], None, False
            m = r["m"]
            yield {**r, "b": b or [], "last": b is None}
            end = _with_inserts(_ACCEPT) if b is None else b
            b = [min(m[4 * q + k] + end[k] for k in range(4)) for q in range(4)]

    def from_the_start(rows):
        conv, f, fresh, total = None, [], True, 0
        for r in rows:
            if fresh or r["conv"] != conv:
                conv, fresh = r["conv"], False
                f = [0, INF, INF, INF]
                end = _with_inserts(_ACCEPT) if r["last"] else r["b"]
                total = min(r["m"][k] + end[k] for k in range(4))
            yield {"conv": r["conv"], "part": r["part"], "seq": r["seq"], "f": f, "b": r["b"], "last": r["last"], "total": total}
            f = [min(INF, min(f[q] + r["m"][4 * q + k] for q in range(4))) for k in range(4)]

    m = stored(_map(open_, f"{key}, m array<long>", matrices), "matrices")
    b = stored(_map(_in_order(m, True), f"{key}, m array<long>, b array<long>, last boolean", from_the_end), "backward")
    f = stored(_map(_in_order(b), f"{key}, f array<long>, b array<long>, last boolean, total long", from_the_start), "forward")
    at = ["conv", "part", "seq"]

    def edges(chunk):
        some = _rows(chunk)
        b_ = backward(some, None if chunk["last"] else chunk["b"])
        f_ = forward(some, chunk["f"], chunk["last"])
        return some, f_, b_

    def exits(rows):
        for chunk in rows:
            some, f_, b_ = edges(chunk)
            to = [min(walk(some, f_, b_, chunk["total"], {q}, chunk["last"])[2]) if f_[0][q] + b_[0][q] == chunk["total"] else -1 for q in range(4)]
            yield {**{k: chunk[k] for k in at}, "to": to}

    def entries(rows):
        conv, q, fresh = None, 0, True
        for r in rows:
            if fresh or r["conv"] != conv:
                conv, q, fresh = r["conv"], 0, False
            yield {**{k: r[k] for k in at}, "entry": q}
            q = r["to"][q]

    def with_edges(more: DataFrame) -> DataFrame:
        return open_.join(more.drop("conv"), ["part", "seq"])

    to = stored(_map(with_edges(f), f"{key}, to array<int>", exits), "exits")
    entry = stored(_map(_in_order(to), f"{key}, entry int", entries), "entries")

    def pieces(rows):
        for chunk in rows:
            some, f_, b_ = edges(chunk)
            letters, turns, _ = walk(some, f_, b_, chunk["total"], {chunk["entry"]}, chunk["last"])
            yield {**{k: chunk[k] for k in at}, "total": chunk["total"], "counts": _counts(chunk, some), "letters": letters, "said": _said(turns) if turns else None}

    counts = ", ".join(f"{c}:long" for c in _COUNTS)
    piece = stored(_map(with_edges(f.join(entry.drop("conv"), ["part", "seq"])), f"{key}, total long, counts struct<{counts}, head:string, tail:string>, letters string, said string", pieces, flush=8), "pieces")

    def joined(rows):
        conv = counts_ = None
        letters, sha, begun, total, fresh = [], hashlib.sha256(), False, 0, True
        for r in rows:
            if not fresh and r["conv"] != conv:
                yield _result(conv, counts_, total, "".join(letters), sha.hexdigest())
                letters, sha, begun, counts_ = [], hashlib.sha256(), False, None
            conv, total, fresh = r["conv"], r["total"], False
            counts_ = _merged(counts_, r["counts"])
            letters.append(r["letters"])
            if r["said"] is not None:
                sha.update(b"\n" * begun + r["said"].encode())
                begun = True
        if not fresh:
            yield _result(conv, counts_, total, "".join(letters), sha.hexdigest())

    return _map(_in_order(piece), _RESULT.format(kind), joined)


def repaired(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", copies_col: str | None = None) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256), one row a conversation. A column
    may say how often a row stands there, 0 where its conversation is to be returned without it."""
    rows = _prepared(turns, conv_col, turn_col, role_col, text_col, copies_col)
    kind = rows.schema["conv"].dataType.simpleString()
    chunks = _chunks(rows)
    return _alone(chunks, kind).union(_across(chunks, kind))


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies): rows dropped, emptied, cut, repeated and re-roled by a checksum of their key."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    d = conversations.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), kind.alias("kind"))
    return d.select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1).alias("copies"),
    )


def op13_query(spark, sf_dir):
    """Faults and cheapest repairs of all conversations, after damage."""
    return repaired(damaged(table(spark, sf_dir, "conversations")), copies_col="copies").withColumnRenamed("conv", "conv_id")


#: The same by a recursion from the end, which keeps (cost, letters, turns) for each of the four nodes; checksums bit by bit.
OP13_SQL = r"""
WITH RECURSIVE k AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
bits AS (
  SELECT key, list_transform(range(0, 8 * length(key)), lambda i: (ascii(substr(key, CAST(i // 8 + 1 AS BIGINT), 1)) >> CAST(i % 8 AS INT)) & 1) AS b FROM (SELECT DISTINCT key FROM k)),
sums AS (
  SELECT key, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(b, lambda x: CAST(x AS BIGINT))), lambda a, x: CASE WHEN xor(a, x) & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END), 4294967295) % 20 AS kind FROM bits),
d AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM k JOIN sums USING (key) WHERE kind <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM d),
f AS (
  SELECT *, substr(role, 1, 1) AS r, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 2
            WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 3 ELSE 0 END AS fault, lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS p FROM o),
s(conv_id, i, b0, b1, b2, b3) AS (
  SELECT conv_id, max(i) + 1, {'c': 0, 'a': '', 't': CAST([] AS VARCHAR[])}, {'c': 6, 'a': 'II', 't': ['user:', 'assistant:']}, {'c': 3, 'a': 'I', 't': ['assistant:']}, {'c': 0, 'a': '', 't': CAST([] AS VARCHAR[])} FROM f GROUP BY conv_id
  UNION ALL
  SELECT conv_id, i, list_min([r0, {'c': x2.c + 3, 'a': 'I' || x2.a, 't': ['user:'] || x2.t}]), list_min([r1, {'c': x2.c + 3, 'a': 'I' || x2.a, 't': ['user:'] || x2.t}]), x2, list_min([r3, {'c': x2.c + 3, 'a': 'I' || x2.a, 't': ['user:'] || x2.t}])
  FROM (SELECT *, list_min([r2, {'c': r3.c + 3, 'a': 'I' || r3.a, 't': ['assistant:'] || r3.t}]) AS x2
    FROM (SELECT s.conv_id, f.i,
      list_min([{'c': b0.c + 4, 'a': 'D' || b0.a, 't': b0.t}, CASE WHEN fault IN (0, 3) AND r = 's' THEN {'c': b1.c + fault, 'a': 'K' || b1.a, 't': [role || ':' || text] || b1.t} WHEN fault IN (0, 3) AND r = 'u' THEN {'c': b2.c + fault, 'a': 'K' || b2.a, 't': [role || ':' || text] || b2.t} END, CASE WHEN fault IN (0, 3) THEN {'c': b2.c + 3 + fault, 'a': 'R' || b2.a, 't': ['user:' || text] || b2.t} END]) AS r0,
      list_min([{'c': b1.c + 4, 'a': 'D' || b1.a, 't': b1.t}, CASE WHEN fault IN (0, 3) AND r = 'u' THEN {'c': b2.c + fault, 'a': 'K' || b2.a, 't': [role || ':' || text] || b2.t} END, CASE WHEN fault IN (0, 3) THEN {'c': b2.c + 3 + fault, 'a': 'R' || b2.a, 't': ['user:' || text] || b2.t} END]) AS r1,
      list_min([{'c': b2.c + 4, 'a': 'D' || b2.a, 't': b2.t}, CASE WHEN fault IN (0, 3) AND r = 'a' THEN {'c': b3.c + fault, 'a': 'K' || b3.a, 't': [role || ':' || text] || b3.t} END, CASE WHEN fault IN (0, 3) THEN {'c': b3.c + 3 + fault, 'a': 'R' || b3.a, 't': ['assistant:' || text] || b3.t} END]) AS r2,
      list_min([{'c': b3.c + 4, 'a': 'D' || b3.a, 't': b3.t}, CASE WHEN fault IN (0, 3) AND r = 'u' THEN {'c': b2.c + fault, 'a': 'K' || b2.a, 't': [role || ':' || text] || b2.t} END, CASE WHEN fault IN (0, 3) THEN {'c': b2.c + 3 + fault, 'a': 'R' || b2.a, 't': ['user:' || text] || b2.t} END]) AS r3
      FROM s JOIN f ON f.conv_id IS NOT DISTINCT FROM s.conv_id AND f.i = s.i - 1))),
n AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 1) AS blank, count(*) FILTER (WHERE fault = 2) AS duplicate, count(*) FILTER (WHERE fault = 3) AS truncated,
         count(*) FILTER (WHERE p IS NOT NULL AND p || r NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id),
c AS (SELECT DISTINCT conv_id FROM conversations)
SELECT c.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       CAST(coalesce(b0.c, 0) AS BIGINT) AS cost, coalesce(b0.a, '') AS audit, sha256(coalesce(array_to_string(b0.t, chr(10)), '')) AS repaired_sha256
FROM c LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM c.conv_id AND s.i = 1
"""
