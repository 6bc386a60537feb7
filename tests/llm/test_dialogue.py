"""Repair of conversations against brute force."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict
from functools import cache

from wardline.llm import dialogue

GOOD = re.compile(r"(s?(ua)+)?")


def enumerated(rows):
    """(cost, audit, repaired) by trying all edits; rows are (role, text, fault)."""
    gaps = [(), ("user",), ("assistant",), ("user", "assistant"), ("assistant", "user"), ("user", "user"), ("assistant", "assistant")]
    best = None
    options = [["D"] if fault in (1, 2) else ["D", "K", "user", "assistant"] for _, _, fault in rows]
    for edits in itertools.product(*options):
        for inserts in itertools.product(gaps, repeat=len(rows) + 1):
            cost, audit, out = 0, "", []
            for i, gap in enumerate(inserts):
                cost, audit, out = cost + 3 * len(gap), audit + "I" * len(gap), out + [(g, "") for g in gap]
                if i < len(rows):
                    role, text, fault = rows[i]
                    e = edits[i]
                    cost += 4 if e == "D" else (0 if e == "K" else 3) + 3 * (fault == 3)
                    audit += "R" if len(e) > 1 else e
                    out += [] if e == "D" else [(role if e == "K" else e, text)]
            if GOOD.fullmatch("".join(r[:1] or "?" for r, _ in out)):
                best = min(best or (10**9,), (cost, audit, out))
    return best


def planned(rows):
    """The same by least (cost, letters) from the end, which the prefix order allows."""

    @cache
    def best(i, q, room):
        found = [(0, "", ())] if i == len(rows) and q in (0, 3) else []
        filled = "assistant" if q == 2 else "user"
        step = lambda c, x, said, rest: (c + rest[0], x + rest[1], said + rest[2])
        if room:
            found.append(step(3, "I", ((filled, ""),), best(i, 3 if q == 2 else 2, room - 1)))
        if i < len(rows):
            role, text, fault = rows[i]
            found.append(step(4, "D", (), best(i + 1, q, 2)))
            if fault not in (1, 2):
                to = {"s": 1 if q == 0 else None, "u": 2 if q != 2 else None, "a": 3 if q == 2 else None}.get(role[:1])
                if to is not None:
                    found.append(step(3 * (fault == 3), "K", ((role, text),), best(i + 1, to, 2)))
                found.append(step(3 + 3 * (fault == 3), "R", ((filled, text),), best(i + 1, 3 if q == 2 else 2, 2)))
        return min(found) if found else (10**9, "", ())

    cost, audit, out = best(0, 0, 2)
    return cost, audit, list(out)


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        words = re.sub(r"[\x20\x09-\x0D]", "", text)
        out.append((role, text, 1 if not words else 2 if (role, text) in seen else 3 if words[-1] not in ".!?" else 0))
        seen.add((role, text))
    return out


def rows_of(rng, n):
    return [(rng.choice(["user", "assistant", "assistant", "user", "system", " ", "tool", ""]), rng.choice(["Hi.", "Hi.", "Yes", "", " \n", "No!", f"{rng.random()}?"])) for _ in range(n)]


def test_cheapest_edits_by_enumeration():
    rng = random.Random(1)
    for _ in range(250):
        rows = faults(rows_of(rng, rng.randrange(0, 3)))
        got = dialogue.repair([dialogue.Row(r, t, f, 1) for r, t, f in rows])
        assert got == enumerated(rows) == planned(rows), rows


def test_cheapest_edits_of_longer_conversations():
    rng = random.Random(2)
    for _ in range(300):
        rows = faults(rows_of(rng, rng.randrange(0, 14)))
        assert dialogue.repair([dialogue.Row(r, t, f, 1) for r, t, f in rows]) == planned(rows), rows


def expected(table):
    """The contract's rows, conversation by conversation."""
    after = defaultdict(list)
    for conv, turn, role, text in table:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        role, text = "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        after[conv] += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = []
    for conv, rows in after.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2].encode()))
        turns = [t for t, _, _ in rows if t is not None]
        marked = faults([r[1:] for r in rows])
        cost, audit, said = planned(marked)
        kinds = [f for _, _, f in marked]
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in said).encode()).hexdigest()
        out.append((conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, kinds.count(1), kinds.count(2), kinds.count(3), illegal, cost, audit, digest))
    return sorted(out, key=str)


def a_table(rng, conversations, most):
    out = []
    for conv in range(conversations):
        turns = [rng.choice([None, *range(12)]) if rng.random() < 0.1 else t for t in range(rng.randrange(1, most))]
        out += [(conv, t, rng.choice([role, role, None]) if rng.random() < 0.1 else role, None if rng.random() < 0.05 else text) for t, (role, text) in zip(turns, rows_of(rng, len(turns)), strict=True)]
    return out + [(None, 1, "user", "A."), (None, None, None, None)]


def written(spark, tmp_path, rows):
    spark.createDataFrame([(*r, "x", 5) for r in rows], "conv_id long, turn long, role string, text string, part string, copies int").write.parquet(str(tmp_path / "conversations.parquet"))
    return str(tmp_path)


def test_query_equals_brute_force(spark, tmp_path):
    rows = a_table(random.Random(3), 120, 9)
    rows += rows[:7]
    got = dialogue.op13_query(spark, written(spark, tmp_path, rows))
    assert got.columns[:3] == ["conv_id", "gaps", "blank"]
    assert sorted(map(tuple, got.collect()), key=str) == expected(rows)


def test_conversations_over_many_chunks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(dialogue, "CHUNK_ROWS", 3)
    rng = random.Random(4)
    rows = a_table(rng, 30, 20) + [(77, t, role, text) for t, (role, text) in enumerate(rows_of(rng, 300))]
    rows += [(78, t, "user", "Same.") for t in range(200)] + [(79, 1, "user", "Same.")] * 50
    got = dialogue.op13_query(spark, written(spark, tmp_path, rows))
    assert sorted(map(tuple, got.collect()), key=str) == expected(rows)


def test_no_rows(spark, tmp_path):
    assert dialogue.op13_query(spark, written(spark, tmp_path, [])).count() == 0
