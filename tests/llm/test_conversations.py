"""Conversation repair against a shortest path over all edits."""

from __future__ import annotations

import hashlib
import heapq
import itertools
import re
import zlib

import numpy as np

import __spark_entry__
from latticework.llm import conversations

NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}


def brute(rows):
    """rows: (initial, must go, truncated). The least (cost, edits) by Dijkstra over (row, last role), texts compared in full."""
    heap, done = [(0, "", 0, "")], set()
    while heap:
        cost, edits, k, last = heapq.heappop(heap)
        if k == len(rows) and last in ("", "a"):
            return cost, edits
        if (k, last) in done:
            continue
        done.add((k, last))
        heapq.heappush(heap, (cost + 2, edits + "I", k, NEXT[last]))
        if k < len(rows):
            initial, must, cut = rows[k]
            heapq.heappush(heap, (cost + 3, edits + "D", k + 1, last))
            if not must:
                heapq.heappush(heap, (cost + 2 + cut, edits + "R", k + 1, NEXT[last]))
                if initial == NEXT[last] or (initial == "s" and last == ""):
                    heapq.heappush(heap, (cost + cut, edits + "K", k + 1, initial))
    raise AssertionError


def symbols(rows):
    return "".join("x" if must else (i if i in ("s", "u", "a") else "o").upper() if cut else (i if i in ("s", "u", "a") else "o") for i, must, cut in rows)


def test_edits():
    kinds = [(i, must, cut) for i in "suat" for must, cut in ((0, 0), (1, 0), (0, 1))]
    rng = np.random.default_rng(3)
    cases = [list(c) for n in range(4) for c in itertools.product(kinds, repeat=n)]
    cases += [[kinds[k] for k in rng.integers(0, len(kinds), rng.integers(4, 40))] for _ in range(400)]
    got = conversations.solve({symbols(c) for c in cases})
    for c in cases:
        assert got[symbols(c)] == brute(c), c
    long = "ua" * 100_000 + "o"
    assert conversations.solve({long})[long] == (3, "K" * 200_000 + "D")


def expected(rows):
    """rows: (conv_id, turn, role, text)."""
    out = {}
    for conv in {r[0] for r in rows}:
        after = []
        for _, turn, role, text in (r for r in rows if r[0] == conv):
            role, text = " " if role is None else role, " " if text is None else text
            kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            if kind == 0:
                continue
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            after += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
        after.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        counts, seen, signature = {"blank": 0, "duplicate": 0, "truncated": 0}, set(), []
        for _, role, text in after:
            shown = text.strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            signature.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
        cost, audit = brute(signature)
        turns = {t for t, _, _ in after if t is not None}
        illegal = sum(x[1][:1] + y[1][:1] not in ("su", "ua", "au") for x, y in zip(after, after[1:], strict=False))
        lines, last, left = [], "", iter(after)
        for e in audit:
            _, role, text = next(left) if e != "I" else (None, None, "")
            if e != "D":
                last = role[:1] if e == "K" else NEXT[last]
                lines.append(f"{role if e == 'K' else {'u': 'user', 'a': 'assistant'}[last]}:{text}")
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *counts.values(), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def table():
    rng, rows = np.random.default_rng(1), []
    for conv in range(120):
        for turn in range(int(rng.integers(1, 12))):
            role = str(rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", "ünder"]))
            rows.append((conv, turn * int(rng.integers(1, 3)), role, str(rng.choice(["Yes.", "No?", "well", "Ah! ", " \t\n", "x\x1c", "ok."]))))
    rows += [(5, None, "user", "first."), (5, None, None, None), (None, 1, "user", "a."), (None, 2, "assistant", "b."), (500, None, "user", "hi."), (7, 3, "user", "long. " * 50_000), (7, 3, "user", "long. " * 50_000)]
    rows += [(-k, k % 8, ("user", "assistant")[k % 2], "Hello.") for k in range(1, 300)]
    return [(*r, "clash") for r in rows]


def test_repair(spark, tmp_path):
    rows = table()
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, cost string").repartition(3).write.parquet(str(tmp_path / "conversations.parquet"))
    got = __spark_entry__.queries()["op13_conversation_repair"](spark, str(tmp_path))
    want = expected([r[:4] for r in rows])
    found = {r["conv_id"]: tuple(r)[1:] for r in got.collect()}
    assert found == want and got.count() == len(want)
    assert any(v[:6] == (0, 0, 0, 0, 0, 0) and v[6] == "" for v in found.values())  # a conversation that lost all rows


def test_small_blocks_ids_and_empty(spark):
    schema = "conv_id string, turn long, role string, text string, kind int"
    rows = [(f"c{k % 7}", k, ("user", "assistant", "system")[k % 3], f"t{k % 5}.", 1) for k in range(60)]
    table = conversations.damaged(spark.createDataFrame(rows, schema))
    a, b = (sorted(map(tuple, conversations.repair(table, n).collect())) for n in (1, 1 << 20))
    assert a == b
    turns = conversations.repaired_turns(table).orderBy("conv_id", "place").collect()
    for conv_id, *_, digest in a:
        own = [t for t in turns if t["conv_id"] == conv_id]
        assert re.fullmatch("(s?(ua)+)?", "".join(t["role"][0] for t in own)) and [t["place"] for t in own] == list(range(len(own)))
        assert hashlib.sha256("\n".join(f"{t['role']}:{t['text']}" for t in own).encode()).hexdigest() == digest
    assert conversations.repair_damaged(spark.createDataFrame([], schema)).count() == 0


def test_long_conversations(spark):
    """Streamed conversations get what held ones get, whatever their length."""
    rows = table()
    damaged = conversations.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, cost string").repartition(3))
    key = lambda r: tuple(str(x) for x in r)
    held = sorted(map(key, conversations.repair(damaged).collect()))
    for most in (0, 1, 5):
        assert sorted(map(key, conversations.repair(damaged, long_rows=most).collect())) == held
    hot = spark.range(60_000).selectExpr("CAST(NULL AS BIGINT) AS conv_id", "id AS turn", "CASE WHEN id % 2 = 0 THEN 'user' ELSE 'assistant' END AS role", "concat('Text ', id, '.') AS text", "false AS lost")
    (one,) = conversations.repair(hot).collect()
    assert one["conv_id"] is None and one["cost"] == 0 and one["audit"] == "K" * 60_000
    lines = "\n".join(f"{('user', 'assistant')[k % 2]}:Text {k}." for k in range(60_000))
    assert one["repaired_sha256"] == hashlib.sha256(lines.encode()).hexdigest()
