"""Conversation structure repair (operator 13): the cheapest edits that make roles alternate again.

A row is reduced to one symbol: its role's initial (s, u, a, or anything else) and its fault (blank and repeated rows have
to go; truncated ones may stay at a price). The symbols of a conversation are its signature. A task takes conversations
block by block, sorts their distinct signatures and inserts them into a prefix trie; as they come sorted only the
trie's rightmost path is held. Each node has one layer of the dynamic program, computed once for all signatures that
share the prefix: for each state of the pattern s?(ua)+ the least cost of the prefix, by which edits it was reached,
and in which order the edits of the states stand. A terminal node answers for all conversations of its signature, so a
conversation that a third of all rows repeat is solved once a block. Layers depend on the layer above only through
cost differences and that order, of which there are few, so they are shared objects.

Order of edits: inserts are taken before the row that follows them, so the edits of a layer all end with a row. No such
text is a prefix of another, hence ties are decided by the layer's order, and the least text of the whole has the
least text of each layer.

Edge cases: null columns read as one space (a null turn comes first all the same); rows of one turn are ordered by role
and text; a role is its initial in the pattern, an empty role or one with another initial can be changed or deleted
alone; a null conv_id is a conversation of its own; conversations that lose all rows are reported with zeros; other
columns are not read; an empty table gives an empty result. A conversation of more than LONG_ROWS rows is never held: its
rows stream through a task in order, as the hash of its repaired text asks for, at some bytes of memory a row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import SPACES, materialize

#: Costs of the edits.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: States: nothing yet, after s, after u, after a; where an inserted or changed row leads (to u or a), and where it may end.
START, SYSTEM, USER, ASSISTANT = range(4)
_NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
_ENDS = (START, ASSISTANT)
_INITIAL = {SYSTEM: "s", USER: "u", ASSISTANT: "a"}
_ROLE = {USER: "user", ASSISTANT: "assistant"}
#: Text of the rows that a task takes together, rows of a conversation that is held, and conversations beyond these whose
#: ids are broadcast.
BLOCK_CHARS, LONG_ROWS, MOST_BROADCAST = 8 << 20, 20_000, 100_000

MUST_GO = "x"


def _inserted(state: int) -> Iterator[tuple[int, int]]:
    """(inserts, state after them): every state that inserts lead to, each by the fewest."""
    seen = set()
    for n in range(4):
        if state in seen:
            return
        seen.add(state)
        yield n, state
        state = _NEXT[state]


def _kept(state: int, initial: str) -> int | None:
    if state == START and initial == "s":
        return SYSTEM
    return _NEXT[state] if initial == _INITIAL[_NEXT[state]] else None


@cache
def _layer(costs: tuple, ranks: tuple, symbol: str) -> tuple:
    """(costs, ranks, base, back) after one more row. costs: of each state, the least being 0, or None where it cannot be
    reached; ranks: the order of their edits; base: what the least cost has grown by; back: (state before, edits)."""
    best: list[tuple | None] = [None] * 4
    for before in range(4):
        if costs[before] is None:
            continue
        for n, state in _inserted(before):
            steps = [(DELETE, "D", state)]
            if symbol != MUST_GO:
                keep = TRUNCATED * symbol.isupper()
                steps.append((REROLE + keep, "R", _NEXT[state]))
                if (after := _kept(state, symbol.lower())) is not None:
                    steps.append((keep, "K", after))
            for cost, edit, after in steps:
                found = costs[before] + n * INSERT + cost, ranks[before], "I" * n + edit, before
                if best[after] is None or found < best[after]:
                    best[after] = found
    base = min(x[0] for x in best if x)
    order = sorted((x[1:3], s) for s, x in enumerate(best) if x)
    rank = {s: k for k, (_, s) in enumerate(order)}
    return tuple(x and x[0] - base for x in best), tuple(rank.get(s, -1) for s in range(4)), base, tuple(x and (x[3], x[2]) for x in best)


_ROOT = ((0, None, None, None), (0, -1, -1, -1), 0, None)


def _answer(path: list[tuple]) -> tuple[int, str]:
    """(cost, edits) at the end of a path of layers."""
    costs, ranks, *_ = path[-1]
    ends = [(costs[s] + n * INSERT, ranks[s], "I" * n, s) for s in range(4) if costs[s] is not None for n, after in _inserted(s) if after in _ENDS]
    cost, _, last, state = min(ends)
    edits = [last]
    for layer in reversed(path[1:]):
        cost += layer[2]
        state, edit = layer[3][state]
        edits.append(edit)
    return cost, "".join(reversed(edits))


def solve(signatures: set[str]) -> dict[str, tuple[int, str]]:
    """The cost and the edits of each signature, by a walk over their prefix trie."""
    out, path, before = {}, [_ROOT], ""
    for signature in sorted(signatures):
        shared = next((k for k, (x, y) in enumerate(zip(before, signature, strict=False)) if x != y), min(len(before), len(signature)))
        del path[shared + 1 :]
        for symbol in signature[shared:]:
            path.append(_layer(*path[-1][:2], symbol))
        out[signature] = _answer(path)
        before = signature
    return out


def repaired(rows: list[tuple[str, str]], edits: str) -> Iterator[tuple[str, str]]:
    """Rows (role, text) after the edits."""
    state, left = START, iter(rows)
    for edit in edits:
        role, text = next(left) if edit != "I" else ("", "")
        if edit == "D":
            continue
        state = _kept(state, role[:1]) if edit == "K" else _NEXT[state]
        yield (role if edit == "K" else _ROLE[state]), text


class _Symbols:
    """A long signature at a byte a symbol."""

    def __init__(self):
        self._bytes = bytearray()

    def append(self, symbol: str) -> None:
        self._bytes += symbol.encode()

    def __iter__(self) -> Iterator[str]:
        return map(chr, self._bytes)


class _Conversation:
    def __init__(self, conv_id):
        self.conv_id = conv_id
        self.rows: list[tuple[str, str]] = []
        self.symbols: list[str] = []
        self.turns: set[int] = set()
        self.seen: set[tuple[str, str]] = set()
        self.faults = dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        self.illegal = 0
        self.last: str | None = None

    def add(self, turn, role: str, text: str) -> int:
        if turn is not None:
            self.turns.add(turn)
        self.note(role, text, (role, text) in self.seen)
        self.seen.add((role, text))
        self.rows.append((role, text))
        return len(text)

    def note(self, role: str, text: str, again: bool) -> None:
        """Counts the row's fault and takes its symbol."""
        if self.last is not None and self.last + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.last = role[:1]
        shown = text.rstrip(SPACES)
        fault = "blank" if not shown else "duplicate" if again else "truncated" if shown[-1] not in ".!?" else None
        if fault:
            self.faults[fault] += 1
        initial = role[:1] if role[:1] in ("s", "u", "a") else "o"
        self.symbols.append(MUST_GO if fault in ("blank", "duplicate") else initial.upper() if fault else initial)

    def gaps(self) -> int:
        return max(self.turns) - min(self.turns) + 1 - len(self.turns) if self.turns else 0


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, lost: rows with planted faults by the checksum of conversation and turn; rows that are
    dropped stay as lost, so that their conversation is known."""
    space = F.lit(" ")
    role, text = (F.coalesce(F.col(c).cast("string"), space) for c in ("role", "text"))
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    kind = F.crc32(key.cast("binary")) % 20
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), kind.alias("kind"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    text = F.when(F.col("kind") <= 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    lost = F.col("kind") == 0
    return rows.select("conv_id", F.when(~lost, F.col("turn")).alias("turn"), F.when(~lost, role).alias("role"), text.alias("text"), lost.alias("lost"), F.explode(times).alias("_k")).drop("_k")


_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal")
_RESULT = f"{', '.join(f'{c} long' for c in _COUNTS)}, cost long, audit string, repaired_sha256 string"
_TURNS = "place long, role string, text string"


def _grouped(batches: Iterator[pa.RecordBatch], block_chars: int) -> Iterator[list[_Conversation]]:
    """Conversations of sorted rows, so many at a time that their texts come to block_chars."""
    held, chars = [], 0
    for batch in batches:
        for conv_id, turn, role, text, lost in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "lost")), strict=True):
            if not held or held[-1].conv_id != conv_id:
                if chars >= block_chars:
                    yield held
                    held, chars = [], 0
                held.append(_Conversation(conv_id))
                chars += 100
            if not lost:
                chars += held[-1].add(turn, role, text)
    if held:
        yield held


def _sorted(rows: DataFrame) -> DataFrame:
    return rows.select("conv_id", "turn", "role", "text", "lost").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def _batch(rows: list[tuple], schema: T.StructType) -> pa.RecordBatch:
    arrow = to_arrow_schema(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)


def _with_conv_id(rows: DataFrame, fields: str) -> T.StructType:
    return T.StructType([T.StructField("conv_id", rows.schema["conv_id"].dataType), *T.StructType.fromDDL(fields).fields])


def _line(first: bool, role: str, text: str) -> bytes:
    return f"{'' if first else chr(10)}{role}:{text}".encode("utf-8", "surrogatepass")


def _repair_short(rows: DataFrame, block_chars: int) -> DataFrame:
    schema = _with_conv_id(rows, _RESULT)

    def run(batches):
        for held in _grouped(batches, block_chars):
            answers, out = solve({"".join(c.symbols) for c in held}), []
            for c in held:
                cost, edits = answers["".join(c.symbols)]
                digest = hashlib.sha256(b"".join(_line(not k, *row) for k, row in enumerate(repaired(c.rows, edits)))).hexdigest()
                out.append((c.conv_id, c.gaps(), *c.faults.values(), c.illegal, cost, edits, digest))
            yield _batch(out, schema)

    return _sorted(rows).mapInArrow(run, schema)


def repaired_turns(rows: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """conv_id, place, role, text: the conversations of rows (conv_id, turn, role, text, lost) after their edits."""
    schema = _with_conv_id(rows, _TURNS)

    def run(batches):
        for held in _grouped(batches, block_chars):
            answers = solve({"".join(c.symbols) for c in held})
            out = [(c.conv_id, k, role, text) for c in held for k, (role, text) in enumerate(repaired(c.rows, answers["".join(c.symbols)][1]))]
            if out:
                yield _batch(out, schema)

    return _sorted(rows).mapInArrow(run, schema)


def _repair_long(rows: DataFrame) -> DataFrame:
    """The same for conversations that are not to be held: their rows stream by twice, and a task keeps some bytes a row.

    Which texts were seen before is found by grouping; the first pass keeps the symbols and the layers, which are shared
    objects, the second has the edits come before the rows and hashes what they leave."""
    key = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in ("conv_id", "role", "text")]
    kept = rows.where("NOT lost")
    earliest = kept.groupBy("conv_id", "role", "text").agg(F.min(F.coalesce("turn", F.lit(-(1 << 63)))).alias("_first"))
    earliest = earliest.select("_first", *(F.col(c).alias(f"_{c}") for c in ("conv_id", "role", "text")))
    seen = F.coalesce(F.col("turn"), F.lit(-(1 << 63))) > F.col("_first")
    marked = rows.join(earliest, key[0] & key[1] & key[2], "left").select("conv_id", "turn", "role", "text", "lost", F.coalesce(seen, F.lit(False)).alias("seen"))
    schema = _with_conv_id(rows, _RESULT.removesuffix(", repaired_sha256 string"))

    def answers(batches):
        c, before, last_turn, spans = None, None, None, None

        def answer():
            path = [_ROOT]
            for symbol in c.symbols:
                path.append(_layer(*path[-1][:2], symbol))
            cost, edits = _answer(path)
            gaps = spans[1] - spans[0] + 1 - spans[2] if spans else 0
            return _batch([(c.conv_id, gaps, *c.faults.values(), c.illegal, cost, edits)], schema)

        for batch in batches:
            for conv_id, turn, role, text, lost, seen in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "turn", "role", "text", "lost", "seen")), strict=True):
                if c is None or c.conv_id != conv_id:
                    if c is not None:
                        yield answer()
                    c, before, spans = _Conversation(conv_id), None, None
                    c.symbols = _Symbols()
                if lost:
                    continue
                c.note(role, text, seen or before == (turn, role, text))
                if turn is not None:
                    spans = (turn, turn, 1) if spans is None else (spans[0], turn, spans[2] + (turn != spans[1]))
                before = turn, role, text
        if c is not None:
            yield answer()

    found = materialize(marked.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(answers, schema), "long-conversations")
    digests = _with_conv_id(rows, "repaired_sha256 string")
    lead = found.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"))
    both = lead.unionByName(kept.select("conv_id", F.lit(1).alias("kind"), "turn", "role", "text"))

    def hashes(batches):
        conv_id, edits, at, state, digest, first = None, None, 0, START, None, True

        def write(role: str, text: str):
            nonlocal first
            digest.update(_line(first, role, text))
            first = False

        def inserts():
            nonlocal at, state
            while at < len(edits) and edits[at] == "I":
                state = _NEXT[state]
                write(_ROLE[state], "")
                at += 1

        for batch in batches:
            for row_id, kind, role, text in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "kind", "role", "text")), strict=True):
                if kind == 0:
                    if edits is not None:
                        inserts()
                        yield _batch([(conv_id, digest.hexdigest())], digests)
                    conv_id, edits, at, state, digest, first = row_id, text, 0, START, hashlib.sha256(), True
                    continue
                inserts()
                edit, at = edits[at], at + 1
                if edit != "D":
                    state = _kept(state, role[:1]) if edit == "K" else _NEXT[state]
                    write(role if edit == "K" else _ROLE[state], text)
        if edits is not None:
            inserts()
            yield _batch([(conv_id, digest.hexdigest())], digests)

    hashed = both.repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "role", "text").mapInArrow(hashes, digests)
    hashed = hashed.select(F.col("conv_id").alias("_conv_id"), "repaired_sha256")
    return found.join(hashed, F.col("conv_id").eqNullSafe(F.col("_conv_id"))).drop("_conv_id")


def repair(rows: DataFrame, block_chars: int = BLOCK_CHARS, long_rows: int = LONG_ROWS) -> DataFrame:
    """One row for each conversation of rows (conv_id, turn, role, text, lost): gaps, counts of faults, cost and edits, and
    the hash of the repaired turns. Conversations of more rows than long_rows are streamed."""
    long = materialize(rows.groupBy("conv_id").count().where(F.col("count") > long_rows).select(F.col("conv_id").alias("_long")), "long")
    n = long.count()
    if not n:
        return _repair_short(rows, block_chars)
    ids = F.broadcast(long) if n <= MOST_BROADCAST else long  # others are joined
    same = F.col("conv_id").eqNullSafe(F.col("_long"))
    return _repair_short(rows.join(ids, same, "left_anti"), block_chars).unionByName(_repair_long(rows.join(ids, same, "left_semi")))


def repair_damaged(conversations: DataFrame) -> DataFrame:
    return repair(damaged(conversations))
