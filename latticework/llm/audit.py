"""Filter interaction audit (operator 11): what each filter removes, and would remove, in every order of the filters.

Each document gets a mask of the filters that it fails, whatever has been removed before. All filters but one look at
the text alone; the last fails a text that is identical to one of a smaller id. For that, texts are routed by their
xxhash: a task keeps, for each fingerprint, a chain of the different texts that have it, each in full with the least id
seen, so a collision of fingerprints is told apart and never taken for a copy. A copy of a larger id is settled where
it is met and sends its mask alone; only the least of each text in a block of a task travels with its text, so a
text that a third of all documents share costs its partition one entry a block. The same chains settle what has
arrived. Masks meet the labels by id, and combineByKey adds them up as vectors of counts, on the map side first. The
vectors of a part answer for all orders at once: a filter removes what fails it and nothing before it.

Edge cases: a null text is an empty one; a null id comes after all others, so it is a copy of any text that has an id and
never of another null id; rows with equal ids are no copies of each other; a null part is the empty string; several
labels of an id count as one that is set where any is; unlabelled documents are neither good nor toxic; other columns
are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Callable, Iterator

import xxhash
from pyspark import RDD
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import parts_for

#: Bytes of text that a task holds before the least ids of its block travel.
BLOCK_BYTES = 16 << 20
#: Bytes of text that a partition of fingerprints is planned for, were all texts different.
PARTITION_BYTES = 64 << 20

_CAPITALS = re.compile(rb"[A-Z]+")
_SYMBOL = re.compile(rb"[#$%&*|]")


class Text:
    """One text as the rules see it. Words are runs of anything but ASCII white space."""

    def __init__(self, text: str):
        self.n_chars, self.data = len(text), text.encode("utf-8", "replace")
        self.words = self.data.split()


def few_words(x: Text) -> bool:
    return len(x.words) < 200


def repetitive(x: Text) -> bool:
    return 100 * len(set(x.words)) < 50 * len(x.words)


def shouting(x: Text) -> bool:
    return 100 * sum(map(len, _CAPITALS.findall(x.data))) > 3 * x.n_chars


def symbols(x: Text) -> bool:
    return _SYMBOL.search(x.data) is not None


#: Filters by letter; the one without a rule fails copies.
RULES: dict[str, Callable[[Text], bool] | None] = {"A": few_words, "B": repetitive, "C": shouting, "D": symbols, "E": None}

_SCHEMA = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def _rank(doc_id) -> tuple:
    return (doc_id is None, doc_id)


class Chains:
    """By fingerprint the different texts met, each with the least id and the documents of that id by part."""

    def __init__(self):
        self._chains: dict[int, list[list]] = {}
        self.bytes = 0

    def add(self, key: int, data: bytes, doc_id, mask: int, parts: dict[str, int]) -> Iterator[tuple]:
        """Yields (id, mask, parts) of documents that turn out not to have the least id of their text."""
        chain = self._chains.setdefault(key, [])
        for entry in chain:
            if entry[0] == data:
                if entry[1] == doc_id:
                    for part, n in parts.items():
                        entry[3][part] = entry[3].get(part, 0) + n
                elif _rank(doc_id) < _rank(entry[1]):
                    yield tuple(entry[1:])
                    entry[1:] = doc_id, mask, parts
                else:
                    yield doc_id, mask, parts
                return
        chain.append([data, doc_id, mask, parts])
        self.bytes += len(data)

    def entries(self) -> Iterator[tuple[int, list]]:
        for key, chain in self._chains.items():
            for entry in chain:
                yield key, entry


def fingerprint(data: bytes) -> int:
    return xxhash.xxh64_intdigest(data)


def masks(docs: DataFrame, rules: dict = RULES, part: str = "lang", block_bytes: int = BLOCK_BYTES, key_of: Callable[[bytes], int] = fingerprint) -> DataFrame:
    """doc_id, part, mask, n: so many documents of an id and part that fail the filters of the mask (bit k: the k-th rule)."""
    spark = docs.sparkSession
    tests = [(1 << k, rule) for k, rule in enumerate(rules.values()) if rule]
    copy = sum(1 << k for k, rule in enumerate(rules.values()) if rule is None)

    def settled(doc_id, mask, parts):
        return xxhash.xxh64_intdigest(repr(doc_id)), (None, doc_id, mask | copy, parts)

    def block(chains: Chains):
        for key, entry in chains.entries():
            yield key, tuple(entry)

    def local(rows):
        chains = Chains()
        for doc_id, part, text in rows:
            x = Text(text)
            mask = sum(bit for bit, rule in tests if rule(x))
            for found in chains.add(key_of(x.data), x.data, doc_id, mask, {part: 1}):
                yield settled(*found)
            if chains.bytes >= block_bytes:
                yield from block(chains)
                chains = Chains()
        yield from block(chains)

    def least(pairs):
        chains = Chains()
        for key, (data, doc_id, mask, parts) in pairs:
            if data is None:
                yield from ((doc_id, part, mask, n) for part, n in parts.items())
            else:
                for found in chains.add(key, data, doc_id, mask, parts):
                    yield from ((found[0], part, found[1] | copy, n) for part, n in found[2].items())
        for _, (_, doc_id, mask, parts) in chains.entries():
            yield from ((doc_id, part, mask, n) for part, n in parts.items())

    rows = docs.select("doc_id", F.coalesce(F.col(part).cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))).rdd
    n_bytes = docs.agg(F.coalesce(F.sum(F.octet_length(F.col("text").cast("string"))), F.lit(0))).first()[0]
    parts = parts_for(n_bytes, PARTITION_BYTES, int(spark.conf.get("spark.sql.shuffle.partitions")))
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *T.StructType.fromDDL("part string, mask int, n long").fields])
    return spark.createDataFrame(rows.mapPartitions(local).partitionBy(parts).mapPartitions(least), schema, verifySchema=False)


def mask_counts(masked: DataFrame, labels: DataFrame, n_filters: int) -> RDD:
    """(part, vector): documents, good ones and toxic ones of each mask, one after the other."""
    marks = labels.groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("bad"))
    good, bad = (F.coalesce(c, F.lit(0)) * F.col("n") for c in ("good", "bad"))
    rows = masked.join(marks, "doc_id", "left").select("part", "mask", "n", good.alias("good"), bad.alias("bad"))
    size = 1 << n_filters

    def add(vector: list[int], x: tuple) -> list[int]:
        mask, *counts = x
        for k, n in enumerate(counts):
            vector[k * size + mask] += n
        return vector

    def merge(x: list[int], y: list[int]) -> list[int]:
        return [a + b for a, b in zip(x, y, strict=True)]

    return rows.rdd.map(lambda r: (r[0], r[1:])).combineByKey(lambda x: add([0] * (3 * size), x), add, merge)


def interactions(part: str, vector: list[int], letters: str) -> Iterator[tuple]:
    """A row for each order of the filters and step in it, from the counts of a part by mask."""
    size = 1 << len(letters)
    n, good, bad = (vector[k * size : (k + 1) * size] for k in range(3))
    orders = math.factorial(len(letters))
    bit = {x: 1 << k for k, x in enumerate(letters)}
    # of the orders, a filter comes first among those that a document fails in an equal share
    shapley = {x: sum(n[m] * orders // m.bit_count() for m in range(size) if m & bit[x]) for x in letters}
    for order in itertools.permutations(letters):
        before = 0
        for step, x in enumerate(order, 1):
            fails = [m for m in range(size) if m & bit[x]]
            first = [m for m in fails if not m & before]
            removed = sum(n[m] for m in first)
            kept = sum(n[m] for m in range(size) if not m & (before | bit[x]))
            redundant = sum(n[m] for m in fails) - removed
            yield part, "".join(order), step, kept, removed, redundant, n[bit[x]], sum(good[m] for m in first), sum(bad[m] for m in first), shapley[x]
            before |= bit[x]


def audit_filters(docs: DataFrame, labels: DataFrame, rules: dict = RULES, part: str = "lang") -> DataFrame:
    """For each part, order of the filters (letters of rules) and step: documents kept after the step and removed in it,
    those that fail its filter but were removed before, those that fail no other, good and toxic ones removed, and the
    filter's removals summed over all orders."""
    letters = "".join(rules)
    counts = mask_counts(masks(docs, rules, part), labels, len(rules))
    return docs.sparkSession.createDataFrame(counts.flatMap(lambda x: interactions(*x, letters)), _SCHEMA, verifySchema=False)
