"""Substring dedup by level-wise doubling (operator 9).

A window of `length` words is removed from a document if the same words also start in a document with a smaller id. A
long window can only be repeated if the shorter ones inside it are, so lengths are tried from short to long, each about
twice the one before (7 and 13 words for the usual 13), and only windows whose parts were repeated at one length are
looked up at the next; documents without a candidate take no further part, and the levels end when none survives.

The first level looks up just one short window in each long one, that with the smallest hash (all of them on ties):
equal long windows choose equal short ones, so none is lost and about a quarter of the positions travel. Each task
settles what repeats among its own documents and sends one entry for each hash and task, so a passage that a third of
all documents share costs a bucket no more than one entry a task. Entries travel as packed arrays to the bucket of
their hash, which answers with the places that are repeated elsewhere.

Edge cases: null and blank texts have no words; documents with fewer words than a window keep all; windows within one
document, or among rows with equal ids, do not count against each other; a null id comes after all others; ids of any
type that sorts; repeated rows get equal results; an empty table gives an empty result; other columns are kept, but for
those named as the new ones. Words kept are unchanged.
"""

from __future__ import annotations

import hashlib
import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.ordering import numbered
from .common import materialize, parts_for
from .shingles import WordHasher, frugal, released, window_hashes

LENGTH = 13
SHORTEST = 8
#: Words that a task takes together, and entries that a bucket is planned for.
BLOCK_WORDS, BUCKET_ENTRIES = 400_000, 250_000
LAST = (1 << 63) - 1

_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def level_lengths(length: int) -> list[int]:
    """Lengths from short to long, each at most twice the one before: 13 comes after 7."""
    lengths = [length]
    while lengths[0] > SHORTEST:
        lengths.insert(0, (lengths[0] + 1) // 2)
    return lengths


def chosen_windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """Which windows are the smallest of some `width` neighbours (all of them on a tie)."""
    n = len(hashes) - width + 1
    least = hashes[:n].copy()
    for k in range(1, width):
        np.minimum(least, hashes[k : k + n], out=least)
    out = np.zeros(len(hashes), bool)
    for k in range(width):
        out[k : k + n] |= hashes[k : k + n] == least
    return out


def _same_as(hashes: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Windows equal to one of those at the places."""
    return np.isin(hashes, hashes[places]) if len(places) else np.zeros(len(hashes), bool)


class Level:
    """One length of window: which windows of a document are looked up, and what an answer means."""

    def __init__(self, lengths: list[int], k: int):
        self.length, self.last = lengths[k], k == len(lengths) - 1
        self.least_words = lengths[-1]
        self.before = lengths[k - 1] if k else None
        self.width = lengths[k + 1] - lengths[k] + 1 if k == 0 and not self.last else 1
        self.thinned = k == 1  # the level before looked up the chosen windows only

    def candidates(self, words: np.ndarray, places: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the windows of one document, and which of them are looked up."""
        hashes = window_hashes(words, self.length)
        if not len(hashes):
            return hashes, np.zeros(0, bool)
        if self.before is None:
            if self.width == 1:
                return hashes, np.ones(len(hashes), bool)
            return hashes, chosen_windows(hashes, self.width)
        parts = window_hashes(words, self.before)
        marked, n, gap = _same_as(parts, places), len(hashes), self.length - self.before
        if not self.thinned:
            return hashes, marked[:n] & marked[gap : gap + n]
        least = parts[:n].copy()
        for k in range(1, gap + 1):
            np.minimum(least, parts[k : k + n], out=least)
        out = np.zeros(n, bool)
        for k in range(gap + 1):
            out |= marked[k : k + n] & (parts[k : k + n] == least)
        return hashes, out


def _settled(hashes, docs, places, orders, last: bool):
    """Entries of one block or bucket, sorted by hash: (index, is repeated as far as seen here, stands for its hash)."""
    by_hash = np.argsort(hashes, kind="stable")
    h, d = hashes[by_hash], docs[by_hash]
    if not len(h):
        return by_hash, np.zeros(0, bool), np.zeros(0, bool)
    fresh = np.concatenate(([True], (h[1:] != h[:-1]) | (d[1:] != d[:-1])))  # a document's first window of a hash
    by_hash, h = by_hash[fresh], h[fresh]
    order = orders[by_hash]
    starts = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
    sizes = np.diff(np.append(starts, len(h)))
    least = np.repeat(np.minimum.reduceat(order, starts), sizes)
    most = np.repeat(np.maximum.reduceat(order, starts), sizes)
    return by_hash, order > least if last else least < most, order == least


_ENTRIES = "bucket int, block long, hashes binary, orders binary, rows binary, counts binary, places binary"


def _entries(docs: DataFrame, level: Level, buckets: int) -> DataFrame:
    """docs: row, ord, text (binary) and, but for the first level, places (packed)."""
    given = "places" in docs.columns
    names = [x.split()[0] for x in _ENTRIES.split(", ")]

    def packed(bucket, block_id, hashes, docs_, places, orders, rows):
        """One row of output; documents are run-length coded."""
        by_doc = np.argsort(docs_.astype(np.uint16), kind="stable") if len(orders) < 1 << 16 else np.argsort(docs_, kind="stable")
        d = docs_[by_doc]
        starts = np.flatnonzero(np.concatenate(([True], d[1:] != d[:-1])))
        counts = np.diff(np.append(starts, len(d))).astype(np.uint32)
        at = d[starts]
        return (int(bucket), block_id, b"" if hashes is None else hashes[by_doc].tobytes(), orders[at].tobytes(), rows[at].tobytes(), counts.tobytes(), places[by_doc].astype(np.uint32).tobytes())

    def block(held, block_id):
        hashes, docs_, places = (np.concatenate(x) for x in list(zip(*held["windows"], strict=True)))
        orders, rows = np.array(held["orders"], np.int64), np.array(held["rows"], np.int64)
        at, repeated, stands = _settled(hashes, docs_, places, orders[docs_], level.last)
        out = []
        for which, is_entry in ((stands, True), (repeated, False)):
            i = at[which]
            if not len(i):
                continue
            bucket = ((hashes[i] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64) if is_entry else np.full(len(i), block_id % buckets)
            order = np.argsort(bucket, kind="stable")
            i, bucket = i[order], bucket[order]
            cuts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True])))
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                part = i[a:b]
                out.append(packed(bucket[a], block_id, hashes[part] if is_entry else None, docs_[part], places[part], orders, rows))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.int32(), pa.int64(), *[pa.binary()] * 5], strict=True)], names=names)

    def run(batches):
        hasher, words_held, block_id = WordHasher(), 0, TaskContext.get().partitionId() << 32
        held: dict[str, list] = {"windows": [], "orders": [], "rows": []}
        for batch in batches:
            marks = batch.column("places").to_pylist() if given else [None] * batch.num_rows
            for row, order, words, places in zip(batch.column("row").to_pylist(), batch.column("ord").to_pylist(), hasher.texts(batch.column("text")), marks, strict=True):
                if len(words) < level.least_words:
                    continue
                at = np.frombuffer(places, np.uint32) if places else None
                hashes, looked_up = level.candidates(words, at)
                found = np.flatnonzero(looked_up)
                if not len(found):
                    continue
                held["windows"].append((hashes[found], np.full(len(found), len(held["rows"]), np.int32), found.astype(np.uint32)))
                held["orders"].append(order)
                held["rows"].append(row)
                words_held += len(words)
                if words_held >= BLOCK_WORDS:
                    yield block(held, block_id)
                    held, words_held, block_id = {"windows": [], "orders": [], "rows": []}, 0, block_id + 1
        if held["rows"]:
            yield block(held, block_id)

    return docs.mapInArrow(frugal(run), _ENTRIES)


def _answers(entries: DataFrame, last: bool) -> DataFrame:
    """row, places (packed): the windows that are repeated. Every bucket answers each block in one piece, and the answers
    to a block are dealt out to its documents."""

    def runs(of: np.ndarray):
        order = np.argsort(of, kind="stable")
        sorted_ = of[order]
        starts = np.flatnonzero(np.concatenate(([True], sorted_[1:] != sorted_[:-1]))) if len(of) else np.zeros(0, np.int64)
        return order, starts, np.append(starts[1:], len(of)).astype(np.int64)[: len(starts)]

    def settle(table: pa.Table) -> pa.Table:
        hashes, orders, rows, places, blocks, known = [], [], [], [], [], []
        for block, h, o, r, c, p in zip(*(table.column(x).to_pylist() for x in ("block", "hashes", "orders", "rows", "counts", "places")), strict=True):
            counts = np.frombuffer(c, np.uint32)
            row, place = np.repeat(np.frombuffer(r, np.int64), counts), np.frombuffer(p, np.uint32)
            if h:
                hashes.append(np.frombuffer(h, np.uint64))
                orders.append(np.repeat(np.frombuffer(o, np.int64), counts))
                rows.append(row)
                places.append(place)
                blocks.append(np.full(len(row), block, np.int64))
            else:
                known.append((np.full(len(row), block, np.int64), row, place))
        if hashes:
            h, o, r, p, b = map(np.concatenate, (hashes, orders, rows, places, blocks))
            at, repeated, _ = _settled(h, r, p, o, last)
            at = at[repeated]
            known.append((b[at], r[at], p[at]))
        b, r, p = (np.concatenate(x) for x in zip(*known, strict=True)) if known else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32))
        order, starts, ends = runs(b)
        b, r, p = b[order], r[order], p[order]
        cut = [slice(x, y) for x, y in zip(starts, ends, strict=True)]
        released()
        return pa.table({"block": b[starts], "rows": pa.array([r[c].tobytes() for c in cut], pa.binary()), "places": pa.array([p[c].tobytes() for c in cut], pa.binary())})

    def deal(table: pa.Table) -> pa.Table:
        r = np.frombuffer(b"".join(table.column("rows").to_pylist()), np.int64)
        p = np.frombuffer(b"".join(table.column("places").to_pylist()), np.uint32)
        order, starts, ends = runs(r)
        r, p = r[order], p[order]
        return pa.table({"row": r[starts], "places": pa.array([p[x:y].tobytes() for x, y in zip(starts, ends, strict=True)], pa.binary())})

    answers = entries.groupBy("bucket").applyInArrow(settle, "block long, rows binary, places binary")
    return answers.groupBy("block").applyInArrow(deal, "row long, places binary")


def covered(n_words: int, starts: np.ndarray, length: int) -> np.ndarray:
    """Which words lie in a window that starts at one of the marked places."""
    begun = np.concatenate(([0], np.cumsum(np.pad(starts, (0, n_words - len(starts))))))
    ends = np.arange(1, n_words + 1)
    return begun[ends] - begun[np.maximum(ends - length, 0)] > 0


def cut_text(text: bytes, removed: np.ndarray) -> bytes:
    """The text without the words removed, each with the white space before it (that after it at the start)."""
    out, at = [], 0
    for m, gone in zip(_WORD.finditer(text), removed.tolist(), strict=True):
        if not gone:
            out.append(text[at : m.end()])
        at = m.end()
    if out:
        out.append(text[at:] if not removed[-1] else b"")
    return b"".join(out).lstrip(b" \t\n\x0b\x0c\r") if len(removed) and removed[0] else b"".join(out)


def _placed(docs: DataFrame, place: str) -> DataFrame:
    """docs with the place of its id among all ids: whole numbers are their own places, ids of other types are numbered
    in their order, and a null id comes last."""
    if isinstance(docs.schema["doc_id"].dataType, T.IntegralType):
        return docs.withColumn(place, F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)))
    ids = numbered(docs.select("doc_id").where("doc_id IS NOT NULL").distinct(), [F.col("doc_id")], place)
    return docs.join(ids, "doc_id", "left").withColumn(place, F.coalesce(place, F.lit(LAST)))


def repeated_windows(docs: DataFrame, row: str, length: int = LENGTH) -> tuple[DataFrame, DataFrame]:
    """(docs with a key of that name, the key and the packed places of its windows that are repeated from a smaller id)."""
    ids = docs.groupBy("doc_id").count().agg(F.max("count"), F.count_if(F.col("doc_id").isNull())).first()
    unique = ids[0] == 1 and not ids[1]
    place = f"{row}_place"
    keyed = _placed(docs, place).withColumn(row, F.col(place) if unique else F.xxhash64("doc_id", "text"))
    slim = keyed.select(F.col(row).alias("row"), F.col(place).alias("ord"), F.col("text").cast("string").cast("binary").alias("text"))
    chars = docs.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    lengths = level_lengths(length)
    marks, rows = None, slim
    for k in range(len(lengths)):
        level = Level(lengths, k)
        buckets = parts_for(chars // 20, BUCKET_ENTRIES)
        marks = _answers(_entries(rows, level, buckets), level.last)
        if not unique:  # the same row may stand in several blocks
            marks = marks.groupBy("row").agg(F.collect_list("places").alias("_p")).select("row", F.aggregate("_p", F.lit(b""), lambda a, x: F.concat(a, x)).alias("places"))
        marks = materialize(marks, f"level-{lengths[k]}")
        if marks.isEmpty():
            break
        rows = slim.join(marks, "row")
    return keyed.drop(place), marks


def dedup_substrings(docs: DataFrame, length: int = LENGTH, with_text: bool = True) -> DataFrame:
    """docs with n_words, n_removed, kept_sha256 (of the kept words joined by one space) and, if asked for, the kept text."""
    row = f"_row_{uuid.uuid4().hex[:8]}"  # no column of docs has this name
    keyed, marks = repeated_windows(docs, row, length)
    kept = [f for f in docs.schema.fields if f.name not in {"text", "n_words", "n_removed", "kept_sha256"}]
    schema = T.StructType([*kept, *T.StructType.fromDDL("text string, n_words long, n_removed long, kept_sha256 string").fields])
    marked = marks.select(F.col("row").alias(row), F.col("places").alias(f"{row}_places"))
    joined = keyed.join(marked, row, "left").select(*(f.name for f in kept), F.col("text").cast("string").cast("binary").alias("text"), f"{row}_places")

    def run(batches):
        hasher = WordHasher()
        for batch in batches:
            texts, sizes, gone, digests = [], [], [], []
            for text, words_hashed, places in zip(batch.column("text").to_pylist(), hasher.texts(batch.column("text")), batch.column(f"{row}_places").to_pylist(), strict=True):
                words = (text or b"").split()  # splits at the same bytes
                if places:
                    hashes = window_hashes(words_hashed, length)
                    removed = covered(len(words), _same_as(hashes, np.frombuffer(places, np.uint32)), length)
                    if with_text:
                        text = cut_text(text, removed)
                    words_kept = [w for w, g in zip(words, removed.tolist(), strict=True) if not g]
                else:
                    words_kept = words
                texts.append(text if with_text else None)
                sizes.append(len(words))
                gone.append(len(words) - len(words_kept))
                digests.append(hashlib.sha256(b" ".join(words_kept)).hexdigest())
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(digests, pa.string())], names=schema.names)

    return joined.mapInArrow(frugal(run), schema)
