"""Best-fit packing (operator 5): documents into sequences of at most 4,096 tokens.

Encoding runs in Arrow batches and leaves one small row per piece; no text is shuffled. Best-fit decreasing treats
pieces of one length alike, so the packing is decided on the histogram of lengths, which has at most `capacity`
entries whatever the size of the corpus: lengths from the longest down, each piece into the tightest open sequence,
found through a segment tree over remaining capacities in logarithmic time, many alike pieces at a step. The outcome
is a list of runs (pieces a to b of length L go to sequences s, s+1, ... at an offset). Pieces are numbered within
their length by distributed counts and joined to the runs.

Edge cases: a null or empty text is one token (the end mark); repeated rows are packed each; ties of length are broken
by the hash of the id, then the id, the piece and the checksum; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import materialize, parts_for
from .shingles import frugal
from .tokens import WordEncoder

CAPACITY = 4096
END_ID = 1


class CapacityTree:
    """A segment tree over the remaining capacities 0..capacity that says which have open sequences."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.open = [False] * (2 * self.leaves)

    def mark(self, remaining: int, is_open: bool) -> None:
        k = self.leaves + remaining
        self.open[k] = is_open
        while k > 1:
            k //= 2
            self.open[k] = self.open[2 * k] or self.open[2 * k + 1]

    def tightest(self, least: int) -> int | None:
        """The smallest open capacity of at least `least`."""
        k = self.leaves + least
        if self.open[k]:
            return least
        while k > 1:
            if k % 2 == 0 and self.open[k + 1]:
                k += 1
                while k < self.leaves:
                    k = 2 * k if self.open[2 * k] else 2 * k + 1
                return k - self.leaves
            k //= 2
        return None


def best_fit_runs(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, number of pieces, first sequence, offset): best-fit decreasing of a histogram of lengths.

    Piece number first+k of that length goes to sequence s+k. Sequences with the same room form runs of ids.
    """
    tree, rooms, runs, sequences = CapacityTree(capacity), {}, [], 0

    def put(remaining: int, start: int, count: int) -> None:
        if remaining:
            if not rooms.get(remaining):
                rooms[remaining] = []
                tree.mark(remaining, True)
            rooms[remaining].append((start, count))

    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            room = tree.tightest(length)
            if room is None:
                per = capacity // length  # new sequences are filled one after another: each is the tightest until full
                layers, count = min(per, left), max(1, left // per)
                for k in range(layers):
                    runs.append((length, rank, count, sequences, k * length))
                    rank += count
                    left -= count
                put(capacity - layers * length, sequences, count)
                sequences += count
                continue
            start, count = rooms[room].pop()
            if not rooms[room]:
                tree.mark(room, False)
            per = room // length
            whole = min(count, left // per)
            if whole:
                for k in range(per):
                    runs.append((length, rank, whole, start, capacity - room + k * length))
                    rank += whole
                    left -= whole
                put(room - per * length, start, whole)
                start, count = start + whole, count - whole
            if left and count:  # fewer pieces than one more sequence could take
                take = left
                for k in range(take):
                    runs.append((length, rank, 1, start, capacity - room + k * length))
                    rank += 1
                left = 0
                put(room - take * length, start, 1)
                start, count = start + 1, count - 1
            if count:
                put(room, start, count)
    return runs


def pieces_of(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 for each piece of each document."""
    schema = T.StructType([docs.schema["doc_id"], *T.StructType.fromDDL("piece int, start long, length long, ids_crc32 long").fields])

    def encode(batches):
        encoder, end, step = WordEncoder(path), np.asarray([end_id], "<u4").tobytes(), 4 * capacity
        for batch in batches:
            rows, out = [], []
            for row, text in enumerate(batch.column("text").to_pylist()):
                ids = encoder.ids(text or "") + end
                for at in range(0, len(ids), step):
                    part = ids[at : at + step]
                    rows.append(row)
                    out.append((at // step, at // 4, len(part) // 4, zlib.crc32(part)))
            piece, start, length, crc = np.asarray(out, np.int64).reshape(-1, 4).T
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(piece.astype(np.int32)), *map(pa.array, (start, length, crc))], names=schema.names)

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(frugal(encode), schema)


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Each piece with sequence_id and offset."""
    spark = docs.sparkSession
    pieces = materialize(pieces_of(docs, path, capacity, end_id), "pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    runs = best_fit_runs(histogram, capacity)
    total = sum(histogram.values())

    # Number the pieces of a length: a count per hash bucket, shifts over the buckets, row numbers inside a bucket.
    key = F.xxhash64("doc_id", "piece")
    buckets = parts_for(max(histogram.values(), default=0), 20_000)
    dealt = pieces.withColumn("_key", key).withColumn("_bucket", F.pmod("_key", F.lit(buckets)).cast("int"))
    counts = dealt.groupBy("length", "_bucket").agg(F.count("*").alias("_n"))
    shifts = counts.withColumn("_shift", F.sum("_n").over(Window.partitionBy("length").orderBy("_bucket")) - F.col("_n")).drop("_n")
    inside = Window.partitionBy("length", "_bucket").orderBy("_key", "doc_id", "piece", "ids_crc32")
    numbered = dealt.withColumn("_n", F.row_number().over(inside)).join(shifts, ["length", "_bucket"]).withColumn("_rank", F.col("_shift") + F.col("_n") - 1)

    # A run is found by an equi-join on the length and the largest first rank that is not beyond the piece's.
    table = pd.DataFrame(runs, columns=["length", "first", "n", "sequence", "offset"]).astype("int64")
    bounds = spark.createDataFrame(table, "length long, first long, n long, sequence long, offset long").groupBy("length").agg(F.array_sort(F.collect_list(F.struct("first", "n", "sequence", "offset"))).alias("runs"))
    run = F.filter("runs", lambda r: (r["first"] <= F.col("_rank")) & (F.col("_rank") < r["first"] + r["n"]))[0]
    placed = numbered.join(F.broadcast(bounds), "length").withColumn("_run", run)  # bounded by the capacity, not by the corpus
    assert total == int(table["n"].sum())
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("_run.sequence") + F.col("_rank") - F.col("_run.first")).alias("sequence_id"), F.col("_run.offset").alias("offset"))
