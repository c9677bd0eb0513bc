"""MinHash near-dedup with odd sketches (operator 12).

A document's set holds the hashes of its distinct shingles; documents with equal sets are one node from the start. A set
is sampled by SAMPLES MinHash functions. The samples are folded into a bitmap in which each flips one bit, the odd
sketch: the exclusive or of two bitmaps holds the samples that differ alone, so its population count tells a high
similarity far more precisely than as many bits of plain samples could (`likeness`). Groups of samples form bands; sets
that agree on a band meet in its bucket.

A bucket is never expanded into pairs. Sets are first sorted by their bands, four times over, and compared with their
successors, which merges most copies; of a bucket only those of different components are compared, all of them, and
only buckets that span components are gathered at all. Large ones are salted and cut into cells of bounded size that
together cover every pair. A pair is a candidate at its first common band alone, if the sketches leave the similarity
possible; a bound from full signatures and then the full sets decide, so a link is never wrong.

What can be missed: the number of bands is chosen so that two sets of just the asked similarity share none of them with
a chance below MISS, and the bound on the population count errs with a chance below MISS too; both fall fast with
rising similarity. Sets are told apart by 64-bit hashes of their tokens' 64-bit hashes.

Edge cases: as in the n-gram Jaccard join: null, empty or blank texts have the empty set and link with nothing; a text of
fewer words than a shingle is one token; repeated rows are labelled each; a null id names no component unless all its
documents have null ids, and is kept only then; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .buckets import _APART, _LOWEST_BITS, BLOCK_SUMS, Entries, folded, overlap_needed, signature
from .common import Scratch
from .components import connected
from .jaccard import CELL, Judge, _sid, _stars, _texts, labelled, likely_pairs, merged, salted_cells
from .shingles import WordHasher, _mixed, released, shingle_set

SHINGLE, PERCENT = 3, 85
#: MinHash functions, of which the first BANDED form the bands; bits of a sketch.
SAMPLES, BANDED, BITS = 256, 128, 1024
#: The chance that a pair of just the asked similarity shares no band, and that its sketches look too far apart.
MISS = 1e-9
#: Tokens that are hashed together.
BLOCK_TOKENS = 4096


def band_rows(percent: int) -> int:
    """The most samples a band can have so that similar sets hardly ever miss all bands."""
    return next((r for r in range(8, 1, -1) if (1 - (percent / 100) ** r) ** (BANDED // r) <= MISS), 1)


def expected_flips(samples_apart: float) -> float:
    """Bits that differ between the sketches of sets that differ in so many samples (each flips one bit on either side)."""
    return BITS / 2 * (1 - math.exp(-4 * samples_apart / BITS))


@cache
def most_flips(percent: int) -> int:
    """Sketches of sets of this similarity or more differ in more bits than this with a chance below MISS."""
    p, tail, x = 1 - percent / 100, 0.0, SAMPLES
    while x and p:
        log = math.lgamma(SAMPLES + 1) - math.lgamma(x + 1) - math.lgamma(SAMPLES - x + 1) + x * math.log(p) + (SAMPLES - x) * math.log1p(-p)
        tail += math.exp(log)
        if tail > MISS:
            break
        x -= 1
    return math.ceil(expected_flips(x if p else 0))


def likeness(x: bytes, y: bytes) -> float:
    """The similarity of two sets as their sketches tell it, 0 to 1."""
    flips = (int.from_bytes(x, "little") ^ int.from_bytes(y, "little")).bit_count()
    return max(0.0, 1 + BITS / (4 * SAMPLES) * math.log(max(1e-9, 1 - 2 * flips / BITS)))


class Sketcher:
    """MinHash samples, odd sketches and band keys."""

    def __init__(self, percent: int = PERCENT):
        seeds = _mixed(np.arange(1, 2 * SAMPLES + 1, dtype=np.uint64)).astype(np.uint32)
        self._factors, self._shifts = (seeds[:SAMPLES] | np.uint32(1))[:, None], seeds[SAMPLES:][:, None]
        self._names = _mixed(np.arange(SAMPLES, dtype=np.uint64) + np.uint64(1 << 40))
        self._rows = band_rows(percent)
        self.n_bands = BANDED // self._rows

    def samples(self, tokens: np.ndarray) -> np.ndarray:
        """The least value of each function over the tokens (of which there must be some)."""
        short, out = (tokens >> np.uint64(32)).astype(np.uint32), np.full(SAMPLES, 0xFFFFFFFF, np.uint32)
        for k in range(0, len(short), BLOCK_TOKENS):
            values = self._factors * short[None, k : k + BLOCK_TOKENS]
            values += self._shifts
            np.minimum(out, values.min(axis=1), out=out)
        return out

    def sketch(self, samples: np.ndarray) -> bytes:
        bits = _mixed(samples.astype(np.uint64) + self._names) >> np.uint64(40)
        return np.packbits(np.bincount(bits.astype(np.int64) % BITS, minlength=BITS) & 1).tobytes()

    def bands(self, samples: np.ndarray) -> np.ndarray:
        rows = samples[: self.n_bands * self._rows].astype(np.uint64).reshape(self.n_bands, self._rows)
        keys = np.arange(1, self.n_bands + 1, dtype=np.uint64)
        for k in range(self._rows):
            keys = _mixed(keys * np.uint64(0x9E3779B97F4A7C15) + rows[:, k])
        return keys.view(np.int64)


class OddEntries(Entries):
    """Entries whose signatures are an odd sketch followed by the counts of the set's tokens by group; often: the bands of
    each set, key: the band that it is entered under."""

    def __init__(self, cell, sid, size, pos, root, role, sig, key=None, often=None):
        super().__init__(cell, sid, size, pos, root, role, sig[:, BITS // 8 :], key, often)
        self.odd = np.ascontiguousarray(sig[:, : BITS // 8]).view(np.uint64)

    def likely(self, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
        """As of the parent's: here the sketches decide first, and what they leave is bounded by the counts."""
        m, n = self.size[i], self.size[j]
        ok = (self.root[i] != self.root[j]) & (np.minimum(m, n) * 100 >= np.maximum(m, n) * percent)
        i, j = i[ok], j[ok]
        ok = np.bitwise_count(self.odd[i] ^ self.odd[j]).sum(axis=1, dtype=np.int64) <= most_flips(percent)
        i, j = i[ok], j[ok]
        alone = self.size[i] + self.size[j]
        alone -= 2 * overlap_needed(alone, 0, percent)  # the most tokens that just one of them may have
        ok = np.bitwise_count((self.words[i] ^ self.words[j]) & _LOWEST_BITS).sum(axis=1, dtype=np.int64) <= alone
        i, j, alone = i[ok], j[ok], alone[ok]
        ok = np.ones(len(i), bool)
        for k in range(0, len(i), BLOCK_SUMS):
            block = slice(k, k + BLOCK_SUMS)
            ok[block] = _APART[self.sig[i[block]], self.sig[j[block]]].sum(axis=1, dtype=np.int64) <= alone[block]
        i, j = i[ok], j[ok]
        if self.often is not None and len(i):
            left, right = (np.array([self.often[k] for k in x.tolist()], np.int64) for x in (i, j))
            first = (left == right).argmax(axis=1)
            ok = left[np.arange(len(i)), first] == self.key[i]
            i, j = i[ok], j[ok]
        a, b = self.sid[i], self.sid[j]
        return np.stack((np.minimum(a, b), np.maximum(a, b)), axis=1)


def sketches(docs: DataFrame, length: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, sid (hash of the set), minima (keys of its bands), narrow (its odd sketch and counts of its tokens
    by group), sig (wide counts); null but for the first two where the set is empty."""
    schema = T.StructType([docs.schema["doc_id"], *T.StructType.fromDDL("n_shingles long, sid long, minima array<long>, narrow binary, sig binary").fields])

    def run(batches):
        hasher, sketcher = WordHasher(lower=True), Sketcher(percent)
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = []
            for words in hasher.texts(batch.column("text")):
                tokens = shingle_set(words, length)
                if len(tokens):
                    samples = sketcher.samples(tokens)
                    wide = signature(tokens)
                    narrow = sketcher.sketch(samples) + folded(np.frombuffer(wide, np.uint8)).tobytes()
                    rows.append((len(tokens), _sid(tokens), sketcher.bands(samples), narrow, wide))
                else:
                    rows.append((0, None, None, None, None))
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True))], names=schema.names)
        released()

    return _texts(docs, "doc_id").mapInArrow(run, schema)


def near_links(docs: DataFrame, base: DataFrame, scratch: Scratch, length: int, percent: int) -> DataFrame:
    """Links (a, b) between sets, enough of them to connect every two similar sets. base: from sketches."""
    firsts = (F.first(c).alias(n) for c, n in (("n_shingles", "size"), ("minima", "minima"), ("narrow", "narrow"), ("sig", "sig")))
    sets = scratch.keep(base.where("sid IS NOT NULL").groupBy("sid").agg(F.min("doc_id").alias("doc_id"), *firsts), "sets")
    judge = Judge(docs, sets, length, percent, scratch)
    roots, known = merged(sets, judge, percent, scratch, OddEntries)
    keyed = known.select("sid", "root", F.explode("minima").alias("key"))
    spanning = keyed.groupBy("key").agg(F.min("root").alias("_lo"), F.max("root").alias("_hi"), F.count("*").alias("_n")).where("_lo <> _hi").select("key", (F.col("_n") >= CELL).alias("salted"))
    members = scratch.keep(keyed.select("sid", "key").join(spanning, "key"), "members")
    rows = known.select("sid", "size", F.lit(0).alias("pos"), F.col("minima").alias("often"), "root", "sig")
    entered = scratch.keep(members.join(rows, "sid"), "entries")
    plain = entered.where("NOT salted").select(F.col("key").alias("cell"), "key", "sid", "size", "pos", "often", "root", F.lit(0).alias("role"), "sig")
    salted = entered.where("salted").drop("salted")
    cells = plain if salted.isEmpty() else plain.unionByName(salted_cells(salted))
    return _stars(roots).unionByName(judge.links(likely_pairs(cells, percent, OddEntries), "last-links"))


def near_duplicates(docs: DataFrame, length: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs."""
    docs = docs.select("doc_id", "text")
    with Scratch(docs.sparkSession) as scratch:
        base = scratch.keep(sketches(docs, length, percent), "sets-of-documents")
        found = labelled(base, connected(near_links(docs, base, scratch, length, percent)), scratch)
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
