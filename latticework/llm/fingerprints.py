"""Document fingerprints (operator 3), in DataFrame functions only: one-permutation MinHash.

The shingles of a text (five words; all words where there are fewer) are hashed once. The top bits of a hash name one of
BINS bins, and each bin keeps the smallest of its hashes; bins without a shingle are filled by optimal densification,
each walking its own pseudo-random permutation of the bins to the first that holds one. The fingerprint is the packed
low-order BITS of the bins in hexadecimal. Two fingerprints agree in a bin by chance with probability 2**-BITS, which
the likeness corrects for: (agreement - 2**-BITS) / (1 - 2**-BITS), not below 0.

Sorting the hashes together with one sentinel for each bin gives the minima in linear passes: the first element of each
bin is its smallest hash, or the sentinel if the bin is empty.

Edge cases: a text without words has the empty fingerprint, which is like another empty one (1) and unlike any other
(0); words are compared in lower case; rows repeated in full have the same next document and give the same result;
rows with equal ids and other texts follow each other in the order of their texts' hashes; with a single row the next
document is the row itself; null ids come last in descending order.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.ordering import numbered
from .common import let, materialize, windows, words_of

SHINGLE = 5
BINS = 256
BITS = 8
#: Steps of a walk that are looked at one by one before the rest is searched.
TRIES = 16
_BIN_SHIFT = 63 - (BINS.bit_length() - 1)


def shingle_hashes(text: Column) -> Column:
    """array<long> of non-negative 63-bit hashes of the shingles of a text."""

    def of(h: Column) -> Column:
        few = F.array(F.aggregate(h, F.lit(42).cast("long"), lambda a, x: F.xxhash64(a, x)))
        return F.when(F.size(h) >= SHINGLE, windows(h, SHINGLE)).when(F.size(h) > 0, few).otherwise(F.array().cast("array<bigint>"))

    words = F.transform(words_of(F.lower(text)), lambda w: F.xxhash64(w))
    return F.transform(let(words, of), lambda x: x.bitwiseAND(F.lit((1 << 63) - 1)))


def bin_minima(hashes: Column) -> Column:
    """array<long> of BINS elements: the smallest hash of each bin without its bin's bits, or null."""
    low = (1 << _BIN_SHIFT) - 1
    sentinels = F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda i: F.call_function("shiftleft", i.cast("long"), F.lit(_BIN_SHIFT)) + F.lit(low))

    def of_bin(x: Column) -> Column:
        return F.call_function("shiftright", x, F.lit(_BIN_SHIFT))

    def first(s: Column) -> Column:
        return F.filter(s, lambda x, i: (i == 0) | (of_bin(x) != of_bin(F.get(s, i - 1))))

    minima = let(F.sort_array(F.concat(hashes, sentinels)), first)
    return F.transform(minima, lambda x: F.when(x.bitwiseAND(F.lit(low)) != low, x.bitwiseAND(F.lit(low))))


def _permutations() -> tuple[list[int], list[int], list[int]]:
    """For each bin the start, the odd step and the step's inverse of its own walk over all bins (a power of two)."""
    mixed = [int.from_bytes(hashlib.sha256(b"bin %d" % i).digest()[:8], "little") for i in range(BINS)]
    steps = [(x >> 32) % BINS | 1 for x in mixed]
    return [x % BINS for x in mixed], steps, [pow(s, -1, BINS) for s in steps]


def _table(values: list[int]) -> Column:
    """A constant array<int> as one folded literal: thousands of literals would each be a node of the plan."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<int>")


def densified(minima: Column) -> Column:
    """Low-order bits of the bins; an empty bin takes those of the first full bin on its walk. [] if all are empty.

    Where many bins are full the walk is followed, since a few tries are enough; where few are, the full bin with the
    least place on the walk is taken, which is the same one."""
    starts, steps, inverses = _permutations()
    begin, step, inverse = map(_table, (starts, steps, inverses))
    tried = _table([(starts[i] + j * steps[i]) % BINS for i in range(BINS) for j in range(TRIES)])
    mask = F.lit((1 << BITS) - 1)

    def fill(m: Column) -> Column:
        def walk(i: Column) -> Column:
            return F.aggregate(F.sequence(F.lit(TRIES), F.lit(BINS - 1)), F.lit(None).cast("long"), lambda a, j: F.coalesce(a, F.get(m, F.pmod(F.get(begin, i) + j * F.get(step, i), F.lit(BINS)))))

        def followed(x: Column, i: Column) -> Column:
            return F.coalesce(x, *(F.get(m, F.get(tried, i * TRIES + j)) for j in range(TRIES)), walk(i)).bitwiseAND(mask).cast("int")

        def nearest(full: Column):
            def of(x: Column, i: Column) -> Column:
                placed = F.transform(full, lambda b: F.pmod((b - F.get(begin, i)) * F.get(inverse, i), F.lit(BINS)) * (1 << BITS) + F.get(m, b).bitwiseAND(mask))
                return F.coalesce(x, F.array_min(placed)).bitwiseAND(mask).cast("int")

            return of

        def by_number(full: Column) -> Column:
            n_full = F.size(full)
            return (
                F.when(n_full == 0, F.array().cast("array<int>"))
                .when(n_full == BINS, F.transform(m, lambda x: x.bitwiseAND(mask).cast("int")))
                .when(n_full >= BINS // 8, F.transform(m, followed))
                .otherwise(F.transform(m, nearest(full)))
            )

        return let(F.filter(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda b: F.get(m, b).isNotNull()), by_number)

    return let(minima, fill)


def bins_of(text: Column) -> Column:
    return densified(bin_minima(shingle_hashes(text)))


def packed(bins: Column) -> Column:
    """Hexadecimal text of the bins' bits."""
    return F.array_join(F.transform(bins, lambda x: F.lower(F.lpad(F.hex(x), BITS // 4, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two arrays of bins, corrected for chance agreement."""
    agree = F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda s, x: s + x) / F.lit(float(BINS))
    chance = 2.0**-BITS
    both = F.greatest(F.lit(0.0), (agree - chance) / (1 - chance))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both).when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(0.0)


def fingerprint(docs: DataFrame) -> DataFrame:
    """docs with fingerprint (string); a column of that name is replaced."""
    return docs.withColumn("fingerprint", packed(bins_of(F.coalesce(F.col("text").cast("string"), F.lit("")))))


def same_rows(left: DataFrame, right: DataFrame, of_left: tuple[str, str], of_right: tuple[str, str]) -> DataFrame:
    """Pairs of rows with the same id (null as null) and the same hash, by their names on either side."""
    (id_left, h_left), (id_right, h_right) = of_left, of_right
    return left.join(right, F.col(id_left).eqNullSafe(F.col(id_right)) & (F.col(h_left) == F.col(h_right)))


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Each document with the fingerprints of its text and of its edited text, and their likeness.

    Only ids travel to find the next document. Texts are shuffled once, by id (both joins read that exchange), and the
    beginnings that are put into the edited texts once more.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text")).withColumn("_h", F.xxhash64("text"))
    ids = materialize(rows.select("doc_id", "_h", F.length("text").cast("long").alias("n_chars")).distinct(), "ids")
    n, all_rows = ids.count(), docs.count()
    order = [F.col("doc_id").desc_nulls_last(), F.col("_h")]
    placed = numbered(ids, order, "position", n)
    following = placed.select(F.col("doc_id").alias("_next"), F.col("_h").alias("_next_h"), F.pmod(F.col("position") - 1, F.lit(max(n, 1))).alias("position"))
    links = materialize(placed.join(following, "position").drop("position"), "links")

    # The same columns for both joins, so that their exchange is shared.
    keyed = rows.select(F.col("doc_id").alias("_id"), F.col("_h").alias("_id_h"), "text")
    needed = links.select("_next", "_next_h", F.col("doc_id").alias("_for"), F.col("_h").alias("_for_h"), F.floor(F.col("n_chars") / 3).cast("int").alias("_n"))
    heads = same_rows(keyed, needed.hint("shuffle_hash"), ("_id", "_id_h"), ("_next", "_next_h")).select("_for", "_for_h", F.substring("text", F.lit(1), F.col("_n")).alias("_head"))
    if all_rows > n:
        heads = heads.dropDuplicates(["_for", "_for_h"])
    cut = F.floor(F.length("text") / 3).cast("int")
    joined = same_rows(same_rows(keyed, links.hint("shuffle_hash"), ("_id", "_id_h"), ("doc_id", "_h")), heads, ("_id", "_id_h"), ("_for", "_for_h"))
    edited = joined.withColumn("_edited", F.concat(F.substring("text", F.lit(1), F.length("text") - cut), F.col("_head")))
    prints = edited.select("doc_id", "_h", "n_chars", "_next", "_next_h", F.sha2("_edited", 256).alias("edited_sha256"), bins_of(F.col("text")).alias("_bins"), bins_of(F.col("_edited")).alias("_edited_bins"))
    prints = materialize(
        prints.select("doc_id", "_h", "n_chars", "_next", "_next_h", "edited_sha256", packed(F.col("_bins")).alias("fingerprint"), packed(F.col("_edited_bins")).alias("edited_fingerprint"), likeness(F.col("_bins"), F.col("_edited_bins")).alias("near_edited")),
        "fingerprints",
    )
    others = prints.select(F.col("doc_id").alias("_id"), F.col("_h").alias("_id_h"), F.col("fingerprint").alias("_next_print"))
    if all_rows > n:
        others = others.groupBy("_id", "_id_h").agg(F.max("_next_print").alias("_next_print"))
    pairs = same_rows(prints, others, ("_next", "_next_h"), ("_id", "_id_h"))
    near = likeness(unpacked(F.col("fingerprint")), unpacked(F.col("_next_print")))
    return pairs.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", near.alias("near_next"))


def unpacked(text: Column) -> Column:
    """The bins of a packed fingerprint as hexadecimal strings."""
    digits = BITS // 4
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.regexp_extract_all(text, F.lit(f"(.{{{digits}}})"), F.lit(1)))
