"""Quality rules by distribution divergence (operator 6), in DataFrame functions only.

Two histograms of a document, its character classes and the most common words of its language, are compared with those
of all documents of the language by Jensen-Shannon distance (base 2, 0 to 1). Documents too short for a histogram to
mean anything are not judged by it (the minimum-length guards). Counts on words come first: base_failed drops a
document whatever its histograms say.

Edge cases: a null text has no words; a document whose language is null or without
enough text is compared with the classes of all documents and not by words; ties among common words go by code point;
repeated rows are judged each; columns of the input named like an output column are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SPACES, let, materialize, shielded, windows, words_of

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
REPEAT_WINDOW = 3

#: Minimum-length guards: characters for the classes, words for the common words.
MIN_CHARS, MIN_WORDS_COMPARED = 300, 80
MAX_CLASS_DISTANCE, MAX_WORD_DISTANCE = 0.24, 0.32
COMMON_WORDS, LEAST_SHARE = 24, 1e-3
#: Repeated windows up to which each window is looked up in their list.
LOOKED_UP = 32
#: References are broadcast up to this many characters (REFERENCE_CHARS for a language besides its words); beyond, documents are joined to them by language.
BROADCAST_CHARS, REFERENCE_CHARS = 16_000_000, 500

# The symbols, and the classes in the order in which they are taken out of the text; the last class is all that is left.
SYMBOLS = "#*$%&|<>"
CLASSES = {
    "lower": r"[\p{Ll}\p{Lo}\p{Lm}]+",
    "space": r"[\x20\x09-\x0D]+",
    "upper": r"[\p{Lu}\p{Lt}]+",
    "digit": r"[\p{N}]+",
    "stop": r"[.,;:?'\"()\-]+",
    "mark": r"[\p{M}]+",
}
CLASS_NAMES = [*CLASSES, "other"]


def base_counts(docs: DataFrame) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and one count for each character class."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    out = docs.withColumn("_words", words_of(text)).withColumn("n_words", F.size("_words").cast("long"))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    out = out.withColumn("n_dup_lines", let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"))
    out = out.withColumn("n_repeat_words", repeat_words(F.col("_words")))
    rest = text
    for name, pattern in CLASSES.items():
        out = out.withColumn(f"_rest_{name}", F.regexp_replace(rest, pattern, ""))
        out = out.withColumn(f"_n_{name}", F.length(rest) - F.length(f"_rest_{name}"))
        rest = F.col(f"_rest_{name}")
    out = out.withColumn("_n_other", F.length(rest))
    # No other class has a symbol, and the class of spaces is all that stands between words.
    out = out.withColumn("n_symbols", (F.length(rest) - F.length(F.translate(rest, SYMBOLS, ""))).cast("long"))
    out = out.withColumn("word_chars", (F.length(text) - F.col("_n_space")).cast("long"))
    return out.drop(*(f"_rest_{n}" for n in CLASSES))


def repeat_words(words: Column) -> Column:
    """Words inside windows of three words that occur twice or more in the text.

    Windows are hashed and sorted; hashes next to an equal one are the repeated ones. Where these are few, each window
    is looked up among them; where they are many, places are found by sorting hashes together with their places.
    """

    n_words = F.size(words)

    def of(hashes: Column) -> Column:
        return F.when(n_words > REPEAT_WINDOW, let(windows(hashes, REPEAT_WINDOW), covered)).otherwise(0)

    def covered(found: Column) -> Column:
        repeated = let(F.sort_array(found), lambda s: F.array_distinct(F.filter(s, lambda x, i: x == F.get(s, i + 1))))
        return let(repeated, lambda r: F.when(F.size(r) == 0, 0).otherwise(covering(places(found, r))))

    def places(found: Column, repeated: Column) -> Column:
        few = F.filter(F.sequence(F.lit(0), F.size(found) - 1), lambda i: F.array_contains(repeated, F.get(found, i)))
        return F.when(F.size(repeated) <= LOOKED_UP, few).otherwise(places_sorted(found))

    def covering(at: Column) -> Column:
        """Each place covers three words, less those that the place before covers too."""
        return let(at, lambda p: F.aggregate(F.zip_with(F.slice(p, 2, F.size(p) - 1), F.slice(p, 1, F.size(p) - 1), lambda x, y: F.least(x - y, F.lit(REPEAT_WINDOW))), F.lit(REPEAT_WINDOW), lambda a, x: a + x))

    return F.coalesce(let(F.transform(words, lambda w: F.xxhash64(w)), of), F.lit(0)).cast("long")


def places_sorted(found: Column) -> Column:
    """Places of the hashes that occur again: hash bits and place share one long, so that sorting brings equals together."""
    bits = F.ceil(F.log2(F.size(found) + 1.0)).cast("int")
    place = F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1

    def of(mask: Column) -> Column:
        keyed = F.transform(found, lambda w, i: F.call_function("shiftrightunsigned", w, F.lit(1)).bitwiseAND(F.bitwise_not(mask)).bitwiseOR(i.cast("long")))

        def twin(keys, key, other):
            near = key.bitwiseXOR(other) <= mask
            same = F.get(found, key.bitwiseAND(mask).cast("int")) == F.get(found, other.bitwiseAND(mask).cast("int"))
            return F.coalesce(near & same, F.lit(False))

        def again(keys):
            kept = F.filter(keys, lambda k, i: twin(keys, k, F.get(keys, i + 1)) | twin(keys, k, F.get(keys, F.when(i > 0, i - 1))))
            return F.sort_array(F.transform(kept, lambda k: k.bitwiseAND(mask).cast("int")))

        return let(F.sort_array(keyed), again)

    return let(place, of)


def class_references(counts: DataFrame) -> DataFrame:
    """Shares of the classes for each language, and for all documents under a null language."""
    by_lang = materialize(counts.groupBy("lang").agg(*(F.sum(f"_n_{n}").alias(n) for n in CLASS_NAMES)), "class-counts")
    known = by_lang.where("lang IS NOT NULL")
    every = by_lang.agg(*(F.sum(n).alias(n) for n in CLASS_NAMES)).withColumn("lang", F.lit(None).cast("string"))
    total = sum(F.col(n) for n in CLASS_NAMES)
    return known.unionByName(every).select("lang", F.transform(F.array(*CLASS_NAMES), lambda x: x / F.when(total > 0, total)).alias("class_ref"))


def word_references(docs: DataFrame) -> DataFrame:
    """For each language its common words and their shares, the share of all other words first."""
    words = docs.where("lang IS NOT NULL").select("lang", F.explode(words_of(F.col("text"))).alias("word"))
    counts = words.groupBy("lang", "word").count()
    total = counts.groupBy("lang").agg(F.sum("count").alias("total"))
    # at most 1 / LEAST_SHARE words of a language pass
    frequent = counts.join(total, "lang").withColumn("share", F.col("count") / F.col("total")).where(F.col("share") >= LEAST_SHARE)
    order = Window.partitionBy("lang").orderBy(F.desc("share"), "word")
    top = frequent.withColumn("k", F.row_number().over(order)).where(F.col("k") <= COMMON_WORDS)
    return top.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("k", "word", "share"))).alias("top")).select(
        "lang", F.col("top.word").alias("ref_words"), F.concat(F.array(F.lit(1.0) - F.aggregate("top.share", F.lit(0.0), lambda a, x: a + x)), F.col("top.share")).alias("word_ref")
    )


def js_distance(counts: Column, reference: Column) -> Column:
    """Jensen-Shannon distance, base 2, of a histogram of counts and an array of shares."""

    def part(p, m):
        return F.when(p > 0, p * F.log2(p / m)).otherwise(0.0)

    def of(cells, total):
        both = F.zip_with(cells, reference, lambda c, q: let(c / total, lambda p: (part(p, (p + q) / 2) + part(q, (p + q) / 2)) / 2))
        return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(both, F.lit(0.0), lambda a, x: a + x)))

    return let(counts, lambda cells: let(F.aggregate(cells, F.lit(0).cast("long"), lambda a, x: a + x), lambda total: of(cells, total)))


def common_word_counts(words: Column, common: Column) -> Column:
    """How often other words occur, then each common word: cells by their run lengths in one sorted array."""
    cells = F.array_remove(F.transform(words, lambda w: F.array_position(common, w)), 0)

    def runs(s):
        starts = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        return let(starts, lambda b: F.transform(b, lambda at, k: (F.coalesce(F.get(b, k + 1), F.size(s)) - at - 1).cast("long")))

    def of(found):
        numbers = F.sequence(F.lit(1).cast("long"), F.size(common).cast("long"))
        return F.concat(F.array((F.size(words) - F.size(found)).cast("long")), let(F.sort_array(F.concat(found, numbers)), runs))

    return let(cells, of)


def judge(docs: DataFrame, references: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """docs with the counts, class_distance, word_distance, base_failed and kept."""
    return shielded(docs, {"text", "lang"}, set(MADE), lambda rows: _judged(rows, references))


MADE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "class_distance", "word_distance", "base_failed", "kept")


def _judged(docs: DataFrame, references: tuple[DataFrame, DataFrame] | None) -> DataFrame:
    docs = docs.withColumn("lang", F.col("lang").cast("string")) if "lang" in docs.columns else docs.withColumn("lang", F.lit(None).cast("string"))
    classes, common = references or (materialize(class_references(class_counts(docs)), "class-references"), materialize(word_references(docs), "word-references"))
    every = F.broadcast(classes.where("lang IS NULL").select(F.col("class_ref").alias("_every")))  # one row
    refs = classes.where("lang IS NOT NULL").join(common, "lang", "left")
    size = refs.agg(F.coalesce(F.sum(REFERENCE_CHARS + F.length(F.array_join(F.coalesce("ref_words", F.array().cast("array<string>")), ""))), F.lit(0))).first()[0]
    out = base_counts(docs).join(F.broadcast(refs) if size <= BROADCAST_CHARS else refs, "lang", "left").join(every)
    class_counts_ = F.array(*(F.col(f"_n_{n}").cast("long") for n in CLASS_NAMES))
    n_chars = sum(F.col(f"_n_{n}") for n in CLASS_NAMES)
    out = out.withColumn("class_distance", F.when(n_chars >= MIN_CHARS, js_distance(class_counts_, F.coalesce("class_ref", "_every"))))
    out = out.withColumn("word_distance", F.when((F.col("n_words") >= MIN_WORDS_COMPARED) & F.col("ref_words").isNotNull(), js_distance(common_word_counts(F.col("_words"), F.col("ref_words")), F.col("word_ref"))))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    near = F.coalesce(F.col("class_distance") <= MAX_CLASS_DISTANCE, F.lit(True)) & F.coalesce(F.col("word_distance") <= MAX_WORD_DISTANCE, F.lit(True))
    out = out.withColumn("base_failed", failed).withColumn("kept", ~failed & near)
    return out.select(*docs.columns, *MADE)


def class_counts(docs: DataFrame) -> DataFrame:
    """lang and the count of each character class."""
    rest = F.coalesce(F.col("text").cast("string"), F.lit(""))
    out = docs.select("lang", rest.alias("_rest"))
    for name, pattern in CLASSES.items():
        out = out.withColumn("_next", F.regexp_replace("_rest", pattern, "")).withColumn(f"_n_{name}", F.length("_rest") - F.length("_next")).withColumn("_rest", F.col("_next"))
    return out.select("lang", *(f"_n_{n}" for n in CLASSES), F.length("_rest").alias("_n_other"))
