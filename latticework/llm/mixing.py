"""Mixing sources to target weights (operator 2), in DataFrame functions only.

Each document gets a hash-random key. Within a source the documents stand in the order of their keys, and the mix takes
the first words of that order up to the source's budget, going round again (another epoch) where the budget exceeds the
source. A document's place is a prefix sum of sizes: a sum per bucket of the key range, a running sum over those few
buckets, and a sort inside the single bucket of each source where the budget ends. Documents in other buckets are
wholly in or wholly out, so no group larger than one bucket is ever sorted.

Edge cases: a null text has size 0; a null source is a source of its own, last in order; a source without words has
target 0; rows repeated in full are interchangeable; an empty table gives an empty result. A column of the input that
is named like an output column is replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.ordering import numbered
from .common import WORD, materialize, parts_for, shielded

WEIGHTS = (5, 2, 1)
SHARE_PERCENT = 150
MOST_EPOCHS = 2
SEED = "mix"


def word_count(text: str = "text"):
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def source_targets(sized: DataFrame, weights=WEIGHTS, share_percent: int = SHARE_PERCENT, most_epochs: int = MOST_EPOCHS) -> DataFrame:
    """One row per source: source, source_size, target; shares above most_epochs times the size are handed on by weight."""
    totals = materialize(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs")), "sources")
    n = totals.count()
    position = F.col("position") % len(weights)
    weight = F.lit(float(weights[-1]))
    for k in range(len(weights) - 1):
        weight = F.when(position == k, F.lit(float(weights[k]))).otherwise(weight)
    order = [F.col("source").isNull(), F.col("source")]
    capped = materialize(numbered(totals, order, "position", n).select("source", "source_size", "n_docs", weight.alias("w"), (F.col("source_size") * most_epochs).cast("double").alias("cap")), "weights")
    budget = (capped.agg(F.sum("source_size")).first()[0] or 0) * share_percent / 100
    # Each round fixes the sources whose share exceeds their cap; the level rises until no further source does.
    level, fixed = -1.0, -1
    while True:
        below = F.col("cap") < level * F.col("w")
        at, caps, left = capped.agg(F.count_if(below), F.coalesce(F.sum(F.when(below, F.col("cap"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~below, F.col("w"))), F.lit(0.0))).first()
        if at == fixed or not left:
            break
        fixed, level = at, (budget - caps) / left
        rest, parts = budget - caps, left
    if n == 0 or fixed < 0:
        rest, parts = 0.0, 1.0
    below = F.col("cap") < level * F.col("w")
    return capped.select("source", "source_size", "n_docs", F.when(below | (F.col("cap") < rest * F.col("w") / parts), F.col("cap")).otherwise(rest * F.col("w") / parts).alias("target"))


def mix_sources(docs: DataFrame, sized: DataFrame | None = None, weights=WEIGHTS, share_percent: int = SHARE_PERCENT, most_epochs: int = MOST_EPOCHS) -> DataFrame:
    """docs with size, source_size, target and taken (words the mix takes of the document, repeats counted).

    docs has doc_id, source and either size or text. sized: the same rows with doc_id, source and size, if the caller
    has them at hand in a form that is cheaper to read than docs.
    """
    return shielded(docs, {"doc_id", "source", "size", "text"}, {"source_size", "target", "taken"}, lambda rows: _mixed(rows, sized, weights, share_percent, most_epochs))


def _mixed(docs: DataFrame, sized: DataFrame | None, weights, share_percent: int, most_epochs: int) -> DataFrame:
    rows = docs if "size" in docs.columns else docs.withColumn("size", word_count())
    sized = (rows if sized is None else sized).select("doc_id", "source", "size")
    targets = materialize(source_targets(sized, weights, share_percent, most_epochs), "targets")
    n_docs = targets.agg(F.max("n_docs")).first()[0] or 0
    buckets = parts_for(n_docs, 2000, 16)

    mixed_key = F.md5(F.concat_ws(":", F.lit(SEED), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    first = F.conv(F.substring("_key", 1, 8), 16, 10).cast("long")
    in_bucket = F.shiftright(first * buckets, 32).cast("int")
    keyed = sized.withColumn("_key", mixed_key).withColumn("_bucket", in_bucket)

    sums = keyed.groupBy("source", "_bucket").agg(F.sum("size").alias("s"))
    run = Window.partitionBy("source").orderBy("_bucket")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = targets.withColumn("_epochs", whole).withColumn("_rest", F.floor("target").cast("long") - F.col("_epochs") * F.col("source_size"))
    before = sums.withColumn("_before", F.sum("s").over(run) - F.col("s"))  # a source has at most `buckets` rows here
    ends = (
        plan.alias("p").join(before.alias("b"), F.col("p.source").eqNullSafe(F.col("b.source")))
        .where("b._before <= p._rest AND p._rest < b._before + b.s")
        .select("p.source", F.col("b._bucket").alias("_end"), F.col("b._before").alias("_before"))
    )
    plan = materialize(
        plan.alias("p").join(ends.alias("e"), F.col("p.source").eqNullSafe(F.col("e.source")), "left")
        .select(F.col("p.source").alias("_source"), "p.source_size", "p.target", "_epochs", "_rest", F.coalesce("_end", F.lit(buckets)).alias("_end"), F.coalesce("_before", F.lit(0)).alias("_before")),
        "cuts",
    )
    kept = [c for c in rows.columns if c not in ("source_size", "target", "taken")]
    joined = rows.select(*kept).withColumn("_key", mixed_key).withColumn("_bucket", in_bucket).join(plan, F.col("source").eqNullSafe(F.col("_source")), "left")
    at_end = F.col("_bucket") == F.col("_end")
    some = F.when(F.col("_bucket") < F.col("_end"), F.col("size")).otherwise(0)
    inside = Window.partitionBy("_source").orderBy("_key", "doc_id", "size")
    prefix = F.col("_before") + F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    cut = F.greatest(F.lit(0), F.least(F.col("size"), F.col("_rest") - prefix))
    out = [*kept, "source_size", "target", (F.col("_epochs") * F.col("size") + F.col("_some")).cast("long").alias("taken")]
    clear = joined.where(~at_end).withColumn("_some", some).select(*out)
    return clear.unionByName(joined.where(at_end).withColumn("_some", cut).select(*out))


def take_words(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """The mix itself: a row for each time a document is taken; the one document of a source where the budget ends is cut to its first words."""
    copies = F.sequence(F.lit(1).cast("long"), F.ceil(F.col("taken") / F.col("size")).cast("long"))
    rows = mixed.where("taken > 0").withColumn("_copy", F.explode(copies))
    left = F.col("taken") - (F.col("_copy") - 1) * F.col("size")
    shortened = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1)), F.lit(1), left.cast("int")), " ")
    text = F.when(left >= F.col("size"), F.col("text")).otherwise(shortened)
    return rows.withColumn("text", text).select(*columns)
