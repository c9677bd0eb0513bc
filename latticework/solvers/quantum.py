"""Independent sets of a graph as bit masks, their counts, and the Hamiltonians over them.

A set of up to 63 nodes is a LONG mask. Larger graphs take a STRUCT of as many LONG words as they need, the word of the
highest nodes first, so that masks compare as numbers do; structs of longs are join and group keys like any other
column, and all work on them is done word by word without carries. Levels are joins: each set carries the mask of the
nodes that may still be added, and is joined to a table of one row for each node.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.matrix import SparseMatrix, Vector, check
from ..plans.ordering import numbered
from ..plans.scratch import materialize

#: Nodes in a word; the sign bit stays free. The table of nodes, which is broadcast, holds two masks a node, so that this
#: many nodes bound it to 4 MB.
WORD, MOST_NODES = 63, 4096


class Masks:
    """Sets of n nodes as one long or as a struct of words."""

    def __init__(self, n: int):
        check(0 <= n <= MOST_NODES, f"graphs have at most {MOST_NODES} nodes")
        self.n, self.words = n, max(1, -(-n // WORD))
        self.names = [f"w{k}" for k in reversed(range(self.words))]
        self.type = "long" if self.words == 1 else f"struct<{', '.join(f'{w}: long' for w in self.names)}>"

    def value(self, nodes: int):
        """The mask of a whole number's bits as a value of a row."""
        low = (1 << WORD) - 1
        return nodes if self.words == 1 else tuple(nodes >> (WORD * int(w[1:])) & low for w in self.names)

    def literal(self, nodes: int) -> Column:
        value = self.value(nodes)
        return F.lit(value).cast("long") if self.words == 1 else F.struct(*(F.lit(x).cast("long").alias(w) for w, x in zip(self.names, value, strict=True)))

    def _each(self, x: Column, y: Column, f) -> Column:
        return f(x, y) if self.words == 1 else F.struct(*(f(x[w], y[w]).alias(w) for w in self.names))

    def common(self, x: Column, y: Column) -> Column:
        return self._each(x, y, lambda a, b: a.bitwiseAND(b))

    def either(self, x: Column, y: Column) -> Column:
        return self._each(x, y, lambda a, b: a.bitwiseOR(b))

    def differing(self, x: Column, y: Column) -> Column:
        return self._each(x, y, lambda a, b: a.bitwiseXOR(b))

    def meet(self, x: Column, y: Column) -> Column:
        """Whether two sets have a node in common."""
        if self.words == 1:
            return x.bitwiseAND(y) != 0
        return reduce(lambda a, b: a | b, (x[w].bitwiseAND(y[w]) != 0 for w in self.names))

    def count(self, x: Column) -> Column:
        return F.bit_count(x) if self.words == 1 else reduce(lambda a, b: a + b, (F.bit_count(x[w]) for w in self.names))

    def of_nodes(self, node: Column) -> Column:
        """The union, as an aggregate, of sets of one node each."""
        bits = {w: F.when(F.floor(node / WORD) == int(w[1:]), F.call_function("shiftleft", F.lit(1).cast("long"), (node % WORD).cast("int"))).otherwise(F.lit(0).cast("long")) for w in self.names}
        return F.bit_or(bits["w0"]) if self.words == 1 else F.struct(*(F.bit_or(bits[w]).alias(w) for w in self.names))


def _nodes(spark: SparkSession, edges, masks: Masks) -> DataFrame:
    """(u, bit, allowed): each node, and the nodes above it that are not its neighbours. edges: pairs, or a table (a, b)
    whose rows are summed into one mask a node."""
    n = masks.n
    full = (1 << n) - 1
    rows = spark.createDataFrame([(u, masks.value(1 << u), masks.value(full & ~((1 << (u + 1)) - 1))) for u in range(n)], f"u int, bit {masks.type}, above {masks.type}")
    if not isinstance(edges, DataFrame):
        edges = spark.createDataFrame([(int(a), int(b)) for a, b in edges], "a int, b int")
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both.groupBy(F.col("a").cast("int").alias("u")).agg(masks.of_nodes(F.col("b")).alias("near"))
    joined = rows.join(near, "u", "left").withColumn("near", F.coalesce("near", masks.literal(0)))
    return materialize(joined.select("u", "bit", masks.differing(F.col("above"), masks.common(F.col("above"), F.col("near"))).alias("allowed")), "nodes")


def next_level(sets: DataFrame, nodes: DataFrame, masks: Masks) -> DataFrame:
    """(mask, candidates) with one more node, from those with one node less."""
    # the broadcast side has a row for each node; the condition is on a bit, so that there is no equi-join
    grown = sets.join(F.broadcast(nodes), masks.meet(F.col("candidates"), F.col("bit")))
    return grown.select(masks.either(F.col("mask"), F.col("bit")).alias("mask"), masks.common(F.col("candidates"), F.col("allowed")).alias("candidates"))


def independent_sets(spark: SparkSession, edges, n: int, most: int | None = None) -> DataFrame:
    """(mask, size) of all independent sets, the empty one included, up to a size. edges: pairs, or a table (a, b)."""
    masks = Masks(n)
    nodes = _nodes(spark, edges, masks)
    level = spark.range(1).select(masks.literal(0).alias("mask"), masks.literal((1 << n) - 1).alias("candidates"))
    out, size = level.select("mask", F.lit(0).alias("size")), 0
    while size < (n if most is None else most):
        level = materialize(next_level(level, nodes, masks), "sets")
        if level.isEmpty():
            break
        size += 1
        out = out.unionByName(level.select("mask", F.lit(size).alias("size")))
    return out


def sets_to_sizes(sets: DataFrame, n: int = WORD) -> DataFrame:
    """n: how many nodes the graph has, where that is more than a word holds."""
    return sets.select("mask", Masks(n).count(F.col("mask")).alias("size"))


def independence_polynomial(spark: SparkSession, edges, n: int, most: int | None = None) -> list[int]:
    counts = {r["size"]: r["count"] for r in independent_sets(spark, edges, n, most).groupBy("size").count().collect()}  # at most n + 1 rows
    return [counts[k] for k in sorted(counts)]


class States:
    """All independent sets with their numbers: by size and mask, counted from the last, so that the empty set has the largest."""

    def __init__(self, spark: SparkSession, edges, n: int, energy: float = 1.0, most: int | None = None):
        self.energy, self.masks = energy, Masks(n)
        sets = numbered(independent_sets(spark, edges, n, most), [F.col("size"), F.col("mask")], "_at")
        sets = materialize(sets, "states")
        self.count, self.n = sets.count(), n
        self.df = sets.select((F.lit(self.count - 1) - F.col("_at")).alias("i"), "mask", "size")

    def driver(self) -> SparseMatrix:
        """Ones between each set and the sets with one node less, both ways."""
        spark = self.df.sparkSession
        bits = spark.createDataFrame([(self.masks.value(1 << u),) for u in range(self.n)], f"bit {self.masks.type}")
        held = self.df.join(F.broadcast(bits), self.masks.meet(F.col("mask"), F.col("bit")))  # one row a node
        less = held.select("i", self.masks.differing(F.col("mask"), F.col("bit")).alias("_m"))
        edges = less.join(self.df.select(F.col("i").alias("j"), F.col("mask").alias("_m")), "_m").select("i", "j")
        both = edges.unionByName(edges.select(F.col("j").alias("i"), F.col("i").alias("j")))
        return SparseMatrix(both.withColumn("v", F.lit(1.0)), (self.count, self.count), "float64", "csr")

    def sizes(self) -> Vector:
        """The diagonal of the cost: the size of each set."""
        return Vector(self.df.select("i", (F.col("size") * F.lit(float(self.energy))).alias("v")), self.count)

    def cost(self) -> SparseMatrix:
        return SparseMatrix(self.df.select("i", F.col("i").alias("j"), (F.col("size") * F.lit(float(self.energy))).alias("v")), (self.count, self.count), "float64", "dia")

    def optimum(self) -> float:
        return self.sizes().df.agg(F.max("v")).first()[0]

    def minimum_energy(self) -> float:
        return self.sizes().df.agg(F.min("v")).first()[0]

    def weights(self, state: Vector) -> DataFrame:
        """(i, cost, p): the cost and the probability of each set in a state of real or complex amplitudes."""
        square = F.col("v") * F.col("v") if state.dtype == "float64" else F.col("v.re") * F.col("v.re") + F.col("v.im") * F.col("v.im")
        return self.sizes().df.withColumnRenamed("v", "cost").join(state.df.select("i", square.alias("p")), "i")

    def cost_function(self, state: Vector) -> float:
        return self.weights(state).agg(F.sum(F.col("cost") * F.col("p"))).first()[0]

    def optimum_overlap(self, state: Vector) -> float:
        return self.weights(state).where(F.col("cost") == self.optimum()).agg(F.coalesce(F.sum("p"), F.lit(0.0))).first()[0]

    def approximation_ratio(self, state: Vector) -> float:
        return self.cost_function(state) / self.optimum()
