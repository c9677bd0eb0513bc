"""N-gram Jaccard join by token-combination prefixes (operator 10).

A document's set holds the hashes of its distinct shingles. Documents with equal sets are one node from the start, so
copies are never compared. Tokens are put in one order, the frequent class last and its rarest tokens first, and a set
of size n is known by its prefix: two sets of similarity t or more share a token among the first n - ceil(t n) + 1 of
each. Where the first shared token may be a frequent one, the prefix is extended by K - 1 tokens and combinations of K
frequent tokens are indexed instead, since two sets whose first shared token is frequent share K of them there (sets
that are too small for that share the single token). The frequent class is counted over all documents: tokens met more
than once in a block of documents are summed over the blocks, and the LARGEST_CLASS largest sums above FREQUENT form
the class; any class gives the same links, the counts only make buckets small.

A bucket (the sets under one token or combination) is never expanded into pairs. Before the index is made, sets are
sorted by minima of their tokens, several times over, and each is compared with its successor, and then with REACH of
them if these are not of its component yet; that costs a fixed number of comparisons a set and merges most copies. Of a bucket only entries of different components
are paired, and of these only those whose sizes, places and signatures (counts of tokens by group, see buckets.py) leave
the similarity possible; full signatures and then the full sets decide. The index travels packed, by key; keys that
only one set has end there, and signatures join what is left. Keys whose bucket may be large (by the counts of the
class) are salted, and their buckets cut into cells of bounded size that cover every pair to be looked at.

Edge cases: null, empty or blank texts have the empty set and link with nothing; a text of fewer words than a shingle
is one token; rows repeated, or with equal ids, are kept and labelled each; a null id never is a component's name
unless all its documents have null ids; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .buckets import Entries, apart, folded, overlap_needed, signature
from .common import Scratch, materialize, parts_for
from .components import connected
from .shingles import WordHasher, _mixed, frugal, shingle_set

SHINGLE = 5
PERCENT = 80
#: Tokens of more documents than this are frequent; the class that is handed to every task is bounded by its largest tokens.
FREQUENT, LARGEST_CLASS = 100, 1 << 20
K = 2
#: Tokens that are counted together; entries of the index that are packed together, and that a part of it is planned for.
BLOCK_TOKENS, BLOCK_ENTRIES, PART_ENTRIES = 3_000_000, 200_000, 250_000
#: Entries of a key that may be as many as this or more are salted, and their buckets cut into cells of this many a side.
CELL = 1000
#: Successors in each sorted order that a set is compared with once its next ones are merged.
REACH = 16
#: Rows of the index that are held while cells are gone through (and the rest of the last cell).
HELD_ROWS = 50_000
#: Ids are broadcast up to this many bytes, at ID_BYTES each; beyond, both sides are shuffled.
BROADCAST_BYTES, ID_BYTES = 32 << 20, 64


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


class FrequentClass:
    """The frequent tokens, sorted, with their counts and places in the order (the rarest first)."""

    def __init__(self, tokens: np.ndarray, counts: np.ndarray):
        by_token = np.argsort(tokens)
        self.tokens, self.counts = tokens[by_token], counts[by_token]
        in_order = np.lexsort((self.tokens, self.counts))
        self.rank = np.empty(len(tokens), np.int64)
        self.rank[in_order] = np.arange(len(tokens))
        self._count = self.counts[in_order]
        #: What a token outside the class may count.
        self.rest = int(counts.min()) if len(tokens) >= LARGEST_CLASS else FREQUENT

    def counts_of(self, ranks: np.ndarray) -> np.ndarray:
        return self._count[ranks]

    def split(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rare tokens, places in the class of the frequent ones, ascending)."""
        if not len(self.tokens):
            return tokens, np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.tokens, tokens), len(self.tokens) - 1)
        common = self.tokens[at] == tokens
        return tokens[~common], np.sort(self.rank[at[common]])


def keys_of(tokens: np.ndarray, frequent: FrequentClass, percent: int) -> tuple[tuple, tuple, np.ndarray]:
    """Index keys of a set: single tokens, rare ones of the prefix and frequent ones of sets too small for combinations, and
    combinations of the places in the class of frequent tokens of the extended prefix.

    Returns (keys, places, bounds) of single tokens, the same of combinations, and the places in the class that are
    combined. A key's place is that of its last token less the tokens before it in the combination, so that at most
    size - place tokens are shared where the key is the first that is; bounds are the most sets that a key can have, as
    far as counts tell."""
    n = len(tokens)
    p = prefix_length(n, percent)
    rare, often = frequent.split(tokens)
    head = rare[:p]
    single = head, np.arange(len(head)), np.full(len(head), frequent.rest)
    reach = often[: p + K - 1 - len(rare)] if len(rare) < p else often[:0]
    i, j = np.triu_indices(len(reach), 1)
    counts = frequent.counts_of(reach)
    pairs = (reach[i] << 32 | reach[j]).view(np.uint64), len(rare) + j - 1, counts[i]  # the first of two is the rarer
    if len(reach) and n - p + 1 < K:  # so small that one shared token may be enough
        some = slice(0, p - len(rare))
        single = tuple(np.concatenate(x) for x in zip(single, (_mixed(reach[some].astype(np.uint64)), len(rare) + np.arange(len(reach[some])), counts[some]), strict=True))
    return single, pairs, reach.astype(np.int32)


def _texts(docs: DataFrame, *columns) -> DataFrame:
    return docs.select(*columns, F.col("text").cast("string").cast("binary").alias("text"))


def _sid(tokens: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(tokens.tobytes()) - (1 << 63)


def summaries(docs: DataFrame, length: int) -> DataFrame:
    """doc_id, n_shingles, sid (hash of the set, null for the empty set), minima (four of its tokens, each the smallest by another order), sig."""
    schema = T.StructType([docs.schema["doc_id"], *T.StructType.fromDDL("n_shingles long, sid long, minima array<long>, sig binary").fields])

    def run(batches):
        hasher = WordHasher(lower=True)
        for batch in batches:
            sizes, sids, minima, sigs = [], [], [], []
            for words in hasher.texts(batch.column("text")):
                tokens = shingle_set(words, length)
                sizes.append(len(tokens))
                if len(tokens):
                    other = _mixed(tokens)
                    sids.append(_sid(tokens))
                    minima.append(np.array([tokens[0], tokens[-1], other.min(), other.max()]).view(np.int64))
                    sigs.append(signature(tokens))
                else:
                    sids.append(None)
                    minima.append(None)
                    sigs.append(None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(sids, pa.int64()), pa.array(minima, pa.list_(pa.int64())), pa.array(sigs, pa.binary())], names=schema.names)

    return _texts(docs, "doc_id").mapInArrow(frugal(run), schema)


def frequent_tokens(docs: DataFrame, length: int) -> FrequentClass:
    """At most LARGEST_CLASS tokens."""

    def run(batches):
        hasher, held, n = WordHasher(lower=True), [], 0

        def counted():
            tokens = np.concatenate(held)
            held.clear()
            tokens.sort()
            starts = np.flatnonzero(np.concatenate((np.ones(min(1, len(tokens)), bool), tokens[1:] != tokens[:-1])))
            counts = np.diff(np.append(starts, len(tokens)))
            keep = counts > 1
            return pa.RecordBatch.from_arrays([pa.array(tokens[starts[keep]].view(np.int64)), pa.array(counts[keep])], names=["token", "n"])

        for batch in batches:
            for words in hasher.texts(batch.column("text")):
                held.append(shingle_set(words, length))
                n += len(held[-1])
                if n >= BLOCK_TOKENS:
                    yield counted()
                    n = 0
        if held:
            yield counted()

    counts = _texts(docs).mapInArrow(frugal(run), "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") > FREQUENT)
    largest = counts.orderBy(F.desc("n"), "token").limit(LARGEST_CLASS).toPandas()
    return FrequentClass(largest["token"].to_numpy(np.int64).view(np.uint64), largest["n"].to_numpy(np.int64))


def _index(docs: DataFrame, frequent: FrequentClass, length: int, percent: int, parts: int) -> DataFrame:
    """key, sid, pos, often, salted: entries whose key another set has too (of salted keys all). Entries travel packed, one
    row for each block of a task and part of the keys; a set that occurs again in the same task is entered once."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def packed(which: list, paired: bool, lists: dict):
        keys, sids, pos, bounds = (np.concatenate(x) for x in zip(*which, strict=True))
        salted = bounds >= CELL
        with np.errstate(over="ignore"):
            part = (_mixed(np.where(salted, _mixed(keys) + sids.view(np.uint64), keys)) >> np.uint64(20)) % np.uint64(parts)
        part = part.astype(np.int64) * 4 + 2 * paired + salted
        order = np.argsort(part, kind="stable")
        keys, sids, pos, part = keys[order], sids[order], pos[order], part[order]
        cuts = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1], [True]))).tolist()
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            names = np.unique(sids[a:b]).tolist() if paired else []
            yield int(part[a]), keys[a:b].tobytes(), sids[a:b].tobytes(), pos[a:b].tobytes(), names, [lists[x] for x in names]

    def block(single: list, pairs: list, lists: dict):
        rows = [*packed(single, False, lists), *(packed(pairs, True, lists) if pairs else ())]
        kinds = (pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.binary()))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["part", "keys", "sids", "pos", "names", "lists"])

    def run(batches):
        hasher, seen, n = WordHasher(lower=True), set(), 0
        held: tuple[list, list, dict] = ([], [], {})
        for batch in batches:
            for words in hasher.texts(batch.column("text")):
                tokens = shingle_set(words, length)
                if not len(tokens) or (sid := _sid(tokens)) in seen:
                    continue
                seen.add(sid)
                *found, reach = keys_of(tokens, shared.value, percent)
                for into, (keys, places, bounds) in zip(held[:2], found, strict=True):
                    if len(keys):
                        into.append((keys, np.full(len(keys), sid, np.int64), np.minimum(places, 0xFFFF).astype(np.uint16), bounds))
                        n += len(keys)
                if len(found[1][0]):
                    held[2][sid] = reach.tobytes()
                if n >= BLOCK_ENTRIES:
                    yield block(*held)
                    held, n = ([], [], {}), 0
        if n:
            yield block(*held)

    def shared_keys(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        paired, salted = bool(part & 2), bool(part & 1)
        keys, sids, pos = (np.frombuffer(b"".join(table.column(c).to_pylist()), t) for c, t in (("keys", np.uint64), ("sids", np.int64), ("pos", np.uint16)))
        lists = {k: v for names, values in zip(table.column("names").to_pylist(), table.column("lists").to_pylist(), strict=True) for k, v in zip(names, values, strict=True)} if paired else {}
        order = np.lexsort((sids, keys))
        keys, sids, pos = keys[order], sids[order], pos[order]
        fresh = np.concatenate(([True], (keys[1:] != keys[:-1]) | (sids[1:] != sids[:-1])))
        keys, sids, pos = keys[fresh], sids[fresh], pos[fresh]
        if not salted:
            same = keys[1:] == keys[:-1]
            again = np.concatenate((same, [False])) | np.concatenate(([False], same))
            keys, sids, pos = keys[again], sids[again], pos[again]
        often = pa.array([lists[x] for x in sids.tolist()] if paired else [None] * len(sids), pa.binary())
        return pa.table({"key": keys.view(np.int64), "sid": sids, "pos": pos.astype(np.int32), "often": often, "salted": pa.array(np.full(len(keys), salted))})

    rows = _texts(docs).mapInArrow(frugal(run), "part long, keys binary, sids binary, pos binary, names array<long>, lists array<binary>")
    return rows.groupBy("part").applyInArrow(shared_keys, "key long, sid long, pos int, often binary, salted boolean")


def salted_cells(entries: DataFrame) -> DataFrame:
    """Salted entries (key, sid, size, pos, often, root, sig) as the sides of cells that together hold every pair of entries of a
    key of which one lies outside the key's largest component: role 1 is a share of all entries, role 2 of those outside."""
    counts = entries.groupBy("key", "root").count().groupBy("key").agg(F.max(F.struct("count", "root")).alias("_main"), F.sum("count").alias("_n"), F.count("*").alias("_roots")).where("_roots > 1")
    sides = counts.select("key", F.col("_main.root").alias("_main"), F.ceil(F.col("_n") / CELL).alias("_p"), F.ceil((F.col("_n") - F.col("_main.count")) / CELL).alias("_q"))
    joined = entries.join(sides, "key").withColumn("_h", F.xxhash64("sid"))
    zero = F.lit(0).cast("long")
    all_ = joined.select("*", F.pmod("_h", "_p").alias("_x"), F.explode(F.sequence(zero, F.col("_q") - 1)).alias("_y"), F.lit(1).alias("role"))
    outside = joined.where("root <> _main").select("*", F.pmod("_h", "_q").alias("_y"), F.explode(F.sequence(zero, F.col("_p") - 1)).alias("_x"), F.lit(2).alias("role"))
    return all_.unionByName(outside).select(F.xxhash64("key", "_x", "_y").alias("cell"), "key", "sid", "size", "pos", "often", "root", "role", "sig")


def likely_pairs(cells: DataFrame, percent: int, kind: type[Entries] = Entries) -> DataFrame:
    """a, b: pairs of sets of different components that meet in a cell and may be similar, as entries of this kind tell.
    Some stand there more than once."""
    names = ("cell", "sid", "size", "pos", "root", "role", "key")

    def run(batches):
        held: list[pa.RecordBatch] = []
        rows = 0

        def settled(last: bool):
            nonlocal held, rows
            table = pa.Table.from_batches(held)
            columns = [table.column(c).to_numpy().astype(np.int64) for c in names]
            cut = len(table) if last else int(np.searchsorted(columns[0], columns[0][-1]))
            sig = np.frombuffer(b"".join(table.column("sig").slice(0, cut).to_pylist()), np.uint8).reshape(cut, -1)
            often = table.column("often").slice(0, cut)
            rest = table.slice(cut)
            held, rows = rest.combine_chunks().to_batches(), len(rest)
            *columns, key = (c[:cut] for c in columns)
            for found in kind(*columns, sig, key, often.to_pylist() if often.null_count < cut else None).pairs(percent):
                if len(found):
                    found = np.unique(found, axis=0)
                    yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["a", "b"])

        limit = HELD_ROWS
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= limit:
                yield from settled(False)
                limit = max(HELD_ROWS, 2 * rows)  # a cell that fills the hold is not gone through again for each batch
        if rows:
            yield from settled(True)

    dealt = cells.select(*names, "often", "sig").repartition("cell").sortWithinPartitions("cell")
    return dealt.mapInArrow(frugal(run), "a long, b long")


def _neighbours(sets: DataFrame, percent: int, reach: int, kind: type[Entries] = Entries) -> DataFrame:
    """a, b: likely pairs of sets of different components among each set and the `reach` sets that follow it when all are
    sorted by one of their minima and then the next. sets: sid, size, root, sig."""

    def run(batches):
        last = None
        for batch in batches:
            table = pa.Table.from_batches([batch] if last is None else [last, batch]).combine_chunks()
            last = table.slice(max(0, len(table) - reach)).to_batches()[0]
            turn, first, sid, size, root = (table.column(c).to_numpy().astype(np.int64) for c in ("turn", "first", "sid", "size", "root"))
            sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint8).reshape(len(table), -1)
            entries = kind(first, sid, size, np.zeros(len(sid), np.int64), root, None, sig)
            for off in range(1, min(reach, len(table) - 1) + 1):
                i = np.flatnonzero((turn[off:] == turn[:-off]) & (first[off:] == first[:-off]))
                found = entries.likely(i, i + off, percent)
                if len(found):
                    yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["a", "b"])

    turns = F.explode(F.array(*(F.struct(F.lit(k).alias("turn"), F.col("minima")[k].alias("first"), F.col("minima")[(k + 1) % 4].alias("then")) for k in range(4))))
    rows = sets.select("sid", "size", "root", "sig", turns.alias("_t")).select("_t.*", "sid", "size", "root", "sig")
    order = ["turn", "first", "then", "sid"]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(frugal(run), "a long, b long")


def _narrow(sets: DataFrame) -> DataFrame:
    """sets (doc_id, sid, size, minima, sig) with narrow, the signature of fixed width."""
    schema = T.StructType([*sets.schema.fields, T.StructField("narrow", T.BinaryType())])

    def run(batches):
        for batch in batches:
            narrow = [folded(np.frombuffer(x, np.uint8)).tobytes() for x in batch.column("sig").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(narrow, pa.binary())], names=schema.names)

    return sets.mapInArrow(frugal(run), schema)


class Judge:
    """Decides likely pairs: by full signatures, then by the full sets of their texts."""

    def __init__(self, docs: DataFrame, sets: DataFrame, length: int, percent: int, scratch: Scratch):
        self.docs, self.sets, self.length, self.percent, self.scratch = docs, sets, length, percent, scratch

    def links(self, pairs: DataFrame, name: str) -> DataFrame:
        possible = self.scratch.keep(self._bounded(pairs.distinct()), f"{name}-possible")
        texts = self._texts_of(possible, name)
        found = self.scratch.keep(self._verified(possible, texts), name)
        self.scratch.drop(possible, texts)
        return found

    def _bounded(self, pairs: DataFrame) -> DataFrame:
        left, right = (self.sets.select(F.col("sid").alias(c), F.col("sig").alias(f"_sig_{c}"), F.col("size").alias(f"_size_{c}")) for c in ("a", "b"))
        percent = self.percent

        def run(batches):
            for batch in batches:
                rows = zip(*(batch.column(c).to_pylist() for c in ("_sig_a", "_sig_b", "_size_a", "_size_b")), strict=True)
                yield batch.select(["a", "b"]).filter(pa.array([(m + n - apart(x, y)) // 2 >= overlap_needed(m, n, percent) for x, y, m, n in rows], pa.bool_()))

        return pairs.join(left, "a").join(right, "b").select("a", "b", "_sig_a", "_sig_b", "_size_a", "_size_b").mapInArrow(frugal(run), "a long, b long")

    def _texts_of(self, pairs: DataFrame, name: str) -> DataFrame:
        """sid, text of one document for each set in the pairs. The ids of those documents are broadcast if they are few."""
        sids = pairs.select(F.col("a").alias("sid")).unionByName(pairs.select(F.col("b").alias("sid"))).distinct()
        needed = self.scratch.keep(self.sets.join(sids, "sid").select("doc_id", F.col("sid").alias("_sid")), f"{name}-needed")
        n, ids = needed.agg(F.count("*"), F.count("doc_id")).first()
        wanted = needed.where("doc_id IS NOT NULL")
        found = _with_sid(self.docs.join(F.broadcast(wanted) if ID_BYTES * n <= BROADCAST_BYTES else wanted, "doc_id"), self.length).where("sid = _sid")
        if n > ids:
            nameless = self.docs.where("doc_id IS NULL").withColumn("_sid", F.lit(0).cast("long"))
            found = found.unionByName(_with_sid(nameless, self.length).join(needed.where("doc_id IS NULL").select(F.col("_sid").alias("sid")), "sid", "left_semi"))
        texts = self.scratch.keep(found.select("sid", "text"), f"{name}-texts")
        if texts.count() > n:  # rows with equal ids
            once = self.scratch.keep(texts.dropDuplicates(["sid"]), f"{name}-texts")
            self.scratch.drop(texts)
            texts = once
        self.scratch.drop(needed)
        return texts

    def _verified(self, pairs: DataFrame, texts: DataFrame) -> DataFrame:
        left, right = texts.select(F.col("sid").alias("a"), F.col("text").alias("_x")), texts.select(F.col("sid").alias("b"), F.col("text").alias("_y"))
        length, percent = self.length, self.percent

        def run(batches):
            hasher = WordHasher(lower=True)
            for batch in batches:
                keep = []
                for x, y in zip(hasher.texts(batch.column("_x")), hasher.texts(batch.column("_y")), strict=True):
                    s, t = shingle_set(x, length), shingle_set(y, length)
                    both = len(np.intersect1d(s, t, assume_unique=True))
                    keep.append(100 * both >= percent * (len(s) + len(t) - both))
                yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

        return pairs.join(left, "a").join(right, "b").select("a", "b", "_x", "_y").mapInArrow(frugal(run), "a long, b long")


def _with_sid(docs: DataFrame, length: int) -> DataFrame:
    """_sid, sid, text: documents with the hash of their own set, which tells apart rows of equal ids."""

    def run(batches):
        hasher = WordHasher(lower=True)
        for batch in batches:
            sids = [_sid(shingle_set(w, length)) for w in hasher.texts(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("_sid"), pa.array(sids, pa.int64()), batch.column("text")], names=["_sid", "sid", "text"])

    return _texts(docs, "_sid").mapInArrow(frugal(run), "_sid long, sid long, text binary")


def _stars(roots: DataFrame) -> DataFrame:
    return roots.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))


def merged(sets: DataFrame, judge: Judge, percent: int, scratch: Scratch, kind: type[Entries] = Entries) -> tuple[DataFrame, DataFrame]:
    """(node, root of sets found similar among neighbours in sorted minima; all sets with their root and narrow signature)."""

    def rooted(roots: DataFrame) -> DataFrame:
        joined = sets.join(roots.withColumnRenamed("node", "sid"), "sid", "left")
        return scratch.keep(joined.select("sid", "size", F.coalesce("root", "sid").alias("root"), F.col("narrow").alias("sig"), "minima"), "known")

    alone = sets.select("sid", "size", F.col("sid").alias("root"), F.col("narrow").alias("sig"), "minima")
    roots = connected(judge.links(_neighbours(alone, percent, 1, kind), "next-links"))
    roots = connected(_stars(roots).unionByName(judge.links(_neighbours(rooted(roots), percent, REACH, kind), "near-links")))
    return roots, rooted(roots)


def near_links(docs: DataFrame, base: DataFrame, scratch: Scratch, length: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Links (a, b) between sets, enough of them to connect every two similar sets. base: from summaries."""
    once = base.where("sid IS NOT NULL").groupBy("sid").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("size"), F.first("minima").alias("minima"), F.first("sig").alias("sig"))
    sets = scratch.keep(_narrow(once), "sets")
    judge = Judge(docs, sets, length, percent, scratch)

    roots, known = merged(sets, judge, percent, scratch)
    frequent = frequent_tokens(docs, length)
    n = sets.agg(F.sum(F.col("size") - F.ceil(percent * F.col("size") / 100) + 1)).first()[0] or 0
    entered = scratch.keep(_index(docs, frequent, length, percent, parts_for(n, PART_ENTRIES, 1, 1 << 22)).join(known.drop("minima"), "sid"), "entries")
    plain = entered.where("NOT salted").select(F.col("key").alias("cell"), "key", "sid", "size", "pos", "often", "root", F.lit(0).alias("role"), "sig")
    salted = entered.where("salted")
    cells = plain if salted.isEmpty() else plain.unionByName(salted_cells(salted))
    return _stars(roots).unionByName(judge.links(likely_pairs(cells, percent), "last-links"))


def labelled(base: DataFrame, roots: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, n_shingles, component_id of the documents of base (doc_id, n_shingles, sid), from the components of sets."""
    rooted = scratch.keep(base.join(roots.withColumnRenamed("node", "sid"), "sid", "left").select("doc_id", "n_shingles", F.coalesce("root", "sid").alias("root")), "labels")
    names = rooted.where("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    alone = rooted.where("root IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return materialize(rooted.where("root IS NOT NULL").join(names, "root").select("doc_id", "n_shingles", "component_id").unionByName(alone), "near-duplicates")


def join_near(docs: DataFrame, length: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs."""
    docs = docs.select("doc_id", "text")
    with Scratch(docs.sparkSession) as scratch:
        base = scratch.keep(summaries(docs, length), "sets-of-documents")
        return labelled(base, connected(near_links(docs, base, scratch, length, percent)), scratch)


def one_of_each(docs: DataFrame, length: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of docs that stay when each group of near duplicates keeps the document that names it.

    Rows without an id stay; of several rows with one id one stays. The ids that go are broadcast if they are few, so
    that texts are not shuffled."""
    labels = join_near(docs, length, percent)
    names = labels.where("component_id IS NOT NULL").select(F.col("component_id").alias("doc_id")).distinct()
    gone = materialize(labels.where("doc_id <> component_id").select("doc_id").distinct().join(names, "doc_id", "left_anti"), "gone")
    kept = docs.join(F.broadcast(gone) if ID_BYTES * gone.count() <= BROADCAST_BYTES else gone, "doc_id", "left_anti")
    if not labels.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").isEmpty():
        kept = kept.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).unionByName(kept.where("doc_id IS NULL"))
    return kept
