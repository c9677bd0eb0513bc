"""Language identification by cross-parsing entropy (operator 1).

For each language the labelled texts of a bounded sample are joined into one reference, whose suffix automaton is laid
out as a transition table of its most frequent characters, and a sorted list of transitions for the others, so that
every character of a reference counts. A text is parsed against a reference from left to right into the longest phrases that occur
there; log2(reference length) bits a phrase over the number of characters estimates its cross-entropy (a
character that the reference lacks is spelled out, at LITERAL_BITS or more), and the language
needing the fewest such normalised phrases wins. Texts are cut into blocks of BLOCK characters that are parsed in step
by NumPy (a phrase ends at a block's end, for every language alike), so whole texts of any length are read at a bounded
memory.

Edge cases: null texts, and texts without a letter, are `und` with score 0; non-letters count as one space; characters
that no reference has are phrases of their own; with equal costs the language first in code point order wins; with one
language learned the score is 1; with none every text is `und`. Repeated rows are scored each. Every language is
learned; the more there are, the shorter their references.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import held_out
from .shingles import frugal

#: The bound of the sample that the references are taken from: hash buckets of documents for each language, characters
#: taken of a document, characters of a language's reference, characters of all references (or LEAST_CHARS for each).
SAMPLE_DOCS, SAMPLE_CHARS, REFERENCE_CHARS, ALL_CHARS, LEAST_CHARS = 64, 4000, 40_000, 400_000, 200
BLOCK = 256
#: Characters of a reference that are columns of its table; transitions of the others are searched for.
ALPHABET = 62
LITERAL_BITS = 16.0
SHARPNESS = 8.0
UNKNOWN = "und"
_OTHER, _PAD, _SPACE = 0, 1, 2
_LETTERS = None


def _letters() -> np.ndarray:
    global _LETTERS
    if _LETTERS is None:
        _LETTERS = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _LETTERS


def normalised(text: str) -> np.ndarray:
    """Code points of the lower-cased text; each run of non-letters is one space."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    space = ~_letters()[points]
    points = np.where(space, np.uint32(0x20), points)
    return points[~(space & np.concatenate(([False], space[:-1])))]


def suffix_automaton(codes) -> list[dict[int, int]]:
    """Transitions of the suffix automaton; state 0 is the root. It accepts exactly the substrings of codes."""
    nxt, link, length = [{}], [-1], [0]
    last = 0
    for c in codes:
        new = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = new
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[new] = clone
        last = new
    return nxt


class Reference:
    """One language's automaton.

    An entry is 2 * (next state * width) + 1 if a phrase begins with this character. Without a transition the phrase has
    ended, and the character begins the next one at the root. Codes from width on are the rare characters: their
    transitions are found by searching the sorted keys of (state, code).
    """

    def __init__(self, ids: np.ndarray, n_ids: int):
        """ids: the text, as places in the characters of all references."""
        seen, counts = np.unique(ids, return_counts=True)
        seen = seen[np.argsort(-counts, kind="stable")]
        seen = seen[seen != _SPACE]
        self.width = width = min(len(seen), ALPHABET) + 3
        self.n_rare = max(0, len(seen) - ALPHABET)
        self.codes = np.zeros(n_ids, np.uint8 if len(seen) + 3 <= 0x100 else np.uint16 if len(seen) + 3 <= 0x10000 else np.uint32)
        self.codes[seen] = np.arange(len(seen)) + 3
        self.codes[[_PAD, _SPACE]] = _PAD, _SPACE
        states = suffix_automaton(self.codes[ids].tolist())
        begin = np.ones(width, np.int64)
        self.begin_rare = np.ones(self.n_rare, np.int32)
        for c, s in states[0].items():
            if c < width:
                begin[c] = 2 * s * width + 1
            else:
                self.begin_rare[c - width] = 2 * s * width + 1
        table = np.tile(begin, (len(states), 1))
        rare = []
        for k, to in enumerate(states[1:], 1):
            for c, s in to.items():
                if c < width:
                    table[k, c] = 2 * s * width
                else:
                    rare.append((k * self.n_rare + c - width, 2 * s * width))
        table[:, _PAD] = 2 * np.arange(len(states)) * width
        self.table = table.astype(np.int32).ravel()
        rare.sort()
        self.keys = np.array([*(k for k, _ in rare), 1 << 62], np.int64)
        self.values = np.array([*(v for _, v in rare), 0], np.int32)

    def count(self, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each column of steps its phrases, and its characters that the reference lacks."""
        coded = self.codes[steps]
        unknown = (coded == _OTHER).sum(0)
        some_rare = (coded >= self.width).any(1).tolist() if self.n_rare else [False] * len(coded)
        state, count = np.zeros(steps.shape[1], np.int32), np.zeros(steps.shape[1], np.int32)
        for codes, searched in zip(coded, some_rare, strict=True):
            entry = self.table[state + np.where(codes < self.width, codes, _OTHER)] if searched else self.table[state + codes]
            if searched:
                at = np.flatnonzero(codes >= self.width)
                code = codes[at].astype(np.int64) - self.width
                key = state[at] // self.width * self.n_rare + code
                place = np.searchsorted(self.keys, key)
                entry[at] = np.where(self.keys[place] == key, self.values[place], self.begin_rare[code])
            count += entry & 1
            state = entry >> 1
        return count, unknown


class Parser:
    """Counts longest-match phrases of texts against every reference at once."""

    def __init__(self, references: dict[str, str]):
        self.languages = sorted(references)
        texts = [normalised(references[x]) for x in self.languages]
        points = np.unique(np.concatenate(texts)) if texts else np.zeros(0, np.uint32)
        points = points[points != 0x20]
        self.places = np.zeros(0x110000, np.uint16 if len(points) + 3 <= 0x10000 else np.uint32)
        self.places[points] = np.arange(len(points)) + 3
        self.places[0x20] = _SPACE
        self.references = [Reference(self.places[t], len(points) + 3) for t in texts]
        self.bits = np.log2([max(2, len(t)) for t in texts])

    def _counts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(texts x languages) numbers of phrases and of characters that the reference lacks, and the numbers of normalised characters."""
        coded = [self.places[normalised(t)] for t in texts]
        sizes = np.fromiter(map(len, coded), np.int64, len(coded))
        blocks = -(-sizes // BLOCK)
        owner = np.repeat(np.arange(len(texts)), blocks)
        flat = np.full(int(blocks.sum()) * BLOCK, _PAD, self.places.dtype)
        at = (np.cumsum(blocks) - blocks) * BLOCK
        for start, codes in zip(at.tolist(), coded, strict=True):
            flat[start : start + len(codes)] = codes
        steps = np.ascontiguousarray(flat.reshape(-1, BLOCK).T)
        out, lacking = (np.zeros((len(texts), len(self.languages)), np.int64) for _ in range(2))
        for k, reference in enumerate(self.references):
            count, unknown = reference.count(steps)
            out[:, k] = np.bincount(owner, count, len(texts))
            lacking[:, k] = np.bincount(owner, unknown, len(texts))
        return out, lacking, sizes

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(texts x languages) numbers of phrases, and the numbers of normalised characters."""
        out, _, sizes = self._counts(texts)
        return out, sizes

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        counts, lacking, sizes = self._counts(texts)
        cost = (counts * self.bits + lacking * np.maximum(0, LITERAL_BITS - self.bits)) / np.maximum(sizes, 1)[:, None]
        best = cost.argmin(1)
        score = 1 / np.exp(-SHARPNESS * (cost - cost.min(1, keepdims=True))).sum(1)
        return [self.languages[k] for k in best], score


def references(docs: DataFrame) -> dict[str, str]:
    """Language to reference text, from documents outside the held-out fold that have a language and a letter."""
    known = docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang")).where(F.col("lang").isNotNull() & ~held_out("doc_id") & F.col("text").rlike(r"\p{L}"))
    keyed = known.select("lang", "text", F.xxhash64("text").alias("h"))
    n = keyed.select("lang").distinct().count()
    if not n:
        return {}
    per = min(REFERENCE_CHARS, max(LEAST_CHARS, ALL_CHARS // n))
    chosen = keyed.groupBy("lang", F.pmod("h", F.lit(SAMPLE_DOCS)).alias("b")).agg(F.min("h").alias("h")).select("lang", "h")
    # At most SAMPLE_DOCS rows a language on either side of the collect, of no more characters than its reference.
    picked = keyed.join(F.broadcast(chosen), ["lang", "h"]).groupBy("lang", "h").agg(F.max(F.substring("text", 1, min(SAMPLE_CHARS, per))).alias("text"))
    found: dict[str, list[str]] = {}
    for r in picked.orderBy("lang", "h").collect():
        found.setdefault(r["lang"], []).append(r["text"])
    return {lang: " ".join(t[: max(200, per // len(texts))] if len(texts) * SAMPLE_CHARS > per else t for t in texts)[:per] for lang, texts in found.items()}


def identify(docs: DataFrame, learned: dict[str, str] | None = None) -> DataFrame:
    """docs with lang_pred and score (0 to 1); columns of these names are replaced."""
    import regex

    model = Parser(references(docs) if learned is None else learned)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [f for f in docs.schema.fields if f.name not in ("lang_pred", "score")]
    schema = T.StructType([*kept, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    at_once = 1_500_000

    def predict(batches):
        parser, letter = shared.value, regex.compile(r"\p{L}")
        for batch in batches:
            texts = batch.column("text").to_pylist()
            langs, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
            rows = [k for k, t in enumerate(texts) if t and letter.search(t)] if parser.languages else []
            while rows:
                size, take = 0, 0
                while take < len(rows) and (not take or size + len(texts[rows[take]]) <= at_once):
                    size += len(texts[rows[take]])
                    take += 1
                now, rows = rows[:take], rows[take:]
                found, sure = parser.predict([texts[k] for k in now])
                for k, lang, s in zip(now, found, sure, strict=True):
                    langs[k], scores[k] = lang, s
            columns = [batch.column(f.name) for f in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(langs, pa.string()), pa.array(scores)], names=schema.names)

    return docs.select(*(f.name for f in kept)).mapInArrow(frugal(predict), schema)
