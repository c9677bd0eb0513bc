"""Toxicity (operator 7): a lexicon learned from labels, matched through Levenshtein automata, weighed by context.

The lexicon is learned from a bounded sample of labelled documents: words, and beginnings of words (stems), that are
far more frequent in toxic documents. It is held as a trie. Each word of a text is a Levenshtein automaton, run as bit
masks, whose intersection with the trie yields exact terms, stems and misspelled terms; a worker remembers the outcome
of words it has met. A window around each match tells a quotation or report from abuse. Sums of the matches go into a
logistic regression fitted to the same sample, in which each class weighs as much as it does among all labelled
documents outside the held-out fold, so that scores do not depend on which class the bound of the sample cuts.

Edge cases: null and empty texts get the score of a text without any match; labels that are null, or of ids without a
document, are ignored; an id that is labelled more than once counts as toxic if any label says so; without both
classes in the sample every score is the share of toxic labels (0 without labels). Repeated rows are scored each.
"""

from __future__ import annotations

import re
from functools import reduce
from math import log
from operator import or_

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import held_out, materialize
from .tokens import _Remembered

#: Bounds of the sample (documents of each class) and of the lexicon.
SAMPLE_DOCS = 3000
LEXICON_SIZE = 300
LEAST_DOCS, LEAST_LOG_ODDS = 4, 2.5
STEM_LENGTHS = range(4, 9)
#: Letters from which one typing error is forgiven.
LEAST_FUZZY = 5
#: A misspelled term counts for less; a term whose misspellings occur in more than this share of clean documents is
#: only looked for as it is spelled.
FUZZY_WEIGHT, MAX_FUZZY_SHARE = 0.7, 0.002
WINDOW = 60
THRESHOLD = 0.3

# Opening and closing quotation marks, and words that report what others said.
QUOTES = {"“": "”", "«": "»", "„": "“", "‘": "’", '"': '"'}
REPORTING = ("said", "says", "wrote", "called", "quoted", "quote", "quoting", "word", "term", "insult", "slur")

_WORD = re.compile(r"[^\W_]+")
_REPORT = re.compile(rf"\b(?:{'|'.join(REPORTING)})\b")


class Lexicon:
    """A trie of terms (whole words) and stems (beginnings of words) with their weights.

    families: words that a stem stands for, with their weights; their misspellings count as those of terms do.
    """

    def __init__(self, terms: dict[str, float], stems: dict[str, float], families: dict[str, float] | None = None):
        self.terms, self.root = terms, {}
        self.spelled = {**(families or {}), **terms}
        for words, slot in ((terms, "term"), (stems, "stem")):
            for word, weight in words.items():
                self._put(self.root, word, slot, weight)
        self.forgive(set(self.spelled))

    @staticmethod
    def _put(node: dict, word: str, slot: str, weight: float) -> None:
        for c in word:
            node = node.setdefault(c, {})
        node[slot] = weight

    def forgive(self, words: set[str]) -> None:
        """Terms and words of stems whose misspellings count; the others are only looked for as they are spelled."""
        self.forgiven: dict = {}
        words = {w for w in words if len(w) >= LEAST_FUZZY}
        for word in words:
            self._put(self.forgiven, word, "term", self.spelled[word])
        # One error leaves the first two letters of a term or its last two as they are.
        self.begins, self.ends = {w[:2] for w in words}, {w[-2:] for w in words}
        self.lengths = range(max(LEAST_FUZZY, min(map(len, words), default=0) - 1), max(map(len, words), default=-2) + 2)

    def find(self, word: str) -> tuple[float, bool, str] | None:
        """(weight, exact, term) of the best match of a word, or None."""
        node, stem = self.root, None
        for c in word:
            node = node.get(c)
            if node is None:
                break
            stem = node.get("stem", stem)
        if node is not None and "term" in node:
            return node["term"], True, word
        if stem is not None:
            return stem, True, word
        if len(word) not in self.lengths or word[:2] not in self.begins and word[-2:] not in self.ends:
            return None
        found = self._within_one(word)
        return None if found is None else (found[0], False, found[1])

    def _within_one(self, word: str) -> tuple[float, str] | None:
        """The weightiest term at Levenshtein distance 1: the word's automaton, as bit masks of the positions
        reached with no and with one error, walked along the trie."""
        masks: dict[str, int] = {}
        for k, c in enumerate(word):
            masks[c] = masks.get(c, 0) | 1 << k
        done, best = 1 << len(word), None
        stack = [(self.forgiven, 1, 0b11, "")]
        while stack:
            node, none, one, term = stack.pop()
            if "term" in node and (none | one) & done and (best is None or (node["term"], term) > best):
                best = node["term"], term
            for c, child in node.items():
                if len(c) == 1:
                    mask = masks.get(c, 0)
                    exact = (none & mask) << 1
                    wrong = (one & mask) << 1 | none | none << 1 | exact << 1
                    if exact | wrong:
                        stack.append((child, exact, wrong, term + c))
        return best


def is_quoted(text: str, start: int, end: int) -> bool:
    """Whether the match stands between quotation marks, or after a reporting word, within WINDOW characters."""
    before, after = text[max(0, start - WINDOW) : start], text[end : end + WINDOW]
    before, after = before[before.rfind("\n") + 1 :], after.split("\n", 1)[0]
    for opening, closing in QUOTES.items():
        if opening == closing:
            if before.count(opening) % 2 and closing in after:
                return True
        elif before.rfind(opening) > before.rfind(closing) and closing in after:
            return True
    return bool(_REPORT.search(before[-30:]))


def features(text: str | None, known: _Remembered) -> list[float]:
    """Sums of the weights of matches and of quoted matches, and matches for each hundred words."""
    lowered = (text or "").lower()
    words = _WORD.findall(lowered)
    if not any(map(known.__getitem__, words)):
        return [0.0, 0.0, 0.0]
    sums = [0.0, 0.0]
    n = 0
    for m in _WORD.finditer(lowered):
        if hit := known[m[0]]:
            weight, exact, _ = hit
            quoted = is_quoted(lowered, m.start(), m.end())
            sums[quoted] += weight if exact else FUZZY_WEIGHT * weight
            n += not quoted
    return [*np.log1p(sums).tolist(), min(5.0, 100 * n / len(words))]


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30, weights: np.ndarray | None = None) -> np.ndarray:
    """Coefficients (the intercept first) by Newton's method with a ridge on all but the intercept; weights: of the rows, 1 by default."""
    a = np.column_stack([np.ones(len(x)), x])
    w = np.ones(len(x)) if weights is None else weights
    beta, penalty = np.zeros(a.shape[1]), ridge * np.diag([1e-6, *np.ones(x.shape[1])])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        hessian = (a * (w * p * (1 - p))[:, None]).T @ a + penalty
        step = np.linalg.solve(hessian, a.T @ (w * (y - p)) - penalty @ beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, toxic of all labelled documents with a text outside the held-out fold."""
    marks = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out("doc_id")).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    return marks.join(docs.where(F.col("text").isNotNull()).select("doc_id"), "doc_id", "left_semi")


def labelled_sample(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """At most SAMPLE_DOCS labelled documents of each class: text, toxic."""
    order = F.xxhash64("doc_id")
    chosen = marks.where("toxic = 1").orderBy(order).limit(SAMPLE_DOCS).unionByName(marks.where("toxic = 0").orderBy(order).limit(SAMPLE_DOCS))
    return docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(chosen), "doc_id").select("text", "toxic")


def class_weights(toxic: np.ndarray, counts: dict[int, int]) -> np.ndarray:
    """Weights of the sample's rows, 1 on average, that give each class its share of all labelled documents."""
    n = np.bincount(toxic, minlength=2)
    share = np.array([counts[0], counts[1]]) / (counts[0] + counts[1])
    return (share * len(toxic) / n)[toxic]


def families(sample: DataFrame, stems: dict[str, float]) -> dict[str, float]:
    """Words of LEAST_FUZZY letters or more that begin with a stem, in LEAST_DOCS toxic documents or more, with the stem's weight."""
    if not stems:
        return {}
    words = F.array_distinct(F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) >= LEAST_FUZZY))
    of = {n: [x for x in stems if len(x) == n] for n in sorted({len(x) for x in stems}, reverse=True)}
    begun = sample.where("toxic = 1").select(F.explode(words).alias("word")).where(reduce(or_, (F.substring("word", 1, n).isin(x) for n, x in of.items())))
    counted = begun.groupBy("word").count().where(F.col("count") >= LEAST_DOCS).collect()  # bounded by the sample
    return {w: next(stems[w[:n]] for n in of if w[:n] in stems) for w in (r["word"] for r in counted)}


def learn_lexicon(sample: DataFrame, n_toxic: int, n_clean: int) -> Lexicon:
    words = F.array_distinct(F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) >= 3))
    terms = sample.select("toxic", F.explode(words).alias("word"))
    stems = F.array_distinct(F.flatten(F.array(*(F.transform(F.filter("words", lambda w, n=n: F.length(w) > n), lambda w, n=n: F.substring(w, 1, n)) for n in STEM_LENGTHS))))
    stems = sample.select("toxic", words.alias("words")).select("toxic", F.explode(stems).alias("word"))

    def weighed(rows: DataFrame) -> DataFrame:
        counted = rows.groupBy("word").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c"))
        odds = F.log((F.col("t") + 0.5) / (n_toxic + 1)) - F.log((F.col("c") + 0.5) / (n_clean + 1))
        return counted.withColumn("odds", odds).where((F.col("t") >= LEAST_DOCS) & (F.col("odds") >= LEAST_LOG_ODDS)).orderBy(F.desc(F.col("t") * F.col("odds")), "word").limit(4 * LEXICON_SIZE)

    found_terms = [(r["word"], r["t"], r["odds"]) for r in weighed(terms).collect()]
    found_stems = [(r["word"], r["t"], r["odds"]) for r in weighed(stems).collect()]
    whole, begins = {}, {}
    counts = {w: t for w, t, _ in found_terms}
    ranked = sorted([(-t * o, len(w), w, o, t, False) for w, t, o in found_terms] + [(-t * o, len(w), w, o, t, True) for w, t, o in found_stems])
    for _, _, word, odds, t, stem in ranked:
        if len(whole) + len(begins) >= LEXICON_SIZE:
            break
        if any(word.startswith(s) for s in begins):
            continue
        if stem:
            # a stem is worth keeping if it stands for more documents than each word that it begins
            if any(w.startswith(word) and n >= 0.8 * t for w, n in counts.items()):
                continue
            begins[word] = odds
        else:
            whole[word] = odds
    return Lexicon(whole, begins, families(sample, begins))


def train(docs: DataFrame, labels: DataFrame) -> tuple[Lexicon, np.ndarray]:
    marks = materialize(labelled(docs, labels), "labelled")
    counts = {r["toxic"]: r["count"] for r in marks.groupBy("toxic").count().collect()}
    sample = labelled_sample(docs, marks).cache()
    n_toxic, n_all = sample.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.count("*")).first()
    if not n_toxic or n_toxic == n_all:
        share = n_toxic / n_all if n_all else 0.0
        sample.unpersist()
        return Lexicon({}, {}), np.array([log(max(share, 1e-6) / max(1 - share, 1e-6)), 0.0, 0.0, 0.0])
    lexicon = learn_lexicon(sample, n_toxic, n_all - n_toxic)

    def misspelled(batches):
        known = _Remembered(lexicon.find)
        for pdf in batches:
            terms = [hit[2] for t in pdf["text"] for hit in {known[w] for w in _WORD.findall(t.lower())} if hit and not hit[1]]
            yield pd.DataFrame({"term": pd.Series(terms, dtype=object)})

    found = sample.where("toxic = 0").mapInPandas(misspelled, "term string").groupBy("term").count().collect()  # at most the lexicon and its families
    lexicon.forgive(set(lexicon.spelled) - {r["term"] for r in found if r["count"] > max(1, MAX_FUZZY_SHARE * (n_all - n_toxic))})

    def measure(batches):
        known = _Remembered(lexicon.find)
        for pdf in batches:
            rows = [features(t, known) for t in pdf["text"]]
            yield pd.DataFrame(rows, columns=list("abc")).assign(toxic=pdf["toxic"].to_numpy())

    pdf = sample.mapInPandas(measure, "a double, b double, c double, toxic int").toPandas()  # bounded by the sample
    sample.unpersist()
    toxic = pdf["toxic"].to_numpy(int)
    return lexicon, fit_logistic(pdf[list("abc")].to_numpy(), toxic.astype(float), weights=class_weights(toxic, counts))


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs with score (0 to 1) and predicted (0 or 1); columns of these names are replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    kept = [f for f in docs.schema.fields if f.name not in ("score", "predicted")]
    schema = T.StructType([*kept, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def predict(batches):
        lexicon, beta = shared.value
        known = _Remembered(lexicon.find)
        for batch in batches:
            x = np.array([features(t, known) for t in batch.column("text").to_pylist()]).reshape(-1, 3)
            score = 1 / (1 + np.exp(-(beta[0] + x @ beta[1:])))
            columns = [batch.column(f.name) for f in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=schema.names)

    return docs.select(*(f.name for f in kept)).mapInArrow(predict, schema)
