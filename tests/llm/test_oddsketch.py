"""Odd sketches: the estimate against true similarities, bands, and near duplicates against brute force."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from latticework.llm import jaccard, oddsketch
from latticework.llm.oddsketch import BITS

from .test_operators import SCHEMA, documents, near_components, prose, row


def pair(rng, n: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Two sets of n tokens with this similarity or a little more."""
    both = int(np.ceil(2 * n * similarity / (1 + similarity)))
    tokens = rng.integers(1, 1 << 63, 2 * n - both).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    return tokens[:n], tokens[n - both :]


@pytest.mark.parametrize("n", [13, 60, 3000])
def test_estimates_and_bands(n):
    rng, sketcher = np.random.default_rng(n), oddsketch.Sketcher(85)
    errors, shared, within = [], 0, 0
    for _ in range(150):
        a, b = pair(rng, n, 0.85)
        both = len(np.intersect1d(a, b))
        x, y = sketcher.samples(a), sketcher.samples(b)
        p, q = sketcher.sketch(x), sketcher.sketch(y)
        assert len(p) * 8 == BITS and sketcher.sketch(sketcher.samples(a[::-1])) == p
        errors.append(oddsketch.likeness(p, q) - both / (2 * n - both))
        shared += bool((sketcher.bands(x) == sketcher.bands(y)).any())
        within += (int.from_bytes(p, "big") ^ int.from_bytes(q, "big")).bit_count() <= oddsketch.most_flips(85)
    assert shared == within == 150
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.04
    assert oddsketch.likeness(p, p) == 1.0


def test_parameters():
    for percent in (60, 75, 80, 85, 90, 95):
        r = oddsketch.band_rows(percent)
        assert r == 1 or (1 - (percent / 100) ** r) ** (oddsketch.BANDED // r) <= oddsketch.MISS
    assert oddsketch.most_flips(100) == 0 and oddsketch.most_flips(80) > oddsketch.most_flips(90)


def test_near_duplicates(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = documents()
    base = prose(30, 120).split()
    for k in range(60):  # copies of one text with more and more words changed, and chains of them
        words = list(base)
        for at in rng.choice(len(words), k // 6, replace=False):
            words[at] = f"x{k}{at}"
        rows.append(row(100 + k, " ".join(words)))
    short = [row(300 + k, " ".join(w for w in "a b c d e f g h".split() if w != "abcdefgh"[k])) for k in range(8)]
    rows += short + [row(400, "a b c d e f g h"), row(401, "A B C D E F G H")]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = oddsketch.near_duplicates(docs).collect()
    key = lambda r: tuple(str(x) for x in r)
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == near_components([(r[0], r[1]) for r in rows], 3, 85)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    again = __spark_entry__.queries()["op12_odd_sketches"](spark, str(tmp_path)).collect()
    assert sorted(map(key, again)) == sorted(map(key, got))
    assert oddsketch.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_large_buckets(spark, monkeypatch):
    """Buckets that are salted and cut into cells give the same components."""
    rng, rows = np.random.default_rng(7), []
    for g in range(3):
        base = prose(40 + g, 80).split()
        for k in range(25):
            words = list(base)
            for at in rng.choice(len(words), 5, replace=False):
                words[at] = f"y{g}{k}{at}"
            rows.append(row(1000 * g + k, " ".join(words)))
    monkeypatch.setattr(oddsketch, "CELL", 2)
    monkeypatch.setattr(jaccard, "CELL", 2)
    monkeypatch.setattr(jaccard, "_neighbours", lambda sets, *_: sets.select(F.col("sid").alias("a"), F.col("sid").alias("b")).limit(0))
    got = oddsketch.near_duplicates(spark.createDataFrame(rows, SCHEMA), percent=60).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == near_components([(r[0], r[1]) for r in rows], 3, 60)
