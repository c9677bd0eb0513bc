"""The pipeline's stages, each held against brute force on its own input."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from latticework.llm import fingerprints

from .test_operators import near_components, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def rows():
    base, passage = prose(1, 150), prose(2, 60)
    near = base.split()
    near[70] = "changed"
    texts = [base, base, " ".join(near), prose(3, 80) + " " + passage, passage + "\n" + prose(4, 90), None, "", "12 34 %%", prose(5, 3000), passage]
    return [(k, t, "en" if k % 2 else None, f"s{k % 2}", len(t or "")) for k, t in enumerate(texts)]


def test_stages(spark, tmp_path):
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(rows(), "doc_id long, text string, lang string, source string, n_chars long").write.parquet(path)
    docs, seen = spark.read.parquet(path), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [tuple(r) for r in docs.select(*COLUMNS).collect()]
        out = stage(spark, docs, str(tmp_path))
        assert k == len(corpus_pipeline.STAGES) - 1 or out.columns == COLUMNS
        out.write.parquet(str(tmp_path / f"{k}.parquet"))
        docs = spark.read.parquet(str(tmp_path / f"{k}.parquet"))
        seen[name] = before, docs.collect()
    before, after = seen["language_id"]
    assert {r["doc_id"] for r in after} == {r[0] for r in before if any(map(str.isalpha, r[1] or ""))}
    before, after = seen["near_duplicates"]
    names = {doc: name for doc, _, name in near_components([(r[0], r[1]) for r in before], 5, 80)}
    assert {r["doc_id"] for r in after} == set(names.values()) and len(after) == len(set(names.values()))
    before, after = seen["repeated_passages"]
    first = {}
    for doc, text, *_ in sorted(before):
        words = WORD.findall(text)
        for k in range(len(words) - 12):
            first.setdefault(tuple(words[k : k + 13]), doc)
    kept = {r["doc_id"]: WORD.findall(r["text"]) for r in after}
    for doc, text, *_ in before:
        words = WORD.findall(text)
        gone = {k + d for k in range(len(words) - 12) if first[tuple(words[k : k + 13])] < doc for d in range(13)}
        left = [w for k, w in enumerate(words) if k not in gone]
        assert kept.get(doc, []) == left
    assert all(r["n_chars"] == len(r["text"]) for r in after)
    before, after = seen["source_mix"]
    sizes, taken = Counter(), Counter()
    for r in before:
        sizes[r[3]] += len(WORD.findall(r[1]))
    for r in after:
        taken[r["source"]] += len(WORD.findall(r["text"]))
    assert abs(sum(taken.values()) - 1.5 * sum(sizes.values())) <= len(sizes) and all(taken[s] <= 2 * sizes[s] for s in sizes)
    before, after = seen["pack_sequences"]
    room = Counter()
    for r in after:
        room[r["sequence_id"]] += r["length"]
    assert max(room.values()) <= 4096 and {r["doc_id"] for r in after} == {r[0] for r in before}


def test_registered(spark):
    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))


def test_densification(spark):
    """Every way to fill a bin finds the first full bin on its walk."""
    starts, steps, inverses = fingerprints._permutations()
    assert all((s * i) % fingerprints.BINS == 1 for s, i in zip(steps, inverses, strict=True))
    rng = np.random.default_rng(1)
    cases = []
    for full in (0, 1, 5, 31, 32, 40, 200, 256):
        values = [None] * fingerprints.BINS
        for b in rng.choice(fingerprints.BINS, full, replace=False):
            values[b] = int(rng.integers(0, 1 << 40))
        cases.append(values)
    got = spark.createDataFrame([(k, c) for k, c in enumerate(cases)], "k int, m array<long>").select("k", fingerprints.densified(F.col("m")).alias("d")).collect()
    for r in got:
        values = cases[r["k"]]
        want = []
        for i in range(fingerprints.BINS if any(v is not None for v in values) else 0):
            at = next(b for j in range(-1, fingerprints.BINS) for b in [i if j < 0 else (starts[i] + j * steps[i]) % fingerprints.BINS] if values[b] is not None)
            want.append(values[at] & 255)
        assert r["d"] == want
