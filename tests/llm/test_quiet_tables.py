"""Tables in which nothing repeats, and ids of other types."""

from __future__ import annotations

import hashlib

import corpus_pipeline
from latticework.llm import substrings

from .test_operators import prose

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, texts):
    return spark.createDataFrame([(k, t, "en", "a", len(t or "")) for k, t in enumerate(texts)], SCHEMA)


def test_substrings_without_a_repeat(spark):
    for texts in ([" ".join(f"a{k}" for k in range(40)), " ".join(f"b{k}" for k in range(40))], [prose(1, 300)], ["a b", None, ""]):
        got = substrings.dedup_substrings(table(spark, texts)).orderBy("doc_id").collect()
        assert [r["n_removed"] for r in got] == [0] * len(texts) and [r["text"] or "" for r in got] == [t or "" for t in texts]
        assert [r["kept_sha256"] for r in got] == [hashlib.sha256(" ".join((t or "").split()).encode()).hexdigest() for t in texts]


def test_substrings_on_their_own_output(spark):
    passage = prose(2, 60)
    texts = [prose(1, 80) + " " + passage, passage + " " + prose(3, 50), prose(4, 30)]
    once = substrings.dedup_substrings(table(spark, texts))
    again = substrings.dedup_substrings(once)
    assert again.agg({"n_removed": "sum"}).first()[0] == 0 and again.columns == once.columns
    assert sorted(r["text"] for r in again.collect()) == sorted(r["text"] for r in once.collect())


def test_substrings_with_text_ids_and_clashing_columns(spark):
    passage = prose(2, 30)
    rows = [("b", passage + " end", 1, 2, 3), ("a", "start " + passage, 1, 2, 3), (None, passage, 1, 2, 3), ("c", None, 1, 2, 3)]
    got = substrings.dedup_substrings(spark.createDataFrame(rows, "doc_id string, text string, row int, ord int, places int"))
    assert {r["doc_id"]: r["n_removed"] for r in got.collect()} == {"a": 0, "b": 30, None: 30, "c": 0}
    assert got.columns[:4] == ["doc_id", "row", "ord", "places"]


def test_pipeline_on_clean_and_empty_tables(spark, tmp_path):
    for k, texts in enumerate(([prose(10 + k, 60) for k in range(4)], [])):
        path = str(tmp_path / f"{k}")
        table(spark, texts).write.parquet(f"{path}/documents.parquet")
        out = corpus_pipeline.run(spark, path).collect()
        assert bool(out) == bool(texts) and all(r["length"] > 0 for r in out)
