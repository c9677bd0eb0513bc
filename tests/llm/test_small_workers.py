"""What workers hold: batches bounded by their bytes in every stage, and nothing kept when a task has ended."""

from __future__ import annotations

import pyarrow as pa
import pytest

import corpus_pipeline
from latticework.llm import shingles


@pytest.mark.parametrize("stage", [corpus_pipeline.language_id, corpus_pipeline.repeated_passages])
def test_batches_of_a_stage_are_small(spark, tmp_path, stage):
    """Whoever calls a stage writes its result, so the bound must hold after the call."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    rows = [(k, f"word{k} " * 700, "en", "s", 6000) for k in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1)
    try:
        stage(spark, docs.limit(5), str(tmp_path))
        sizes = docs.select("text").mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows], "size": [b.nbytes]}) for b in batches), "n long, size long").collect()
    finally:
        spark.conf.set(key, before)
    assert sum(r["n"] for r in sizes) == len(rows) and max(r["size"] for r in sizes) < 6 << 20


def test_a_task_hands_back_what_it_freed(monkeypatch):
    seen = []
    monkeypatch.setattr(shingles, "released", lambda: seen.append("released"))

    def run(batches):
        for b in batches:
            yield 2 * b
        seen.append("ended")

    assert list(shingles.frugal(run)([1, 2])) == [2, 4] and seen == ["ended", "released"]
