"""Offset-mapped token counts (operator 8): tokens of whole documents attributed to their fields or sections.

Each document is encoded once; the character spans of its tokens are interval-joined to the spans of its sections by
binary search, and a token that crosses a boundary goes to one section by an explicit rule:
`largest` (the section holding most of its characters, the earlier on a tie), `start` (that of its first character) or
`end` (that of its last). Counts of a document's sections therefore add up to its tokens.

Sections are lines (each with its line feed) unless the documents bring a column `sections`, an array of structs
(start, end) in code points, in order and apart. Tokens in none of them are counted in a row with section -1.

Edge cases: a null or empty text has one empty section without tokens; a section without tokens has count 0; repeated
rows are counted each; very long texts are held one at a time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tokens import SpanEncoder

RULES = ("largest", "start", "end")
BATCH_ROWS = 20_000


def line_sections(text: str) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter((len(x) + 1 for x in text.split("\n")), np.int64)
    ends = np.cumsum(sizes)
    ends[-1] -= 1
    starts = ends - sizes
    starts[-1] += 1
    if len(sizes) > 1 and sizes[-1] == 1:  # the text ends with a line feed
        return starts[:-1], ends[:-1]
    return starts, ends


def attribute(spans: np.ndarray, starts: np.ndarray, ends: np.ndarray, rule: str = "largest") -> np.ndarray:
    """Index of the section of each token; -1 for none."""
    n = len(starts)
    if not n or not len(spans):
        return np.full(len(spans), -1)
    a, b = spans[:, 0], np.maximum(spans[:, 1], spans[:, 0] + 1)
    first = np.searchsorted(ends, a, "right")  # the first section that ends after the token's start
    last = np.searchsorted(starts, b - 1, "right") - 1  # the last that begins before its end
    touched = first <= last
    if rule == "start":
        return np.where(touched & (starts[np.minimum(first, n - 1)] <= a), first, -1)
    if rule == "end":
        return np.where(touched & (ends[np.maximum(last, 0)] >= b), last, -1)
    out = np.where(touched, first, -1)
    for k in np.flatnonzero(touched & (first < last)):
        held = np.arange(first[k], last[k] + 1)
        overlap = np.minimum(ends[held], b[k]) - np.maximum(starts[held], a[k])
        out[k] = held[overlap.argmax()]
    return out


def count_tokens(docs: DataFrame, path: str, pattern: str, rule: str = "largest") -> DataFrame:
    """doc_id, section, start, n_chars, n_tokens for every section of every document."""
    if rule not in RULES:
        raise ValueError(f"rule is one of {', '.join(RULES)}")
    given = "sections" in docs.columns
    schema = T.StructType([docs.schema["doc_id"], *T.StructType.fromDDL("section int, start long, n_chars long, n_tokens long").fields])

    def out(ids, rows, columns):
        section, start, size, tokens = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in zip(*columns, strict=True))
        return pa.RecordBatch.from_arrays([ids.take(pa.array(rows, pa.int64())), pa.array(section.astype(np.int32)), *(pa.array(x.astype(np.int64)) for x in (start, size, tokens))], names=schema.names)

    def count(batches):
        encoder = SpanEncoder(path, pattern)
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text").to_pylist()
            bounds = batch.column("sections").to_pylist() if given else None
            rows, columns = [], []
            for row, text in enumerate(texts):
                text = text or ""
                if given:
                    parts = np.array([(s["start"], s["end"]) for s in bounds[row] or ()], np.int64).reshape(-1, 2)
                    starts, ends = parts[:, 0], parts[:, 1]
                else:
                    starts, ends = line_sections(text)
                at = attribute(encoder.spans(text), starts, ends, rule)
                counts = np.bincount(at + 1, minlength=len(starts) + 1)
                numbers, sizes = np.arange(len(starts)), ends - starts
                if counts[0]:
                    numbers, starts, sizes, counts = np.append(numbers, -1), np.append(starts, 0), np.append(sizes, 0), np.append(counts[1:], counts[0])
                else:
                    counts = counts[1:]
                rows += [row] * len(numbers)
                columns.append((numbers, starts, sizes, counts))
                if len(rows) >= BATCH_ROWS:
                    yield out(ids, rows, columns)
                    rows, columns = [], []
            if rows:
                yield out(ids, rows, columns)

    return docs.select("doc_id", F.col("text").cast("string").alias("text"), *["sections"] * given).mapInArrow(count, schema)
