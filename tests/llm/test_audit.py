"""The filter audit against a plain count over all orders."""

from __future__ import annotations

import itertools
import re

import __spark_entry__
from latticework.llm import audit

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PROSE = " ".join(f"w{k % 130}" for k in range(220))
DOCS = [
    (1, PROSE, "en", 7), (2, PROSE, "en", 7), (2, PROSE, None, 7), (3, PROSE + " #", "de", 7), (4, "short", "en", 7), (5, "short", "", 7), (6, None, "de", 7), (7, "", "de", 7), (None, PROSE, "en", 7), (None, "only here", "fr", 7),
    (None, "only here", "fr", 7), (8, "a " * 400, "en", 7), (9, "ABC " * 300, "de", 7), (10, "ABC " * 300, "de", 7), (11, "\x1c".join("ab" * 300), "fr", 7), (0, "a " * 400, "fr", 7),
]
LABELS = [(1, 1, 0), (2, 1, 1), (2, 0, 0), (4, None, 1), (5, 1, None), (8, 1, 1), (None, 1, 1), (99, 1, 1)]
SCHEMA = "doc_id long, text string, lang string, mask long"


def brute(docs, labels):
    def fails(doc):
        doc_id, text, *_ = doc
        text = text or ""
        words = WORD.findall(text)
        ids = [d[0] for d in docs if (d[1] or "") == text and d[0] is not None]
        copy = bool(ids) and (doc_id is None or min(ids) < doc_id)
        return {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), "D": bool(re.search("[#$%&*|]", text)), "E": copy}

    rows = [(d[2] or "", fails(d), any(x[1] == 1 for x in labels if x[0] == d[0] is not None), any(x[2] == 1 for x in labels if x[0] == d[0] is not None)) for d in docs]
    orders = list(itertools.permutations("ABCDE"))
    out = []
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        removed_by = dict.fromkeys("ABCDE", 0)
        found = []
        for order in orders:
            left = own
            for step, x in enumerate(order, 1):
                gone = [r for r in left if r[1][x]]
                left = [r for r in left if not r[1][x]]
                removed_by[x] += len(gone)
                found.append((part, "".join(order), step, len(left), len(gone), sum(r[1][x] for r in own) - len(gone), sum(r[1][x] and sum(r[1].values()) == 1 for r in own), sum(r[2] for r in gone), sum(r[3] for r in gone), x))
        out += [(*f[:-1], removed_by[f[-1]]) for f in found]
    return sorted(out)


def test_audit(spark, tmp_path):
    docs = spark.createDataFrame(DOCS, SCHEMA).repartition(3)
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    got = sorted(map(tuple, audit.audit_filters(docs, labels).collect()))
    assert got == brute(DOCS, LABELS)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    assert sorted(map(tuple, __spark_entry__.queries()["op11_filter_audit"](spark, str(tmp_path)).collect())) == got


def test_collisions_and_blocks(spark):
    """All texts of one fingerprint are told apart, and blocks of a few texts give the same masks."""
    docs = spark.createDataFrame(DOCS, SCHEMA).repartition(4)

    def counted(**options):
        return sorted(map(str, audit.masks(docs, **options).groupBy("doc_id", "part", "mask").sum("n").collect()))

    assert counted(key_of=lambda data: 5, block_bytes=10) == counted()
    assert len(counted()) == len(set(counted()))


def test_empty(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.audit_filters(spark.createDataFrame([], SCHEMA), labels).count() == 0
    one = audit.audit_filters(spark.createDataFrame([("b", "x", None, 1)], "doc_id string, text string, lang string, mask long"), spark.createDataFrame([], "doc_id string, quality int, toxic int")).collect()
    assert len(one) == 600 and {r["part"] for r in one} == {""} and {r["kept"] for r in one if r["step"] == 5} == {0}
    two = audit.audit_filters(spark.createDataFrame(DOCS, SCHEMA), labels, {"X": audit.symbols, "Y": None}).collect()
    assert {(r["filter_order"], r["step"]) for r in two} == {("XY", 1), ("XY", 2), ("YX", 1), ("YX", 2)}
