"""Every name that an operator uses inside may be a column of its input."""

from __future__ import annotations

import ast
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from latticework.llm import audit, conversations, fingerprints, jaccard, langid, mixing, oddsketch, packing, quality, queries, substrings, toxicity, wrappers

from .test_operators import documents

PACKAGE = Path(wrappers.__file__).parent


def names_in(module) -> list[str]:
    """All strings of a module that could name a column."""
    files = [Path(module.__file__), PACKAGE / "common.py", PACKAGE.parent / "plans" / "ordering.py"]
    found = {n.value for f in files for n in ast.walk(ast.parse(f.read_text())) if isinstance(n, ast.Constant) and isinstance(n.value, str)}
    return sorted({x.lower() for x in found if x.isidentifier() and len(x) < 30})


OPERATORS = {
    "op1": (langid, lambda d, s: langid.identify(d, {"en": "bank den fin"})), "op2": (mixing, lambda d, s: mixing.mix_sources(d)),
    "op3": (fingerprints, lambda d, s: fingerprints.fingerprint_edits(d)), "op4": (wrappers, lambda d, s: wrappers.extract_pages(d)),
    "op5": (packing, lambda d, s: packing.pack(d, queries.tokenizer_path("word_bpe_49k.json"))), "op6": (quality, lambda d, s: quality.judge(d)),
    "op7": (toxicity, lambda d, s: toxicity.score_toxicity(d, s.createDataFrame([(k, 1, k % 2) for k in range(16)], "doc_id long, quality int, toxic int"))),
    "op9": (substrings, lambda d, s: substrings.dedup_substrings(d)), "op10": (jaccard, lambda d, s: jaccard.join_near(d)),
    "op11": (audit, lambda d, s: audit.audit_filters(d, s.createDataFrame([(1, 1, 1)], "doc_id long, quality int, toxic int"))), "op12": (oddsketch, lambda d, s: oddsketch.near_duplicates(d)),
    "op13": (conversations, lambda d, s: conversations.repair_damaged(d)),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_clashing_columns(spark, name):
    module, operator = OPERATORS[name]
    base = [(r[0], r[1], r[2], r[3]) for r in documents() if r[0] != 14]
    schema = "doc_id long, text string, lang string, source string"
    if name == "op4":
        base, schema = [(k, f"https://h{k % 2}.example/{k}", f"<p>same</p><p>text {k}</p>", "x") for k in range(8)], "page_id long, url string, html string, more string"
    if name == "op13":
        base, schema = [(k % 3, k, ("user", "assistant")[k % 2], "Yes.") for k in range(20)], "conv_id long, turn long, role string, text string"
    plain = spark.createDataFrame(base, schema)
    extra = [n for n in names_in(module) if n not in plain.columns and not (name == "op2" and n == "size") and not (name == "op7" and n == "held_out")]
    assert any(n.startswith("_") for n in extra) or name in ("op9", "op11")
    wide = plain.select("*", *(F.lit(f"mine {n}").alias(n) for n in extra))
    want, got = operator(plain, spark), operator(wide, spark)
    assert set(want.columns) <= set(got.columns)
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(key, got.select(*want.columns).collect())) == sorted(map(key, want.collect()))
    for n in set(extra) & set(got.columns) - set(want.columns):
        assert {r[0] for r in got.select(n).distinct().collect()} == {f"mine {n}"}
