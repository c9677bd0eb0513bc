"""Queries without SQL held against plain Python: language ID, quality, toxicity and token counts of whole tables."""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from latticework.llm import attribution, langid, quality, queries, toxicity

from .test_operators import WORD, edit, prose

DOCUMENTS = "doc_id long, text string, lang string, source string"


def is_held_out(doc_id) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 4 == 2


def written(spark, folder, rows, labels=()):
    spark.createDataFrame(rows, DOCUMENTS).write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id long, toxic int, quality int").write.mode("overwrite").parquet(f"{folder}/labels.parquet")
    return str(folder)


# Language ID


def cross_parse(text, learned):
    """(language, score) by greedy longest matches within blocks."""

    def plain(t):
        return re.sub(r"[\W\d_]+", " ", t.lower())

    points = plain(text)
    costs = {}
    for lang, reference in learned.items():
        known = plain(reference)
        bits = math.log2(max(2, len(known)))
        n = 0
        for at in range(0, len(points), langid.BLOCK):
            block = points[at : at + langid.BLOCK]
            k = 0
            while k < len(block):
                end = k
                while end < len(block) and block[k : end + 1] in known:
                    end += 1
                k, n = max(end, k + 1), n + 1
        lacking = sum(c not in known for c in points)
        costs[lang] = (n * bits + lacking * max(0.0, langid.LITERAL_BITS - bits)) / len(points)
    best = min(costs, key=lambda x: (costs[x], x))
    return best, 1 / sum(math.exp(-langid.SHARPNESS * (c - costs[best])) for c in costs.values())


def test_language_id_query(spark, tmp_path):
    words = {"aa": "ola merin tasu keppo dinar", "bb": "schag ürtel quamb frotz ölig", "cc": "тома рекин лопа змей дунь"}

    def text(lang, seed, n):
        return " ".join(np.random.default_rng(seed).choice(words[lang].split(), n))

    rows = [(k, text(lang, k, 40 + 31 * (k % 9)), lang, "s") for k in range(60) for lang in [("aa", "bb", "cc")[k % 3]]]
    rows += [(100, text("aa", 1, 3000) + " 12 " + text("bb", 2, 900), None, "s"), (101, None, "aa", "s"), (102, "12 !? 7", "bb", "s"), (103, "x", None, "s"), (None, text("cc", 5, 300), "cc", "s"), (7, rows[7][1], "bb", "s")]
    only_held_out = [(k, text("cc", k, 50), "dd", "s") for k in range(200, 400) if is_held_out(k)]
    rows += only_held_out
    learned = langid.references(spark.createDataFrame(rows, DOCUMENTS))
    assert set(learned) == {"aa", "bb", "cc"}
    got = queries.op1_language_id(spark, written(spark, tmp_path / "a", rows)).collect()
    wanted = defaultdict(list)
    for doc_id, t, *_ in rows:
        wanted[doc_id].append(cross_parse(t, learned) if t and any(map(str.isalpha, t)) else ("und", 0.0))
    assert len(got) == len(rows)
    for r in got:
        assert r["held_out"] == is_held_out(r["doc_id"])
        assert any(r["lang_pred"] == lang and abs(r["score"] - score) < 1e-9 for lang, score in wanted[r["doc_id"]])
    # whatever language the held-out rows are said to have, all predictions stay
    changed = [(i, t, "zz" if is_held_out(i) else lang, s) for i, t, lang, s in rows]
    again = queries.op1_language_id(spark, written(spark, tmp_path / "b", changed)).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))


# Quality


def character_class(c):
    if c in " \t\n\x0b\x0c\r":
        return "space"
    if c in ".,;:?'\"()-":
        return "stop"
    kind = unicodedata.category(c)
    if kind in ("Ll", "Lo", "Lm"):
        return "lower"
    return "upper" if kind in ("Lu", "Lt") else "digit" if kind[0] == "N" else "mark" if kind[0] == "M" else "other"


def divergence(p, q):
    p, q = np.array(p, float), np.array(q, float)
    p = p / p.sum()
    m = (p + q) / 2
    return math.sqrt(max(0.0, sum(a * math.log2(a / c) for side in (p, q) for a, c in zip(side, m, strict=True) if a) / 2))


def judged(rows):
    """For each row (class_distance, word_distance, base_failed, kept)."""
    chars, words = defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, _ in rows:
        for key in {lang, None}:
            chars[key].update(map(character_class, text or ""))
        if lang is not None:
            words[lang].update(WORD.findall(text or ""))
    for _, text, lang, _ in rows:
        found = WORD.findall(text or "")
        of = Counter(map(character_class, text or ""))
        reference = chars[lang]
        total = reference.total()
        by_class = divergence([of[c] for c in quality.CLASS_NAMES], [reference[c] / total for c in quality.CLASS_NAMES]) if of.total() >= quality.MIN_CHARS else None
        by_word = None
        if lang is not None and len(found) >= quality.MIN_WORDS_COMPARED:
            total = words[lang].total()
            common = sorted((w for w, n in words[lang].items() if n / total >= quality.LEAST_SHARE), key=lambda w: (-words[lang][w], w))[: quality.COMMON_WORDS]
            n = Counter(found)
            cells = [n[w] for w in common]
            shares = [words[lang][w] / total for w in common]
            by_word = divergence([len(found) - sum(cells), *cells], [1 - sum(shares), *shares])
        triples = Counter(zip(found, found[1:], found[2:], strict=False))
        covered = {k + d for k in range(len(found) - 2) if triples[tuple(found[k : k + 3])] > 1 for d in range(3)}
        failed = len(found) < quality.MIN_WORDS or 100 * len(covered) > quality.MAX_REPEAT_PERCENT * len(found)
        yield by_class, by_word, failed, not failed and (by_class or 0) <= quality.MAX_CLASS_DISTANCE and (by_word or 0) <= quality.MAX_WORD_DISTANCE


def test_quality_query(spark, tmp_path):
    rng = np.random.default_rng(0)
    common = {"en": "the of and to in is".split(), "de": "der die und in zu".split()}

    def text(seed, lang, n, share=0.4):
        r = np.random.default_rng(seed)
        return " ".join(r.choice(common[lang]) if r.random() < share else w for w in prose(seed, n).split())

    rows = [(k, text(k, "en" if k % 3 else "de", int(rng.integers(40, 260))), "en" if k % 3 else "de", "s") for k in range(60)]
    symbols = " ".join(f"#{w}$|&" for w in prose(1, 120).split())
    rows += [
        (70, symbols, "en", "s"), (71, text(3, "de", 200), "en", "s"), (72, text(5, "en", 30).upper() * 6, "en", "s"), (73, prose(9, 200).upper(), "de", "s"), (74, " ".join(["the"] * 90), "en", "s"), (75, None, "en", "s"), (76, "", None, "s"),
        (77, text(8, "en", 150), None, "s"), (78, "1234 " * 100 + text(4, "en", 60), None, "s"), (79, "é " * 20 + "ǅ ʰ " + text(11, "de", 150), "de", "s"), (80, text(1, "en", 20) + "\n\n" + text(1, "en", 20), "fr", "s"), (None, text(6, "en", 120), "en", "s"),
        (83, " ".join(w if w in common["en"] else f"{w.upper()}{w.upper()}" for w in text(21, "en", 150).split()), "en", "s"), (81, prose(33, 150), "en", "s"), (82, text(12, "en", 150, share=1.0), "en", "s"),
    ]
    rows += [rows[3]] * 2
    got = queries.op6_quality_rules(spark, written(spark, tmp_path, rows)).collect()
    want = defaultdict(list)
    for r, w in zip(rows, judged(rows), strict=True):
        want[r[0]].append(w)
    assert len(got) == len(rows)
    for r in got:
        by_class, by_word, failed, kept = want[r["doc_id"]][0]
        for name, value in (("class_distance", by_class), ("word_distance", by_word)):
            assert r[name] is None if value is None else r[name] == pytest.approx(value, abs=1e-7)
        assert (r["base_failed"], r["kept"]) == (failed, kept)
    verdicts = {(r["base_failed"], r["kept"]) for r in got}
    assert verdicts == {(True, False), (False, True), (False, False)}
    # each of the two histograms alone drops a document
    assert any(not r["base_failed"] and (r["class_distance"] or 0) > quality.MAX_CLASS_DISTANCE and (r["word_distance"] or 0) <= quality.MAX_WORD_DISTANCE for r in got)
    assert any(not r["base_failed"] and (r["word_distance"] or 0) > quality.MAX_WORD_DISTANCE and (r["class_distance"] or 0) <= quality.MAX_CLASS_DISTANCE for r in got)


# Toxicity


def stems_of(node, begun=""):
    for c, child in node.items():
        if c == "stem":
            yield begun, child
        elif isinstance(child, dict):
            yield from stems_of(child, begun + c)


def terms_of(node, begun=""):
    for c, child in node.items():
        if c == "term":
            yield begun, child
        elif isinstance(child, dict):
            yield from terms_of(child, begun + c)


def best_match(word, lexicon, stems, forgiven):
    """(weight, exact) by comparing the word with every term and stem."""
    if word in lexicon.terms:
        return lexicon.terms[word], True
    begun = [s for s in stems if word.startswith(s)]
    if begun:
        return stems[max(begun, key=len)], True
    near = [w for t, w in forgiven.items() if len(word) >= toxicity.LEAST_FUZZY and abs(len(t) - len(word)) < 2 and edit(word, t) == 1]
    return (max(near), False) if near else None


def test_toxicity_query(spark, tmp_path):
    bad = ["idiot", "loser", "scumbag", "scumlord", "scummers", "trash"]
    slips = ["idiiot", "loset", "scumbg", "trahs", "xtrash"]

    def text(k):
        said = prose(k, 40).split()
        if k % 3 == 0:
            said[10:10] = ["you", bad[k // 3 % len(bad)]]
            if k % 2:
                said += ["such", "a", bad[(k // 3 + 2) % len(bad)]]
        if k % 10 == 1:
            said[5:5] = ["they", "said", f"“{bad[k // 10 % len(bad)]}”", "to", "us"]
        if k % 13 == 4:
            said += [slips[k % len(slips)]]
        return " ".join(said)

    rows = [(k, text(k), "en", "s") for k in range(240)] + [(500, None, None, None), (501, "", "en", "s"), (502, "IDIOT! you Idiot", "en", "s"), (503, '"an idiot" he wrote\nyou loser', "en", "s"), (None, text(3), "en", "s"), (9, text(9), "en", "s")]
    labels = [(k, int(k % 3 == 0), 1) for k in range(240)] + [(501, 0, 1), (None, 1, 1), (6, None, 1), (9999, 1, 1)]
    folder = written(spark, tmp_path / "a", rows, labels)
    lexicon, beta = toxicity.train(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))
    stems, forgiven = dict(stems_of(lexicon.root)), dict(terms_of(lexicon.forgiven))

    # the lexicon's weights are the log odds of the learning fold
    marks = {k: m for k, m, _ in labels if k is not None and m is not None and not is_held_out(k)}
    learned = [(marks[i], t) for i, t, *_ in rows if i in marks and t is not None]
    n = Counter(m for m, _ in learned)
    assert lexicon.terms
    for word, weight, found in [*((w, x, lambda t, w=w: w in t) for w, x in lexicon.terms.items()), *((s, x, lambda t, s=s: any(w.startswith(s) and w != s for w in t)) for s, x in stems.items())]:
        seen = Counter(m for m, t in learned if found(set(re.findall(r"[^\W_]+", t.lower()))))
        odds = math.log((seen[1] + 0.5) / (n[1] + 1)) - math.log((seen[0] + 0.5) / (n[0] + 1))
        assert weight == pytest.approx(odds) and seen[1] >= toxicity.LEAST_DOCS and odds >= toxicity.LEAST_LOG_ODDS, word

    def measures(t):
        t = (t or "").lower()
        words = re.findall(r"[^\W_]+", t)
        sums, at, unquoted = [0.0, 0.0], 0, 0
        for w in words:
            at = t.index(w, at)
            hit = best_match(w, lexicon, stems, forgiven)
            if hit:
                quoted = toxicity.is_quoted(t, at, at + len(w))
                sums[quoted] += hit[0] * (1 if hit[1] else toxicity.FUZZY_WEIGHT)
                unquoted += not quoted
            at += len(w)
        return [1.0, math.log1p(sums[0]), math.log1p(sums[1]), min(5.0, 100 * unquoted / len(words)) if words else 0.0]

    # the coefficients are where the slope of the penalised likelihood is zero; classes weigh as they do among labelled ids
    x, y = np.array([measures(t) for _, t in learned]), np.array([m for m, _ in learned])
    ids = Counter(marks[i] for i in {i for i, t, *_ in rows if i in marks and t is not None})
    weights = np.array([ids[m] / ids.total() * len(y) / n[m] for m in y])
    slope = x.T @ (weights * (y - 1 / (1 + np.exp(-(x @ beta))))) - np.array([1e-6, 1, 1, 1]) * beta
    assert np.abs(slope).max() < 1e-6

    got = queries.op7_toxicity(spark, folder).collect()
    want = defaultdict(list)
    for i, t, *_ in rows:
        want[i].append(1 / (1 + math.exp(-float(np.dot(beta, measures(t))))))
    assert len(got) == len(rows)
    for r in got:
        assert r["score"] == pytest.approx(want[r["doc_id"]][0], abs=1e-9) and r["predicted"] == (r["score"] >= 0.3) and r["held_out"] == is_held_out(r["doc_id"])
    # misspellings and quotations occur, and are told apart from plain abuse
    assert any(measures(t)[2] for _, t, *_ in rows) and any(hit and not hit[1] for s in slips for hit in [best_match(s, lexicon, stems, forgiven)])
    # labels of held-out documents change nothing
    turned = [(k, m if m is None or not is_held_out(k) else 1 - m, q) for k, m, q in labels]
    again = queries.op7_toxicity(spark, written(spark, tmp_path / "b", rows, turned)).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))


# Token counts


def allotted(spans, sections, rule):
    """Tokens of each section, -1 for none."""
    out = Counter(dict.fromkeys(range(len(sections)), 0))
    for a, b in spans:
        b = max(b, a + 1)
        held = [max(0, min(b, e) - max(a, s)) for s, e in sections]
        if rule == "largest":
            at = held.index(max(held)) if any(held) else -1
        else:
            point = a if rule == "start" else b - 1
            at = next((k for k, (s, e) in enumerate(sections) if s <= point < e), -1)
        out[at] += 1
    return out


@pytest.mark.parametrize("rule", attribution.RULES)
def test_token_counts(spark, rule):
    path = public_tokenizers.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    texts = [None, "", "\n", "one", "two\n\n\n  three four \n five\n", "a\n \n\tb", "日本\n 😀 it's\r\n\n", prose(1, 400).replace(" k", "\n\n k"), "\n\n\nend", prose(2, 50) + "\n" * 40 + "  x"]
    rng = np.random.default_rng(1)
    rows = []
    for k, t in enumerate(texts):
        cuts = sorted(rng.choice(len(t) + 1, min(len(t), 8), replace=False).tolist()) if t else []
        rows.append((k, t, list(zip(cuts[::2], cuts[1::2], strict=False))))
    rows.append((50, "no sections here", None))

    def lines(t):
        ends = [k + 1 for k, c in enumerate(t) if c == "\n"]
        ends += [len(t)] * (not ends or ends[-1] < len(t))
        return list(zip([0, *ends], ends, strict=False))

    table = spark.createDataFrame(rows, "doc_id long, text string, sections array<struct<start:long,end:long>>")
    for given in (False, True):
        got = defaultdict(dict)
        for r in attribution.count_tokens(table if given else table.drop("sections"), path, public_tokenizers.PATTERN, rule).collect():
            got[r["doc_id"]][r["section"]] = (r["start"], r["n_chars"], r["n_tokens"])
        for doc_id, t, cuts in rows:
            sections = (cuts or []) if given else lines(t or "")
            counts = allotted(plain.encode(t or "", add_special_tokens=False).offsets, sections, rule)
            want = {k: (*((sections[k][0], sections[k][1] - sections[k][0]) if k >= 0 else (0, 0)), n) for k, n in counts.items()}
            assert got[doc_id] == want, (doc_id, given)
