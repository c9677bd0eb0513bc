"""The text operators against brute force, on rows with nulls, blanks, ties, repeats and clashing columns."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from latticework.llm import attribution, buckets, components, fingerprints, jaccard, langid, mixing, packing, quality, substrings, toxicity, wrappers
from latticework.llm.shingles import WordHasher
from latticework.llm.tokens import SpanEncoder, WordEncoder

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, score string"
WORDS = [f"{a}{b}{c}" for a in "bdfgklmnprst" for b in "aeiou" for c in ("n", "r", "st", "l")]


def prose(seed: int, n: int) -> str:
    rng = np.random.default_rng(seed)
    return " ".join(rng.choice(WORDS, n)) + "."


def row(doc_id, text, lang="en", source="a"):
    return (doc_id, text, lang, source, len(text or ""), "clash", "clash")


def documents():
    base, passage = prose(1, 200), prose(2, 60)
    near = base.split()
    near[100] = "changed"
    return [
        row(1, base), row(2, base), row(2, base), row(3, " ".join(near), source="b"), row(4, prose(3, 40) + " " + passage), row(5, passage + "\n\n" + prose(4, 30), None, None),
        row(6, None), row(7, ""), row(8, " \t\n"), row(9, "one"), row(10, "one two"), row(11, "THE end"), row(12, "the END"), row(None, base), row(None, prose(6, 20)), row(13, "☃ é́ 😀 <|endoftext|> it's 12"), row(14, prose(7, 6000), source="b"), row(15, "x " * 300),
    ]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(documents(), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_word_hashes():
    texts = [None, b"", b" a  b\ta", "é x\x0bA".encode(), b"a", b"\n"]
    for lower in (False, True):
        seen = {}
        for text, hashes in zip(texts, WordHasher(lower).texts(pa.array(texts, pa.binary())), strict=True):
            words = (text or b"").lower().split() if lower else (text or b"").split()
            assert len(words) == len(hashes)
            assert all(seen.setdefault(w, h) == h for w, h in zip(words, hashes.tolist(), strict=True))
        assert len(set(seen.values())) == len(seen)


def test_language_id(spark, docs, empty):
    parser = langid.Parser({"en": "the cat and the dog", "de": "der hund und die katze"})
    text = "the dog and der hund x9"
    points = "".join(map(chr, langid.normalised(text)))

    def phrases(reference):
        at = n = 0
        while at < len(points):
            end = at
            while end < len(points) and points[at : end + 1] in reference:
                end += 1
            at, n = max(end, at + 1), n + 1
        return n

    assert parser.phrases([text])[0][0].tolist() == [phrases("der hund und die katze"), phrases("the cat and the dog")]
    got = langid.identify(docs, {"en": " ".join(WORDS), "de": "ößü äch heit keit"}).collect()
    assert all((r["lang_pred"] == "und" and r["score"] == 0) == (not any(map(str.isalpha, r["text"] or ""))) for r in got)
    assert {r["lang_pred"] for r in got if r["doc_id"] in (1, 4, 14)} == {"en"}
    assert langid.identify(empty).count() == 0
    assert {r["lang_pred"] for r in langid.identify(docs, {}).collect()} == {"und"}


def test_language_id_of_many_scripts(spark):
    # words of each script's letters, 60 common words a language; CJK letters from ranges of 2,000; 70 languages more
    def words(seed, letters, length=5):
        rng = np.random.default_rng(seed)
        return ["".join(rng.choice(letters, length)) for _ in range(60)]

    def letters(first, n):
        return [c for c in map(chr, range(first, first + n)) if c.isalpha()]

    latin = [*"abcdefghijklmnopqrstuvwxyz"]
    vocabulary = {
        "aa": words(1, latin), "de": words(2, [*latin, *"äöüß"]), "ru": words(3, letters(0x430, 32)), "uk": words(4, [*letters(0x430, 32), *"іїєґ"]), "el": words(5, letters(0x3B1, 25)), "hy": words(6, letters(0x561, 38)),
        "zh": words(7, letters(0x4E00, 2000), 2), "ja": words(8, letters(0x5E00, 2000) + 20 * letters(0x3041, 86), 3), "ko": words(9, letters(0xAC00, 2000), 3), "ff": words(10, letters(0x1E922, 34)),
    } | {f"x{k}": words(100 + k, latin) for k in range(70)}

    def text(lang, seed, n):
        return " ".join(np.random.default_rng(seed).choice(vocabulary[lang], n))

    rows = [(f"{lang}-{k}", text(lang, k, 40), lang) for lang in vocabulary for k in range(2 if lang == "x69" else 8)]
    learned = langid.references(spark.createDataFrame(rows, "doc_id string, text string, lang string"))
    assert set(learned) == set(vocabulary)
    asked = spark.createDataFrame([(lang, text(lang, 1000 + k, 40)) for lang in vocabulary for k in range(3)], "want string, text string")
    assert {(r["want"], r["lang_pred"]) for r in langid.identify(asked, learned).collect()} == {(x, x) for x in vocabulary}
    # a letter outside the table ends and begins phrases like any other, and a short reference is no cheaper for letters that it lacks
    parser = langid.Parser({"zh": "".join(map(chr, range(0x4E00, 0x4E00 + 500))), "aa": "short text"})
    assert parser.phrases(["".join(map(chr, [*range(0x4E64, 0x4E96), *range(0x4E00, 0x4E10), 0x6000]))])[0][0].tolist() == [67, 3]
    assert parser.predict(["".join(map(chr, range(0x4E00, 0x4E00 + 500, 7)))])[0] == ["zh"]


def test_mixing(docs, empty):
    got = mixing.mix_sources(docs.drop("size")).collect()
    sizes = {"a": 0, "b": 0, None: 0}
    for r in documents():
        sizes[r[3]] += len(WORD.findall(r[1] or ""))
    assert {r["source"]: r["source_size"] for r in got} == sizes
    targets = {r["source"]: r["target"] for r in got}
    assert np.isclose(sum(targets.values()), 1.5 * sum(sizes.values())) and all(targets[s] <= 2 * sizes[s] for s in sizes)
    taken = Counter()
    for r in got:
        taken[r["source"]] += r["taken"]
        assert 0 <= r["taken"] <= 2 * r["size"]
    assert all(taken[s] == int(targets[s]) for s in sizes)
    mixed = mixing.take_words(mixing.mix_sources(docs.drop("size")), ["source", "text"]).collect()
    words = Counter()
    for r in mixed:
        words[r["source"]] += len(WORD.findall(r["text"]))
    assert words == +taken
    assert mixing.mix_sources(empty.drop("size")).count() == 0


def five_words(text):
    """The distinct shingles of five words of a text, or its words if there are fewer."""
    words = WORD.findall(text.lower())
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def test_fingerprints(docs, empty):
    got = fingerprints.fingerprint_edits(docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])).collect()
    texts = {r[0]: r[1] or "" for r in documents() if r[0] is not None}
    order = sorted(texts, reverse=True)
    following = dict(zip(order, [*order[1:], order[0]], strict=True))
    prints = {r["doc_id"]: r["fingerprint"] for r in got}
    for r in got:
        text, other = texts[r["doc_id"]], texts[following[r["doc_id"]]]
        cut = len(text) // 3
        edited = text[: len(text) - cut] + other[:cut]
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and r["n_chars"] == len(text)
        for other_text, near in ((edited, r["near_edited"]), (other, r["near_next"])):
            x, y = five_words(text), five_words(other_text)
            # 256 bins: a standard error of at most 0.032, more where few bins are full
            assert abs(near - (len(x & y) / len(x | y) if x | y else 1.0)) < (0.15 if min(len(x), len(y)) > 100 else 0.4)
        assert 0 <= r["near_edited"] <= 1 and (r["near_next"] == 1 if prints[r["doc_id"]] == prints[following[r["doc_id"]]] else r["near_next"] < 1)
    assert prints[1] == prints[2] and prints[6] == prints[7] == prints[8] == "" and prints[1] != prints[3]
    assert fingerprints.fingerprint_edits(docs).count() == docs.count()
    assert fingerprints.fingerprint_edits(empty).count() == 0
    assert len(fingerprints.fingerprint(docs).select("fingerprint").distinct().collect()) > 5


PAGE = "<html><head><title>T</title><script>if (a < b) {{ }}</script></head><body class='has-sidebar'><header><h1>Site</h1></header><nav><ul><li>Home</li></ul></nav><div class='cookie-notice'>We use cookies</div>{}<div id='comments'><p>first!</p></div><form><label>Mail</label></form><footer>&copy; now</footer></body></html>"


def test_html(spark):
    assert wrappers.extract(PAGE.format("<article><h1>Caf&eacute;  a</h1><p>one <b>two</b>\n three<br>four<p>five &amp; <i>six</i><aside>x</aside></article>")) == "Café a\none two three four\nfive & six"
    assert wrappers.extract(PAGE.format("<div class='content'><p>only text</p></div>")) == "only text"
    assert wrappers.extract(None) == wrappers.extract("") == wrappers.extract("<p>") == ""
    assert wrappers.extract("<article><p>a < b<p>c") == "a < b\nc"
    pages = [PAGE.format(f"<article><p>Read more here</p><p>{prose(k, 12)}</p></article>") for k in range(8)]
    template = wrappers.template_tree(wrappers.learn(pages))
    assert [wrappers.extract(p, template) for p in pages] == [prose(k, 12) for k in range(8)]
    table = spark.createDataFrame([(k, f"https://h.example/{k}", p, "clash") for k, p in enumerate(pages)] + [(90, None, None, "clash"), (91, "h", "<p>x</p>", None)], "page_id long, url string, html string, text string")
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in wrappers.extract_pages(table).collect()}
    assert got[0] == (prose(0, 12), len(prose(0, 12))) and got[90] == ("", 0) and got[91] == ("x", 1)
    assert wrappers.extract_pages(table.limit(0)).count() == 0


def test_html_beside_articles():
    card = "<article class='card'><h3>{}</h3></article>"
    for page in ("<main><div><header>head</header><p>one</p></div>{}</main>", "<div class='post'><p>head</p><p>one</p></div><section>{}</section>", "<main><p>head</p><article><p>one</p></article>{}</main>"):
        assert wrappers.extract(PAGE.format(page.format(card.format("teaser")))) == "head\none\nteaser"
    assert wrappers.extract("<header>site</header><div class='ad'>buy</div><article><header>head</header><p>one</p><div class='share'>x</div></article><p>after</p><footer>f</footer>") == "head\none\nafter"
    # the template decides: what is the same on every page goes, inside an article or beside it
    pages = [PAGE.format(f"<main><p>Our mission</p><p>{prose(k, 9)}</p>{card.format(prose(50 + k, 3))}{card.format('Read more here')}</main>") for k in range(8)]
    template = wrappers.template_tree(wrappers.learn(pages))
    assert [wrappers.extract(p, template) for p in pages] == [f"{prose(k, 9)}\n{prose(50 + k, 3)}" for k in range(8)]


def test_html_without_telling_names():
    """No tag, role or class tells the parts: menus, notices and signatures are known by their slots alone."""

    def page(k):
        menu = "".join(f"<li><a href='/{w}'>{w}</a></li>" for w in prose(100 + k, 3 + k % 3).split())
        notice = f"<div><p>Read so far by {k} people from {prose(200 + k, 1)} here</p></div>"
        body = "".join(f"<p>{prose(300 + 10 * k + j, 30)}</p>" for j in range(2 + k % 3))
        return f"<body><div><ul>{menu}</ul></div><div><h1>{prose(400 + k, 4)}</h1>{body}</div>{notice}<div><p>All rights kept</p></div></body>"

    def want(k):
        return "\n".join([prose(400 + k, 4), *(prose(300 + 10 * k + j, 30) for j in range(2 + k % 3))])

    learned = wrappers.learn([page(k) for k in range(12)])
    template = wrappers.template_tree(learned)
    assert learned and [wrappers.extract(page(k), template) for k in range(40)] == [want(k) for k in range(40)]
    assert wrappers.extract(page(3)) != want(3)  # nothing else would tell
    linked = [n.linked for n in wrappers.leaves_of(wrappers.parse("<p>ab <a>cd</a></p><p><a>x</a></p><p>y"))]
    assert linked == [0.5, 1.0, 0.0]


def test_kinds_of_slots():
    def brute(texts, linked):
        n = len(texts)
        if any(sum(t == u for u in texts) >= 0.9 * n for t in texts):
            return "constant"
        if sum(x >= 0.8 for x in linked) >= 0.9 * n:
            return "links"
        tokens = [w for t in texts for w in t.split()]
        inside = [w for w in tokens if sum(w in u.split() for u in texts) >= 0.9 * n]
        return "notice" if len(inside) > 0.5 * len(tokens) else "content"

    rng, seen = np.random.default_rng(5), set()
    for _ in range(400):
        n, same = int(rng.integers(3, 13)), rng.random()
        texts = [" ".join(["a", "b", "c"][: rng.integers(1, 4)] if rng.random() < same else rng.choice(WORDS, 3)) for _ in range(n)]
        linked = [float(rng.random() < same) for _ in range(n)]
        kind = wrappers.kind_of_slot([wrappers.Node("#text", t, linked=x) for t, x in zip(texts, linked, strict=True)])[0]
        assert kind == brute(texts, linked)
        seen.add(kind)
    assert seen == {"constant", "links", "notice", "content"}


def test_tree_matching():
    def brute(a, b):
        if a.tag != b.tag:
            return 0
        if a.tag == "#text":
            return 2 if a.text == b.text else 1

        def best(x, y):
            return 0 if not x or not y else max(best(x[1:], y), best(x, y[1:]), brute(x[0], y[0]) + best(x[1:], y[1:]))

        return 1 + best(a.children, b.children)

    trees = [wrappers.parse(t) for t in ("<p>a</p><div><p>b</p></div>", "<div><p>b<p>c</div><p>a</p>", "x<ul><li>1<li>2</ul>")]
    assert all(wrappers.match(x, y) == brute(x, y) for x in trees for y in trees)


def test_packing(spark, docs, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    got = packing.pack(docs, path).collect()
    want = Counter()
    for r in documents():
        ids = np.array([*plain.encode(r[1] or "", add_special_tokens=False).ids, 1], "<u4")
        for at in range(0, len(ids), 4096):
            want[r[0], at // 4096, at, len(ids[at : at + 4096]), zlib.crc32(ids[at : at + 4096].tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 4096
    assert packing.pack(empty, path).count() == 0


def test_best_fit_decreasing():
    rng = np.random.default_rng(5)
    for _ in range(30):
        lengths = rng.integers(1, 21, rng.integers(1, 60)).tolist()
        rooms = []
        for x in sorted(lengths, reverse=True):  # one by one
            fits = [k for k, r in enumerate(rooms) if r >= x]
            k = min(fits, key=lambda k: rooms[k]) if fits else len(rooms)
            if not fits:
                rooms.append(20)
            rooms[k] -= x
        used = Counter()
        for length, _, n, first, _ in packing.best_fit_runs(dict(Counter(lengths)), 20):
            for k in range(n):
                used[first + k] += length
        assert sorted(20 - v for v in used.values()) == sorted(rooms)


def test_quality(docs, empty):
    for r in quality.judge(docs).collect():
        text = r["text"] or ""
        words = WORD.findall(text)
        counts = Counter(zip(words, words[1:], words[2:], strict=False))
        covered = {k + d for k in range(len(words) - 2) if counts[tuple(words[k : k + 3])] > 1 for d in range(3)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        want = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
        assert r["base_failed"] == failed and not (failed and r["kept"])
    assert quality.judge(empty).count() == 0


def test_quality_of_many_languages(spark, monkeypatch):
    # 70 languages, the small ones in capitals; texts of a language share its words
    def text(k, seed):
        words = [w.upper() if k >= 60 else w for w in WORDS[k : k + 30]]
        return " ".join(np.random.default_rng(seed).choice(words, 120))

    rows = [(f"{k}-{n}", text(k, n), f"l{k}") for k in range(70) for n in range(2 if k >= 60 else 4)]
    table = spark.createDataFrame(rows, "doc_id string, text string, lang string")

    def judged():
        return {r["doc_id"]: r for r in quality.judge(table).select("doc_id", "kept", "class_distance", "word_distance").collect()}

    got = judged()
    assert len(got) == len(rows) and all(r["word_distance"] is not None and r["class_distance"] < 0.1 and r["kept"] for r in got.values())
    monkeypatch.setattr(quality, "BROADCAST_CHARS", 0)
    assert judged() == got


def test_repeats_beyond_the_list(spark):
    text = " ".join([*(f"w{k} x{k} y{k}" for k in range(60))] * 2) + " tail of it"
    got = quality.judge(spark.createDataFrame([(1, text, "en")], "doc_id long, text string, lang string")).first()
    words = text.split()
    counts = Counter(zip(words, words[1:], words[2:], strict=False))
    assert got["n_repeat_words"] == len({k + d for k in range(len(words) - 2) if counts[tuple(words[k : k + 3])] > 1 for d in range(3)})


def test_js_distance(spark):
    frame = spark.createDataFrame([([3, 1, 0], [0.5, 0.25, 0.25])], "c array<long>, q array<double>")
    p, q = np.array([0.75, 0.25, 0]), np.array([0.5, 0.25, 0.25])
    m = (p + q) / 2
    want = np.sqrt((sum(a * np.log2(a / b) for a, b in zip(p, m, strict=True) if a) + sum(a * np.log2(a / b) for a, b in zip(q, m, strict=True) if a)) / 2)
    assert np.isclose(frame.select(quality.js_distance(F.col("c"), F.col("q"))).first()[0], want)


def test_lexicon():
    lexicon = toxicity.Lexicon({"moron": 2.0, "idiot": 3.0}, {"scu": 1.0})
    assert lexicon.find("idiot") == (3.0, True, "idiot") and lexicon.find("scummy")[:2] == (1.0, True)
    for word in ("idiott", "diot", "idjot", "idoit", "xidiot", "moronx", "mxron", "marron", "plain"):
        near = [t for t in ("idiot", "moron") if edit(word, t) == 1]
        found = lexicon.find(word) if len(word) >= 5 else None
        assert (found is not None) == bool(near and len(word) >= 5)
    assert toxicity.is_quoted('he said "what an idiot" to me', 17, 22) and not toxicity.is_quoted("you are an idiot", 11, 16)


def edit(a, b):
    rows = [[max(i, j) if not i or not j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            rows[i][j] = min(rows[i - 1][j] + 1, rows[i][j - 1] + 1, rows[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
    return rows[-1][-1]


def test_toxicity(spark, docs, empty):
    rows = [(k, prose(k, 30) + (" you idiot loser" if k % 2 else ""), "c") for k in range(60)] + [(99, None, None), (100, "", None)]
    table = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)] + [(None, 1), (5, None), (777, 1)], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(table, labels).collect()}
    assert all(got[k]["predicted"] == k % 2 for k in range(60)) and got[99]["score"] == got[100]["score"] < 0.3
    none = toxicity.score_toxicity(table, labels.limit(0)).collect()
    assert {r["predicted"] for r in none} == {0}
    assert toxicity.score_toxicity(empty, labels).count() == 0


def test_toxicity_misspelled_stems(spark):
    lexicon = toxicity.Lexicon({}, {"scum": 3.0}, {"scummer": 3.0})
    assert lexicon.find("scummy") == (3.0, True, "scummy") and lexicon.find("scmmer") == lexicon.find("xcummer") == (3.0, False, "scummer") and lexicon.find("scorner") is None
    forms = ["scumber", "scumming", "scumlord"]
    rows = [(k, prose(k, 30) + (f" you {forms[k % 3]}" if k % 2 else "")) for k in range(120)] + [(902, prose(902, 30) + " you scmming"), (903, prose(902, 30) + " you plodding"), (904, prose(902, 30) + " you scumming")]
    labels = spark.createDataFrame([(k, k % 2) for k in range(120)], "doc_id long, toxic int")
    got = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(spark.createDataFrame(rows, "doc_id long, text string"), labels).collect()}
    assert got[903] < got[902] < got[904] and got[902] >= toxicity.THRESHOLD


def test_toxicity_beyond_the_sample(spark, monkeypatch):
    # half of the toxic texts have no word of the lexicon; the share of toxic labels is 1 in 10 whatever the sample cuts
    rows = [(k, prose(k, 30) + (" you idiot loser" if k % 20 == 0 else "")) for k in range(2000)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 10 == 0)) for k in range(2000)] + [(k, 1) for k in range(5000, 9000)], "doc_id long, toxic int")

    def scores(bound):
        monkeypatch.setattr(toxicity, "SAMPLE_DOCS", bound)
        return {r["doc_id"]: r for r in toxicity.score_toxicity(table, labels).collect()}

    whole, cut = scores(3000), scores(150)
    assert all(abs(whole[k]["score"] - cut[k]["score"]) < 0.05 and whole[k]["predicted"] == cut[k]["predicted"] for k in whole)
    assert whole[1]["score"] < 0.15 and whole[0]["predicted"] == 1


def test_attribution(spark, docs, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    encoder = SpanEncoder(path, public_tokenizers.PATTERN)
    word = WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    odd = ["a\x1cb c", " nbsp em\n\n  z", "It's we'll DON'T ΣΑΣ İ ﬁ ½ 123 a_b ª­​", "日本 😀", ""]
    for text in [*odd, *(r[1] or "" for r in documents())]:
        assert encoder.spans(text).tolist() == [list(x) for x in plain.encode(text, add_special_tokens=False).offsets]
        assert np.frombuffer(word.ids(text), "<u4").tolist() == word.tokenizer.encode(text, add_special_tokens=False).ids
    totals = Counter()
    for r in attribution.count_tokens(docs, path, public_tokenizers.PATTERN).collect():
        totals[r["doc_id"]] += r["n_tokens"]
    want = Counter()
    for r in documents():
        want[r[0]] += len(plain.encode(r[1] or "", add_special_tokens=False).ids)
    assert +totals == +want
    spans, starts, ends = np.array([[0, 3], [3, 6], [8, 9]]), np.array([0, 4]), np.array([4, 7])
    assert attribution.attribute(spans, starts, ends, "largest").tolist() == [0, 1, -1]
    assert attribution.attribute(spans, starts, ends, "start").tolist() == [0, 0, -1]
    assert attribution.attribute(spans, starts, ends, "end").tolist() == [0, 1, -1]
    assert attribution.count_tokens(empty, path, public_tokenizers.PATTERN).count() == 0


def test_substring_dedup(spark, docs, empty):
    rows = [(r[0], r[1] or "") for r in documents()]
    first = {}
    for doc_id, text in rows:
        words = WORD.findall(text)
        for k in range(len(words) - 12):
            key = tuple(words[k : k + 13])
            first[key] = min(first.get(key, 10**9), 10**9 if doc_id is None else doc_id)
    got = {(r["doc_id"], r["n_words"]): r for r in substrings.dedup_substrings(docs).collect()}
    assert len(substrings.dedup_substrings(docs).collect()) == len(rows)
    for doc_id, text in rows:
        words = WORD.findall(text)
        gone = {k + d for k in range(len(words) - 12) if first[tuple(words[k : k + 13])] < (10**9 if doc_id is None else doc_id) for d in range(13)}
        kept = [w for k, w in enumerate(words) if k not in gone]
        r = got[doc_id, len(words)]
        assert r["n_removed"] == len(gone) and r["kept_sha256"] == hashlib.sha256(" ".join(kept).encode()).hexdigest()
        assert WORD.findall(r["text"] or "") == kept
    assert substrings.dedup_substrings(empty).count() == 0
    assert substrings.level_lengths(13) == [7, 13] and substrings.level_lengths(50)[-2:] == [25, 50]
    long = spark.createDataFrame([(1, prose(1, 90)), (2, prose(9, 20) + " " + prose(1, 90))], "doc_id long, text string")
    assert [r["n_removed"] for r in substrings.dedup_substrings(long, 40).orderBy("doc_id").collect()] == [0, 90]


def near_components(rows, length, percent):
    sets = []
    for _, text in rows:
        words = (text or "").encode().lower().split()
        sets.append({tuple(words[k : k + length]) for k in range(max(1, len(words) - length + 1))} if words else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                parent[find(a)] = find(b)
    groups = {}
    for k in range(len(rows)):
        groups.setdefault(find(k), []).append(k)
    name = {}
    for members in groups.values():
        ids = [rows[k][0] for k in members if rows[k][0] is not None]
        for k in members:
            name[k] = min(ids, default=None)
    return Counter((rows[k][0], len(sets[k]), name[k]) for k in range(len(rows)))


@pytest.mark.parametrize(("length", "percent", "frequent", "cell"), [(3, 90, 100, 1000), (5, 80, 100, 1000), (3, 90, 1, 3), (5, 80, 2, 1000), (2, 60, 1, 3)])
def test_jaccard_join(spark, docs, empty, monkeypatch, length, percent, frequent, cell):
    """With a small class, few entries a cell and no pairs from the sorted sets, every link comes out of split buckets."""
    monkeypatch.setattr(jaccard, "FREQUENT", frequent)
    monkeypatch.setattr(jaccard, "CELL", cell)
    if cell < 1000:
        monkeypatch.setattr(jaccard, "HELD_ROWS", 7)
        monkeypatch.setattr(jaccard, "_neighbours", lambda sets, *_: sets.select(F.col("sid").alias("a"), F.col("sid").alias("b")).limit(0))
    rng = np.random.default_rng(3)
    rows = [(r[0], r[1]) for r in documents()]
    for k in range(40):
        words = prose(50 + k % 4, 80).split()
        for at in rng.integers(0, 80, rng.integers(0, 6)):
            words[at] = rng.choice(WORDS)
        rows.append((100 + k, " ".join(words)))
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.join_near(table, length, percent).collect())
    assert got == near_components(rows, length, percent)
    if frequent == 100:
        assert jaccard.join_near(empty).count() == 0


def test_signatures():
    rng = np.random.default_rng(5)
    for _ in range(200):
        n, m = rng.integers(1, 3000, 2)
        both = rng.integers(0, min(n, m) + 1)
        tokens = np.unique(rng.integers(0, 1 << 63, n + m - both).astype(np.uint64))
        rng.shuffle(tokens)
        x, y = np.sort(tokens[:n]), np.sort(tokens[n - both :])
        assert buckets.apart(buckets.signature(x), buckets.signature(y)) <= len(np.setxor1d(x, y))


def test_components(spark):
    edges = [(k, k + 1) for k in range(20)] + [(100, 50), (50, 70)]
    got = {r["node"]: r["root"] for r in components.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(21), 0), 50: 50, 70: 50, 100: 50}
