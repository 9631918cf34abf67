"""Trained operators: held-out accuracy, exact counts, edge rows."""

import os
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from faultscope.llm import html_main, language, quality_classifier, quality_rules
from faultscope.llm.dom import blocks_of, read_page
from faultscope.llm.queries import QUERIES, table
from tests.llm.conftest import DOCS

SF = os.environ.get("FAULTSCOPE_TEST_SF_LLM", "/root/testdata/sf0.01")
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def brute_counts(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    windows = [tuple(words[k:k + 5]) for k in range(len(words) - 4)]
    seen = Counter(windows)
    repeated = set()
    for k, w in enumerate(windows):
        if seen[w] > 1:
            repeated.update(range(k, k + 5))
    earlier, dup = set(), 0
    for line in text.split("\n"):
        if re.search("[^\x20\x09-\x0d]", line):
            dup += line in earlier
            earlier.add(line)
    return len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text)), dup, len(repeated)


def test_base_counts_are_exact(edge_docs):
    rnd = random.Random(1)
    texts = [r.text or "" for r in edge_docs.collect()]
    texts += [" ".join(rnd.choice(["a", "b", "c#", "é|", "x\ny"]) for _ in range(rnd.randint(0, 80))) for _ in range(300)]
    for t in texts:
        assert quality_rules.text_counts(t) == brute_counts(t), t


@needs_tables
def test_quality_rules_on_held_out_labels(spark):
    rows = {r.doc_id: r for r in QUERIES["op4_quality_rules"](spark, SF).collect()}
    docs = {r.doc_id: r.text for r in table(spark, SF, "documents").collect()}
    assert set(rows) == set(docs)
    for k, r in rows.items():
        counts = brute_counts(docs[k])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts
        assert r.base_failed == (counts[0] < 10 or 100 * counts[4] > 20 * counts[0])
        assert not (r.kept and r.base_failed)
    judged = [(r.quality, rows[r.doc_id]) for r in table(spark, SF, "labels").collect() if _held_out(r.doc_id)]
    assert np.mean([(row.probability >= 0.5) == (q == 1) for q, row in judged]) > 0.95


def _held_out(doc_id):
    import zlib
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


@needs_tables
def test_quality_classifier_on_held_out_labels(spark):
    rows = {r.doc_id: r for r in QUERIES["op9_quality_classifier"](spark, SF).collect()}
    assert all(r.held_out == _held_out(k) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for k, r in rows.items())
    judged = [(r.quality, rows[r.doc_id].predicted) for r in table(spark, SF, "labels").collect() if _held_out(r.doc_id)]
    assert np.mean([q == p for q, p in judged]) > 0.93


@needs_tables
def test_language_on_held_out_rows(spark):
    rows = {r.doc_id: r for r in QUERIES["op5_language"](spark, SF).collect()}
    judged = [(r.lang, rows[r.doc_id].lang_pred) for r in table(spark, SF, "documents").collect() if r.lang and _held_out(r.doc_id)]
    assert len(rows) == table(spark, SF, "documents").count()
    assert np.mean([a == b for a, b in judged]) > 0.97


def test_distance_is_the_out_of_place_sum():
    texts = ["the cat sat on the mat", "der hund und die katze", "zzz"]
    profiles = []
    for t in texts[:2]:
        doc, gram, n = language.grams([t])
        order = np.lexsort((gram, -n))
        profiles.append({int(g): k for k, g in enumerate(gram[order][:language.TOP])})
    known = np.unique([g for p in profiles for g in p])
    rank = np.array([[p.get(int(g), language.TOP) for p in profiles] for g in known])
    got, scores = language.Profiles(["en", "de"], known, rank).predict([*texts, "", "12"])
    assert got[:2] == ["en", "de"] and got[3:] == ["und", "und"] and scores[3] == 0
    for t, name in zip(texts, got):
        doc, gram, n = language.grams([t])
        own = [int(g) for g in gram[np.lexsort((gram, -n))][:language.TOP]]
        far = [sum(abs(k - p[g]) if g in p else language.TOP for k, g in enumerate(own)) for p in profiles]
        assert name == ["en", "de"][int(np.argmin(far))]


def test_trained_operators_take_edge_rows_and_no_labels(spark, edge_docs, no_docs, no_labels):
    n = edge_docs.count()
    labels = spark.createDataFrame([(4, 0, 0), (5, 0, None), (10, 1, 0), (11, 1, 1), (11, 1, 1), (None, 1, 0), (7, None, None)], no_labels.schema)
    for some in (labels, no_labels):
        assert quality_rules.quality_rules(edge_docs, some).count() == n
        assert quality_classifier.quality_scores(edge_docs, some).where("score between 0 and 1").count() == n
        assert quality_rules.quality_rules(no_docs, some).count() == quality_classifier.quality_scores(no_docs, some).count() == 0
        assert quality_rules.keep_good(edge_docs, some).columns == edge_docs.columns
    got = language.identify_languages(edge_docs).collect()
    assert len(got) == n and {r.lang_pred for r in got if r.doc_id in (0, 1, 2)} == {"und"}
    assert language.identify_languages(no_docs).count() == 0
    assert {r.lang_pred for r in language.identify_languages(edge_docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body>
<nav><ul><li><a href=/a>Home</a></li></ul></nav><article><h1>Head &amp; line</h1><p>One &lt;two&gt;\n  three<br>four<p>Five <b>six</b>.</p>
<div class="comments"><p>First!</p></div></article><footer>&copy; me</footer></body></html>"""


def test_blocks_of_a_page():
    nodes = read_page(PAGE)
    assert blocks_of(nodes, html_main.seed_labels(nodes)) == ["Head & line", "One <two> three four", "Five six."]
    for page in ("", "plain", "<p>a<p>b</i></div>", "<div>" * 3000 + "deep", "<script>never closed", "<!-- x", "<table><tr><td>a<td>b</table>c"):
        nodes = read_page(page)
        assert all(x.parent < k for k, x in enumerate(nodes))
        assert blocks_of(nodes, np.ones(len(nodes), bool)) == {"": [], "plain": ["plain"], "<p>a<p>b</i></div>": ["a", "b"], "<script>never closed": [], "<!-- x": [],
                                                               "<table><tr><td>a<td>b</table>c": ["a", "b", "c"]}.get(page, ["deep"])


def test_decoding_contradicts_nobody_and_is_the_best_choice():
    rng = np.random.default_rng(0)
    for _ in range(60):
        nodes = read_page("".join(rng.choice(["<div>", "</div>", "<section>", "</section>", "x"], 14)))
        odds = rng.normal(size=len(nodes))
        keep = html_main.decode(nodes, odds)
        best = -1e9
        for code in range(1 << (len(nodes) - 1)):
            own = np.array([True, *(bool(code >> k & 1) for k in range(len(nodes) - 1))])
            if all(own[x.parent] for k, x in enumerate(nodes) if k and own[k]):
                best = max(best, odds[1:][own[1:]].sum())
        assert all(keep[x.parent] for k, x in enumerate(nodes) if k and keep[k])
        assert odds[1:][keep[1:]].sum() == pytest.approx(best)


@needs_tables
def test_main_text_of_the_given_pages_and_of_other_layouts(spark):
    pages = {r.page_id: r.html for r in table(spark, SF, "pages").collect()}
    got = {r.page_id: r for r in QUERIES["op6_html_main"](spark, SF).collect()}
    right = 0
    blocks = {}
    for k, page in pages.items():
        nodes = read_page(page)
        blocks[k] = blocks_of(nodes, html_main.seed_labels(nodes))
        right += got[k].text == "\n".join(blocks[k])
        assert got[k].n_chars == len(got[k].text)
    assert right >= 0.99 * len(pages)
    model = html_main.train(table(spark, SF, "pages"))
    fresh = [k for k in sorted(pages) if blocks[k]][-40:]
    made = [html_main.compose(blocks[k], blocks[fresh[n - 1]], np.random.default_rng(10**9 + k)) for n, k in enumerate(fresh)]
    assert np.mean([a == "\n".join(blocks[k]) for a, k in zip(html_main.main_texts(made, model), fresh)]) > 0.9


def test_pages_of_the_edge(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "<p>only text</p>"), (3, "u", "<p>only text</p>"), (None, None, PAGE)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = {(r.page_id, r.text) for r in html_main.extract_main_text(pages).collect()}
    assert {(1, ""), (2, "")} <= got and html_main.extract_main_text(pages).count() == 5
    assert html_main.extract_main_text(pages.limit(0)).count() == 0
    assert {r.text for r in html_main.extract_main_text(pages.where("page_id = 3")).collect()} == {"only text"}


def test_training_pages_do_not_depend_on_the_layout(spark):
    pages = table(spark, SF, "pages")
    models = [html_main.train(p, 40) for p in (pages, pages.repartition(1), pages.repartition(7).unionByName(pages.where("page_id % 3 = 0")))]
    for other in models[1:]:
        assert all(np.array_equal(getattr(models[0], name), getattr(other, name)) for name in ("feature", "threshold", "leaf")) and models[0].base == other.base


def plain_grams(text):
    """N-grams of one to three letters, an edge as a blank, counted one by one."""
    line = " " + "".join(c if c.isalpha() else " " for c in text.lower()) + " "
    line = re.sub(" +", " ", line)
    found = Counter()
    for n in (1, 2, 3):
        for k in range(len(line) - n + 1):
            piece = line[k:k + n]
            if piece[0] == " " and (n == 1 or piece[1] == " ") or " " in piece[1:-1]:
                continue
            found[piece] += 1
    return found


def test_grams_keep_letters_of_every_script_apart(monkeypatch):
    rnd = random.Random(2)
    letters = "abé ,ΔжабAहिन्दी한국어日本語漢字かなカナ你好世界\U00020000\U0001f600\U0001e900 "
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 60))) for _ in range(50)] + ["", "语" * 3 + "語" * 3]

    def got(texts):
        out = [Counter() for _ in texts]
        for d, g, n in zip(*(x.tolist() for x in language.grams(texts))):
            piece = "".join(chr(g >> k * 21 & 0x1FFFFF) for k in (2, 1, 0) if g >> k * 21 & 0x1FFFFF)
            out[d][piece] += n
        return out

    want = [plain_grams(t) for t in texts]
    assert got(texts) == want
    # An alphabet that leaves no room for the number of a text beside its n-grams.
    monkeypatch.setattr(language, "_ROOM", 50)
    wide = ["".join(chr(c) for c in range(0x4E00 + 700 * k, 0x4E00 + 700 * (k + 1))) for k in range(29)] * 200
    assert got(wide)[::29][:3] == [plain_grams(wide[0])] * 3


def test_languages_of_other_scripts(spark):
    """Chinese and Japanese of letters that differ in their upper bits alone."""
    rnd = random.Random(5)
    alphabets = {"x": [chr(0x5000 + k) for k in range(40)], "y": [chr(0x6000 + k) for k in range(40)]}
    rows = [(k, " ".join("".join(rnd.choice(alphabets[lang]) for _ in range(4)) for _ in range(30)), lang, None, 0) for k, lang in enumerate("xy" * 100)]
    found = language.identify_languages(spark.createDataFrame(rows, DOCS)).collect()
    assert all(r.lang_pred == rows[r.doc_id][2] for r in found) and any(r.held_out for r in found)
