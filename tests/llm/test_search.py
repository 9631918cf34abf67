"""Ranked search against a plain scan of all documents."""

import math
import random
import re

import numpy as np
import pytest

from faultscope.llm import search
from tests.llm.conftest import DOCS

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_search(docs, items, top=50):
    counted = []
    for doc_id, text in docs:
        terms = TERM.findall((text or "").translate(LOWER))
        if terms:
            counted.append((doc_id, len(terms), {t: terms.count(t) for t in set(terms)}))
    total, words = len(counted), sum(n for _, n, _ in counted)
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(TERM.findall((text or "").translate(LOWER)))
    out = []
    for item, terms in asked.items():
        weights = {}
        for t in terms:
            df = sum(t in c for _, _, c in counted)
            weights[t] = math.floor(1000 * math.log((2 * total + 2) / (2 * df + 1)))
        rows = []
        for doc_id, n, c in counted:
            m = 50 + 50 * n * total // words
            score = sum(w * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t, w in weights.items() if t in c)
            if score > 0:
                rows.append((-score, doc_id is None, doc_id or 0, doc_id))
        out += [(item, k + 1, r[3], -r[0]) for k, r in enumerate(sorted(rows)[:top])]
    return sorted(out, key=repr)


def rows_of(df):
    return sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def items(spark):
    rows = [(1, "The café don't 你好", 3), (2, None, 1), (3, " .!", 1), (4, "word word nothing", 1), (5, "eleven seven w1 w2 w3 W4", 2), (5, "w7", 2), (None, "one", 0)]
    return spark.createDataFrame(rows, "item_id long, text string, score int")


def random_rows(n=400, seed=3):
    rnd = random.Random(seed)
    return [(k, " ".join(f"w{int(rnd.paretovariate(0.6)) % 90}" for _ in range(rnd.choice([1, 3, 9, 30, 120]))), None, None, 0) for k in range(n)]


@pytest.mark.parametrize("top", [1, 7, 50])
def test_ranks_agree_with_a_scan(spark, edge_docs, no_docs, items, top):
    want_items = [(r.item_id, r.text) for r in items.collect()]
    many = spark.createDataFrame(random_rows(), DOCS).repartition(5)
    for docs in (edge_docs, many):
        want = brute_search([(r.doc_id, r.text) for r in docs.collect()], want_items, top)
        index = search.build_index(docs, segment_docs=60)
        assert rows_of(search.search(index, items, top=top)) == want
        assert rows_of(search.search(index, items, top=top, block=1)) == want


def test_empty_tables(spark, no_docs, edge_docs, items):
    assert search.ranked_search(no_docs, items).count() == 0
    assert search.ranked_search(edge_docs, items.where("false")).count() == 0


def test_strata_that_cannot_win_are_not_scored():
    rnd = np.random.default_rng(5)
    lengths = rnd.integers(1, 400, 3000)
    postings = []
    for share in (0.5, 0.2, 0.01):
        places = np.flatnonzero(rnd.random(3000) < share)
        postings.append((places, rnd.integers(1, 4, len(places))))
    strata = search.Strata(lengths, 3000, int(lengths.sum()), postings)
    terms, weights = np.arange(3), np.array([500, 1500, 4000])
    places, scores, seen = strata.best(terms, weights, 10, 1)
    full = np.zeros(3000, np.int64)
    for (at, count), w in zip(postings, weights.tolist()):
        m = 50 + 50 * lengths[at] * 3000 // int(lengths.sum())
        full[at] += w * (10**9 * count // (1000 * count + 20 * m))
    assert sorted(scores.tolist())[-10:] == sorted(full.tolist())[-10:]
    assert (full[places] == scores).all() and seen < len(strata.m)


def test_long_texts_are_split_in_pieces(monkeypatch):
    text = "alpha Beta-gamma é1 " * 500 + "x" * 300
    whole = search.terms_of(text)
    monkeypatch.setattr(search, "PIECE", 64)
    assert search.terms_of(text) == whole
    assert whole["é1".encode()] == 500 and whole[b"beta"] == 500 and whole[b"x" * 300] == 1
