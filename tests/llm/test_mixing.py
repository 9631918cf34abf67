"""Targets, rates and copies of the mix; the pipeline."""

import os
from collections import defaultdict

import numpy as np
import pytest

import corpus_pipeline
from faultscope.llm import bpe, mixing
from faultscope.llm.common import with_copies
from faultscope.llm.queries import tokenizer_file
from tests.llm.conftest import LABELS


def brute_targets(sizes, weights=(5, 2, 1), limit=3):
    """Water filling, one source after the other."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total, open_, target = sum(sizes.values()), set(names), {}
    while open_:
        left = total - sum(target.values())
        share = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if weight[s] * share > limit * sizes[s]]
        if not over:
            target.update({s: weight[s] * share for s in open_})
            break
        for s in over:
            target[s] = limit * sizes[s]
            open_.discard(s)
    return target


@pytest.mark.parametrize("case", [{"a": [100] * 30, "b": [7] * 40, "c": [3], "d": [50, 1, 1], None: [900]}, {"x": [5]}, {"x": [0, 0], "y": [0]}, {"a": [1], "b": [1000] * 50}])
def test_targets_and_taken_words(spark, case):
    rows, n = [], 0
    for s, sizes in case.items():
        for size in sizes:
            rows.append((n, s, size))
            n += 1
    got = mixing.mix_documents(spark.createDataFrame(rows, "doc_id long, source string, size long"), group=16).collect()
    target = brute_targets({s: sum(v) for s, v in case.items()})
    assert len(got) == n
    taken, largest = defaultdict(int), {s: max(v) for s, v in case.items()}
    for r in got:
        assert r.target == pytest.approx(target[r.source]) and r.source_size == sum(case[r.source])
        assert 0 <= r.copies <= 3 and r.taken == r.copies * r.size
        taken[r.source] += r.taken
    for s in case:
        assert abs(taken[s] - target[s]) <= largest[s]


def test_rates_meet_the_targets_and_are_exponential(spark):
    rng = np.random.default_rng(1)
    rows = [(k, f"s{k % 4}", int(x)) for k, x in enumerate(rng.pareto(1.5, 4000) * 50)]
    got = mixing.mix_documents(spark.createDataFrame(rows, "doc_id long, source string, size long")).toPandas()
    again = mixing.mix_documents(spark.createDataFrame(rows[::-1], "doc_id long, source string, size long")).toPandas()
    assert got.sort_values("doc_id").copies.tolist() == again.sort_values("doc_id").copies.tolist()
    for _, own in got[got["size"] > 0].groupby("source"):
        assert (own.rate * own["size"]).sum() == pytest.approx(own.target.iloc[0], rel=1e-6)
        assert own.taken.sum() == pytest.approx(own.target.iloc[0], rel=2e-3)
        free = own[own.rate < 3]
        slope = np.log(free.rate) / free["size"]
        assert slope.std() < 1e-9 + 1e-6 * abs(slope.mean())


def test_edge_rows(edge_docs, no_docs):
    got = mixing.mixture(edge_docs).collect()
    assert len(got) == edge_docs.count()
    assert all(r.taken <= 3 * r.size for r in got)
    assert mixing.mixture(no_docs).count() == 0


def test_copies_of_rows_that_share_an_id(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d"), (3, "e")], "doc_id long, text string")
    decided = spark.createDataFrame([(1, 2), (1, 1), (2, 0), (None, 1), (3, 3)], "doc_id long, copies int")
    got = sorted(r.text for r in with_copies(docs, decided, order=(docs["text"],)).collect())
    assert got == ["a", "a", "b", "d", "e", "e", "e"]


def brute_pipeline(spark, docs, sf_dir):
    """What each stage must return, from its own input."""
    for name, step in corpus_pipeline.STAGES:
        yield name, docs, step(spark, docs, sf_dir)


def test_pipeline_stages_against_brute_force(spark, edge_docs, tmp_path):
    from tests.llm.test_dedup import brute_components, brute_fingerprint, exact_brute_force, random_docs

    good = random_docs(spark, 120)
    spark.createDataFrame([(k, 1 if k % 3 else 0, 0) for k in range(50)], LABELS).write.parquet(str(tmp_path / "labels.parquet"))
    docs = good
    for number, (name, step) in enumerate(corpus_pipeline.STAGES):
        before = docs.collect()
        path = str(tmp_path / str(number))
        step(spark, docs, str(tmp_path)).write.parquet(path)
        docs = spark.read.parquet(path)
        after = docs.collect()
        if number < 4:
            assert docs.columns == good.columns
        texts = sorted((r.doc_id, r.text) for r in after) if number < 4 else None
        if number == 0:
            assert set(map(tuple, after)) <= set(map(tuple, before))
        elif number == 1:
            assert len(after) == exact_brute_force(before)[1] == len({r.text.replace(" ", "").replace("\n", "").replace("\t", "") for r in after})
        elif number == 2:
            root = brute_components([brute_fingerprint(r.text) for r in before])
            least = {}
            for r, c in zip(before, root):
                least[c] = min(least.get(c, (1 << 60, "")), (r.doc_id, r.text))
            assert texts == sorted(least.values())
        elif number == 3:
            copies = {r.doc_id: r.copies for r in mixing.mixture(spark.read.parquet(str(tmp_path / "2"))).collect()}
            assert texts == sorted((r.doc_id, r.text) for r in before for _ in range(copies[r.doc_id]))
        else:
            words = bpe.loaded(open(tokenizer_file("word_bpe_49k.json"), encoding="utf-8").read())
            assert sorted((r.doc_id, tuple(r.ids)) for r in after) == sorted((r.doc_id, tuple(np.frombuffer(words.encode(r.text), "<u4").tolist())) for r in before)


def test_pipeline_stages_take_edge_rows_and_empty_tables(spark, edge_docs, no_docs, tmp_path):
    spark.createDataFrame([], LABELS).write.parquet(str(tmp_path / "labels.parquet"))
    for name, step in corpus_pipeline.STAGES:
        out = step(spark, edge_docs, str(tmp_path))
        out.count()
        if name != "bpe":
            assert out.columns == edge_docs.columns
        assert step(spark, no_docs, str(tmp_path)).count() == 0
    # Of the repeated rows one stays; rows without an id are judged by their text.
    exact = dict(corpus_pipeline.STAGES)["exact_dedup"](spark, edge_docs, str(tmp_path)).collect()
    texts = sorted((r.text or "").replace(" ", "").replace("\t", "").replace("\n", "") for r in exact)
    assert len(texts) == len(set(texts))
    near = dict(corpus_pipeline.STAGES)["simhash_near_dedup"](spark, edge_docs, str(tmp_path)).collect()
    assert len({r.text for r in near}) == len(near)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_run_applies_all_stages(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.columns[:2] == ["doc_id", "n_tokens"] and out.count() > 0
