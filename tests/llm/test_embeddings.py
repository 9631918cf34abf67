"""Embedding near-dedup against all pairs."""

import numpy as np
import pytest

from faultscope.llm import embedding_dedup as dedup

ROWS = "vec_id long, embedding array<double>, label int, node int, n int"


def brute(rows, threshold=0.93):
    def fits(v, label):
        return label is not None and v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v)

    ok = [fits(r[1], r[2]) for r in rows]
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if ok[a] and ok[b] and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
                x, y = (np.array(rows[k][1], float) / np.abs(np.array(rows[k][1], float)).max() for k in (a, b))
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
                    links[a] += 1
                    links[b] += 1
                    root[max(find(a), find(b))] = min(find(a), find(b))
    least = {}
    for k, r in enumerate(rows):
        least.setdefault(find(k), []).append((r[0] is None, r[0] or 0, r[0]))
    out = []
    for k, r in enumerate(rows):
        component = min(least[find(k)])[2]
        out.append((r[0], links[k], component, r[0] == component))
    return sorted(out, key=repr)


def found(df):
    return sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in df.collect()), key=repr)


def clouds(seed, n=260, dims=24):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(30, dims))
    out = []
    for k in range(n):
        v = centres[rng.integers(30)] + rng.normal(size=dims) * rng.choice([0.0, 0.1, 0.25, 0.4])
        out.append((int(n - k) * 3, (v * 10.0 ** rng.integers(-3, 4)).tolist(), int(rng.choice([0, 0, 0, 1, 2])), 1, 1))
    return out


@pytest.mark.parametrize("bits, tile", [(11, 256), (4, 5)])
def test_links_and_components(spark, bits, tile):
    rows = clouds(1)
    got = dedup.near_vectors(spark.createDataFrame(rows, ROWS).repartition(6), chunk_bits=bits, tile=tile)
    assert found(got) == brute(rows)


def test_vectors_that_link_with_nothing(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(1, v, 0, 0, 0), (2, v, 0, 0, 0), (2, v, 0, 0, 0), (3, None, 0, 0, 0), (4, [0.0, 0.0, 0.0], 0, 0, 0), (5, [1.0, None, 3.0], 0, 0, 0),
            (6, [1.0, float("nan"), 1.0], 0, 0, 0), (7, [1.0, float("inf"), 1.0], 0, 0, 0), (8, v, None, 0, 0), (9, v, None, 0, 0), (10, v, 1, 0, 0),
            (11, [1.0, 2.0], 0, 0, 0), (12, [2.0, 4.0], 0, 0, 0), (13, [], 0, 0, 0), (14, [], 0, 0, 0), (None, v, 0, 0, 0), (None, [9.0, 0.0, -1.0], 0, 0, 0),
            (15, [1e300, 2e300, 3e300], 0, 0, 0), (16, [1e-300, 2e-300, 3e-300], 0, 0, 0), (17, [-1.0, -2.0, -3.0], 0, 0, 0), (18, [-0.0, 5.0, 0.0], 3, 0, 0), (19, [0.0, 5.0, 0.0], 3, 0, 0)]
    frame = spark.createDataFrame(rows, ROWS)
    want = [(i, n, c, i == c) for i, n, c, _ in brute(rows)]
    assert found(dedup.near_vectors(frame)) == want
    assert dedup.near_vectors(frame.where("false")).count() == 0
    assert found(dedup.near_vectors(frame.where("vec_id in (3, 4)"))) == [(3, 0, 3, True), (4, 0, 4, True)]


def test_bounds_stop_early_and_lose_nothing():
    rng = np.random.default_rng(7)
    vectors = rng.normal(size=(300, 64)) * np.linspace(3, 0.05, 64)
    vectors[1::3] = vectors[::3] + rng.normal(size=(100, 64)) * 0.15
    u = dedup.units(vectors)
    axes = dedup.axes_of(u.T @ u)
    rotated = dedup.Rotated(vectors, axes)
    p, q = dedup.linked_in_tile(rotated, slice(0, 300), rotated, slice(0, 300), same=True)
    want = np.argwhere(np.triu(u @ u.T >= 0.93, 1))
    assert sorted(zip(p.tolist(), q.tolist())) == sorted(map(tuple, want.tolist()))
    # After eight of 64 axes most pairs are settled.
    first = rotated.turned[:, :8] @ rotated.turned[:, :8].T + np.outer(rotated.suffix[8], rotated.suffix[8])
    assert (first >= 0.93).mean() < 0.5


def test_pairs_of_chunks_reach_as_far_as_links_do(spark):
    rng = np.random.default_rng(2)
    low = rng.uniform(-1, 0.8, size=(40, 2))
    high = low + rng.uniform(0, 0.5, size=(40, 2))
    chunks = spark.createDataFrame([(1, 2, k, low[k].tolist(), high[k].tolist()) for k in range(40)], "label int, dims int, chunk long, low array<double>, high array<double>")
    got = sorted((r.p, r.q) for r in dedup.chunk_pairs(chunks, 0.3).collect())
    want = [(a, b) for a in range(40) for b in range(a, 40) if (np.maximum(0, np.maximum(low[a] - high[b], low[b] - high[a])) ** 2).sum() <= 0.09 + 1e-9]
    assert got == want
