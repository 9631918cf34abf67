"""Exact and near duplicates against brute force."""

import hashlib
import random
import re

import numpy as np
import xxhash

from faultscope.llm import exact_dedup, simhash
from tests.llm.conftest import DOCS


def random_docs(spark, n=300, seed=2):
    rnd = random.Random(seed)
    words = [f"w{k}" for k in range(40)]
    base = [" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 60))) for _ in range(40)]
    rows = []
    for k in range(n):
        text = rnd.choice(base)
        if rnd.random() < 0.4:
            text = text.replace(" ", rnd.choice(["  ", "\n", "\t "]), rnd.randint(1, 3))
        if rnd.random() < 0.3:
            text += " " + rnd.choice(words)
        rows.append((k * 7 % n, text, None, None, len(text)))
    return spark.createDataFrame(rows, DOCS).repartition(20)


def exact_brute_force(rows):
    groups = {}
    for r in rows:
        text = r.text or ""
        groups.setdefault(re.sub("[\x20\x09-\x0d]", "", text), []).append((-len(text), r.doc_id is None, r.doc_id or 0, r.doc_id))
    out = []
    for norm, members in groups.items():
        keep = min(members)[3]
        sha = hashlib.sha256(norm.encode()).hexdigest()
        out += [(m[3], keep, len(members), sha) for m in members]
    return sorted(out, key=repr), len(groups)


def test_exact_duplicates(spark, edge_docs, no_docs):
    for docs in (random_docs(spark), edge_docs):
        want, groups = exact_brute_force(docs.select("doc_id", "text").collect())
        for fan_in in (2, 16):
            got = exact_dedup.exact_duplicates(docs, fan_in=fan_in).collect()
            assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=repr) == want
            kept = [r for r in got if r.kept]
            assert len(kept) == groups and all(r.doc_id == r.keep_id for r in kept)
    assert exact_dedup.exact_duplicates(no_docs).count() == 0


def test_merging_uses_no_python(spark, edge_docs):
    plan = exact_dedup.merge_runs(exact_dedup.digest_rows(edge_docs), 300)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and plan.count("SortAggregate") >= 4


def brute_fingerprint(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[k:k + 3]) for k in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, radius=3):
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(prints)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return [find(k) for k in range(len(prints))]


def check_near(rows, got):
    prints = [brute_fingerprint(r.text) for r in rows]
    root = brute_components(prints)
    ids = {}
    for r, c in zip(rows, root):
        if r.doc_id is not None:
            ids[c] = min(ids.get(c, r.doc_id), r.doc_id)
    want = sorted(((r.doc_id, f"{p:016x}", ids.get(c)) for r, p, c in zip(rows, prints, root)), key=repr)
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got), key=repr) == want
    assert len({(r.component_id, r.doc_id, r.key) for r in got if r.kept}) == len(set(root))


def test_near_duplicates(spark, edge_docs, no_docs):
    for docs in (random_docs(spark), edge_docs):
        rows = docs.select("doc_id", "text").collect()
        check_near(rows, simhash.near_duplicates(docs).collect())
        check_near(rows, simhash.near_duplicates(docs, chunk=7).collect())
    assert simhash.near_duplicates(no_docs).count() == 0


def test_tiles_find_every_link():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    near = np.unique(np.concatenate([base] + [base ^ np.uint64(1 << int(a)) ^ np.uint64(1 << int(b)) for a, b in rng.integers(0, 63, (12, 2))]))
    a, b = near[::2], near[1::2]
    inside = simhash.linked_in_tiles(near, None, tile=16)
    assert _parts(near, inside) == _parts_brute(near)
    across = np.concatenate([simhash.linked_in_tiles(a, b, tile=16), simhash.linked_in_tiles(a, None), simhash.linked_in_tiles(b, None)])
    assert _parts(near, across) == _parts_brute(near)


def _parts(nodes, links):
    root = {int(n): int(n) for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for u, v in links.tolist():
        root[find(u)] = find(v)
    groups = {}
    for n in root:
        groups.setdefault(find(n), set()).add(n)
    return sorted(map(sorted, groups.values()))


def _parts_brute(nodes):
    values = nodes.tolist()
    groups = {}
    for n, c in zip(values, brute_components(values)):
        groups.setdefault(c, set()).add(n)
    return sorted(map(sorted, groups.values()))


def test_components_of_a_chain_and_a_hub(spark):
    chain = [(k, k + 1) for k in range(100, 160)]
    hub = [(5, k) for k in range(6, 60)] + [(3, 5)]
    edges = spark.createDataFrame(chain + hub, "u long, v long")
    got = {r.node: r.root for r in simhash.components(edges).collect()}
    assert got == {**{k: 100 for k in range(101, 161)}, **{k: 3 for k in range(5, 60)}}
