"""SimHash near-dedup: fingerprints, compared exactly in tiles.

1. A 64-bit fingerprint per text (Arrow batches), staged: 16 bytes a row from here on.
2. Equal fingerprints become one node, so copies never meet each other again.
3. Nodes are dealt into bands by population count. Two fingerprints within the radius
   differ by at most the radius in their counts, so only bands that near meet; a band of
   more than ``chunk`` nodes is cut by hash. One task compares one pair of chunks:
   tiles of the chunks are compared by numpy exclusive-or and bit counts, and a tile
   pair is skipped when the counts of its four 16-bit quarters are further apart than
   the radius (the quarters' differences add up to no more than the distance).
4. A task hands on a spanning forest of its links, not the links: connectivity is kept,
   and a dense group of m fingerprints gives m - 1 rows.
5. Components by rounds of large-star and small-star, each round a written table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultscope.llm.common import ascii_lower, texts_of
from faultscope.staging import stage

RADIUS = 3
SHINGLE = 3
SEED = 42
CHUNK = 16_384
TILE = 256


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """SimHash of a text: a bit is set when over half of the shingle hashes set it."""
    import xxhash

    words = ascii_lower(text).split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(line, SEED)
    stops = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], stops[:-shingle])).tolist()
    digest, seed = xxhash.xxh64_intdigest, SEED
    hashes = np.array([digest(line[a:b], seed) for a, b in zip(starts, (stops[shingle - 1:] - 1).tolist())], "<u8")
    ones = np.zeros(64, np.int64)
    for part in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[part:part + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id, ``fp``, the fingerprint as a signed long, and ``key``, a hash of the text."""
    def run(batches):
        for batch in batches:
            prints = np.fromiter((fingerprint(t, shingle) for t in (x.as_py() for x in batch.column("text"))), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array(prints.view(np.int64))], names=["doc_id", "key", "fp"])

    rows = texts_of(docs, id_col, text_col).withColumn("key", F.xxhash64("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, key long, fp long")


class Forest:
    """Sets of numbered nodes that links join.

    ``links`` gets the roots of two sets whenever a link joins them: as many rows as
    nodes at most, and connected in the same way as all the links.
    """

    def __init__(self, n: int):
        self.root = np.arange(n)
        self.links: list[tuple[int, int]] = []

    def _find(self, x: int) -> int:
        root = self.root
        while root[x] != x:
            root[x] = root[root[x]]
            x = int(root[x])
        return x

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while (self.root[self.root] != self.root).any():
            self.root = self.root[self.root]
        ra, rb = self.root[a], self.root[b]
        apart = ra != rb
        for x, y in np.unique(np.stack([ra[apart], rb[apart]], axis=1), axis=0).tolist():
            x, y = self._find(x), self._find(y)
            if x != y:
                self.root[max(x, y)] = min(x, y)
                self.links.append((x, y))


def _sorted_by_quarters(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the fingerprints by the counts of their quarters, and those counts."""
    quarters = np.bitwise_count(np.ascontiguousarray(fps).view("<u2").reshape(-1, 4)).astype(np.int16)
    order = np.lexsort(quarters.T[::-1])
    return order, quarters[order]


def _boxes(quarters: np.ndarray, tile: int) -> tuple[np.ndarray, np.ndarray]:
    starts = np.arange(0, len(quarters), tile)
    return np.minimum.reduceat(quarters, starts), np.maximum.reduceat(quarters, starts)


def linked_in_tiles(left: np.ndarray, right: np.ndarray | None, radius: int = RADIUS, tile: int = TILE) -> np.ndarray:
    """Forest of the links between two lists of distinct fingerprints, or inside one.

    It connects what the links connect. Returns pairs of fingerprints (n, 2). Memory is bounded by one pair of tiles.
    """
    a_order, a_q = _sorted_by_quarters(left)
    a = left[a_order]
    b, b_q, shift = (a, a_q, 0) if right is None else (None, None, len(a))
    if right is not None:
        b_order, b_q = _sorted_by_quarters(right)
        b = right[b_order]
    if not len(a) or not len(b):
        return np.zeros((0, 2), np.uint64)
    (a_low, a_high), (b_low, b_high) = _boxes(a_q, tile), _boxes(b_q, tile)
    forest = Forest(len(a) + (0 if right is None else len(b)))
    for i in range(len(a_low)):
        gap = np.maximum(0, np.maximum(b_low - a_high[i], a_low[i] - b_high)).sum(axis=1)
        near = np.flatnonzero(gap <= radius)
        for j in near[near >= i] if right is None else near:
            x, y = a[i * tile:(i + 1) * tile], b[j * tile:(j + 1) * tile]
            close = np.bitwise_count(x[:, None] ^ y[None, :]) <= radius
            if right is None and i == j:
                close = np.triu(close, 1)
            if close.any():
                p, q = np.nonzero(close)
                forest.join(p + i * tile, q + j * tile + shift)
    nodes = a if right is None else np.concatenate([a, b])
    return nodes[np.array(forest.links, np.int64).reshape(-1, 2)]


def links(nodes: DataFrame, radius: int = RADIUS, chunk: int = CHUNK) -> DataFrame:
    """Pairs (u, v) of fingerprints that connect what links within the radius connect."""
    banded = nodes.select("fp", F.bit_count("fp").cast("int").alias("band"))
    # At most 65 rows, whatever the input.
    cuts = stage(banded.groupBy("band").agg(F.ceil(F.count("*") / chunk).cast("int").alias("cuts")), "bands")
    # Which pairs of chunks (p, i), (q, j) meet, and which chunk is which side of a pair.
    low, high = cuts.select(F.col("band").alias("p"), F.col("cuts").alias("n")), cuts.select(F.col("band").alias("q"), F.col("cuts").alias("m"))
    pairs = (low.withColumn("q", F.explode(F.sequence(F.col("p"), F.col("p") + radius))).join(F.broadcast(high), "q")
             .withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
             .withColumn("j", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
             .where("p < q or i <= j").select("p", "i", "q", "j"))
    left = pairs.withColumns({"band": F.col("p"), "part": F.col("i"), "side": F.lit(0)})
    right = pairs.where("p < q or i < j").withColumns({"band": F.col("q"), "part": F.col("j"), "side": F.lit(1)})
    chunks = banded.join(F.broadcast(cuts), "band").select("fp", "band", F.pmod(F.xxhash64("fp"), F.col("cuts").cast("long")).cast("int").alias("part"))

    def compare(table: pa.Table) -> pa.Table:
        fp, side = table["fp"].to_numpy().view(np.uint64), table["side"].to_numpy()
        second = fp[side == 1]
        found = linked_in_tiles(fp[side == 0], second if len(second) else None, radius)
        return pa.table({"u": found[:, 0].copy().view(np.int64), "v": found[:, 1].copy().view(np.int64)})

    met = chunks.join(left.unionByName(right), ["band", "part"])
    return met.select("p", "i", "q", "j", "side", "fp").groupBy("p", "i", "q", "j").applyInArrow(compare, "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of an edge list (u, v); root is the smallest node reachable.

    Large-star then small-star until every node points at its root and no root points on.
    Each round is two small shuffles and a written table; rounds grow with the logarithm
    of the longest chain. Minima combine before the shuffle and hubs are split by the skew join.
    """
    edges = stage(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = stage(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "low")
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = stage(large, "large")
        low = stage(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        linked = large.join(low, "u")
        small = linked.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        edges = stage(small.distinct(), "edges")
        open_ends = edges.join(edges.select(F.col("u").alias("v")).distinct(), "v", "left_semi")
        split = edges.groupBy("u").agg(F.count("*").alias("n")).where("n > 1")
        if open_ends.isEmpty() and split.isEmpty():
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS,
                    shingle: int = SHINGLE, chunk: int = CHUNK) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id, kept, key.

    Fingerprints within ``radius`` bits are linked; component_id is the smallest doc_id
    reachable over links. ``kept`` marks the row of a component that stays, the first by
    doc_id (null last) and ``key``, a hash of the text; rows that repeat both are marked
    alike. Null and empty texts have fingerprint zero and are linked like any other. A
    null doc_id takes part and is never a component_id unless its component has no other.
    Other columns are not read. An empty table gives an empty result.
    """
    own = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")
    prints = stage(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    nodes = stage(prints.groupBy("fp").agg(F.min(own).alias("first"), F.count("*").alias("n")), "nodes")
    roots = components(links(nodes, radius, chunk))
    # Per fingerprint of more than one row or with a link: its root; a root is its own.
    rooted = stage(nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", "n", F.coalesce("root", "fp").alias("root")), "rooted")
    least = stage(rooted.groupBy("root").agg(F.min("first").alias("stays"), F.sum("n").alias("rows")).where("rows > 1"), "least")
    named = stage(rooted.join(least, "root").select("fp", "stays"), "components")
    out = prints.join(named, "fp", "left")
    alone = F.col("stays").isNull()
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                      F.when(alone, F.col("doc_id")).otherwise(F.col("stays.doc_id")).alias("component_id"),
                      (alone | F.col("stays").eqNullSafe(own)).alias("kept"), "key")
