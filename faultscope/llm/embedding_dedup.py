"""Embedding near-dedup: exact cosine links, compared in tiles in the order of principal axes.

1. Equal vectors of a label become one node that carries their number, so copies never
   meet each other again.
2. The covariance of all unit nodes is summed in the tasks; its eigenvectors, largest first,
   are the axes. A rotation changes no cosine, so the axes decide speed alone, never a link.
3. Nodes are sorted by label and leading coordinate over the whole table and cut into
   chunks of consecutive nodes. Unit vectors of cosine t are no further apart than
   sqrt(2 - 2t), so chunks whose boxes over the leading axes are further apart don't meet.
4. One task step compares one pair of chunks, tile by tile: products over the leading axes
   first; what the rest can add is bounded by the product of the suffix norms. A tile ends as
   soon as no pair of it can reach the threshold, and later axes are read for the pairs that
   still can only. Those that remain are decided by their cosine over the given components.
5. A pair of chunks hands on the number of links per node and a spanning forest of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultscope.llm.simhash import Forest, components
from faultscope.staging import stage

THRESHOLD = 0.93
CHUNK_BITS = 11
TILE = 256
#: Axes whose ranges make the box of a chunk.
BOX = 8
#: Rounding of a product of unit vectors; a bound this near to the threshold decides nothing.
SLACK = 1e-9


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Rows as doubles, each divided by its largest absolute component, so that norms neither overflow nor vanish."""
    vectors = np.asarray(vectors, np.float64)
    return vectors / np.abs(vectors).max(axis=1, keepdims=True)


def units(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.sqrt(np.einsum("ij,ij->i", vectors, vectors))[:, None]


def axes_of(moment: np.ndarray) -> np.ndarray:
    """Columns are the eigenvectors of a symmetric matrix, largest eigenvalue first."""
    return np.linalg.eigh(moment)[1][:, ::-1]


def steps_of(dims: int, first: int = 8) -> list[tuple[int, int]]:
    """Cuts of the axes, each twice as wide as the one before."""
    cuts, width = [0], first
    while cuts[-1] < dims:
        cuts.append(min(dims, cuts[-1] + width))
        width = cuts[-1]
    return list(zip(cuts, cuts[1:]))


class Rotated:
    """Nodes of a chunk: scaled vectors, unit vectors on the axes, suffix norms at every cut."""

    def __init__(self, vectors: np.ndarray, axes: np.ndarray | None):
        self.plain = scaled(vectors)
        self.norm = np.sqrt(np.einsum("ij,ij->i", self.plain, self.plain))
        self.turned = self.plain / self.norm[:, None]
        if axes is not None:
            self.turned = self.turned @ axes
        square = self.turned ** 2
        self.suffix = {b: np.sqrt(square[:, b:].sum(axis=1)) for _, b in steps_of(vectors.shape[1])}

    def __len__(self) -> int:
        return len(self.plain)


def linked_in_tile(a: Rotated, i: slice, b: Rotated, j: slice, threshold: float = THRESHOLD, same: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers (p, q) inside two tiles whose cosine reaches the threshold; p < q if they are the same tile."""
    x, y = a.turned[i], b.turned[j]
    p = q = partial = None
    for low, high in steps_of(x.shape[1]):
        if p is None:
            product = x[:, low:high] @ y[:, low:high].T
            open_ = product + a.suffix[high][i][:, None] * b.suffix[high][j][None, :] >= threshold - SLACK
            if same:
                open_ = np.triu(open_, 1)
            p, q = np.nonzero(open_)
            partial = product[p, q]
        else:
            partial = partial + np.einsum("ij,ij->i", x[p, low:high], y[q, low:high])
            keep = partial + a.suffix[high][i][p] * b.suffix[high][j][q] >= threshold - SLACK
            p, q, partial = p[keep], q[keep], partial[keep]
        if not len(p):
            return p, q
    cosine = np.einsum("ij,ij->i", a.plain[i][p], b.plain[j][q]) / (a.norm[i][p] * b.norm[j][q])
    keep = cosine >= threshold
    return p[keep], q[keep]


def links_of_chunks(a: Rotated, a_n: np.ndarray, b: Rotated | None, b_n: np.ndarray | None, threshold: float = THRESHOLD,
                    tile: int = TILE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links per node of a, of b (weighted by the rows of the other node) and forest pairs of node numbers, b's after a's."""
    inside = b is None
    right, right_n, shift = (a, a_n, 0) if inside else (b, b_n, len(a))
    forest = Forest(len(a) + (0 if inside else len(right)))
    of_a, of_b = np.zeros(len(a), np.int64), np.zeros(len(right), np.int64)
    for i in range(0, len(a), tile):
        for j in range(i if inside else 0, len(right), tile):
            p, q = linked_in_tile(a, slice(i, i + tile), right, slice(j, j + tile), threshold, inside and i == j)
            if len(p):
                p, q = p + i, q + j
                np.add.at(of_a, p, right_n[q])
                np.add.at(of_b, q, a_n[p])
                forest.join(p, q + shift)
    if inside:
        of_a, of_b = of_a + of_b, of_b[:0]
    return of_a, of_b, np.array(forest.links, np.int64).reshape(-1, 2)


# ------------------------------------------------------------ over the table

def usable_rows(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, label, vector (array of doubles), key: digest of a vector that can link, else null."""
    vector = F.col(vector_col).cast("array<double>")
    fits = F.col(label_col).isNotNull() & vector.isNotNull() & F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))) & F.exists(vector, lambda v: v != 0)
    rows = table.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.when(fits, vector).alias("vector"))
    # Equal components print alike and different ones differently; zero has one sign.
    shown = F.concat_ws(",", F.transform("vector", lambda v: (v + F.lit(0.0)).cast("string")))
    return rows.withColumn("key", F.when(F.col("vector").isNotNull(), F.unhex(F.sha2(shown, 256))))


def principal_axes(nodes: DataFrame, dims: int) -> np.ndarray:
    """Axes of all nodes of ``dims`` components, from one dims x dims sum that tasks make."""
    def moments(batches):
        total = np.zeros((dims, dims))
        for batch in batches:
            if batch.num_rows:
                u = units(scaled(_matrix(batch.column("vector"), dims)))
                total += u.T @ u
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims)), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "row"])

    rows = nodes.where(F.size("vector") == dims).select("vector").mapInArrow(moments, "i long, row array<double>")
    sums = rows.select("i", F.posexplode("row").alias("j", "x")).groupBy("i", "j").agg(F.sum("x").alias("x"))
    moment = np.zeros((dims, dims))
    for i, j, x in sums.toLocalIterator():
        moment[i, j] = x
    return axes_of((moment + moment.T) / 2)


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(-1, dims)


def _coordinates(nodes: DataFrame, dims: int, axes: np.ndarray, box: int) -> DataFrame:
    """Adds ``lead``: the leading coordinates of a node (of other dimensions: its first components)."""
    lead = axes[:, :box]

    def run(batches):
        for batch in batches:
            out = []
            for v in (np.array(x, np.float64) for x in batch.column("vector").to_pylist()):
                u = units(scaled(v[None, :]))
                out.append((u @ lead if len(v) == dims else u[:, :box])[0].tolist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.float64()))], names=[*batch.schema.names, "lead"])

    return nodes.mapInArrow(run, nodes.withColumn("lead", F.array(F.lit(0.0))).schema)


def chunk_pairs(chunks: DataFrame, reach: float) -> DataFrame:
    """Pairs (p, q), p <= q, of chunks of a label and dimension whose boxes are within ``reach``.

    ``chunks`` has label, dims, chunk, low and high (arrays over the leading axes). Chunks
    meet over cells of the first axis as wide as the reach; a pair that shares several
    cells is taken in the first that both cover.
    """
    cell = lambda x: F.floor(x / reach).cast("int")
    left = chunks.select("label", "dims", F.col("chunk").alias("p"), F.col("low").alias("a_low"), F.col("high").alias("a_high"),
                         F.explode(F.sequence(cell(F.col("low")[0]), cell(F.col("high")[0] + reach))).alias("cell"))
    right = chunks.select("label", "dims", F.col("chunk").alias("q"), F.col("low").alias("b_low"), F.col("high").alias("b_high"),
                          F.explode(F.sequence(cell(F.col("low")[0]), cell(F.col("high")[0] + reach))).alias("cell"))
    both = left.join(right, ["label", "dims", "cell"]).where("p <= q")
    first = F.greatest(cell(F.col("a_low")[0]), cell(F.col("b_low")[0]))
    gap = F.zip_with(F.zip_with("a_low", "b_high", lambda x, y: x - y), F.zip_with("b_low", "a_high", lambda x, y: x - y), lambda x, y: F.greatest(x, y, F.lit(0.0)))
    square = F.aggregate(gap, F.lit(0.0), lambda s, g: s + g * g)
    return both.where((F.col("cell") == first) & (square <= reach * reach + SLACK)).select("p", "q")


def compare_chunks(nodes: DataFrame, pairs: DataFrame, axes: np.ndarray, dims: int, threshold: float, tile: int) -> DataFrame:
    """Rows (u, v, n): n links of node u where v is null, else a link u - v of the forest."""
    sides = pairs.select("p", "q", F.col("p").alias("chunk"), F.lit(0).alias("side")).unionByName(
        pairs.where("p < q").select("p", "q", F.col("q").alias("chunk"), F.lit(1).alias("side")))

    def compare(table: pa.Table) -> pa.Table:
        side = table["side"].to_numpy()
        out = []
        parts = []
        for s in (0, 1):
            part = table.filter(pa.array(side == s))
            if part.num_rows:
                vectors = np.stack([np.array(v, np.float64) for v in part["vector"].to_pylist()])
                parts.append((part["node"].to_numpy(), part["n"].to_numpy(), Rotated(vectors, axes if vectors.shape[1] == dims else None)))
        (a_id, a_n, a), (b_id, b_n, b) = parts[0], parts[1] if len(parts) > 1 else (None, None, None)
        of_a, of_b, forest = links_of_chunks(a, a_n, b, b_n, threshold, tile)
        ids = a_id if b is None else np.concatenate([a_id, b_id])
        counts = np.concatenate([of_a, of_b])
        some = np.flatnonzero(counts)
        out = pa.table({"u": np.concatenate([ids[some], ids[forest[:, 0]]]),
                        "v": pa.concat_arrays([pa.nulls(len(some), pa.int64()), pa.array(ids[forest[:, 1]], pa.int64())]),
                        "n": np.concatenate([counts[some], np.zeros(len(forest), np.int64)])})
        return out

    met = nodes.join(sides, "chunk").select("p", "q", "side", "node", "n", "vector")
    return met.groupBy("p", "q").applyInArrow(compare, "u long, v long, n long")


def near_vectors(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                 threshold: float = THRESHOLD, chunk_bits: int = CHUNK_BITS, tile: int = TILE, box: int = BOX) -> DataFrame:
    """One row per input row: vec_id, n_links, component_id, kept.

    Rows of one label are linked when the cosine of their vectors, in double precision, is at
    least ``threshold`` (above 0). Null labels, and vectors that are null, empty, zero or hold
    a null or non-finite component, link with nothing; vectors of different length don't
    either. ``n_links`` counts rows, copies and repeated ids too, but not the row itself.
    component_id is the smallest id reachable, nulls after all others; ``kept`` says that the
    id is its own component_id, so rows that repeat a smallest id are all kept. Other columns
    are not read. An empty table gives an empty result.
    """
    rows = stage(usable_rows(table, id_col, vector_col, label_col), "vectors")
    own = F.struct(F.col("vec_id").isNull().alias("no_id"), "vec_id")
    grouped = rows.where("key is not null").groupBy("label", "key").agg(F.count("*").alias("n"), F.min(own).alias("least"), F.first("vector").alias("vector"))
    nodes = stage(grouped, "vector-nodes")
    common = nodes.groupBy(F.size("vector").alias("dims")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dims").first()
    if common is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    dims = common["dims"]
    axes = principal_axes(nodes, dims)
    led = stage(_coordinates(nodes, dims, axes, box).withColumn("dims", F.size("vector")), "vector-coordinates")
    order = ["label", "dims", F.col("lead")[0], "key"]
    placed = stage(led.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("node", F.monotonically_increasing_id()), "vector-order")
    # Consecutive nodes; a place where the label or dimension changes parts a chunk.
    block = F.shiftright("node", chunk_bits)
    ranges = [F.coalesce(f(F.get("lead", k)), F.lit(0.0)) for f in (F.min, F.max) for k in range(box)]
    chunks = stage(placed.groupBy("label", "dims", block.alias("block")).agg(F.min("node").alias("chunk"), F.array(*ranges[:box]).alias("low"), F.array(*ranges[box:]).alias("high")), "vector-chunks")
    named = placed.withColumn("block", block).join(chunks.select("label", "dims", "block", "chunk"), ["label", "dims", "block"]).select("chunk", "node", "n", "vector")
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + SLACK
    found = stage(compare_chunks(named, chunk_pairs(chunks, reach), axes, dims, threshold, tile), "vector-links")
    counts = found.where("v is null").groupBy(F.col("u").alias("node")).agg(F.sum("n").alias("links"))
    roots = components(found.where("v is not null").select("u", "v")).withColumnRenamed("root", "__root")
    rooted = stage(placed.select("label", "key", "node", "n", "least").join(counts, "node", "left").join(roots, "node", "left")
                   .select("label", "key", "n", "least", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("__root", "node").alias("root")), "vector-roots")
    least = rooted.groupBy("root").agg(F.min("least").alias("first"))
    named = stage(rooted.join(least, "root").select(F.col("label").alias("__label"), F.col("key").alias("__key"), (F.col("links") + F.col("n") - 1).alias("links"), "first"), "vector-components")
    out = rows.join(named, (rows["label"] == named["__label"]) & (rows["key"] == named["__key"]), "left")
    component = F.when(F.col("first").isNull(), F.col("vec_id")).otherwise(F.col("first.vec_id"))
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id")).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
