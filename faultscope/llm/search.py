"""Ranked lexical search over a length-stratified index.

The index is cut into segments of documents, each about as much text as one step of a
task takes; texts are split once and never shuffled. A segment row holds one term: the
places of its documents and their counts; one more row holds ids and lengths. Sizes
of the whole table (documents, terms, documents of a term) are sums over segments.

Searching joins terms of items to segment rows by term. Then, segment by segment:

1. Documents of equal normaliser ``m`` are a stratum. Postings are sorted by stratum and
   count, so an impact is computed once per stratum and count.
2. The largest impact of a term in a stratum bounds what it can give there; their weighted
   sum over an item's terms bounds the item's scores in the stratum.
3. Strata are visited by falling bounds. The best scores found so far, in this and earlier
   segments of the task, give the score to beat; a stratum whose bound is below it is
   never scored. Scores are exact integers.

Each task hands on an item's best rows of all its segments; the last ranking sees those alone.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from faultscope.staging import stage

TOP = 50
#: Bytes of text and number of documents after which a segment ends.
SEGMENT_BYTES, SEGMENT_DOCS = 8 << 20, 4_096
#: Bytes of one text that are split at once.
PIECE = 4 << 20
#: Items that are searched together.
BLOCK = 512

# Bytes that no term has become blanks; A-Z become small.
_FOLD = bytes((c | 32 if 65 <= c <= 90 else c) if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def terms_of(text: str) -> Counter:
    """Terms of a whole text with their counts, as UTF-8."""
    data = text.encode().translate(_FOLD)
    if len(data) <= PIECE:
        return Counter(data.split())
    counts: Counter = Counter()
    start = 0
    while start < len(data):
        stop = data.find(b" ", min(len(data), start + PIECE))
        stop = len(data) if stop < 0 else stop
        counts.update(data[start:stop].split())
        start = stop
    return counts


class _Segment:
    """Postings of the documents read so far."""

    def __init__(self):
        self.numbers: defaultdict = defaultdict()
        self.numbers.default_factory = self.numbers.__len__
        self.ids, self.lengths, self.distinct, self.size = [], [], [], 0
        self.terms: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []

    def add(self, doc_id, text: str) -> None:
        counts = terms_of(text)
        self.size += len(text)
        if counts:
            n = np.fromiter(counts.values(), np.int32, len(counts))
            self.terms.append(np.fromiter(map(self.numbers.__getitem__, counts), np.int32, len(counts)))
            self.counts.append(n)
            self.ids.append(doc_id)
            self.lengths.append(int(n.sum(dtype=np.int64)))
            self.distinct.append(len(counts))

    def batch(self, name: str, schema: pa.Schema) -> pa.RecordBatch:
        """Row of ids and lengths (term null), then a row per term."""
        term, count = np.concatenate(self.terms), np.concatenate(self.counts)
        place = np.repeat(np.arange(len(self.ids), dtype=np.int32), self.distinct)
        order = np.argsort(term, kind="stable")
        stops = np.cumsum(np.bincount(term, minlength=len(self.numbers)))
        m = len(self.ids)
        offsets = pa.array(np.concatenate(([0, m], m + stops)).astype(np.int32))
        no_ids = pa.array(np.concatenate(([0, m], np.full(len(stops), m))).astype(np.int32))
        none = pa.array(np.concatenate(([0, 0], stops)).astype(np.int32))
        values = pa.array(np.concatenate((np.array(self.lengths, np.int32), count[order])))
        return pa.RecordBatch.from_arrays([
            pa.array([name] * (len(stops) + 1)), pa.array([None, *(t.decode() for t in self.numbers)], pa.string()),
            pa.ListArray.from_arrays(no_ids, pa.array(self.ids, schema.field("ids").type.value_type)),
            pa.ListArray.from_arrays(none, pa.array(place[order])), pa.ListArray.from_arrays(offsets, values)], schema=schema)


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", segment_bytes: int = SEGMENT_BYTES, segment_docs: int = SEGMENT_DOCS) -> DataFrame:
    """The index as a written table: segment, term, ids, places, counts.

    A row without a term has the ids of the segment's documents and, as counts, their
    lengths; any other row has the places (0, 1, ...) of the documents that hold its term and
    how often. Documents without a term are left out: no search finds them.
    """
    kind = docs.schema[id_col].dataType
    schema = StructType([StructField("segment", StringType()), StructField("term", StringType()), StructField("ids", ArrayType(kind)),
                         StructField("places", ArrayType(IntegerType())), StructField("counts", ArrayType(IntegerType()))])
    arrow = to_arrow_schema(schema)

    def run(batches):
        from pyspark import TaskContext

        part, nth, segment = TaskContext.get().partitionId(), 0, _Segment()
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                segment.add(doc_id, text.as_py())
                if segment.size >= segment_bytes or len(segment.ids) >= segment_docs:
                    if segment.ids:
                        yield from _pieces(segment.batch(f"{part}-{nth}", arrow))
                    nth, segment = nth + 1, _Segment()
        if segment.ids:
            yield from _pieces(segment.batch(f"{part}-{nth}", arrow))

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where("text is not null")
    return stage(rows.mapInArrow(run, schema), "search-index")


def _pieces(batch: pa.RecordBatch, rows: int = 32_768) -> Iterator[pa.RecordBatch]:
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)


# ------------------------------------------------------------ items

def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, term, each once; the rows of a repeated item_id are one item."""
    def run(batches):
        for batch in batches:
            ids, terms = [], []
            for item, text in zip(batch.column("item_id").to_pylist(), batch.column("text")):
                found = terms_of(text.as_py())
                ids += [item] * len(found)
                terms += [t.decode() for t in found]
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.column("item_id").type), pa.array(terms, pa.string())], names=["item_id", "term"])

    rows = items.select(F.col(id_col).alias("item_id"), F.col(text_col).alias("text")).where("text is not null")
    return rows.mapInArrow(run, StructType([rows.schema["item_id"], StructField("term", StringType())])).distinct()


def weight(total, holding):
    """floor(1000 ln((2N + 2) / (2 df + 1)))"""
    return F.floor(1000 * F.log((2 * total + 2).cast("double") / (2 * holding + 1).cast("double"))).cast("long")


def impacts(count: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a term gives per unit of its weight, rounded down."""
    return 1_000_000_000 * count // (1_000 * count + 20 * m)


# ------------------------------------------------------------ one segment, one block of items

class Strata:
    """Documents of a segment grouped by their normaliser, with the postings of some terms."""

    def __init__(self, lengths: np.ndarray, documents: int, words: int, postings: list[tuple[np.ndarray, np.ndarray]]):
        m = 50 + np.array([50 * n * documents // words for n in lengths.tolist()], np.int64)
        self.m, self.stratum = np.unique(m, return_inverse=True)
        self.sizes = np.bincount(self.stratum, minlength=len(self.m))
        self.postings, self.most = [], np.zeros((len(postings), len(self.m)), np.int64)
        for t, (places, counts) in enumerate(postings):
            group = self.stratum[places]
            order = np.lexsort((counts, group))
            places, counts, group = places[order], counts[order], group[order]
            fresh = np.ones(len(places), bool)
            fresh[1:] = (np.diff(counts) != 0) | (np.diff(group) != 0)
            once = impacts(counts[fresh].astype(np.int64), self.m[group[fresh]])
            given = once[np.cumsum(fresh) - 1]
            self.postings.append((places, group, given))
            # Counts grow inside a stratum, so its last impact is the largest.
            last = np.flatnonzero(np.diff(group, append=-1))
            self.most[t, group[last]] = given[last]

    def best(self, terms: np.ndarray, weights: np.ndarray, top: int, beat: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Places and scores that may be among the best ``top``, and how many strata were scored.

        A document with a score below ``beat`` is not needed; one that equals it is.
        """
        bound = weights @ self.most[terms]
        order = np.argsort(-bound, kind="stable")
        reached = np.cumsum(self.sizes[order])
        places, scores, seen = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        goal = top
        while seen < len(order) and bound[order[seen]] >= max(beat, 1):
            until = max(seen + 1, int(np.searchsorted(reached, goal)) + 1)
            until = min(until, int(np.searchsorted(-bound[order], -max(beat, 1), side="right")))
            total, of = np.zeros(len(self.stratum), np.int64), np.zeros(len(self.m), bool)
            of[order[seen:until]] = True
            for t, w in zip(terms.tolist(), weights.tolist()):
                at, group, given = self.postings[t]
                some = of[group]
                total[at[some]] += w * given[some]
            found = np.flatnonzero(total >= max(beat, 1))
            places, scores = np.concatenate((places, found)), np.concatenate((scores, total[found]))
            if len(scores) >= top:
                beat = max(beat, int(np.partition(scores, len(scores) - top)[len(scores) - top]))
                some = scores >= beat
                places, scores = places[some], scores[some]
            seen, goal = until, 4 * (int(reached[until - 1]) + top)
        return places, scores, seen


class _Best:
    """The best rows of one item over the segments of a task, ties included."""

    def __init__(self):
        self.rows: list[tuple[int, object]] = []
        self.beat = 1

    def add(self, scores: list[int], ids: list, top: int) -> None:
        self.rows += zip(scores, ids)
        if len(self.rows) > top:
            self.rows.sort(key=lambda r: (-r[0], r[1] is None, 0 if r[1] is None else r[1]))
            del self.rows[top:]
            self.beat = self.rows[-1][0]


def search(index: DataFrame, items: DataFrame, id_col: str = "item_id", text_col: str = "text", top: int = TOP, block: int = BLOCK) -> DataFrame:
    """item_id, rank, doc_id, score of every item's ``top`` best documents of a ``build_index`` table.

    Equal scores rank by ascending doc_id, nulls last. Null and empty texts have no terms and
    find nothing; rows that repeat an item_id are one item; repeated documents rank one by
    one. Only scores above 0 count. An empty table on either side gives an empty result.
    """
    terms = stage(item_terms(items, id_col, text_col), "item-terms")
    item_count = terms.select("item_id").distinct().count()
    lengths = index.where("term is null")
    sums = lengths.agg(F.sum(F.size("counts")).alias("documents"), F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda s, x: s + x)).alias("words")).first()
    kind = index.schema["ids"].dataType.elementType
    item_kind = terms.schema["item_id"].dataType
    schema = StructType([StructField("item_id", item_kind), StructField("doc_id", kind), StructField("score", LongType())])
    documents, words = sums["documents"] or 0, sums["words"] or 0
    blocks = max(1, -(-item_count // block))
    number = F.pmod(F.xxhash64("item_id"), F.lit(blocks))
    asked = terms.select("term").distinct()
    # Only what is asked for goes on; of a large vocabulary that is little.
    postings = stage(index.where("term is not null").join(asked, "term", "left_semi").select("term", "segment", "places", "counts"), "postings")
    held = stage(postings.groupBy("term").agg(F.sum(F.size("counts")).alias("df")).withColumn("w", weight(F.lit(documents), F.col("df"))).where("w > 0").select("term", "w"), "term-weights")
    wanted = (terms.join(held, "term").withColumn("block", number).groupBy("block", "term", "w")
              .agg(F.collect_list(F.struct("item_id")).alias("items")))
    no_ids = F.array().cast(index.schema["ids"].dataType)
    hits = postings.join(wanted, "term").select("block", "segment", no_ids.alias("ids"), "places", "counts", "w", "items")
    no_items = F.array().cast(hits.schema["items"].dataType)
    frames = lengths.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"), "segment", "ids", "places", "counts", F.lit(-1).cast("long").alias("w"), no_items.alias("items"))
    together = frames.unionByName(hits).repartition("block", "segment").sortWithinPartitions("block", "segment", "w")
    arrow = to_arrow_schema(schema)

    def run(batches):
        best: dict = {}
        at, ids, sizes, postings, by_item = None, None, None, [], {}
        current = None

        def score() -> None:
            if not postings:
                return
            strata = Strata(sizes, documents, words, postings)
            for item, pairs in by_item.items():
                mine = best.setdefault(item, _Best())
                t, w = np.array(pairs, np.int64).T
                places, scores, _ = strata.best(t, w, top, mine.beat)
                if len(places):
                    mine.add(scores.tolist(), ids.take(pa.array(places)).to_pylist(), top)

        def handed():
            out = [(item, doc, s) for item, x in best.items() for s, doc in x.rows]
            best.clear()
            for k in range(0, len(out), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out[k:k + 10_000]), arrow)], schema=arrow)

        for batch in batches:
            columns = {c: batch.column(c) for c in batch.schema.names}
            for k, (b, segment, w) in enumerate(zip(*(columns[c].to_pylist() for c in ("block", "segment", "w")))):
                if (b, segment) != at:
                    score()
                    if current is not None and b != current:
                        yield from handed()
                    at, current, postings, by_item = (b, segment), b, [], {}
                if w < 0:
                    ids, sizes = columns["ids"][k].values, columns["counts"][k].values.to_numpy()
                else:
                    for x in columns["items"][k].as_py():
                        by_item.setdefault(x["item_id"], []).append((len(postings), w))
                    postings.append((columns["places"][k].values.to_numpy(), columns["counts"][k].values.to_numpy()))
        score()
        yield from handed()

    found = together.mapInArrow(run, schema)
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")


def ranked_search(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """``search`` over an index built of all ``docs``."""
    return search(build_index(docs), items, top=top)
