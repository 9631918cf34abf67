"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultscope.staging import stage

#: Bytes of text that one vectorised step takes at once; a longer text is a step of its own.
SLICE_BYTES = 4 << 20

#: White space of the word rule ``[^\x20\x09-\x0D]+``; exactly what ``bytes.split()`` drops.
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"


def texts_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator reads, under fixed names; a null text is empty."""
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """Whether a row belongs to the fold that nothing is learnt from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds == 0


def slices(batch: pa.RecordBatch, by: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that column ``by`` has about ``limit`` bytes in each piece."""
    sizes = np.asarray(pc.binary_length(batch.column(by)).fill_null(0), dtype=np.int64)
    piece = np.cumsum(sizes) // limit
    starts = np.flatnonzero(np.diff(piece, prepend=-1))
    for a, b in zip(starts, [*starts[1:], batch.num_rows]):
        yield batch.slice(int(a), int(b - a))


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text, null as 0, by built-in functions."""
    words = F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+"))
    return F.coalesce(words, F.lit(0)).cast("long")


def bounded_sample(rows: DataFrame, key: str, limit: int) -> DataFrame:
    """About ``limit`` rows, chosen by a hash of ``key``; all rows when there are fewer.

    The count is one pass over the key column; the choice depends on the key alone,
    so that a rerun or a lost executor chooses the same rows.
    """
    n = rows.count()
    if n <= limit:
        return rows
    cut = int((1 << 31) * (limit / n))
    return rows.where(F.shiftrightunsigned(F.xxhash64(F.lit("sample"), F.col(key)), 33) < cut)


def with_copies(docs: DataFrame, decided: DataFrame, id_col: str = "doc_id", key: Column | None = None, order: tuple[Column, ...] = (), once: bool = False) -> DataFrame:
    """The rows of ``docs``, each as often as ``decided`` says, with all their columns.

    ``decided`` has one row per row of ``docs``: doc_id, ``copies`` and, with ``key`` (an
    expression over ``docs``), also ``key``. Rows that share an id and a key share their
    copies: each gets the whole part, the first by ``order`` the remainder; with ``once``
    they count as one row, the first, and its copies are the most that any was given.
    Such ids are rare, and the ranking and the second scan they need are left out when
    there is none.
    """
    # Texts are shuffled once, by id, at every size: a list of ids that happens to be short
    # is not broadcast, so that a small run shows what a large one does.
    by = ["doc_id"] if key is None else ["doc_id", "key"]
    per = stage(decided.groupBy(*by).agg((F.max if once else F.sum)("copies").cast("long").alias("__copies"), F.count("*").alias("__rows"))
                .withColumn("__ids", F.count("*").over(Window.partitionBy("doc_id")))
                .withColumnsRenamed({"doc_id": "__id", "key": "__key"}), "copies")
    same = docs[id_col].eqNullSafe(F.col("__id"))
    columns = [docs[c] for c in docs.columns]
    repeated = (F.col("__rows") > 1) | (F.col("__ids") > 1)
    most = per.agg(F.max("__copies"), F.max(repeated.cast("int"))).first()
    single = per.where(~repeated)
    if (most[0] or 0) <= 1:
        # What goes is less than what stays: drop it.
        gone = per.where(repeated | (F.col("__copies") == 0))
        out = docs.join(gone.select("__id").distinct().hint("merge"), same, "left_anti")
    else:
        out = docs.join(single.where("__copies > 0").select("__id", "__copies").hint("merge"), same)
        out = out.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int")))).select(*columns)
    if not most[1]:
        return out
    some = per.where(repeated)
    match = same if key is None else same & key.eqNullSafe(F.col("__key"))
    rank = Window.partitionBy(*[F.col(c) for c in ("__id", "__key") if c in some.columns]).orderBy(*(order or (F.lit(0),)))
    several = docs.join(some, match).withColumn("__nth", F.row_number().over(rank))
    share = F.floor(F.col("__copies") / F.col("__rows")) + (F.col("__nth") <= F.col("__copies") % F.col("__rows")).cast("long")
    several = several.withColumn("__share", share).where("__share > 0")
    return out.unionByName(several.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__share").cast("int")))).select(*columns))


# ------------------------------------------------ hashed words, a whole batch at once

_WORD_BASE = np.uint64(0x9E3779B97F4A7C15)


def _inverse(odd: int) -> int:
    return pow(odd, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


class WordBatch:
    """The words of many texts as 64-bit hashes.

    ``data`` are the UTF-8 bytes of all texts, each followed by a blank; ``hashes[i]`` is
    the hash of word i, ``doc[i]`` the row of its text; text k has the words
    ``first[k]`` to ``first[k + 1]`` and the bytes ``starts[k]`` to ``ends[k] - 1``.
    """

    def __init__(self, texts: list[str]):
        parts = [t.encode() for t in texts]
        self.n_docs = len(parts)
        lengths = np.fromiter((len(p) + 1 for p in parts), np.int64, len(parts))
        self.ends = np.cumsum(lengths)
        self.starts = self.ends - lengths
        self.data = np.frombuffer(b" ".join(parts) + b" ", np.uint8) if parts else np.zeros(0, np.uint8)
        blank = (self.data == 32) | ((self.data >= 9) & (self.data <= 13))
        edge = np.diff(blank.astype(np.int8), prepend=np.int8(1), append=np.int8(1))
        starts, stops = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        n = len(self.data)
        with np.errstate(over="ignore"):
            # hash(word) = sum of byte * base**k, from prefix sums; the odd base has an inverse.
            power = np.empty(n + 1, np.uint64)
            power[0] = 1
            power[1:] = _WORD_BASE
            np.multiply.accumulate(power, out=power)
            prefix = np.zeros(n + 1, np.uint64)
            np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * power[:n], out=prefix[1:])
            back = np.empty(n + 1, np.uint64)
            back[0] = 1
            back[1:] = np.uint64(_inverse(int(_WORD_BASE)))
            np.multiply.accumulate(back, out=back)
            self.hashes = mix((prefix[stops] - prefix[starts]) * back[starts])
        self.doc = np.searchsorted(self.ends, starts, side="right")
        self.first = np.searchsorted(self.doc, np.arange(self.n_docs + 1))

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Hash of every two neighbouring words of a text, and the number of the first.

        A word that follows itself gives one hash, whatever the word.
        """
        left = np.flatnonzero(self.doc[:-1] == self.doc[1:])
        a, b = self.hashes[left], self.hashes[left + 1]
        with np.errstate(over="ignore"):
            both = mix(a * np.uint64(3) + b)
        both[a == b] = np.uint64(1)
        return both, left

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the ``n`` bytes from every position, and how many positions each text has."""
        wide = np.concatenate((self.data, np.zeros(n, np.uint8)))
        value = np.zeros(len(self.data), np.uint64)
        with np.errstate(over="ignore"):
            for k in range(n):
                value = value * np.uint64(257) + wide[k:k + len(self.data)]
            value *= np.uint64(0x9E3779B97F4A7C15)
        return value, np.maximum(0, self.ends - self.starts - n)


def sums_between(values: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Sum of ``values[start:stop]`` for each pair."""
    upto = np.zeros((len(values) + 1, *values.shape[1:]), np.float64)
    np.cumsum(values, axis=0, out=upto[1:])
    return upto[stops] - upto[starts]


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, limit: int, id_col: str = "doc_id", text_col: str = "text", skip_held_out: bool = True) -> DataFrame:
    """doc_id, text and ``label`` (0 or 1) of about ``limit`` labelled rows, whole texts.

    The labels are sampled by a hash of their doc_id, so the documents are read once and
    joined with a table of a bounded size. Rows without a label are left out, and, unless
    told otherwise, the fold that nothing is learnt from.
    """
    known = labels.select(F.col(id_col).alias("__id"), F.col(label).cast("int").alias("label")).where("label in (0, 1) and __id is not null")
    if skip_held_out:
        known = known.where(~held_out(F.col("__id")))
    known = bounded_sample(known, "__id", limit)
    return texts_of(docs, id_col, text_col).join(F.broadcast(known), F.col("doc_id") == F.col("__id")).select("doc_id", "text", "label")


def calibration_fold(doc_id: Column) -> Column:
    """A fifth of the rows, set apart to calibrate probabilities on."""
    return F.pmod(F.xxhash64(F.lit("calibrate"), doc_id), F.lit(5)) == 0


def ascii_lower(text: str) -> bytes:
    """UTF-8 bytes with A-Z in lower case and nothing else changed."""
    return text.encode().lower()
