"""Language by rank-order profiles.

A profile is the list of the most frequent letter n-grams of a language, by rank. A text
is ranked in the same way and gets the language with the least out-of-place distance:
how far each of its n-grams is from its rank in the profile, a fixed penalty where the
profile lacks it. N-grams are one to three letters inside words, word edges included.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultscope.llm.common import held_out, slices, texts_of
from faultscope.staging import stage

#: Labelled rows per language that a profile is learnt from, at most about so many.
SAMPLE = 2_000
#: N-grams of a profile and of a text that are ranked.
TOP = 400
ORDER = 3
UNKNOWN = "und"
STEP = 1 << 20
#: Bits of a letter, enough for every code point; three letters fit a long.
_BITS = 21
#: Bits of a key of text number and n-gram.
_ROOM = 62
_EDGE = 32
#: Sharpness of the score: log odds per unit of distance over the largest possible.
_SHARP = 40.0


@functools.lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Symbol of every code point: itself for letters, else a blank."""
    points = np.arange(0x110000)
    is_letter = np.fromiter((chr(c).isalpha() for c in points.tolist()), bool, len(points))
    return np.where(is_letter, points, _EDGE).astype(np.int64)


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, n-gram, count) of every text, sorted by text and n-gram.

    Inside, letters are numbered by the alphabet of these texts, so that a text's number and
    an n-gram share one sortable key; texts of an alphabet too large for that are halved.
    """
    lowered = [f" {t.lower()} " for t in texts]
    symbols = _letters()[np.frombuffer("".join(lowered).encode("utf-32-le"), "<u4")]
    seen = np.zeros(0x110000, bool)
    seen[symbols] = True
    # Number 0 stands for no letter at all, as in the short n-grams.
    alphabet = np.concatenate(([0], np.flatnonzero(seen)))
    bits = len(alphabet).bit_length()
    if ORDER * bits + len(texts).bit_length() > _ROOM and len(texts) > 1:
        half = len(texts) // 2
        left, right = grams(texts[:half]), grams(texts[half:])
        return np.concatenate((left[0], right[0] + half)), np.concatenate((left[1], right[1])), np.concatenate((left[2], right[2]))
    number = np.zeros(0x110000, np.int64)
    number[alphabet[1:]] = np.arange(1, len(alphabet))
    symbols, edge = number[symbols], number[_EDGE]
    doc = np.repeat(np.arange(len(texts)), [len(t) for t in lowered])
    # Runs of blanks count as one edge.
    keep = np.ones(len(symbols), bool)
    keep[1:] = (symbols[1:] != edge) | (symbols[:-1] != edge) | (doc[1:] != doc[:-1])
    symbols, doc = symbols[keep], doc[keep]
    keys = []
    for n in range(1, ORDER + 1):
        if len(symbols) < n:
            break
        parts = [symbols[k:len(symbols) - n + 1 + k] for k in range(n)]
        good = doc[:len(doc) - n + 1] == doc[n - 1:]
        good &= parts[0] != edge if n == 1 else (parts[0] != edge) | (parts[1] != edge)
        for middle in parts[1:-1]:
            good &= middle != edge
        code = parts[0]
        for part in parts[1:]:
            code = code << bits | part
        keys.append((doc[:len(doc) - n + 1] << ORDER * bits | code)[good])
    key = np.sort(np.concatenate(keys)) if keys else np.zeros(0, np.int64)
    first = np.flatnonzero(np.diff(key, prepend=-1))
    count = np.diff(np.append(first, len(key)))
    key = key[first]
    gram = np.zeros(len(key), np.int64)
    for k in range(ORDER - 1, -1, -1):
        gram = gram << _BITS | alphabet[key >> k * bits & (1 << bits) - 1]
    return key >> ORDER * bits, gram, count


@dataclass
class Profiles:
    languages: list[str]
    grams: np.ndarray
    #: rank[gram, language]; TOP where a profile lacks the n-gram.
    rank: np.ndarray

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text; ``und`` without a letter or a profile."""
        doc, gram, count = grams(texts)
        order = np.lexsort((gram, -count, doc))
        doc, gram = doc[order], gram[order]
        rank = np.arange(len(doc)) - np.searchsorted(doc, doc, side="left")
        top = rank < TOP
        doc, gram, rank = doc[top], gram[top], rank[top]
        known = len(np.unique(doc))
        names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        if not known or not self.languages:
            return names, scores
        place = np.minimum(np.searchsorted(self.grams, gram), len(self.grams) - 1)
        found = self.grams[place] == gram
        apart = np.where(found[:, None], np.abs(self.rank[place] - rank[:, None]), TOP)
        starts = np.flatnonzero(np.diff(doc, prepend=-1))
        distance = np.add.reduceat(apart, starts, axis=0) / (TOP * np.diff(np.append(starts, len(doc))))[:, None]
        best = distance.argmin(axis=1)
        odds = np.exp(-_SHARP * (distance - distance.min(axis=1, keepdims=True)))
        scores[doc[starts]] = odds.max(axis=1) / odds.sum(axis=1)
        for k, b in zip(doc[starts].tolist(), best.tolist()):
            names[k] = self.languages[b]
        return names, scores


def learn(docs: DataFrame, limit: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Profiles:
    """Profiles of all languages among the rows outside the held-out fold.

    About ``limit`` rows per language, chosen by a hash of the id; all of rarer ones.
    N-grams are counted by tasks and added up by Spark; ``TOP`` of each language reach
    the driver.
    """
    key = F.col(id_col).alias("doc_id")
    known = docs.select(key, F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text is not null and lang is not null and doc_id is not null").where(~held_out(F.col("doc_id")))
    # The choice is made on ids and languages alone; texts meet no more than the ids chosen.
    narrow = known.select("doc_id", "lang")
    share = narrow.groupBy("lang").agg((limit / F.count("*")).alias("share"))
    ids = narrow.join(share, "lang").where(F.shiftrightunsigned(F.xxhash64(F.lit("profile"), "doc_id"), 33) < F.col("share") * (1 << 31))
    ids = stage(ids.select(F.col("doc_id").alias("__id")).distinct(), "profile-ids")
    chosen = known.join(ids, F.col("doc_id") == F.col("__id"), "left_semi")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", STEP):
                names, number = np.unique(np.array(part.column("lang").to_pylist(), object), return_inverse=True)
                doc, gram, n = grams(part.column("text").to_pylist())
                different, at = np.unique(gram, return_inverse=True)
                key, place = np.unique(number[doc] * len(different) + at, return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array(names[key // max(1, len(different))].tolist(), pa.string()), pa.array(different[key % max(1, len(different))]),
                                                  pa.array(np.bincount(place, weights=n).astype(np.int64))], names=["lang", "gram", "n"])

    total = chosen.select("lang", "text").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.col("n").desc(), "gram")
    top = stage(total.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < TOP), "profiles").toArrow()
    languages = sorted(set(top["lang"].to_pylist()))
    all_grams = np.unique(top["gram"].to_numpy()) if top.num_rows else np.zeros(1, np.int64)
    rank = np.full((len(all_grams), max(1, len(languages))), TOP, np.int64)
    for lang, gram, r in zip(top["lang"].to_pylist(), top["gram"].to_pylist(), top["rank"].to_pylist()):
        rank[np.searchsorted(all_grams, gram), languages.index(lang)] = r
    return Profiles(languages, all_grams, rank)


def identify_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score (0 to 1).

    Only the text enters a prediction. A null text and one without a letter are ``und``
    with score 0; so is every text when there is nothing to learn from. Equal distances
    go to the first language by code point. A row with a null doc_id is not held out and
    not learnt from. Repeated rows are predicted alike; other columns are not read.
    """
    profiles = docs.sparkSession.sparkContext.broadcast(learn(docs, sample, id_col, text_col, lang_col))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", STEP):
                names, scores = profiles.value.predict(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(names, pa.string()), pa.array(scores)], names=["doc_id", "lang_pred", "score"])

    rows = texts_of(docs, id_col, text_col)
    out = rows.mapInArrow(predict, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score")
