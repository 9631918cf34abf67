"""Machine paths by a table of prefixes, a set of its own for every machine.

Prefixes are probed by joins: every place of a text where a prefix could begin gives the
strings of growing length that begin there, for the lengths that its machine's table has
under the same first two characters, and those are looked up by equality. No prefix is part
of the plan, so a table may hold any number.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def replaced(text: str, found: list[tuple[int, str, str]]) -> str:
    """``text`` with (start, prefix, placeholder) replaced: longer prefixes first, then from the
    left; what overlaps an earlier choice stays."""
    taken: list[tuple[int, int, str]] = []
    for start, prefix, new in sorted(found, key=lambda f: (-len(f[1]), f[0], f[1])):
        stop = start + len(prefix)
        k = bisect_left(taken, (start,))
        if (k == 0 or taken[k - 1][1] <= start) and (k == len(taken) or taken[k][0] >= stop):
            insort(taken, (start, stop, new))
    out, at = [], 0
    for start, stop, new in taken:
        out += [text[at:start], new]
        at = stop
    return "".join([*out, text[at:]])


def scrub_by_table(rows: DataFrame, prefixes: DataFrame) -> DataFrame:
    """``(id, text)`` of ``rows (id, machine, text)`` with the prefixes of their machine replaced.

    ``prefixes`` are ``(machine, prefix, placeholder)``; empty ones and the bare root are left
    out, and of a prefix given twice the least placeholder counts. The result is that of
    replacing the machine's prefixes one after the other, longest first. Ids must differ;
    null texts stay null.
    """
    table = (prefixes.where("prefix is not null and prefix <> '' and prefix <> '/'").groupBy("machine", "prefix").agg(F.min("placeholder").alias("placeholder")))
    # At most as many rows as there are characters; and one number.
    firsts = [r[0] for r in table.select(F.substring("prefix", 1, 1)).distinct().toLocalIterator()]
    longest = table.agg(F.max(F.length("prefix"))).first()[0]
    if not firsts:
        return rows.select("id", "text")
    starts = "[" + "".join(map(re.escape, firsts)) + "]"
    pieces = F.regexp_extract_all("text", F.lit(f"(?s)(?=({starts}.{{0,{longest - 1}}}))"), F.lit(1))
    # Where each piece begins: after what lies before it, cut at the same places.
    cuts = F.transform(F.split("text", f"(?={starts})"), lambda x: F.length(x))
    places = (rows.where("text is not null").select("id", "machine", F.posexplode(pieces).alias("nth", "piece"), cuts.alias("cuts"), F.substring("text", 1, 1).rlike(starts).alias("at_once"))
              .withColumn("start", F.aggregate(F.slice("cuts", 1, F.col("nth") + F.when(F.col("at_once"), 0).otherwise(1)), F.lit(0), lambda s, x: s + x)))
    heads = table.groupBy("machine", F.substring("prefix", 1, 2).alias("head")).agg(F.collect_set(F.length("prefix")).alias("sizes"))
    probes = (places.select("id", "machine", "start", "piece", F.substring("piece", 1, 2).alias("head")).join(heads, ["machine", "head"])
              .select("id", "machine", "start", "piece", F.explode("sizes").alias("size")).where(F.length("piece") >= F.col("size"))
              .select("id", "machine", "start", F.col("piece").substr(F.lit(1), F.col("size")).alias("prefix")))
    found = probes.join(table, ["machine", "prefix"]).groupBy("id").agg(F.collect_list(F.struct("start", "prefix", "placeholder")).alias("found"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = [t if not f else replaced(t, [(x["start"], x["prefix"], x["placeholder"]) for x in f]) for t, f in zip(batch.column("text").to_pylist(), batch.column("found").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(new, pa.string())], names=["id", "text"])

    both = rows.select("id", "text").join(found, "id", "left")
    return both.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, text string")
