"""JSON documents of any size and layout, cut into the elements of one list, block by block.

A file is read as pieces between closing braces, so a document on a single line is split
like any other and many tasks read it. What a byte means depends on all bytes before it:
whether it lies in a string, after a backslash, and how deep. So a block first yields a
map over these states (``block_maps``); the maps of a file, one row a block, are composed
from its start (``block_starts``). Knowing its start, each block finds the commas and
brackets down to the depth of the list and cuts there (``block_cuts``); what is left over
at its ends is joined with its neighbours' (``elements``).

No part of this holds a document: an element of the list, and any other member of the
object around it, must fit a row, or, if it is a list or object, each of its entries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from faultscope.staging import stage

_QUOTE, _BACKSLASH, _COMMA = b'"\\,'
_BLANK = " \t\n\r"
#: Marks instead of a bracket or comma: the start and the end of a file.
START, END = "^", "$"

_STEP = np.zeros(256, np.int8)
_STEP[[ord("["), ord("{")]] = 1
_STEP[[ord("]"), ord("}")]] = -1
_CUT = _STEP != 0
_CUT[_COMMA] = True


def scan(data: np.ndarray, escaped: bool) -> tuple[np.ndarray, bool]:
    """Whether each byte lies in a string, if the first does not start in one, and whether the
    byte after the last is escaped."""
    quote = data == _QUOTE
    if escaped or (data == _BACKSLASH).any():
        # A byte is escaped after an odd run of backslashes.
        slash, place = data == _BACKSLASH, np.arange(len(data))
        last = np.maximum.accumulate(np.where(slash, -1, place))
        run = np.where(last < 0, place + 1 + escaped, place - last)
        quote &= np.concatenate(([not escaped], run[:-1] % 2 == 0))
        escaped = bool(run[-1] % 2)
    else:
        escaped = False
    return np.cumsum(quote) % 2 == 1, escaped


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, bytes | None]]:
    """(first row of the block, bytes) for consecutive pieces of a block, then None at its end.

    Pieces get back the brace between them and the block the one at its end, unless its row
    says that the file ends without (``open_end``).
    """
    head = None

    def close():
        if not head.get("open_end"):
            yield head, b"}"
        yield head, None

    for batch in batches:
        stops = {int(x) for c in ("path", "block") for x in pc.run_end_encode(batch.column(c)).run_ends.to_pylist()}
        start = 0
        for stop in sorted(stops):
            row = {c: batch.column(c)[start].as_py() for c in batch.schema.names if c != "value"}
            text = b"}".join(batch.column("value")[start:stop].to_pylist())
            if head is not None and (row["path"], row["block"]) == (head["path"], head["block"]):
                text = b"}" + text
            else:
                if head is not None:
                    yield from close()
                head = row
            if text:
                yield head, text
            start = stop
    if head is not None:
        yield from close()


def read_pieces(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``(path, artifact, block, size, id, value)``: the text between closing braces, in the order of ``id``."""
    meta = F.col("_metadata")
    return spark.read.option("lineSep", "}").text(paths).select(
        meta["file_path"].alias("path"), meta["file_name"].alias("artifact"), meta["file_block_start"].alias("block"),
        meta["file_size"].alias("size"), F.monotonically_increasing_id().alias("id"), F.col("value").cast("binary").alias("value"))


_KINDS = {"string": T.StringType(), "long": T.LongType(), "int": T.IntegerType(), "boolean": T.BooleanType(), "binary": T.BinaryType(),
          "array<int>": T.ArrayType(T.IntegerType()), "array<long>": T.ArrayType(T.LongType())}


def _schema(fields: str) -> T.StructType:
    """A schema from names and kinds, before there is a session."""
    return T.StructType([T.StructField(*f.split(" ")[:1], _KINDS[f.split(" ")[1]]) for f in fields.split(", ")])


def _arrow(rows: list[tuple], schema: T.StructType) -> pa.RecordBatch:
    kinds = to_arrow_schema(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), kinds)], schema=kinds)


_MAPS = _schema("path string, artifact string, block long, size long, bytes long, first int, to array<int>, deeper array<long>")


def block_maps(pieces: DataFrame) -> DataFrame:
    """A row per block: where each of the four states at its start leads.

    A state is 1 in a string, plus 2 when the next byte is escaped. ``to`` has the state at
    the end and ``deeper`` the change of depth, both by the state at the start; ``first`` is
    the first byte that is no blank.
    """
    def run(batches):
        to, deeper, first, size = [0, 1, 2, 3], [0] * 4, None, 0
        for head, text in _blocks(batches):
            if text is None:
                yield _arrow([(head["path"], head["artifact"], head["block"], head["size"], size, first, to, deeper)], _MAPS)
                to, deeper, first, size = [0, 1, 2, 3], [0] * 4, None, 0
                continue
            size += len(text)
            if first is None and text.lstrip(_BLANK.encode()):
                first = text.lstrip(_BLANK.encode())[0]
            data = np.frombuffer(text, np.uint8)
            step = _STEP[data]
            found = {}
            for escaped in {s >> 1 for s in to}:
                inside, after = scan(data, bool(escaped))
                # By whether the first byte lies in a string.
                found[escaped] = (int(step[~inside].sum()), int(step[inside].sum())), int(inside[-1]), int(after)
            for s, at in enumerate(to):
                changes, flips, after = found[at >> 1]
                deeper[s] += changes[at & 1]
                to[s] = (at & 1 ^ flips) | after << 1

    return pieces.mapInArrow(run, _MAPS)


_STARTS = _schema("path string, block long, state int, depth long, limit int, last boolean, open_end boolean")


def block_starts(maps: DataFrame) -> DataFrame:
    """``(path, block, state, depth, limit, last, open_end)``: what each block starts in.

    ``limit`` is the depth of the list: 1 for a list, 2 for one inside an object. A file
    that begins with anything else, or with a byte order mark, has no row.
    """
    def run(batches):
        for batch in batches:
            for file in batch.to_pylist():
                blocks = file["blocks"]
                first = next((b["first"] for b in blocks if b["first"] is not None), None)
                over = sum(b["bytes"] for b in blocks) - file["size"]
                if first is None or chr(first) not in "[{" or over not in (0, 1):
                    continue
                state, depth, out = 0, 0, []
                for b in blocks:
                    last = b is blocks[-1]
                    out.append((file["path"], b["block"], state, depth, 1 if chr(first) == "[" else 2, last, last and over == 1))
                    depth += b["deeper"][state]
                    state = b["to"][state]
                yield _arrow(out, _STARTS)

    files = maps.groupBy("path").agg(F.first("size").alias("size"), F.sort_array(F.collect_list(F.struct("block", "bytes", "first", "to", "deeper"))).alias("blocks"))
    return files.mapInArrow(run, _STARTS)


_CUTS = _schema("path string, artifact string, block long, limit int, k long, before string, after string, depth long, holder long, kind string, text binary")


def block_cuts(pieces: DataFrame, starts: DataFrame) -> DataFrame:
    """The text between cuts: ``(path, artifact, block, limit, k, before, after, depth, holder, kind, text)``.

    Cuts are brackets and commas down to the depth ``limit``. ``k`` counts the cuts of the
    block so far, ``before`` and ``after`` are the characters cut at (null at the ends of a
    block, marks at the ends of the file), ``depth`` is that of the text. ``holder`` is the k
    right after the last bracket of the block that opened the lowest level, ``kind`` that bracket.
    """
    def cut(head, text, at):
        data = np.frombuffer(text, np.uint8)
        inside, escaped = scan(data, bool(at["state"] >> 1))
        if at["state"] & 1:
            inside = ~inside
        step = np.where(inside, 0, _STEP[data])
        depth = at["depth"] + np.cumsum(step, dtype=np.int64)
        places = np.flatnonzero(~inside & _CUT[data] & (depth <= head["limit"] - (step < 0)))
        # The state after the last byte: a closing quote is not inside, an opening one is.
        at["state"] = int(inside[-1]) | escaped << 1
        start = 0
        for place, deep in zip(places.tolist(), depth[places].tolist()):
            after = chr(data[place])
            yield (head["path"], head["artifact"], head["block"], head["limit"], at["k"], at["before"], after, at["level"], at["holder"], at["kind"],
                   at["tail"] + text[start:place])
            start, at["tail"] = place + 1, b""
            at["k"] += 1
            at["before"], at["level"] = after, deep
            if after in "[{" and deep == head["limit"]:
                at["holder"], at["kind"] = at["k"], after
        at["tail"] += text[start:]
        at["depth"] = int(depth[-1])

    def run(batches):
        out, size, at = [], 0, None
        for head, text in _blocks(batches):
            if at is None:
                at = {"state": head["state"], "depth": head["depth"], "level": head["depth"], "k": 0, "before": START if head["block"] == 0 else None,
                      "tail": b"", "holder": None, "kind": None}
            if text is None:
                out.append((head["path"], head["artifact"], head["block"], head["limit"], at["k"], at["before"], END if head["last"] else None, at["level"],
                            at["holder"], at["kind"], at["tail"]))
                at = None
            else:
                out += cut(head, text, at)
                size += len(text)
            if size > 1 << 22 or len(out) > 8192:
                if out:
                    yield _arrow(out, _CUTS)
                out, size = [], 0
        if out:
            yield _arrow(out, _CUTS)

    rows = pieces.join(starts, ["path", "block"]).select("path", "artifact", "block", "id", "value", "state", "depth", "limit", "last", "open_end")
    return rows.sortWithinPartitions("path", "block", "id").drop("id").mapInArrow(run, _CUTS)


def elements(cuts: DataFrame) -> DataFrame:
    """Whole texts between cuts: ``(path, artifact, block, k, limit, before, after, depth, holder, kind, text)``.

    Cut texts at the ends of blocks are joined with what follows them, under the block and
    number of their first part.
    """
    cuts = cuts.withColumn("text", F.make_valid_utf8(F.col("text").cast("string")))
    whole = F.col("before").isNotNull() & F.col("after").isNotNull()
    # Two rows a block at most: the text after its last cut and that before its first.
    so_far = Window.partitionBy("path").orderBy("block", "k").rowsBetween(Window.unboundedPreceding, 0)
    parts = cuts.where(~whole).withColumn("nth", F.sum(F.col("before").isNotNull().cast("long")).over(so_far))
    at = F.struct("block", "k")
    joined = parts.groupBy("path", "nth").agg(
        *[F.min_by(c, at).alias(c) for c in ("artifact", "block", "k", "limit", "before", "depth", "holder", "kind")], F.max_by("after", at).alias("after"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "k", "text"))), lambda x: x["text"]), "").alias("text"))
    return cuts.where(whole).unionByName(joined.select(*cuts.columns))


def _block_frames(found: DataFrame) -> DataFrame:
    """``(path, block, base, over, over_kind)``: the number of a block's element 0, and the first
    element and bracket of the lowest list or object that is open at the start of the block."""
    per = found.groupBy("path", "block").agg(F.max("k").alias("n"), F.max(F.struct("holder", "kind")).alias("opened"))
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    based = per.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    opened = F.when(F.col("opened.holder").isNotNull(), F.struct((F.col("base") + F.col("opened.holder")).alias("first"), F.col("opened.kind").alias("kind")))
    carried = F.last(opened, ignorenulls=True).over(before)
    return based.withColumn("_over", carried).select("path", "block", "base", F.col("_over.first").alias("over"), F.col("_over.kind").alias("over_kind"))


def _is(column: str, *values: str) -> Column:
    return F.col(column).isin(*values)


def list_elements(spark: SparkSession, paths: str | list[str], key: str) -> DataFrame:
    """``(artifact, idx, text)`` of the elements of every file's list: the file is a list, or an
    object that holds one under ``key``.

    A file that is not one strict JSON document of this form has no rows: each element and
    member is parsed, commas and brackets must stand where they may, and names of an object
    must differ. Elements count from 0.
    """
    pieces = read_pieces(spark, paths)
    starts = stage(block_starts(stage(block_maps(pieces), "json-maps")), "json-starts")
    cuts = stage(block_cuts(pieces, starts), "json-cuts")
    frames = stage(_block_frames(cuts), "json-frames")
    found = elements(cuts).join(frames, ["path", "block"])
    number, low = F.col("base") + F.col("k"), F.col("depth") == F.col("limit")
    inner = F.col("limit") > 1
    first = F.when(low & inner, F.coalesce(F.col("base") + F.col("holder"), "over"))
    # What holds the text: nothing, the outer list or object, or the one inside.
    kind = (F.when(F.col("depth") == 0, F.lit("")).when(~inner, F.lit("[")).when(F.col("depth") == 1, F.lit("{"))
            .when(low, F.coalesce("kind", "over_kind")).otherwise("?"))
    blank = F.translate("text", _BLANK, "") == ""
    found = found.select("path", "artifact", "block", number.alias("n"), "before", "after", "depth", "limit", first.alias("first"), kind.alias("kind"), "text", blank.alias("blank"))

    def parsed(*around: str) -> Column:
        return F.try_parse_json(F.concat(F.lit(around[0]), "text", F.lit(around[1])))
    value = ~F.col("blank") & parsed("[", "]").isNotNull()
    opening = _is("after", "[", "{")
    member = F.map_keys(F.try_variant_get(F.when(opening, parsed("{", "null}")).otherwise(parsed("{", "}")), "$", "map<string,variant>"))
    name = F.when((F.size(member) == 1) & ~F.col("blank"), member[0])
    in_list = _is("before", "[", ",") & _is("after", "]", ",") & (value | (F.col("blank") & _is("before", "[") & _is("after", "]")))
    closed = F.col("blank") & _is("before", "]", "}") & _is("after", ",", "}")
    in_object = closed | (_is("before", "{", ",") & (F.col("name").isNotNull() & (_is("after", ",", "}") | (opening & (F.col("depth") == 1)))
                                                    | (F.col("blank") & _is("before", "{") & _is("after", "}"))))
    outside = F.col("blank") & ((_is("before", START) & opening) | (_is("before", "]", "}") & _is("after", END)))
    judged = found.withColumn("name", F.when(F.col("kind") == "{", name)).withColumn(
        "sound", F.when(F.col("kind") == "", outside).when(F.col("kind") == "[", in_list).when(F.col("kind") == "{", in_object).otherwise(False))
    judged = judged.select("path", "n", "first", "name", "after", "sound", "limit")
    # Brackets pair up: a list is closed by what its kind allows, and only at depth 0 the file ends.
    sound = judged.groupBy("path", "limit").agg(F.bool_and("sound").alias("sound"))
    again = judged.where("name is not null").groupBy("path", "first", "name").agg(F.count("*").alias("times")).where("times > 1").select("path").distinct()
    lists = judged.where((F.col("name") == key) & (F.col("after") == "[")).groupBy("path").agg(F.min(F.col("n") + 1).alias("start"))
    files = (sound.where("sound").join(again, "path", "left_anti").join(lists, "path", "left")
             .select("path", F.when(F.col("limit") == 1, 1).otherwise(F.col("start")).alias("start"), "limit").where("start is not null"))
    files = stage(files, "json-lists")
    mine = F.when(F.col("limit") == 1, F.col("depth") == 1).otherwise(F.col("first") == F.col("start"))
    return (found.join(files.drop("limit"), "path").where(mine & ~F.col("blank"))
            .select("artifact", (F.col("n") - F.col("start")).alias("idx"), "text"))
