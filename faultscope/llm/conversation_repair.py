"""Conversation structure repair: the cheapest edits that make roles alternate.

Rows get a symbol: role initial (system, user, assistant, other) and fault (none,
truncated, to be deleted). An automaton of four states says what may follow; a row is a
4 x 4 min-plus matrix of what it costs to get from one state to another over it,
insertions before it included.

1. Rows are sorted once over the whole table, by ranges, so a conversation of any length
   lies in order over as many tasks as it needs. 65,536 places of a conversation are a slice.
2. Equal consecutive symbols of a slice collapse to runs. A run is crossed by cached binary
   powers of its symbol's matrix; a slice gives one 4 x 4 matrix.
3. The matrices of a conversation's slices are folded from its end: costs to go at the end
   of each slice. Conversations of one slice have nothing to fold.
4. Each slice followed by another gives a map, start state to end state, along its least
   edits; the maps are folded from the front: the state each slice starts in.
5. Every slice unrolls its choices by itself.

Only narrow rows (a conversation's slices, one row per 65,536 rows) meet in one place.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultscope.llm.common import SPACES
from faultscope.staging import stage

REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
SLICE_BITS = 16
INF = 1 << 60

#: States: nothing written, after system, after user, after assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
#: The only state that a user or assistant row leads to from each state.
NEXT = (USER, USER, ASSISTANT, USER)
#: Costs after the last row: what the insertions cost that still have to follow.
END = (0, 2 * INSERT, INSERT, 0)
INITIALS = "sua"
KEPT, CUT, DOOMED = range(3)


# ------------------------------------------------------------ the automaton

def _moves(symbol: int, state: int) -> list[tuple[str, int, int]]:
    """Edits of one row in a state: (initial, cost, next state), least initial first."""
    role, fault = divmod(symbol, 3)
    moves = [("D", DELETE, state)]
    if fault == DOOMED:
        return moves
    extra = TRUNCATED if fault == CUT else 0
    if role == 0 and state == START:
        moves.append(("K", extra, SYSTEM))
    if role in (1, 2) and NEXT[state] == (USER, ASSISTANT)[role - 1]:
        moves.append(("K", extra, NEXT[state]))
    return [*moves, ("R", REROLE + extra, NEXT[state])]


@lru_cache(maxsize=None)
def power(symbol: int, k: int) -> tuple[tuple[int, ...], ...]:
    """Min-plus matrix of 2**k rows of a symbol."""
    if k:
        half = power(symbol, k - 1)
        return tuple(tuple(min(half[q][m] + half[m][r] for m in STATES) for r in STATES) for q in STATES)
    rows = []
    for q in STATES:
        row, at, paid = [INF] * 4, q, 0
        for _ in STATES:
            for _, cost, to in _moves(symbol, at):
                row[to] = min(row[to], paid + cost)
            at, paid = NEXT[at], paid + INSERT
        rows.append(tuple(row))
    return tuple(rows)


def _cross(matrix: tuple, after: tuple) -> tuple:
    return tuple(min(INF, *(row[r] + after[r] for r in STATES)) for row in matrix)


def _level(costs: tuple) -> tuple[tuple, int]:
    """Costs above their least, and the least."""
    low = min(costs)
    return tuple(min(INF, c - low) for c in costs), low


@lru_cache(maxsize=1 << 16)
def _over_run(symbol: int, length: int, after: tuple) -> tuple[tuple, int]:
    total = 0
    for k in range(length.bit_length()):
        if length >> k & 1:
            after, low = _level(_cross(power(symbol, k), after))
            total += low
    return after, total


@lru_cache(maxsize=1 << 16)
def _choice(symbol: int, after: tuple, state: int) -> tuple[str, int, tuple[int, ...]]:
    """Least initials of the cheapest edits for one row, the next state, the states written."""
    best = _cross(power(symbol, 0), after)
    edits, written = "", []
    while True:
        moves = {e: (cost, to) for e, cost, to in _moves(symbol, state)}
        for edit in "DIKR":
            cost, to = (INSERT, NEXT[state]) if edit == "I" else moves.get(edit, (INF, 0))
            if edit == "I":
                fits = cost + best[to] == best[state]
            else:
                fits = cost + after[to] == best[state]
            if fits:
                break
        edits += edit
        written.append(to)
        state = to
        if edit != "I":
            return edits, state, tuple(written)


def runs_of(symbols: bytes) -> list[tuple[int, int]]:
    return [(s, sum(1 for _ in same)) for s, same in groupby(symbols)]


def slice_matrix(symbols: bytes) -> list[int]:
    """The 16 costs of crossing a slice, row by row."""
    columns = []
    for target in STATES:
        costs, total = tuple(0 if q == target else INF for q in STATES), 0
        for symbol, length in reversed(runs_of(symbols)):
            costs, low = _over_run(symbol, length, costs)
            total += low
        columns.append([min(INF, c + total) if c < INF else INF for c in costs])
    return [columns[r][q] for q in STATES for r in STATES]


def unroll(symbols: bytes, after: tuple = END, start: int = START) -> Iterator[tuple[int, str, int]]:
    """(row, edit, state) of every edit; insertions have the number of the row they precede.

    The audit is the ASCII-least of the cheapest: no sequence of edits is the beginning of
    another of the same cost (it would lack insertions), so the least edit that is still
    cheapest is right at every step.
    """
    runs = runs_of(symbols)
    ends = [_level(after)[0]]
    for symbol, length in reversed(runs):
        ends.append(_over_run(symbol, length, ends[-1])[0])
    ends.reverse()
    row, state = 0, start
    for (symbol, length), costs in zip(runs, ends[1:]):
        inner = [costs]
        for _ in range(length - 1):
            inner.append(_over_run(symbol, 1, inner[-1])[0])
        for costs in reversed(inner):
            edits, state, written = _choice(symbol, costs, state)
            for edit, to in zip(edits, written):
                yield row, edit, to
            row += 1


def closing(state: int) -> int:
    """Insertions that must follow the last row."""
    return END[state] // INSERT


def slice_edits(symbols: bytes, after: tuple = END, start: int = START, last: bool = True) -> tuple[list[str], list[str], int]:
    """Per row its edits and, digit by digit, the states they write; the state at the end.

    Insertions stand with the row they precede, those at the very end with the last row.
    """
    edits, states, state = [""] * len(symbols), [""] * len(symbols), start
    for row, edit, state in unroll(symbols, after, start):
        edits[row] += edit
        states[row] += str(state)
    while last and END[state]:
        state = NEXT[state]
        edits[-1] += "I"
        states[-1] += str(state)
    return edits, states, state


def is_illegal(before: int, role: int) -> bool:
    return INITIALS[before:before + 1] + INITIALS[role:role + 1] not in ("su", "ua", "au")


# ------------------------------------------------------------ rows and their symbols

def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of rows broken on purpose, chosen by a checksum of ``conv_id:turn``.

    Of 20 remainders, 0 drops the row, 1 empties its text, 2 removes its full stops,
    exclamation and question marks, 3 repeats it, 4 makes its role user. Nulls count as one
    space, in the checksum too; conv_id and turn stay null in the result.
    """
    word = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")]
    kind = F.crc32(F.concat(word[0], F.lit(":"), word[1]).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", word[2].alias("role"), word[3].alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    times = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
                       F.explode(times).alias("copy")).drop("copy")


def _role(role: Column) -> Column:
    """Place of the first letter in ``INITIALS``; an empty role and any other letter are one past them."""
    first, out = F.substring(role, 1, 1), F.lit(len(INITIALS))
    for k, letter in enumerate(INITIALS):
        out = F.when(first == letter, k).otherwise(out)
    return out


def marked(rows: DataFrame) -> DataFrame:
    """The rows in order, with faults and symbols: conv_id, turn, role, text, pos, blank, duplicate, truncated, symbol.

    ``pos`` grows with (conv_id, turn, role, text), nulls first, and is without gaps inside a
    conversation as far as one task holds it. Texts of one turn and role are ordered by their
    first 64 characters, then by digest; rows that repeat in every column are alike.
    Null roles and texts count as one space.
    """
    space = F.lit(" ")
    shown = F.rtrim(F.translate(F.col("text"), SPACES, " "))
    ends = F.substring(shown, -1, 1)
    tagged = stage(rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"))
                   .withColumns({"blank": shown == "", "open_end": ~ends.isin(".", "!", "?"), "sha": F.unhex(F.sha2("text", 256)),
                                 "start": F.substring("text", 1, 64), "tag": F.monotonically_increasing_id()}), "conversation-rows")
    # The first of equal rows, found without bringing equal rows together.
    first = (tagged.where(~F.col("blank")).groupBy("conv_id", "role", "sha").agg(F.min(F.struct("turn", "tag")).alias("least"))
             .select(F.col("least.tag").alias("tag"), F.lit(True).alias("new")))
    faults = (tagged.join(first, "tag", "left").withColumn("duplicate", ~F.col("blank") & F.col("new").isNull())
              .withColumn("truncated", ~F.col("blank") & ~F.col("duplicate") & F.col("open_end")))
    fault = F.when(F.col("blank") | F.col("duplicate"), DOOMED).when(F.col("truncated"), CUT).otherwise(KEPT)
    order = ["conv_id", "turn", "role", "start", "sha", "tag"]
    out = (faults.withColumn("symbol", (_role(F.col("role")) * 3 + fault).cast("byte"))
           .repartitionByRange(*order).sortWithinPartitions(*order).withColumn("pos", F.monotonically_increasing_id()))
    return stage(out.select("conv_id", "turn", "role", "text", "pos", "blank", "duplicate", "truncated", "symbol"), "conversation-order")


# ------------------------------------------------------------ the repair

def _same(left: DataFrame, right: DataFrame, *names: str) -> Column:
    """Equal keys, null conversations too."""
    both = left["conv_id"].eqNullSafe(right["conv_id"])
    for name in names:
        both = both & (left[name] == right[name])
    return both


def _each_row(df: DataFrame, schema: str, fn) -> DataFrame:
    """``fn`` of every row (a dict) gives rows as tuples; the first column is conv_id."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kinds = to_arrow_schema(StructType([df.schema["conv_id"], *StructType.fromDDL(schema)]))

    def run(batches):
        for batch in batches:
            rows = [(x["conv_id"], *made) for x in batch.to_pylist() for made in fn(x)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), kinds)], schema=kinds)

    return df.mapInArrow(run, StructType([df.schema["conv_id"], *StructType.fromDDL(schema)]))


def _symbols(row: dict) -> bytes:
    return bytes(row["symbols"])


def slices_of(rows: DataFrame, bits: int = SLICE_BITS) -> DataFrame:
    """conv_id, slice, pos (of its first row), symbols (an array of at most 2**bits)."""
    return (rows.withColumn("slice", F.shiftright("pos", bits)).groupBy("conv_id", "slice")
            .agg(F.min("pos").alias("pos"), F.sort_array(F.collect_list(F.struct("pos", "symbol"))).alias("both"))
            .select("conv_id", "slice", "pos", F.col("both.symbol").alias("symbols")))


def _fold_ends(conversation: dict) -> Iterator[tuple]:
    """Costs to go at the end of every slice, the slice that follows, and the seam's legality."""
    after, behind = END, None
    for frame in reversed(conversation["frames"]):
        seam = behind is not None and is_illegal(frame["last"], behind["first"])
        yield frame["slice"], None if behind is None else behind["slice"], list(after), int(seam)
        m = frame["m"]
        after = _level(_cross(tuple(tuple(m[4 * q:4 * q + 4]) for q in STATES), after))[0]
        behind = frame


def _fold_starts(conversation: dict) -> Iterator[tuple]:
    state = START
    for x in conversation["maps"]:
        state = x["to"][state]
        yield x["next"], state


def _bounds(slices: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per slice of a conversation of several: (next, after, seam) and, from the second on, start."""
    counts = slices.groupBy("conv_id").agg(F.count("*").alias("n")).where("n > 1")
    several = stage(slices.join(counts, _same(slices, counts), "left_semi"), "cut-slices")

    def frame(x):
        s = _symbols(x)
        yield x["slice"], s[0] // 3, s[-1] // 3, slice_matrix(s)

    frames = _each_row(several, "slice long, first int, last int, m array<long>", frame)
    per = frames.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("slice", "first", "last", "m"))).alias("frames"))
    ends = stage(_each_row(per, "slice long, next long, after array<long>, seam long", _fold_ends), "slice-ends")

    def to(x):
        s, after = _symbols(x), tuple(x["after"])
        yield x["slice"], x["next"], [slice_edits(s, after, q, False)[2] for q in STATES]

    inner = several.join(ends, _same(several, ends, "slice")).where("next is not null").select(several["conv_id"], several["slice"], "next", "symbols", "after")
    maps = _each_row(inner, "slice long, next long, to array<int>", to)
    per = maps.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("slice", "next", "to"))).alias("maps"))
    return ends, stage(_each_row(per, "slice long, start int", _fold_starts), "slice-starts")


def slice_choices(rows: DataFrame, bits: int = SLICE_BITS) -> DataFrame:
    """conv_id, pos, edits, states, illegal per slice of ``marked`` rows.

    ``edits`` and ``states`` have an entry per row; ``illegal`` counts neighbours that may
    not follow each other, the seam to the next slice included.
    """
    slices = stage(slices_of(rows, bits), "slices")
    ends, starts = _bounds(slices)
    bound = (slices.join(ends, _same(slices, ends, "slice"), "left").select(slices["conv_id"], slices["slice"], "pos", "symbols", "next", "after", "seam"))
    bound = bound.join(starts, _same(bound, starts, "slice"), "left").select(bound["conv_id"], "pos", "symbols", "next", "after", "seam", "start")

    def choose(x):
        s = _symbols(x)
        edits, states, _ = slice_edits(s, tuple(x["after"] or END), x["start"] or START, x["next"] is None)
        inside = sum(is_illegal(a // 3, b // 3) for a, b in zip(s, s[1:]))
        yield x["pos"], edits, states, inside + (x["seam"] or 0)

    return _each_row(bound, "pos long, edits array<string>, states array<string>, illegal long", choose)


def edited(rows: DataFrame, choices: DataFrame) -> DataFrame:
    """``marked`` rows with their ``edits`` (initials, in order) and ``states`` written."""
    each = choices.select(F.col("pos").alias("first"), F.posexplode(F.arrays_zip("edits", "states")).alias("nth", "x"))
    each = each.select((F.col("first") + F.col("nth")).alias("pos"), "x.edits", "x.states")
    return rows.join(each, "pos")


def repaired_rows(edits: DataFrame) -> DataFrame:
    """The repaired conversations, row by row: conv_id, pos, nth, edit, role, text.

    Order a conversation by pos and nth. Inserted rows have an empty text.
    """
    one = F.explode(F.sequence(F.lit(1), F.length("edits"))).alias("nth")
    each = edits.select("conv_id", "pos", one, "edits", "states", "role", "text")
    edit, state = F.col("edits").substr(F.col("nth"), F.lit(1)), F.col("states").substr(F.col("nth"), F.lit(1))
    new = F.when(state == str(USER), "user").otherwise("assistant")
    return (each.withColumn("edit", edit).where("edit <> 'D'")
            .select("conv_id", "pos", "nth", "edit", F.when(F.col("edit") == "K", F.col("role")).otherwise(new).alias("role"),
                    F.when(F.col("edit") == "I", "").otherwise(F.col("text")).alias("text")))


def _digests(edits: DataFrame) -> DataFrame:
    """conv_id, audit, repaired_sha256: each conversation streams through one digest, in order."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = StructType([edits.schema["conv_id"], *StructType.fromDDL("audit string, repaired_sha256 string")])
    kinds = to_arrow_schema(schema)
    names = {str(USER): b"user", str(ASSISTANT): b"assistant"}

    def run(batches):
        out, key, audit, sha = [], (), [], None

        def close():
            if sha is not None:
                out.append((key[0], "".join(audit), sha.hexdigest()))

        for batch in batches:
            for conv, initials, states, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "edits", "states", "role", "text"))):
                if sha is None or conv != key[0]:
                    close()
                    key, audit, sha, empty = (conv,), [], hashlib.sha256(), True
                audit.append(initials)
                for edit, state in zip(initials, states):
                    if edit != "D":
                        name = role.encode() if edit == "K" else names[state]
                        sha.update((b"" if empty else b"\n") + name + b":" + (b"" if edit == "I" else text.encode()))
                        empty = False
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), kinds)], schema=kinds)
                out.clear()
        close()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), kinds)], schema=kinds)

    rows = edits.select("conv_id", "pos", "edits", "states", "role", "text")
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "pos").mapInArrow(run, schema)


def repair(rows: DataFrame, bits: int = SLICE_BITS) -> tuple[DataFrame, DataFrame]:
    """Edits per row (see ``edited``) and choices per slice of conversations (conv_id, turn, role, text)."""
    ordered = marked(rows)
    choices = stage(slice_choices(ordered, bits), "choices")
    return stage(edited(ordered, choices), "edits"), choices


def repair_report(rows: DataFrame, bits: int = SLICE_BITS) -> DataFrame:
    """One row per conv_id: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Rows are ordered by turn (nulls first), then role and text. The first fault of a row
    counts: blank, duplicate of an earlier role and text, truncated. Null conv_ids are one
    conversation, null roles and texts one space. Repeated rows are duplicates. Missing turns
    are counted between the least and the greatest, nulls ignored, 0 if all are null. An
    empty table gives an empty result; other columns are not read. The audit of a
    conversation is one string and its digest one stream, so those two are made by one task
    for each conversation, row by row; all else of a long conversation is spread.
    """
    edits, choices = repair(rows, bits)
    def times(c):
        return F.sum(F.length(F.translate("edits", "DIKR".replace(c, ""), "")))
    undeleted = F.col("truncated") & ~F.contains("edits", F.lit("D"))
    per = edits.groupBy("conv_id").agg(
        (F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("gaps"),
        *[F.sum(F.col(c).cast("long")).alias(c) for c in ("blank", "duplicate", "truncated")],
        (REROLE * times("R") + DELETE * times("D") + INSERT * times("I") + TRUNCATED * F.sum(undeleted.cast("long"))).alias("cost"))
    illegal = choices.groupBy("conv_id").agg(F.sum("illegal").alias("illegal"))
    digests = _digests(edits)
    out = per.join(illegal, _same(per, illegal)).select(per["*"], "illegal")
    out = out.join(digests, _same(out, digests)).select(out["*"], "audit", "repaired_sha256")
    return out.select("conv_id", F.coalesce("gaps", F.lit(0)).cast("long").alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def with_emptied(report: DataFrame, conversations: DataFrame) -> DataFrame:
    """The report with a row for every conv_id of ``conversations``: zeros, an empty audit and
    the digest of nothing where no row is left."""
    ids = conversations.select("conv_id").distinct()
    zeros = {c: F.coalesce(F.col(c), F.lit(0)).cast("long") for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    nothing = hashlib.sha256().hexdigest()
    both = ids.join(report, _same(ids, report), "left").select(ids["conv_id"], *report.columns[1:])
    return both.withColumns({**zeros, "audit": F.coalesce("audit", F.lit("")), "repaired_sha256": F.coalesce("repaired_sha256", F.lit(nothing))})
