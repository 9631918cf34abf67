"""Facts against a rule table of any size.

What rules ask about artifacts is kept as rows, not sets: the kinds an artifact has, and
where its numbers lie among the bounds of the conditions.

- **Conditions.** The distinct bounds of a (family, kind, field) cut the numbers into slots:
  a bound is an even slot, what lies between two bounds an odd one. Numbers find their slots
  by one sort together with the bounds. A condition is a range of slots, met when the last
  slot of the artifact up to its end is not before its start. No fact meets a condition row.
- **Kinds.** Rules that require and forbid the same kinds share a premise. A premise is looked up
  by the kind it requires that the fewest artifacts have; the other required and the forbidden
  kinds are then counted for those artifacts alone. Artifacts, kinds, fields and premises are
  numbers there, not names.
- **Rows.** What fires is far more than what is read. The last join makes its rows in generated
  code alone: conditions are judged before it, 63 rules at a time, and come to it as one mask.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultscope.functions.numbers import finite_number
from faultscope.operators.ordered import running_count
from faultscope.schema import KEY
from faultscope.staging import stage

FIELD = ["family", "kind", "field"]
_FAR = (1 << 62)
#: Rules whose conditions one mask holds.
MASK = 63
#: A cell of artifacts and rules is judged in one piece: 2**SPAN artifacts, MASK * 2**BLOCK rules.
SPAN, BLOCK = 13, 12
#: Conditions of artifacts that are judged at a time.
STEP = 1 << 18


def _conditions(rules: DataFrame) -> DataFrame:
    """``(family, rid, nth, kind, field, lo, hi)``."""
    return rules.select("family", "rid", F.posexplode("conditions").alias("nth", "c")).select(
        "family", "rid", "nth", "c.kind", "c.field", "c.lo", "c.hi")


def _bounds(conditions: DataFrame) -> DataFrame:
    """``(family, kind, field, value)`` of every distinct bound; zero has one sign."""
    both = F.explode(F.filter(F.array("lo", "hi"), lambda b: b.isNotNull()))
    return conditions.select(*FIELD, both.alias("value")).withColumn("value", F.col("value") + F.lit(0.0)).distinct()


def _able(book) -> DataFrame:
    """Rules that require something and whose conditions can all be read."""
    return book.frame.where((F.size("requires") > 0) & F.forall("conditions", lambda c: c["ok"]))


def usable_rules(book) -> DataFrame:
    """Rules that can fire, each with an id of its own: they require something and every
    condition can be read. Rules that repeat in every column are one."""
    rules = _able(book).select("family", F.col("id").alias("code"), "ord", "severity", F.array_distinct("requires").alias("requires"),
                         F.array_distinct("absent").alias("absent"), "conditions")
    return rules.withColumn("rid", F.md5(F.to_json(F.struct("*")))).dropDuplicates(["family", "rid"])


def fact_slots(facts: DataFrame, conditions: DataFrame) -> DataFrame:
    """``(family, artifact, kind, field, slot)``: where the numbers of an artifact lie among
    the bounds of their field. Facts fold to distinct numbers before they are sorted."""
    asked = conditions.select(*FIELD).distinct()
    entries = (facts.select(*KEY, "kind", "data").join(asked.select("family", "kind").distinct(), ["family", "kind"], "left_semi")
               .select(*KEY, "kind", F.explode("data").alias("field", "text")).join(asked, FIELD, "left_semi"))
    numbers = (entries.select(*KEY, "kind", "field", (finite_number(F.col("text")) + F.lit(0.0)).alias("value"))
               .where("value is not null").distinct())
    numbers = stage(numbers, "condition-numbers")
    marks = (numbers.select(*FIELD, "value", F.lit(0).alias("bound")).unionByName(_bounds(conditions).withColumn("bound", F.lit(1)))
             .groupBy(*FIELD, "value").agg(F.max("bound").cast("long").alias("bound")))
    ranked = running_count(marks, FIELD, "value", "bound", "rank")
    slots = ranked.select(*FIELD, "value", (2 * F.col("rank") + 1 - F.col("bound")).alias("slot"))
    return numbers.join(slots, [*FIELD, "value"]).select(*KEY, "kind", "field", "slot").distinct()


def condition_slots(conditions: DataFrame) -> DataFrame:
    """``(family, rid, nth, kind, field, first, last)``: conditions as ranges of slots."""
    ranks = stage(running_count(_bounds(conditions).withColumn("bound", F.lit(1).cast("long")), FIELD, "value", "bound", "rank").select(*FIELD, "value", "rank"), "condition-bounds")
    out = conditions
    for bound, name, far in (("lo", "first", -1), ("hi", "last", _FAR)):
        one = ranks.select(*FIELD, F.col("value").alias(bound), (2 * F.col("rank")).alias(name))
        out = out.withColumn(bound, F.col(bound) + F.lit(0.0)).join(one, [*FIELD, bound], "left").withColumn(name, F.coalesce(name, F.lit(far).cast("long")))
    return out.select("family", "rid", "nth", "kind", "field", "first", "last")


def named_profile(facts: DataFrame, book) -> DataFrame:
    """``(family, artifact, kind, field, slot, facts)``: a row per kind of an artifact that rules
    ask about (``facts``: the largest number of the facts; rows without a kind carry it
    for kinds that are not asked about) and a row per slot of a number."""
    rules = _able(book).select("family", F.lit("").alias("rid"), F.array_distinct("requires").alias("requires"), F.array_distinct("absent").alias("absent"), "conditions")
    asked = rules.select("family", F.explode(F.concat("requires", "absent")).alias("kind")).distinct().withColumn("asked", F.lit(True))
    folded = facts.groupBy(*KEY, "kind").agg(F.max("seq").alias("facts"))
    kinds = folded.join(asked, ["family", "kind"], "left").withColumn("kind", F.when(F.col("asked"), F.col("kind")))
    none = F.lit(None)
    slots = fact_slots(facts, _conditions(rules))
    return stage(kinds.select(*KEY, "kind", none.cast("string").alias("field"), none.cast("long").alias("slot"), "facts").unionByName(
        slots.withColumn("facts", none.cast("long"))), "named-profile")


def _marked(kinds: Column | str, wanted: bool) -> Column:
    return F.transform(kinds, lambda k: F.struct(k.alias("kind"), F.lit(wanted).alias("wanted")))


def candidates(kinds: DataFrame, rules: DataFrame, scope: tuple[str, ...] = ("family",)) -> DataFrame:
    """``(family, artifact, rid, code, ord, severity, rarest, requires, absent, asks)``: the artifacts that have a rule's
    rarest required kind, ``asks`` the other kinds to be there or not. A rule that requires a kind nobody has is left out here. Kinds that
    are numbers of their own in every family need no ``scope``."""
    held = kinds.groupBy(*scope, "kind").agg(F.count("*").alias("n"))
    each = rules.select(*scope, "rid", F.explode("requires").alias("kind")).join(held, [*scope, "kind"])
    rarest = each.groupBy(*scope, "rid").agg(F.count("*").alias("there"), F.min_by("kind", F.struct("n", "kind")).alias("rarest"))
    keyed = rules.drop("conditions").join(rarest, [*scope, "rid"]).where(F.col("there") == F.size("requires")).drop("there")
    keyed = keyed.withColumn("asks", F.concat(_marked(F.array_except("requires", F.array("rarest")), True), _marked("absent", False)))
    return kinds.withColumnRenamed("kind", "rarest").join(keyed, [*scope, "rarest"])


def premises(rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What rules share, found once for all of them, and the rules by it.

    ``(family, requires, absent, rid)``: distinct sets of kinds, numbered.
    ``(premise, family, rid, code, ord, severity, chunk, bit)``: the rules. Those with conditions
    are cut into chunks of a premise, ``MASK`` rules at most, ``bit`` their place in it; the
    others have no ``chunk``.
    """
    kinds = {c: F.sort_array(c) for c in ("requires", "absent")}
    same = ["family", *kinds]
    sets = stage(rules.select("family", *[v.alias(c) for c, v in kinds.items()]).dropDuplicates(same)
                 .withColumn("rid", F.monotonically_increasing_id()), "premises")
    keyed = (rules.select("family", "rid", "code", "ord", "severity", (F.size("conditions") > 0).alias("_asks"), *[v.alias(c) for c, v in kinds.items()])
             .join(sets.withColumnRenamed("rid", "premise"), same).drop(*kinds))
    place = ["_asks", "premise", "rid"]
    placed = stage(keyed.repartitionByRange(*place).sortWithinPartitions(*place).withColumn("_at", F.monotonically_increasing_id()), "rules-by-premise")
    group = Window.partitionBy("_asks", "premise", F.floor(F.col("_at") / MASK))
    by_premise = placed.select("premise", "family", "rid", "code", "ord", "severity", F.when(F.col("_asks"), F.min("_at").over(group)).alias("chunk"),
                               F.expr(f"shiftleft(1L, int(_at % {MASK}))").alias("bit"))
    return sets, stage(by_premise, "rules-in-chunks")


def _names(rules: DataFrame, conditions: DataFrame) -> DataFrame:
    """``(family, kind, field, number)``: a number for every kind that rules ask about, where
    ``field`` is null, and for every field of a condition."""
    kinds = rules.select("family", F.explode(F.concat("requires", "absent")).alias("kind"), F.lit(None).cast("string").alias("field"))
    named = kinds.unionByName(conditions.select(*FIELD).where("field is not null")).where("family is not null and kind is not null").distinct()
    return stage(named.withColumn("number", F.monotonically_increasing_id()), "names")


def _artifacts(profile: DataFrame, names: DataFrame) -> DataFrame:
    """``(id, family, artifact, facts, kinds, points)``: a row per artifact, numbered, with the
    numbers of its kinds and ``(field, slot)`` of its numbers."""
    numbers = names.select(*[F.col(c).alias(f"_{c}") for c in names.columns])
    known = profile.where("family is not null and artifact is not null").join(
        numbers, (F.col("family") == F.col("_family")) & (F.col("kind") == F.col("_kind")) & F.col("field").eqNullSafe(F.col("_field")), "left")
    rows = known.groupBy(*KEY).agg(
        F.max("facts").alias("facts"), F.collect_list(F.when(F.col("field").isNull(), F.col("_number"))).alias("kinds"),
        F.collect_list(F.when(F.col("field").isNotNull() & F.col("_number").isNotNull(), F.struct(F.col("_number").alias("field"), "slot"))).alias("points"))
    return stage(rows.withColumn("id", F.monotonically_increasing_id()), "artifacts")


def _numbered(sets: DataFrame, names: DataFrame) -> DataFrame:
    """``(rid, requires, absent)``: premises and their kinds as numbers. A kind without a name is never there."""
    able = sets.where(F.forall("requires", lambda k: k.isNotNull()))
    each = able.select("family", "rid", F.explode(F.concat(_marked("requires", True), _marked("absent", False))).alias("k"))
    found = each.select("family", "rid", "k.kind", "k.wanted").join(names.where("field is null").select("family", "kind", "number"), ["family", "kind"])
    return found.groupBy("rid").agg(
        F.collect_list(F.when(F.col("wanted"), F.col("number"))).alias("requires"), F.collect_list(F.when(~F.col("wanted"), F.col("number"))).alias("absent"))


def _with_all_kinds(found: DataFrame, kinds: DataFrame) -> DataFrame:
    """``(artifact, rid)`` of candidates that have every required kind and no forbidden one."""
    each = found.select("artifact", "rid", F.explode_outer("asks").alias("ask")).select("artifact", "rid", "ask.kind", "ask.wanted")
    seen = each.join(kinds.withColumn("there", F.lit(True)), ["artifact", "kind"], "left")
    there = F.col("there").isNotNull()
    wrong = F.count_if((F.col("wanted") & ~there) | (~F.col("wanted") & there))
    return seen.groupBy("artifact", "rid").agg(wrong.alias("wrong")).where("wrong = 0").drop("wrong")


def _lists(column: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """Lengths and values of a column of lists."""
    column = column.combine_chunks()
    return column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), column.flatten()


def judge(asked: pa.Table, chunks: pa.Table) -> pa.Table:
    """``(id, chunk, mask)``: the rules of chunks whose conditions are all met.

    ``asked`` has ``(id, points, chunks)`` of artifacts, ``chunks`` ``(chunk, conditions)``. All points are
    sorted together; a condition is met when the last point of the artifact up to its end
    is not before its start. One search per condition, whatever the artifact holds.
    """
    n_cond, flat = _lists(chunks["conditions"])
    field, first, last, bit = (flat.field(flat.type.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("field", "first", "last", "bit"))
    n_points, points = _lists(asked["points"])
    of, slot = (points.field(points.type.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("field", "slot"))
    n_chunks, wanted = _lists(asked["chunks"])
    # Fields and slots count on from zero inside the cell, so that artifact, field and slot fit one number.
    fields, values = np.unique(field), np.unique(np.concatenate([first, last, slot]))
    wide = len(fields) * len(values)
    at = np.searchsorted(fields, of)
    here = fields[np.minimum(at, len(fields) - 1)] == of
    owner = np.repeat(np.arange(asked.num_rows), n_points)
    keys = np.concatenate([[-1], np.sort((owner * wide + at * len(values) + np.searchsorted(values, slot))[here])])
    line = np.searchsorted(fields, field) * len(values)
    owner_of = np.repeat(np.arange(chunks.num_rows), n_cond)
    low, high = line + np.searchsorted(values, first), line + np.searchsorted(values, last)
    order = np.lexsort((high, owner_of))
    low, high, bit, start = low[order], high[order], bit[order], np.cumsum(n_cond) - n_cond
    whole = np.bitwise_or.reduceat(bit, start)
    known = chunks["chunk"].to_numpy()
    by = np.argsort(known)
    chunk = by[np.searchsorted(known, wanted.to_numpy(), sorter=by)]
    artifact = np.repeat(np.arange(asked.num_rows), n_chunks)
    masks, ends = np.empty(len(chunk), np.int64), np.cumsum(n_cond[chunk])
    cuts = np.unique(np.concatenate([[0], np.searchsorted(ends, np.arange(STEP, ends[-1], STEP)), [len(chunk)]]))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        mine, n = chunk[a:b], n_cond[chunk[a:b]]
        begin = np.cumsum(n) - n
        each = np.arange(begin[-1] + n[-1]) + np.repeat(start[mine] - begin, n)
        base = np.repeat(artifact[a:b] * wide, n)
        met = keys[np.searchsorted(keys, base + high[each], "right") - 1] >= base + low[each]
        masks[a:b] = whole[mine] & ~np.bitwise_or.reduceat(np.where(met, 0, bit[each]), begin)
    some = masks != 0
    return pa.table({"id": asked["id"].to_numpy()[artifact[some]], "chunk": known[chunk[some]], "mask": masks[some]})


def _masks(found: DataFrame, artifacts: DataFrame, rules: DataFrame, conditions: DataFrame, names: DataFrame) -> DataFrame:
    """``(id, chunk, mask)``: the rules that fire, of chunks whose premise holds for the artifact.

    Artifacts and chunks meet in cells. What an artifact's numbers are goes once to every
    block of rules, the conditions once to every span of artifacts.
    """
    fields = names.where("field is not null").select(*FIELD, F.col("number"))
    asks = (condition_slots(conditions).join(fields, FIELD, "left").join(rules.where("chunk is not null").select("family", "rid", "premise", "chunk", "bit"), ["family", "rid"])
            .groupBy("premise", "chunk").agg(F.collect_list(F.struct(F.coalesce("number", F.lit(-1)).alias("field"), "first", "last", "bit")).alias("conditions")))
    chunks = stage(asks.withColumn("block", F.shiftright(F.floor(F.col("chunk") / MASK), BLOCK)), "condition-chunks")
    wanted = (found.join(chunks.select(F.col("premise").alias("rid"), "chunk", "block"), "rid")
              .groupBy(F.col("artifact").alias("id"), "block").agg(F.collect_list("chunk").alias("chunks")))
    span = F.shiftright("id", SPAN).alias("span")
    left = wanted.join(artifacts.select("id", "points"), "id").select(span, "block", "id", "points", "chunks")
    right = chunks.select(F.col("block").alias("of"), "chunk", "conditions").crossJoin(F.broadcast(artifacts.select(span).distinct()))
    return left.groupBy("span", "block").cogroup(right.groupBy("span", "of")).applyInArrow(
        lambda mine, theirs: judge(mine, theirs) if mine.num_rows and theirs.num_rows else pa.table({c: np.empty(0, np.int64) for c in ("id", "chunk", "mask")}),
        "id long, chunk long, mask long")


def match_named(profile: DataFrame, book) -> DataFrame:
    """``(family, artifact, code, ord, severity, facts)`` of every rule of a table that fires.

    Artifacts meet premises, not rules: all that is shuffled is a pair of numbers per
    artifact and premise that holds, and a mask per ``MASK`` rules of it that have conditions.
    Rules are told apart by the last join; nothing is shuffled or written for a rule that fires.
    """
    usable = stage(usable_rules(book), "usable-rules")
    conditions = _conditions(usable)
    names = _names(usable, conditions)
    sets, rules = premises(usable)
    artifacts = _artifacts(profile, names)
    # Lists of numbers are small as files and large as rows: never to be broadcast.
    kinds = artifacts.select(F.col("id").alias("artifact"), F.explode("kinds").alias("kind")).hint("merge")
    found = stage(_with_all_kinds(candidates(kinds, _numbered(sets, names), ()), kinds), "premises-found")
    who, what = artifacts.select("id", *KEY, "facts"), rules.drop("family", "rid")
    plain = (found.select(F.col("artifact").alias("id"), F.col("rid").alias("premise")).join(who, "id")
             .join(what.where("chunk is null").drop("chunk", "bit"), "premise"))
    judged = (_masks(found, artifacts, rules, conditions, names).join(who, "id").join(what.where("chunk is not null").drop("premise"), "chunk")
              .where(F.col("mask").bitwiseAND(F.col("bit")) != 0))
    out = [*KEY, "code", "ord", "severity", "facts"]
    return plain.select(*out).unionByName(judged.select(*out))
