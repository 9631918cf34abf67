"""Diagnosis of artifacts while their lines still arrive.

Lines are matched as they come (no state). What needs the lines before, a block's heading,
the number of a fact, the kinds seen and conditions met, is state per artifact
(``transformWithState``): a few words, however long the artifact is, and the distinct
operators of a session. A fact leaves with its number in the batch that its line came in.
An artifact ends with an ``end`` row, or when event time has passed its last line by
``idle``; then its derived facts, masks and verdict follow. What arrives behind its turn,
or after the end, goes to a table of its own.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from decimal import Decimal, InvalidOperation

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from faultscope.families import FAMILIES
from faultscope.families.base import Context
from faultscope.families.ort import CPU
from faultscope.functions.text import strip_unicode
from faultscope.operators.facts import as_facts
from faultscope.operators.rules import artifact_profile, conditions_met, match_rules
from faultscope.operators.signatures import observe
from faultscope.operators.verdicts import verdicts
from faultscope.schema import FACTS, KEY
from faultscope.sources.rulebook import Rulebook
from faultscope.staging import stage

LINES = T.StructType([T.StructField("family", T.StringType()), T.StructField("artifact", T.StringType()), T.StructField("lineno", T.LongType()),
                      T.StructField("line", T.StringType()), T.StructField("at", T.TimestampType()), T.StructField("end", T.BooleanType())])
_WORDS = T.ArrayType(T.LongType())
_OUT = T.StructType([T.StructField("what", T.StringType()), T.StructField("family", T.StringType()), T.StructField("artifact", T.StringType()),
                     T.StructField("seq", T.LongType()), T.StructField("lineno", T.LongType()), T.StructField("ordinal", T.IntegerType()),
                     T.StructField("kind", T.StringType()), T.StructField("excerpt", T.StringType()), T.StructField("data", T.MapType(T.StringType(), T.StringType())),
                     T.StructField("kinds", _WORDS), T.StructField("met", _WORDS)])


# Spark hands rows to a processor value by value and takes a batch per artifact back: a row
# is one JSON text on either way.
_PACKED = T.StructType([T.StructField("out", T.StringType())])
_ENTRY = ("lineno", "ordinal", "kind", "excerpt", "data", "end", "ms", "kinds", "met")
_ABSENT = dict.fromkeys(_ENTRY)


def _plain(value) -> str:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


class Session:
    """What the derived facts of a session log ask about its lines, as a plain dict."""

    @staticmethod
    def see(state: dict, kind: str, data: dict, lineno: int, excerpt: str) -> str | None:
        """Take one fact in; gives the operator of a node on the CPU."""
        provider = data.get("provider")
        if kind == "node_placement":
            if provider is not None and provider not in state.setdefault("providers", []):
                state["providers"].append(provider)
            state.setdefault("placement", [lineno, excerpt])
            if provider == CPU:
                try:
                    state["groups"] = str(Decimal(state.get("groups", "0")) + Decimal(data.get("count", "0")))
                except InvalidOperation:
                    pass
        elif kind == "node_on_provider" and provider == CPU:
            state["nodes"] = state.get("nodes", 0) + 1
            state.setdefault("node", [lineno, excerpt, data.get("op")])
            return data.get("op")
        elif kind == "provider_unavailable":
            state.setdefault("missing", [lineno, excerpt, data.get("requested")])
        elif kind == "session_providers" and "active" not in state:
            state["active"] = data.get("providers")
        return None

    @staticmethod
    def derived(state: dict, ops: list[str]) -> Iterator[tuple[str, int, str, dict]]:
        """(kind, lineno, excerpt, data) of the facts about the whole session."""
        providers = sorted(state.get("providers", []))
        if len(providers) > 1 and CPU in providers:
            yield "split_execution", *state["placement"], {"providers": _plain(providers), "accelerators": _plain([p for p in providers if p != CPU]),
                                                           "cpu_node_groups": state.get("groups", "0")}
        if state.get("nodes") and len(providers) > 1:
            lineno, excerpt, op = state["node"]
            yield "cpu_fallback_ops", lineno, excerpt, {"ops": _plain(sorted(ops)), "count": str(state["nodes"]), "first_op": op, "distinct_ops": str(len(ops))}
        if "missing" in state and state.get("active") == _plain([CPU]):
            lineno, excerpt, requested = state["missing"]
            yield "silent_cpu_only", lineno, excerpt, {"requested": requested, "actual": state["active"]}


def _taken(context: Context | None, heading: str | None, kind: str, data: dict) -> tuple[str | None, dict | None]:
    """The heading after a fact, and its payload under it; no payload where it is no fact."""
    if context is None:
        return heading, data
    if kind in context.opens and data.get(context.key) is not None:
        heading = data[context.key]
    if heading is None:
        return heading, None if context.required and kind in (context.takes or ()) else data
    if (context.takes is None or kind in context.takes) and context.key not in data:
        data = {**data, context.key: heading}
    return heading, data


class ArtifactState(StatefulProcessor):
    """State and output of one artifact. ``idle`` are milliseconds of event time.

    Every call of the handle or of a state is a round trip to the JVM, and most artifacts
    bring a few lines to a batch: so the state says itself when its timer is due (``timer``)
    and when the artifact is (``due``). A timer stays while lines move ``due`` on; when it
    fires too early, one for the rest follows.
    """

    def __init__(self, contexts: dict[str, Context | None], idle: int):
        self.contexts, self.idle = contexts, idle

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("artifact", "json string")
        self.ops = handle.getMapState("operators", "op string", "n long")

    def close(self) -> None:
        pass

    def _load(self) -> dict:
        stored = self.state.get()
        if stored is not None:
            return json.loads(stored[0])
        return {"timer": None, "due": None, "at": [0, -1], "heading": None, "seq": 0, "done": False, "kinds": [], "met": [], "session": {}}

    def _out(self, key, what: str, **values) -> Row:
        return Row(out=_plain({"what": what, "family": key[0], "artifact": key[1], **values}))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        state, latest = self._load(), 0
        was_done = state["done"]
        place = lambda r: (r["lineno"], -1 if r["ordinal"] is None else r["ordinal"])
        batch = [{**_ABSENT, **json.loads(r["entry"])} for r in rows]
        for r in sorted((r for r in batch if not r["end"]), key=place):
            latest = max(latest, r["ms"])
            if state["done"] or list(place(r)) <= state["at"]:
                if r["kind"] is not None:
                    yield self._out(key, "late", lineno=r["lineno"], ordinal=r["ordinal"], kind=r["kind"], excerpt=r["excerpt"], data=r["data"])
                continue
            state["at"] = list(place(r))
            if r["kind"] is None:
                continue
            state["heading"], data = _taken(self.contexts.get(key[0]), state["heading"], r["kind"], dict(r["data"] or {}))
            if data is None:
                continue
            state["seq"] += 1
            for mask in ("kinds", "met"):
                state[mask] = [a | b for a, b in zip(state[mask] or [0] * len(r[mask]), r[mask])]
            if key[0] == "onnxruntime":
                op = Session.see(state["session"], r["kind"], data, r["lineno"], r["excerpt"])
                if op is not None and not self.ops.containsKey((op,)):
                    self.ops.updateValue((op,), (1,))
            yield self._out(key, "fact", seq=state["seq"], lineno=r["lineno"], ordinal=r["ordinal"], kind=r["kind"], excerpt=r["excerpt"], data=data)
        ended = any(r["end"] for r in batch)
        if ended and not state["done"]:
            yield from self._finish(key, state)
        elif not state["done"] and latest:
            state["due"] = latest + self.idle
            if state["timer"] is None or state["due"] < state["timer"]:
                self._set_timer(state)
        if not was_done:
            self.state.update((json.dumps(state),))

    def _set_timer(self, state: dict) -> None:
        if state["timer"] is not None:
            self.handle.deleteTimer(state["timer"])
        self.handle.registerTimer(state["due"])
        state["timer"] = state["due"]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        state = self._load()
        if state["done"]:
            return
        fired = expiredTimerInfo.getExpiryTimeInMs()
        if fired < state["due"] and timerValues.getCurrentWatermarkInMs() <= state["due"]:
            state["timer"] = None
            self._set_timer(state)
        else:
            yield from self._finish(key, state)
        self.state.update((json.dumps(state),))

    def _finish(self, key, state: dict) -> Iterator[Row]:
        """Derived facts and the masks; what stays is that the artifact is done."""
        nodes = state["session"].get("nodes")
        ops = [k[0] for k in self.ops.keys()] if nodes else []
        for kind, lineno, excerpt, data in Session.derived(state["session"], ops):
            state["seq"] += 1
            yield self._out(key, "derived", seq=state["seq"], lineno=lineno, kind=kind, excerpt=excerpt, data={k: v for k, v in data.items() if v is not None})
        yield self._out(key, "done", seq=state["seq"], kinds=state["kinds"], met=state["met"])
        state.update(done=True, session={}, heading=None)
        if nodes:
            self.ops.clear()


def observations(lines: DataFrame, book: Rulebook) -> DataFrame:
    """Rows that state takes in: matched lines with the bits they set, the first line of every
    artifact whatever it says, and ``end`` rows."""
    names = [f.name for f in FAMILIES.values()]
    words = range(book.words)
    rows = lines.where(F.col("family").isin(names)).select(
        *KEY, "lineno", "line", "at", F.coalesce("end", F.lit(False)).alias("end"), F.inline_outer(observe(list(FAMILIES.values()))))
    return rows.where(F.col("kind").isNotNull() | (F.col("lineno") == 1) | F.col("end")).select(
        *KEY, "lineno", "ordinal", "kind", strip_unicode(F.col("line")).alias("excerpt"), "data", "end", "at", F.unix_millis("at").alias("ms"),
        F.array(*[book.kind_bit(F.col("family"), F.col("kind"), w) for w in words]).alias("kinds"),
        F.array(*[conditions_met(book, w) for w in words]).alias("met"))


def _combined(done: DataFrame, derived: DataFrame, book: Rulebook) -> DataFrame:
    """Profiles of finished artifacts, their derived facts included."""
    words = range(book.words)
    parts = done.select(*KEY, "kinds", "met", F.col("seq").alias("facts")).unionByName(artifact_profile(derived, book))
    merged = parts.groupBy(*KEY).agg(*[F.bit_or(F.coalesce(F.get(c, F.lit(w)), F.lit(0))).alias(f"{c}{w}") for c in ("kinds", "met") for w in words], F.max("facts").alias("facts"))
    return merged.select(*KEY, *[F.array(*[f"{c}{w}" for w in words]).alias(c) for c in ("kinds", "met")], "facts")


def diagnose_lines_stream(lines: DataFrame, out: str, checkpoint: str, idle_ms: int = 600_000, lateness: str = "1 hour", **trigger) -> StreamingQuery:
    """Facts, late facts and verdicts of a stream of lines (schema ``LINES``).

    Lines of an artifact are expected in order from batch to batch; inside a batch any order
    will do. Spark itself drops rows more than ``lateness`` behind the latest event time; what
    is behind its artifact only, or after its end, is kept in ``late``. ``out`` gets the tables ``facts``, ``late`` and ``verdicts``, a folder for each
    batch, so a batch that is run again replaces its own rows. An artifact's lines of one
    batch meet in one task; bound a batch by the source (``maxFilesPerTrigger``).
    """
    spark, book = lines.sparkSession, Rulebook.builtin()
    contexts = {f.name: f.context for f in FAMILIES.values()}
    for rule in book.rules:
        context = contexts.get(rule["family"])
        if context and any(c["field"] == context.key for c in rule["conditions"]):
            raise ValueError(f"{rule['id']}: a condition on a block's heading can't be judged line by line")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = observations(lines.withWatermark("at", lateness), book)
    entries = rows.select(*KEY, "at", F.to_json(F.struct(*_ENTRY), {"ignoreNullFields": "false"}).alias("entry"))
    states = entries.groupBy(*KEY).transformWithState(ArtifactState(contexts, idle_ms), _PACKED, "Append", "EventTime")

    def work(batch: DataFrame, epoch: int) -> None:
        batch = stage(batch.select(F.inline(F.array(F.from_json("out", _OUT, {"mode": "FAILFAST"})))), "stream-batch")
        found = as_facts(batch.where("what in ('fact', 'derived')"), F.col("lineno"))
        done = batch.where("what = 'done'")
        fired = match_rules(_combined(done, as_facts(batch.where("what = 'derived'"), F.col("lineno")), book), book)
        for name, df in (("facts", found.select(*FACTS.fieldNames())), ("late", batch.where("what = 'late'").select(*KEY, "lineno", "ordinal", "kind", "excerpt", "data")),
                         ("verdicts", verdicts(done, fired.withColumn("origin", F.lit("rules"))))):
            df.write.mode("overwrite").parquet(f"{out}/{name}/epoch={epoch}")

    return states.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).outputMode("append").trigger(**trigger).start()


def streamed(spark: SparkSession, out: str, name: str) -> DataFrame:
    """One of the tables of ``diagnose_lines_stream``."""
    return spark.read.parquet(f"{out}/{name}").drop("epoch")
