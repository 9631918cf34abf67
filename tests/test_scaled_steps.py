"""Steps of whole ways that must not be done twice, alone or once per artifact."""

import collections
import contextlib
import json
import os

from pyspark.sql import Row
from pyspark.sql import functions as F

from faultscope.sources import report_files
from faultscope.staging import shared_folder
from faultscope.streaming.stateful import ArtifactState
from faultscope.workload import relations, whole


class Counted:
    """A handle and its states that write down every call."""

    def __init__(self):
        self.value, self.calls = None, []

    def getValueState(self, *_):
        return self

    getMapState = getValueState

    def __getattr__(self, name):
        def call(*args):
            self.calls.append((name, *args))
            if name == "update":
                self.value = args[0]
            return {"get": self.value, "exists": self.value is not None}.get(name, [])
        return call

    def taken(self):
        out, self.calls = [c[0] if c[0] in ("get", "update") else c for c in self.calls], []
        return out


class Clock:
    def __init__(self, ms):
        self.getCurrentWatermarkInMs = self.getExpiryTimeInMs = lambda: ms


def _line(n, ms, end=False):
    return Row(entry=json.dumps({"lineno": n, "ms": ms, "end": end}))


def test_state_is_asked_once_and_timers_move_on_by_themselves():
    handle, key = Counted(), ("raspberrypi", "a.log")
    state = ArtifactState({}, 1000)
    state.init(handle)
    assert list(state.handleInputRows(key, iter([_line(1, 500)]), None)) == []
    assert handle.taken() == ["get", ("registerTimer", 1500), "update"]
    assert list(state.handleInputRows(key, iter([_line(2, 900)]), None)) == [] and handle.taken() == ["get", "update"]
    # Lines came since: not the end yet, a timer for the rest.
    assert list(state.handleExpiredTimer(key, Clock(1600), Clock(1500))) == []
    assert handle.taken() == ["get", ("registerTimer", 1900), "update"]
    assert [json.loads(r["out"])["what"] for r in state.handleExpiredTimer(key, Clock(2000), Clock(1900))] == ["done"]
    assert handle.taken() == ["get", "update"]
    assert list(state.handleInputRows(key, iter([_line(2, None, True)]), None)) == [] and handle.taken() == ["get"]


def test_a_line_before_the_last_batch_brings_the_end_forward():
    handle, key = Counted(), ("raspberrypi", "a.log")
    state = ArtifactState({}, 1000)
    state.init(handle)
    for n, ms in ((1, 800), (2, 300)):
        list(state.handleInputRows(key, iter([_line(n, ms)]), None))
    assert handle.taken() == ["get", ("registerTimer", 1800), "update", "get", ("deleteTimer", 1800), ("registerTimer", 1300), "update"]
    # Time may be past both ends when the timer fires.
    list(state.handleInputRows(key, iter([_line(3, 900)]), None))
    assert len(list(state.handleExpiredTimer(key, Clock(5000), Clock(1300)))) == 1


def _events(spark, folder):
    kinds = F.element_at(F.array(*[F.lit(x) for x in ("signup", "error", "click", "view", "purchase")]), (F.col("id") * 7 % 5 + 1).cast("int"))
    spark.range(160).select(
        F.col("id").alias("event_id"), F.timestamp_seconds("id").alias("ts"), (F.col("id") % 3).alias("user_id"), kinds.alias("event_type"),
        (F.col("id") / 4).alias("value"), F.concat(F.lit('{"k": '), F.col("id") % 40, F.lit("}")).alias("props")).write.parquet(f"{folder}/events.parquet")
    return str(folder)


def _staged(spark):
    folder = f"{shared_folder(spark)}/faultscope"
    return collections.Counter(name.rpartition("-")[0] for name in os.listdir(folder)) if os.path.isdir(folder) else collections.Counter()


def test_facts_read_once_and_trace_events_are_not_written_again(spark, tmp_path):
    sf = _events(spark, tmp_path)
    before = _staged(spark)
    assert relations.j1_rules_by_artifact(spark, sf).count() > 0
    assert not (_staged(spark) - before)["facts"]
    before = _staged(spark)
    assert whole.run_logs_and_traces(spark, sf).count() == 43
    assert (_staged(spark) - before)["trace-events"] == 1


def test_a_batch_of_the_stream_is_written_and_read_by_many_tasks(spark, tmp_path, monkeypatch):
    seen = []

    class Started:
        def awaitTermination(self):
            pass

    monkeypatch.setattr(whole, "diagnose_lines_stream", lambda stream, *_, **__: seen.append(stream) or Started())
    monkeypatch.setattr(whole, "streamed", lambda *_: None)
    before = set(os.listdir(f"{shared_folder(spark)}/faultscope")) if _staged(spark) else set()
    whole._streamed(spark, _events(spark, tmp_path), "verdicts")
    [source] = [n for n in set(os.listdir(f"{shared_folder(spark)}/faultscope")) - before if n.startswith("arriving")]
    source = f"{shared_folder(spark)}/faultscope/{source}"
    for k in range(5):
        assert sum(n.endswith(".parquet") for n in os.listdir(f"{source}/part={k}")) == whole._FILES > 1
    lines = spark.read.parquet(source)
    assert lines.where("family is not null and not end").count() == 160 and lines.where("end").count() == 40
    # An artifact's lines of a part lie in one file.
    assert lines.where("family is not null").withColumn("file", F.input_file_name()).groupBy("part", "artifact").agg(F.countDistinct("file").alias("n")).where("n > 1").count() == 0


def test_documents_of_one_file_share_its_opening(spark, tmp_path):
    rows = [("f", f"a{n:03d}", 0, 0, 0, False, True, f'{{"n":{n}}}\n') for n in range(120)]
    frame = spark.createDataFrame(rows, "family string, artifact string, section int, at long, pos long, element boolean, ends boolean, text string").coalesce(1)
    manifest = report_files.write_documents(frame, str(tmp_path / "reports"))
    assert {(r.artifact, r.document) for r in report_files.read_documents(manifest).collect()} == {(r[1], r[7]) for r in rows}
    parts, files = [r.asDict() for r in manifest.collect()], {}
    opened = lambda path: contextlib.nullcontext(files[path] if path in files else files.setdefault(path, report_files._open_file(path)))
    assert {b"".join(report_files.document_pieces([p], opened=opened)).decode() for p in parts} == {r[7] for r in rows}
    assert len(files) == len({p["path"] for p in parts}) < len(parts)
