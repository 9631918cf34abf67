"""Documents read block by block against the reader of whole rows."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from faultscope.sources import json_blocks
from faultscope.sources.artifacts import read_artifacts
from faultscope.sources.json_blocks import scan
from faultscope.sources.traces import read_trace, read_trace_documents
from faultscope.staging import stage


def events(n, seed=1):
    rnd = random.Random(seed)
    odd = ["", "}", "{", "a,b", '"', "\\", '\\"', "]", "é}你", "x" * 300, "\\\\", "line\nbreak", " "]
    kinds = [lambda: {"cat": "Node", "name": rnd.choice(odd), "dur": rnd.randint(0, 99), "args": {"op_name": rnd.choice(odd), "list": [1, [2, {"d": {}}]]}},
             lambda: rnd.choice([1, -2.5e3, None, True, "text}", [], {}, [[{}]], {"a": {"b": {"c": "}"}}}])]
    return [rnd.choice(kinds)() for _ in range(n)]


def documents():
    some, more = events(6), events(60, 2)
    good = {
        "line": json.dumps(some), "ascii": json.dumps(some, ensure_ascii=True), "raw": json.dumps(some, ensure_ascii=False), "pretty": json.dumps(some, indent=2), "tabs": json.dumps(some, indent="\t") + "\n\n",
        "object": json.dumps({"traceEvents": some}), "members": json.dumps({"unit": "ns", "other": {"a": some, "b": {"traceEvents": [7]}}, "traceEvents": some, "tail": [some, 1], "e": {}, "f": []}, indent=1),
        "many": json.dumps(more), "empty": "[]", "blank": " [\n ] ", "none": '{"traceEvents": []}', "one": "[{}]", "escaped": '{"trace\\u0045vents": [1, {"a": "\\u007d"}]}', "nested": "[[1, 2], [[3]], {}]",
        "crlf": json.dumps(some, indent=2).replace("\n", "\r\n"), "scalars": '["a", 1, null, true, 1e5]',
    }
    text = json.dumps(some)
    bad = {
        "cut": text[:-1], "cut2": text[:len(text) // 2], "open": text[:text.index('"') + 1], "after": text + " x", "twice": text + text, "close": text + "]", "comma": text[:-1] + ",]", "commas": text[:1] + "," + text[1:],
        "scalar": "17", "word": "null", "nothing": "   ", "keys": '{"traceEvents": 3}', "map": '{"traceEvents": {"a": 1}}', "other": '{"events": [1]}', "same": '{"traceEvents": [1], "traceEvents": [2]}',
        "same2": '{"a": {"k": 1, "k": 2}, "traceEvents": [1]}', "nan": "[NaN]", "pair": '[{"a": 1]]', "pair2": '{"traceEvents": [1}', "colon": '{"traceEvents": : [1]}', "bare": '{traceEvents: [1]}', "gap": "[1 2]",
        "quote": "['a']", "swap": "]1[", "member": '{"traceEvents": [1], "b"}', "member2": '{"traceEvents": [1] "b": 2}', "member3": '{"traceEvents": [1],}', "value": '{"traceEvents": [1], "b": 2 3}', "key": '[{"a" 1}]',
        "inner": '{"traceEvents": [1], "b": [1,,2]}', "before": 'x [1]', "control": '["a\u0001"]', "zero": "[01]", "extra": '{"traceEvents": [1]}, {}', "list": '{"traceEvents": [1], "c": {[1]}}', "slash": '[1, \\"a"]',
        "strings": '["a" "b"]', "deep": '[{"a": [1}]', "unclosed": '["abc', "trail": '{"traceEvents": 1 [2]}', "trail2": '{"traceEvents": [2] 1}', "key2": '{"traceEvents" 5: [2]}', "none2": "", "bom": "﻿[1]",
    }
    return good, bad


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("documents")
    good, bad = documents()
    for name, text in {**good, **bad}.items():
        (path / f"{name}.json").write_bytes(text.encode())
    (path / "bytes.json").write_bytes(b'["\xff\xfe", "\xc3}"]')
    return path


@pytest.fixture(scope="module")
def want(spark, folder):
    rows = read_trace(read_artifacts(spark, str(folder), "ort_profile")).select("artifact", "idx", F.to_json("ev").alias("ev")).collect()
    return sorted(map(tuple, rows))


def test_rows_hold_what_the_parser_of_python_finds(want):
    good, bad = documents()
    found = {}
    for artifact, idx, ev in want:
        found.setdefault(artifact.removesuffix(".json"), []).append(json.loads(ev))
    del found["bytes"]
    assert not set(found) & set(bad)
    for name, text in good.items():
        doc = json.loads(text)
        assert found.get(name, []) == (doc if isinstance(doc, list) else doc["traceEvents"]), name


@pytest.mark.parametrize("block, names", [(64, ["members", "crlf", "after", "line", "trail"]), (700, None), (1 << 20, None)])
def test_blocks_of_any_size(spark, folder, want, monkeypatch, block, names):
    """Only the documents are read in small blocks, not the tables in between."""
    keep = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}

    def staged(df, name):
        try:
            if name in ("json-maps", "json-cuts"):
                spark.conf.set("spark.sql.files.maxPartitionBytes", str(block))
                spark.conf.set("spark.sql.files.openCostInBytes", "1")
            return stage(df, name)
        finally:
            for c, v in keep.items():
                spark.conf.set(c, v)

    monkeypatch.setattr(json_blocks, "stage", staged)
    paths = str(folder) if names is None else [str(folder / f"{n}.json") for n in names]
    got = read_trace_documents(spark, paths).select("artifact", "idx", F.to_json("ev").alias("ev")).collect()
    mine = [w for w in want if names is None or w[0].removesuffix(".json") in names]
    assert sorted(map(tuple, got)) == mine and mine


def test_scan_agrees_with_one_byte_at_a_time():
    rnd = random.Random(3)
    for _ in range(300):
        data = bytes(rnd.choice(b'\\\\"a}') for _ in range(rnd.randint(1, 30)))
        for escaped in (False, True):
            inside, esc, want = False, escaped, []
            for c in data:
                if esc:
                    esc = False
                elif c == 92:
                    esc = True
                elif c == 34:
                    inside = not inside
                want.append(inside)
            got, after = scan(np.frombuffer(data, np.uint8), escaped)
            assert got.tolist() == want and after == esc, (data, escaped)
