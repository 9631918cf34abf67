"""Prefixes from a table against one replacement after the other."""

import random

from faultscope.operators.path_table import replaced, scrub_by_table


def one_by_one(text, prefixes):
    for p in sorted((p for p in prefixes if p and p != "/"), key=lambda p: (-len(p), p)):
        text = text.replace(p, prefixes[p])
    return text


def test_ten_thousand_prefixes_of_many_machines(spark):
    rnd = random.Random(3)
    parts = ["home", "ci", "app", ".venv", "data", "u1", "u12", "é", "x y", "bin"]
    table = {}
    while sum(map(len, table.values())) < 10_000:
        machine = f"m{rnd.randint(0, 40)}"
        prefix = "".join("/" + rnd.choice(parts) + (str(rnd.randint(0, 99)) if rnd.random() < 0.5 else "") for _ in range(rnd.randint(1, 4)))
        mine = table.setdefault(machine, {})
        mine[prefix] = f"<{len(mine)}>"
    table.setdefault("m0", {}).update({"": "<EMPTY>", "/": "<ROOT>", "C:\\x": "<C>"})
    rows = []
    for k in range(400):
        machine = f"m{rnd.randint(0, 42)}"
        known = list(table.get(machine, {"/none": ""}))
        text = rnd.choice(["", "see "]) + " and ".join(rnd.choice(known) + rnd.choice(["", "/bin", "x", "/", " C:\\xy"]) for _ in range(rnd.randint(0, 6)))
        rows.append((k, machine, text if k % 17 else None))
    frame = spark.createDataFrame(rows, "id long, machine string, text string").repartition(3)
    prefixes = spark.createDataFrame([(m, p, n) for m, ps in table.items() for p, n in ps.items()], "machine string, prefix string, placeholder string")
    scrubbed = scrub_by_table(frame, prefixes)
    got = {r.id: r.text for r in scrubbed.collect()}
    assert got == {k: None if t is None else one_by_one(t, table.get(m, {})) for k, m, t in rows}
    # No chain of replacements: the plan does not grow with the table.
    assert len(scrubbed._jdf.queryExecution().optimizedPlan().toString()) < 20_000
    assert scrub_by_table(frame, prefixes.where("false")).count() == 400


def test_longer_prefixes_win_over_those_further_left():
    found = [(0, "/a/b", "<1>"), (2, "/b/c/d", "<2>"), (0, "/a", "<3>")]
    assert replaced("/a/b/c/d", found) == one_by_one("/a/b/c/d", {p: n for _, p, n in found}) == "<3><2>"
