"""Rule tables by interval index and rarest kind, against one rule and artifact at a time."""

import random
import re

import pyarrow as pa
from pyspark.sql import functions as F

from faultscope.operators import rule_match
from faultscope.operators.ordered import running_count
from faultscope.operators.rules import artifact_profile, match_rules
from faultscope.schema import FACTS, RULES
from faultscope.sources.rulebook import Rulebook

NUMBER = re.compile(r"\s*[+-]?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?\s*")


def number(text):
    return float(text) if text is not None and NUMBER.fullmatch(text) and abs(float(text)) < float("inf") else None


def rule(k, requires, absent=(), conditions=(), family="f"):
    return (family, f"R{k}", "error", k, list(requires), list(absent), [], [(*c, True) if len(c) == 4 else c for c in conditions], [], "", [], [])


def brute(facts, rules):
    by = {}
    for family, artifact, seq, _, kind, *_, data in facts:
        by.setdefault((family, artifact), []).append((seq, kind, data))
    out = set()
    for (family, artifact), mine in by.items():
        kinds = {k for _, k, _ in mine}
        for fam, code, _, ord_, need, bar, _, conditions, *_ in rules:
            def met(c):
                kind, field, lo, hi, ok = c
                values = [number((d or {}).get(field)) for _, k, d in mine if k == kind]
                return ok and any(v is not None and (lo is None or v >= lo) and (hi is None or v <= hi) for v in values)
            if fam == family and need and set(need) <= kinds and not set(bar) & kinds and all(map(met, conditions)):
                out.add((family, artifact, code, ord_, max(s for s, _, _ in mine)))
    return out


def fired(spark, facts, rules):
    book = Rulebook.of(spark.createDataFrame(rules, RULES))
    rows = match_rules(artifact_profile(spark.createDataFrame(facts, FACTS), book), book).collect()
    assert len(rows) == len({tuple(r) for r in rows})
    return {(r.family, r.artifact, r.code, r.ord, r.facts) for r in rows}


def fact(artifact, seq, kind, data=None, family="f"):
    return (family, artifact, seq, f"f{seq}", kind, "s", f"{artifact}:1", "e", data)


def test_any_rules_against_any_facts(spark):
    rnd = random.Random(8)
    kinds = [f"k{n}" for n in range(12)]
    texts = ["1", "2", "-0.0", "0", "2.5", "1e1", "nan", "x", "", "5d", " 3 ", "-7"]
    facts = [fact(f"a{a}", s, rnd.choice(kinds), {rnd.choice("xyz"): rnd.choice(texts) for _ in range(rnd.randint(0, 3))}, rnd.choice("fg"))
             for a in range(40) for s in range(1, rnd.randint(2, 12))]
    bounds = [None, -7.0, -0.0, 0.0, 1.0, 2.0, 2.5, 3.0, 10.0, 11.0]
    rules = [rule(k, rnd.sample(kinds + ["nobody"], rnd.choice([0, 1, 1, 2, 3])), rnd.sample(kinds, rnd.choice([0, 0, 1])),
                  [(rnd.choice(kinds[:6]), rnd.choice("xyzw"), rnd.choice(bounds), rnd.choice(bounds)) for _ in range(rnd.choice([0, 0, 1, 2]))], rnd.choice("fg"))
             for k in range(300)]
    rules += [rule(900, ["k1", "k1"], [], [("k1", "x", None, None, False)]), rule(901, ["k2"], ["k2"]), rules[5], rule(902, ["k3"], [], [("k3", "x", None, None)])]
    want = brute(facts, rules)
    assert fired(spark, facts, rules) == want and len(want) > 50


def test_no_facts_or_no_rules(spark):
    assert fired(spark, [], [rule(1, ["a"])]) == set()
    assert fired(spark, [fact("a", 1, "k")], []) == set()


def test_twenty_thousand_conditions_on_one_hot_kind(spark):
    rnd = random.Random(9)
    facts = [fact(f"a{a}", s, "hot" if s % 3 == 0 else f"k{rnd.randint(0, 400)}", {"x": str(rnd.randint(0, 60_000))}) for a in range(30) for s in range(1, 100)]
    rules = [rule(k, ["hot", f"k{k % 400}"], [], [("hot", "x", float(3 * k), float(3 * k + 40))]) for k in range(20_000)]
    assert fired(spark, facts, rules) == brute(facts, rules)
    # Numbers meet bounds in one sort: as many rows as there are distinct numbers, not pairs.
    conditions = rule_match._conditions(rule_match.usable_rules(Rulebook.of(spark.createDataFrame(rules, RULES))))
    slots = rule_match.fact_slots(spark.createDataFrame(facts, FACTS), conditions)
    assert slots.count() <= 30 * 33
    # Every rule lists the hot kind first; the other one decides how many artifacts it is looked at for.
    frame = spark.createDataFrame(facts, FACTS)
    kinds = frame.select("family", "artifact", "kind").distinct()
    looked = rule_match.candidates(kinds, rule_match.usable_rules(Rulebook.of(spark.createDataFrame(rules, RULES)))).count()
    assert looked == kinds.where("kind <> 'hot' and kind <> 'k400'").count() * 50 < 30 * 20_000 / 4


def test_rules_of_the_same_kinds_are_looked_at_once(spark):
    """Artifacts meet premises; rules are told apart where they fire, by their own conditions."""
    rnd = random.Random(10)
    facts = [fact(f"a{a}", s, f"k{rnd.randint(0, 3)}", {rnd.choice("xy"): str(rnd.randint(0, 50))}) for a in range(20) for s in range(1, 6)]
    sets = [(["k0", "k1"], ["k3"]), (["k1", "k0"], ["k3"]), (["k2"], []), (["k2", "k1"], ["k0"])]
    rules = [rule(k, *sets[k % 4], [("k1", "x", float(k % 40), None), ("k2", "y", None, float(k % 13))][: k % 3]) for k in range(400)]
    frame = spark.createDataFrame(facts, FACTS)
    usable = rule_match.usable_rules(Rulebook.of(spark.createDataFrame(rules, RULES)))
    premises, by_premise = rule_match.premises(usable)
    assert premises.count() == 3 and by_premise.count() == 400
    assert rule_match.candidates(frame.select("family", "artifact", "kind").distinct(), premises).count() <= 3 * 20
    want = brute(facts, rules)
    assert fired(spark, facts, rules) == want and len(want) > 400


def test_counts_over_many_slices(spark):
    rows = [(f"k{n % 3}", float(n * 7 % 101), n % 2) for n in range(101)]
    got = running_count(spark.createDataFrame(rows, "key string, at double, one int"), ["key"], "at", "one", "n", bits=2).collect()
    assert all(r.n == sum(o for k, a, o in rows if k == r.key and a <= r.at) for r in got) and len(got) == 101


def test_conditions_are_judged_before_rows_are_made(spark, monkeypatch):
    """Masks of many chunks, spans and blocks; the step that makes the rows has no lambda left."""
    monkeypatch.setattr(rule_match, "SPAN", 2)
    monkeypatch.setattr(rule_match, "BLOCK", 0)
    rnd = random.Random(11)
    facts = [fact(f"a{a}", s, f"k{rnd.randint(0, 2)}", {rnd.choice("xy"): str(rnd.randint(0, 30))}) for a in range(25) for s in range(1, 5)]

    def condition():
        lo = rnd.choice([None, rnd.randint(0, 30)])
        return rnd.choice(["k0", "k1", "k7"] + ["k0"] * 5), rnd.choice("xxxz"), lo, rnd.choice([None, (lo or 0) + rnd.randint(-2, 12)])
    rules = [rule(k, ["k0"] if k % 3 else ["k0", "k1"], [], [tuple(float(v) if isinstance(v, int) else v for v in condition()) for _ in range(k % 4)]) for k in range(300)]
    book = Rulebook.of(spark.createDataFrame(rules, RULES))
    found = match_rules(artifact_profile(spark.createDataFrame(facts, FACTS), book), book)
    assert "lambda" not in found._jdf.queryExecution().optimizedPlan().toString().split("FlatMapCoGroupsInArrow")[0]
    want = brute(facts, rules)
    rows = found.collect()
    assert len(rows) == len(want) > 400 and {(r.family, r.artifact, r.code, r.ord, r.facts) for r in rows} == want


def test_masks_of_a_cell(monkeypatch):
    monkeypatch.setattr(rule_match, "STEP", 7)
    rnd = random.Random(12)
    chunks = [(63 * c, [{"field": rnd.choice([5, 9, 1 << 40, -1]), "first": (lo := rnd.choice([-1, rnd.randint(1, 20)])), "last": rnd.choice([1 << 62, lo + rnd.randint(-1, 3)]), "bit": 1 << rnd.choice([0, 1, 62])}
                        for _ in range(rnd.randint(1, 5))]) for c in (4, 0, 2, 1 << 35)]
    asked = [(i << 20, [{"field": rnd.choice([5, 9, 1 << 40, 77]), "slot": rnd.randint(1, 20)} for _ in range(rnd.randint(0, 6))], rnd.sample([c for c, _ in chunks], rnd.randint(1, 4))) for i in range(200)]
    point, ask = pa.struct([("field", pa.int64()), ("slot", pa.int64())]), pa.struct([(c, pa.int64()) for c in ("field", "first", "last", "bit")])
    got = rule_match.judge(
        pa.table({"id": [a for a, _, _ in asked], "points": pa.array([p for _, p, _ in asked], pa.list_(point)), "chunks": pa.array([c for *_, c in asked], pa.list_(pa.int64()))}),
        pa.table({"chunk": [c for c, _ in chunks], "conditions": pa.array([c for _, c in chunks], pa.list_(ask))}))
    want = {}
    for i, points, mine in asked:
        for c in mine:
            conditions = dict(chunks)[c]
            ok = [any(p["field"] == k["field"] and k["first"] <= p["slot"] <= k["last"] for p in points) for k in conditions]
            mask = sum(b for b in {k["bit"] for k in conditions} if all(o for o, k in zip(ok, conditions, strict=True) if k["bit"] == b))
            if mask:
                want[i, c] = mask
    assert {(r["id"], r["chunk"]): r["mask"] for r in got.to_pylist()} == want and len(want) > 20
