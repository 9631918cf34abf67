"""Comparison by classes of equal outputs and by digests, against every pair and row."""

import itertools
import random

from faultscope.operators import audit
from faultscope.operators.compare import class_agreement, class_pairs, output_classes, with_representatives
from faultscope.schema import FACTS

RUNS = "host string, model string, variant string, inputs string, output string"


def test_counts_of_all_pairs_come_from_class_sizes(spark):
    rnd = random.Random(11)
    hosts = [f"h{n}" for n in range(60)]
    suits = {h: rnd.choice([True, False, None]) for h in hosts}
    runs = [(h, m, "plain", "in", f"o{rnd.randint(0, 3)}") for h in hosts for m in ("hot", "rare") if m == "hot" or h < "h2"]
    frame = spark.createDataFrame(runs + runs[:9], RUNS)
    verdicts = spark.createDataFrame(list(suits.items()), "host string, suitable boolean")
    classes = output_classes(frame, verdicts)
    want = {}
    for a, b in itertools.permutations(set(runs), 2):
        if a[1] == b[1] and suits[b[0]]:
            want.setdefault(a[1], []).append((a[4], b[4]))
    got = {r.model: r for r in class_agreement(classes).collect()}
    for model, pairs in want.items():
        assert (got[model].pairs, got[model].agree) == (len(pairs), sum(x == y for x, y in pairs))
        assert got[model].differ == got[model].pairs - got[model].agree
    assert got["hot"].hosts == 60 and classes.where("model = 'hot'").count() == 4
    rows = class_pairs(with_representatives(classes, frame, verdicts)).collect()
    assert {(r.model, r.output, r.baseline_output): r.pairs for r in rows} == {(m, *p): ps.count(p) for m, ps in want.items() for p in set(ps)}
    for r in rows:
        assert r.representative == min(h for h, m, _, _, o in runs if (m, o) == (r.model, r.output))
        assert r.baseline_representative == min(h for h, m, _, _, o in runs if (m, o) == (r.model, r.baseline_output) and suits[h])
    assert class_agreement(classes.where("false")).count() == 0


def fact(artifact, seq, value, kind="k"):
    return ("f", artifact, seq, f"f{seq}", kind, "s", f"{artifact}:{seq}", "e", {"v": value, "w": "1"})


def test_a_planted_swap_is_found_and_nothing_else_is_read(spark):
    rows = [fact(f"a{a}", s, str(s)) for a in range(20) for s in range(1, 30)]
    swapped = [fact("a7", 3, "4") if r[1] == "a7" and r[2] == 3 else fact("a7", 4, "3") if r[1] == "a7" and r[2] == 4 else r for r in rows]
    first, second = spark.createDataFrame(rows, FACTS), spark.createDataFrame(swapped[::-1], FACTS).repartition(5)
    assert audit.changed_artifacts(first, first.repartition(7)).count() == 0
    assert [r.artifact for r in audit.changed_artifacts(first, second).collect()] == ["a7"]
    found = sorted((r.artifact, r.id, r.problem) for r in audit.determinism(first, second).collect())
    assert found == [("a7", i, f"only in the {n} run") for i in ("f3", "f4") for n in ("first", "second")]
    # The rows are compared behind a semi join with the changed artifacts.
    assert audit.determinism(first, second)._jdf.queryExecution().optimizedPlan().toString().count("LeftSemi") >= 2


def test_repeated_and_missing_rows(spark):
    rows = [fact("a", 1, "x"), fact("a", 2, "y"), fact("b", 1, "z")]
    first, second = spark.createDataFrame(rows, FACTS), spark.createDataFrame([rows[0], rows[1], rows[1]], FACTS)
    assert sorted((r.artifact, r.id, r.problem) for r in audit.determinism(first, second).collect()) == [("a", "f2", "only in the second run"), ("b", "f1", "only in the first run")]
    assert [(r.id, r.problem) for r in audit.determinism(second, second).collect()] == [("f2", "id given twice")]
