"""Verdicts over batches against one run over all."""

import itertools
import random

import pytest

from faultscope.operators.rules import artifact_profile, match_rules
from faultscope.operators.verdicts import verdicts
from faultscope.plans.standing import Standing
from faultscope.schema import FACTS
from faultscope.sources.rulebook import Rulebook


def rows(seed=4):
    rnd = random.Random(seed)
    kinds = {"polygraphy": ["output_mismatch", "all_outputs_matched", "mismatched_outputs", "shape_mismatch"], "raspberrypi": ["throttle_active", "throttle_occurred", "throttle_clear", "oom_kill"]}
    return [(f, f"{f}-{a}", s, f"f{s}", rnd.choice(kinds[f]), "s", f"{f}-{a}:{s}", "e", {"count": str(rnd.randint(1, 3))}) for f in kinds for a in range(12) for s in range(1, rnd.randint(2, 6))]


def found(df):
    return sorted(map(tuple, df.select("family", "artifact", "exit_code").collect()))


def test_batches_in_any_order_give_the_result_of_one_run(spark, tmp_path):
    every, book = rows(), Rulebook.builtin()
    facts = spark.createDataFrame(every, FACTS)
    clean = spark.createDataFrame([("raspberrypi", "clean.log")], "family string, artifact string")
    names = facts.select("family", "artifact").unionByName(clean)
    from pyspark.sql import functions as F
    want = found(verdicts(names, match_rules(artifact_profile(facts, book), book).withColumn("origin", F.lit("rules"))))
    firsts = sorted({(f, a, k): min(r[2] for r in every if (r[0], r[1], r[4]) == (f, a, k)) for f, a, _, _, k, *_ in every}.items())
    for n, order in enumerate([(0, 1, 2), (2, 0, 1)]):
        standing = Standing(spark, f"{tmp_path}/{n}")
        for part in order:
            standing.add(facts.where(F.col("seq") % 3 == part), clean if part == 1 else None)
        assert found(standing.verdicts()) == want and standing.version() == 3
        assert sorted(((r.family, r.artifact, r.kind), r.seq) for r in standing.firsts().collect()) == firsts
    # A batch that was taken in before changes nothing, and a new fact one artifact alone.
    assert standing.add(facts) == 0 and found(standing.verdicts()) == want
    one = spark.createDataFrame([("raspberrypi", "clean.log", 1, "f1", "oom_kill", "s", "clean.log:1", "e", {})], FACTS)
    assert standing.add(one) == 1
    assert found(standing.verdicts()) == sorted([w for w in want if w[1] != "clean.log"] + [("raspberrypi", "clean.log", 2)])
    assert Standing(spark, f"{tmp_path}/1").version() == 5
    with pytest.raises(ValueError):
        Standing(spark, f"{tmp_path}/1", Rulebook(book.rules[:3])).version()


def test_nothing_yet(spark, tmp_path):
    standing = Standing(spark, f"{tmp_path}/none")
    assert standing.version() == 0 and standing.verdicts().count() == 0 and standing.add(spark.createDataFrame([], FACTS)) == 0
