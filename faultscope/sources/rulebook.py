"""The rule table of a run."""

import json
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultscope.families import FAMILIES, profile
from faultscope.operators.rule_tables import normalize_rules
from faultscope.schema import RULES
from faultscope.staging import stage

# Bits of one mask word; a family with more kinds takes more words.
WORD = 63


def _builtin(rule: dict, family: str, order: int) -> dict:
    """A rule of this package in the rules schema."""
    pieces = re.split(r"\{(\w+)\}", rule["message"])
    return {
        "family": family, "id": rule["id"], "severity": rule["severity"], "ord": order,
        "requires": rule["requires"], "absent": rule.get("absent", []), "optional": rule.get("optional", []),
        "conditions": [{"kind": c["kind"], "field": c["field"], "lo": c.get("min"), "hi": c.get("max"), "ok": True}
                       for c in rule.get("conditions", [])],
        "segments": [{"lit": p, "key": None} if i % 2 == 0 else {"lit": None, "key": p}
                     for i, p in enumerate(pieces) if p],
        "cause": rule["cause"], "refs": rule["refs"],
        "suggestions": [{"summary": s["summary"], "command": s.get("command", ""),
                         "applicability": s.get("applicability", "maybe-incorrect")} for s in rule["suggestions"]],
    }


@dataclass(frozen=True)
class Rulebook:
    """The rules of this package, known when the plan is built. So kinds and conditions
    become bits of a few words, and an artifact's whole evidence is those words. Rules
    from outside are a ``RuleTable``."""

    rules: tuple[dict, ...]

    @classmethod
    def builtin(cls) -> "Rulebook":
        by_family = {**{f.name: f.rules for f in FAMILIES.values()}, profile.NAME: profile.RULES}
        return cls(tuple(_builtin(r, name, i) for name, rules in by_family.items() for i, r in enumerate(rules)))

    @staticmethod
    def of(rules: DataFrame) -> "RuleTable":
        """From a table in the rules schema, which stays a table."""
        return RuleTable(rules)

    @staticmethod
    def read(spark: SparkSession, path: str) -> "RuleTable":
        """A rule table in JSON lines: ``family``, ``ord`` and the fields of a rule. Lines
        that are no JSON object are dropped one by one. What is read is staged once."""
        raw = spark.read.text(path).select(F.try_parse_json("value").alias("rule"))
        return RuleTable(stage(normalize_rules(raw.select(
            F.try_variant_get("rule", "$.family", "string").alias("family"),
            F.coalesce(F.try_variant_get("rule", "$.ord", "int"), F.lit(0)).alias("ord"), "rule")), "rules"))

    @staticmethod
    def _bits(names: list[str]) -> dict[str, tuple[int, int]]:
        return {n: (i // WORD, 1 << i % WORD) for i, n in enumerate(dict.fromkeys(names))}

    def kind_bits(self, family: str) -> dict[str, tuple[int, int]]:
        """Word and bit of every kind that the family's rules require or forbid."""
        kinds = [k for r in self.rules if r["family"] == family for k in (*r["requires"], *r["absent"])]
        return self._bits(kinds)

    def condition_bits(self, family: str) -> dict[str, tuple[int, int]]:
        keys = [json.dumps(c, sort_keys=True) for r in self.rules if r["family"] == family for c in r["conditions"]]
        return self._bits(keys)

    @property
    def words(self) -> int:
        """Mask words that the largest family takes, one at least."""
        most = [len(bits) for f in self.families for bits in (self.kind_bits(f), self.condition_bits(f))]
        return -(-max([1, *most]) // WORD)

    @property
    def families(self) -> list[str]:
        return list(dict.fromkeys(r["family"] for r in self.rules))

    def _local(self, spark: SparkSession, rows: list[dict], schema: T.StructType) -> DataFrame:
        """A driver-side list as a relation of the JVM: no Python worker, no RDD, and Spark
        judges its size when it joins."""
        return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), T.ArrayType(schema))))

    def table(self, spark: SparkSession) -> DataFrame:
        """The rules schema plus the masks ``need``, ``bar`` and ``meet``, arrays of words."""
        mask = T.ArrayType(T.LongType())
        masks = T.StructType([*RULES.fields, *(T.StructField(n, mask) for n in ("need", "bar", "meet"))])
        words = self.words
        bits = {f: (self.kind_bits(f), self.condition_bits(f)) for f in self.families}

        def packed(places) -> list[int]:
            out = [0] * words
            for word, bit in places:
                out[word] |= bit
            return out

        rows = []
        for r in self.rules:
            kinds, conds = bits[r["family"]]
            rows.append({**r, "need": packed(kinds[k] for k in r["requires"]), "bar": packed(kinds[k] for k in r["absent"]),
                         "meet": packed(conds[json.dumps(c, sort_keys=True)] for c in r["conditions"])})
        return self._local(spark, rows, masks)

    def roles(self, spark: SparkSession) -> DataFrame:
        """``(family, kind, code, grp, keys, conditions)``: which kinds a rule cites,
        in which order group (0 required, then each optional kind), and which
        payload keys its message uses."""
        schema = T.StructType([
            T.StructField("family", T.StringType()), T.StructField("kind", T.StringType()),
            T.StructField("code", T.StringType()), T.StructField("ord", T.IntegerType()), T.StructField("grp", T.IntegerType()),
            T.StructField("keys", T.ArrayType(T.StringType())),
            T.StructField("conditions", RULES["conditions"].dataType)])
        rows = []
        for r in self.rules:
            keys = list(dict.fromkeys(s["key"] for s in r["segments"] if s["key"]))
            kinds = [(k, 0) for k in r["requires"]]
            kinds += [(k, i + 1) for i, k in enumerate(r["optional"]) if k not in r["requires"]]
            rows += [{"family": r["family"], "kind": k, "code": r["id"], "ord": r["ord"], "grp": g, "keys": keys,
                      "conditions": [c for c in r["conditions"] if c["kind"] == k]} for k, g in kinds]
        return self._local(spark, rows, schema)

    def kind_bit(self, family: Column, kind: Column, word: int = 0) -> Column:
        """Bit of a fact's kind in one mask word, 0 for kinds no rule asks about."""
        out = F.lit(0).cast("bigint")
        for name in self.families:
            bits = {k: bit for k, (at, bit) in self.kind_bits(name).items() if at == word}
            if bits:
                table = F.create_map(*[x for k, b in bits.items() for x in (F.lit(k), F.lit(b).cast("bigint"))])
                out = F.when(family == name, F.coalesce(F.try_element_at(table, kind), F.lit(0).cast("bigint"))).otherwise(out)
        return out


@dataclass(frozen=True)
class RuleTable:
    """Rules that stay a DataFrame in the rules schema, however many: nothing passes the
    driver, and kinds and conditions are joined by name instead of numbered."""

    frame: DataFrame

    @property
    def rules(self) -> tuple[dict, ...]:
        """The rows on the driver, to look at a table that is known to be small."""
        rows = self.frame.orderBy("family", "ord").toLocalIterator()
        return tuple(r.asDict(recursive=True) for r in rows)

    def table(self, spark: SparkSession) -> DataFrame:
        """The rules schema."""
        return self.frame.select(*RULES.fieldNames())

    def roles(self, spark: SparkSession) -> DataFrame:
        """As ``Rulebook.roles``."""
        keys = F.array_distinct(F.transform(F.filter("segments", lambda s: s["key"].isNotNull()), lambda s: s["key"]))
        required = F.transform("requires", lambda k: F.struct(k.alias("kind"), F.lit(0).alias("grp")))
        optional = F.filter(F.transform("optional", lambda k, i: F.struct(k.alias("kind"), (i + 1).alias("grp"))),
                            lambda x: ~F.coalesce(F.array_contains("requires", x["kind"]), F.lit(False)))
        each = self.frame.select("family", F.col("id").alias("code"), "ord", keys.alias("keys"), "conditions",
                                 F.inline(F.concat(required, optional)))
        return each.select("family", "kind", "code", "ord", "grp", "keys",
                           F.filter("conditions", lambda c: c["kind"] == F.col("kind")).alias("conditions"))
