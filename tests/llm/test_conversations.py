"""Conversation repair against all edits of short conversations and a plain dynamic program."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from faultscope.llm import conversation_repair as repair

ROWS = "conv_id long, turn long, role string, text string, pos long, edits string"
LEGAL = re.compile("(s?(ua)+)?")


def brute_edits(symbols):
    """Cheapest cost and ASCII-least initials, by a table over (row, state): no runs, no matrices."""
    def follows(state):
        return {"": "su", "s": "u", "u": "a", "a": "u"}[state]

    table = {"": (0, "")}

    def inserted(table):
        for _ in range(4):
            for state, (cost, audit) in list(table.items()):
                for role in follows(state).replace("s", ""):
                    new = (cost + 5, audit + "I")
                    table[role] = min(table.get(role, (10**9, "")), new)
        return table

    for role, fault in symbols:
        nxt = {}

        def put(state, cost, audit):
            nxt[state] = min(nxt.get(state, (10**9, "")), (cost, audit))

        for state, (cost, audit) in inserted(table).items():
            put(state, cost + 2, audit + "D")
            if fault != "x":
                extra = 5 if fault == "t" else 0
                if role and role in follows(state):
                    put(role, cost + extra, audit + "K")
                for new in follows(state).replace("s", ""):
                    put(new, cost + 1 + extra, audit + "R")
        table = nxt
    table = inserted(table)
    return min(table[s] for s in ("", "a") if s in table)


def encoded(symbols):
    return bytes(("sua".find(r) if r and r in "sua" else 3) * 3 + "-tx".index(f) for r, f in symbols)


def audit_of(symbols, **bounds):
    return "".join(repair.slice_edits(encoded(symbols), **bounds)[0])


KINDS = list(itertools.product("suat", "-tx"))


def test_short_sequences():
    for n in (1, 2, 3):
        for symbols in itertools.product(KINDS, repeat=n):
            cost, audit = brute_edits(symbols)
            assert audit_of(symbols) == audit


def test_every_edit_of_tiny_conversations():
    """The table above against all strings of edits, so that both are right about ties."""
    rnd = random.Random(1)
    for _ in range(60):
        symbols = [rnd.choice(KINDS) for _ in range(rnd.randint(1, 3))]
        best = None
        for gaps in itertools.product(range(3), repeat=len(symbols) + 1):
            for kinds in itertools.product("DKR", repeat=len(symbols)):
                for roles in itertools.product("ua", repeat=sum(gaps) + kinds.count("R")):
                    new, out, audit, cost, bad = iter(roles), "", "", 0, False
                    for k, gap in enumerate(gaps):
                        out += "".join(next(new) for _ in range(gap))
                        audit, cost = audit + "I" * gap, cost + 5 * gap
                        if k < len(symbols):
                            role, fault = symbols[k]
                            bad |= fault == "x" and kinds[k] != "D"
                            cost += {"D": 2, "K": 0, "R": 1}[kinds[k]] + (5 if fault == "t" and kinds[k] != "D" else 0)
                            out += {"D": "", "K": role, "R": ""}[kinds[k]]
                            out += next(new) if kinds[k] == "R" else ""
                            audit += kinds[k]
                    if not bad and LEGAL.fullmatch(out):
                        best = min(best or (cost, audit), (cost, audit))
        assert brute_edits(symbols) == best


def test_long_runs_by_powers():
    rnd = random.Random(4)
    for _ in range(200):
        symbols = [s for _ in range(rnd.randint(1, 9)) for s in [rnd.choice(KINDS)] * rnd.choice([1, 2, 3, 17, 64])]
        assert audit_of(symbols) == brute_edits(symbols)[1]
        matrix, end = repair.slice_matrix(encoded(symbols)), repair.END
        assert min(matrix[r] + end[r] for r in range(4)) == brute_edits(symbols)[0]


def brute_report(rows, cut=True):
    by = {}
    for conv, turn, role, text in rows:
        mine = by.setdefault(conv, [])
        shown = [" " if x is None else str(x) for x in (conv, turn, role, text)]
        role, text, kind = shown[2], shown[3], zlib.crc32(f"{shown[0]}:{shown[1]}".encode()) % 20 if cut else 9
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        row = (turn, "user" if kind == 4 else role, text)
        mine += [row, row] if kind == 3 else [row]
    out = []
    for conv, mine in by.items():
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2][:64], hashlib.sha256(r[2].encode()).digest()))
        seen, symbols, faults = set(), [], []
        for turn, role, text in mine:
            shown = re.sub("[\x20\x09-\x0d]", "", text)
            fault = "b" if not shown else "d" if (role, text) in seen else "t" if shown[-1] not in ".!?" else "-"
            seen.add((role, text))
            faults.append(fault)
            symbols.append((role[:1], {"b": "x", "d": "x"}.get(fault, fault)))
        cost, audit = brute_edits(symbols)
        turns = [r[0] for r in mine if r[0] is not None]
        k, lines, last = 0, [], ""
        for edit in audit:
            new = {"": "user", "s": "user", "u": "assistant", "a": "user"}[last]
            if edit == "I":
                lines.append(f"{new}:")
            else:
                role, text = mine[k][1:]
                k += 1
                if edit == "D":
                    continue
                new = role if edit == "K" else new
                lines.append(f"{new}:{text}")
            last = new[:1]
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(symbols, symbols[1:]))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out.append((conv, gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def random_conversations(n=60, seed=6):
    rnd = random.Random(seed)
    rows = []
    for conv in [*range(n), None]:
        for turn in range(rnd.choice([1, 2, 5, 9, 40])):
            role = rnd.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = rnd.choice(["Yes.", "No!", "open end", " ", "", None, f"text {rnd.randint(0, 3)}?", "é 你好。", "x" * 3000 + "."])
            rows.append((conv, turn if rnd.random() < 0.9 else None, role, text))
    return rows + rows[5:9]


def test_reports_of_damaged_conversations(spark):
    rows = random_conversations()
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], ROWS).repartition(5)
    want = brute_report(rows)
    got = repair.with_emptied(repair.repair_report(repair.damaged(frame)), frame)
    assert sorted((tuple(r[c] for c in COLUMNS) for r in got.collect()), key=repr) == want
    none = frame.where("false")
    assert repair.with_emptied(repair.repair_report(repair.damaged(none)), none).count() == 0


@pytest.mark.parametrize("bits", [1, 3])
def test_conversations_over_many_slices(spark, bits):
    rows = random_conversations(12, 9) + [(99, k, random.Random(k).choice(["user", "assistant", "user"]), f"turn {k // 2}.") for k in range(150)]
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], ROWS)
    got = repair.repair_report(frame, bits=bits)
    assert sorted((tuple(r[c] for c in COLUMNS) for r in got.collect()), key=repr) == brute_report(rows, cut=False)


def test_repaired_rows_alternate(spark):
    frame = spark.createDataFrame([(*r, 1, "x") for r in random_conversations(20, 3)], ROWS)
    edits, _ = repair.repair(frame)
    out = {}
    for r in repair.repaired_rows(edits).orderBy("conv_id", "pos", "nth").collect():
        out[r.conv_id] = out.get(r.conv_id, "") + r.role[0]
    assert out and all(LEGAL.fullmatch(x) for x in out.values())
