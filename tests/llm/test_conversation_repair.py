"""Conversation repair against plain search, the whole chart, and its SQL."""

import hashlib
import itertools
import re
import zlib
from collections import defaultdict

import duckdb
import pytest

from unitlens.llm import conversation_repair as repair
from unitlens.llm.queries import op12_conversation_repair
from unitlens.llm.sql import ORACLES

COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string, n string, audit int"


def by_search(kinds):
    """(cost, audit) by trying all edits: at most one insert is worth it before a turn, two behind the last."""
    best = None
    for edits in itertools.product("KRD", repeat=len(kinds)):
        for inserts in itertools.product(range(3), repeat=len(kinds) + 1):
            cost, audit, roles = 0, "", [""]

            def insert(n):
                nonlocal audit, cost, roles
                audit, cost, roles = audit + "I" * n, cost + 2 * n, ["".join(r) for r in itertools.product(roles, *["ua"] * n)]

            for kind, edit, n in zip(kinds, edits, inserts):
                insert(n)
                if kind == "-" and edit != "D":
                    break
                audit += edit
                cost += {"K": 0, "R": 2, "D": 3}[edit] + (kind.isupper() and edit != "D")
                new = {"K": [kind.lower()], "R": "ua", "D": [""]}[edit]
                roles = [r + x for r in roles for x in new]
            else:
                insert(inserts[-1])
                if any(re.fullmatch("(s?(ua)+)?", r) for r in roles):
                    best = min(best or (cost, audit), (cost, audit))
    return best


@pytest.mark.parametrize("n", [0, 1, 2, 3])
def test_least_repair_by_search(n):
    for kinds in itertools.product("suU-" if n == 3 else "suaoSUAO-", repeat=n):
        assert repair.repaired(repair.span_cell("".join(kinds))) == by_search(kinds), kinds


def test_all_splits_of_a_span_give_one_cell():
    for kinds in ("uaua", "sauo-U", "-U-Aous", "aaasss", "uuaa--oo"):
        chart = {(i, i + 1): repair.turn_cell(k) for i, k in enumerate(kinds)}
        for size in range(2, len(kinds) + 1):
            for i in range(len(kinds) - size + 1):
                cells = [repair.join(chart[i, k], chart[k, i + size]) for k in range(i + 1, i + size)]
                assert all(c == cells[0] for c in cells)
                chart[i, i + size] = cells[0]
        assert chart[0, len(kinds)] == repair.span_cell(kinds)


def plain(rows, damage=True):
    """The contract, conversation by conversation."""
    found = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        key = ":".join(" " if x is None else str(x) for x in (conv, turn))
        hit = zlib.crc32(key.encode()) % 20 if damage else 9
        found[conv] += []
        if hit == 0:
            continue
        text = "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text
        found[conv] += [(turn, "user" if hit == 4 else role, text)] * (2 if hit == 3 else 1)
    out = []
    for conv, turns in found.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1], t[2]))
        seen, faults, kinds = set(), [], ""
        for _, role, text in turns:
            visible = re.sub("[\x20\x09-\x0d]", "", text)
            fault = "blank" if not visible else "duplicate" if (role, text) in seen else "" if visible[-1] in ".!?" else "truncated"
            seen.add((role, text))
            faults.append(fault)
            initial = role[:1] if role[:1] in ("s", "u", "a") else "o"
            kinds += "-" if fault in ("blank", "duplicate") else initial.upper() if fault else initial
        known = [t for t, _, _ in turns if t is not None]
        pairs = [a[1][:1] + b[1][:1] for a, b in itertools.pairwise(turns)]
        cells = {0: (0, "", []), 2: (2, "I", ["user:"]), 3: (4, "II", ["user:", "assistant:"])}
        for (_, role, text), kind in zip(turns, kinds, strict=True):
            new = {}

            def offer(q, cost, audit, made, new=new):
                for k in range(3):
                    if q not in new or (cost, audit) < new[q][:2]:
                        new[q] = (cost, audit, made)
                    line, q = ("assistant:", 3) if q == 2 else ("user:", 2)
                    cost, audit, made = cost + 2, audit + "I", [*made, line]

            for p, (cost, audit, made) in cells.items():
                offer(p, cost + 3, audit + "D", made)
                if kind != "-":
                    extra = cost + kind.isupper()
                    for name, q in {0: [("system", 1), ("user", 2)], 1: [("user", 2)], 2: [("assistant", 3)], 3: [("user", 2)]}[p]:
                        if kind.lower() == name[0]:
                            offer(q, extra, audit + "K", [*made, f"{role}:{text}"])
                        if name != "system":
                            offer(q, extra + 2, audit + "R", [*made, f"{name}:{text}"])
            cells = new
        cost, audit, made = min((cells[q] for q in (0, 3) if q in cells), key=lambda c: c[:2]) if turns else (0, "", [])
        out.append((conv, max(known) - min(known) + 1 - len(set(known)) if known else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
                    sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(made).encode()).hexdigest()))
    return sorted(out, key=str)


ROWS = [(1, 0, "system", "Be brief."), (1, 1, "user", "Hi?"), (1, 2, "assistant", "Yes."), (2, 5, "assistant", "No"), (2, 9, "user", " \t\n"),
        (2, 9, "user", "Why? "), (3, None, None, None), (3, None, "user", "First."), (3, 4, "user", "First."), (3, 4, "user", "First."),
        (None, 1, "user", "Nobody."), (None, 2, "tool", "x = 1"), (5, 1, "", "No role."), (5, 2, "User", "Upper."), (5, 3, "usher", "Kept!"),
        (6, 1, "user", "日本。"), (6, 2, "assistant", "é!\x0b\x0c"), (6, 2, "system", "late."), (7, 1, "user", "long " * 50_000 + "."), (8, -3, "user", "a."),
        (8, -1, "user", "b."), (8, 7, "assistant", "b.")] + [(9, i, "ua"[i % 2] + "x", f"t{i % 3}.") for i in range(30)]


def told(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


@pytest.mark.parametrize("damage", [True, False])
def test_odd_conversations(spark, damage):
    turns = spark.createDataFrame([(*r, "x", 1) for r in ROWS * 2 if r[0] != 9 or True], SCHEMA).repartition(5)
    got = repair.repair((repair.damaged if damage else repair.as_turns)(turns), turns)
    assert got.columns == COLUMNS and told(got) == plain(ROWS * 2, damage)


def test_a_conversation_over_many_partitions(spark):
    rows = [(1, i, ["user", "assistant", "system", "user"][i * 7 % 4], f"text {i % 900}" + "." * (i % 5 > 0)) for i in range(3000)] + [(2, 0, "user", "x.")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert told(repair.repair(repair.damaged(turns), turns)) == plain(rows)


def test_a_turn_repeated_very_often(spark):
    turns = spark.range(20_000).selectExpr("1L as conv_id", "1L as turn", "'user' as role", "'same.' as text")
    row = repair.repair(repair.as_turns(turns)).first()
    assert (row.duplicate, row.illegal, row.cost) == (19_999, 19_999, 3 * 19_999 + 2) and row.audit == "K" + "D" * 19_999 + "I"


def test_no_rows(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert repair.repair(repair.damaged(none), none).collect() == []


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_op12_equals_its_sql(spark, size):
    folder = f"/root/testdata/{size}"
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{folder}/conversations.parquet'")
    answer = con.execute(ORACLES["op12_conversation_repair"])
    names = [c[0] for c in answer.description]
    got = op12_conversation_repair(spark, folder)
    assert sorted(names) == sorted(got.columns)
    assert told(got) == sorted((tuple(r[names.index(c)] for c in COLUMNS) for r in answer.fetchall()), key=str)
