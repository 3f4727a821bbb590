"""The prefix trie against plain recursion and its SQL."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest

from unitlens.llm import prefix_trie as trie
from unitlens.llm.queries import op13_prefix_trie
from unitlens.llm.sql import ORACLES

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string, depth string, node int"


def grouped(rows):
    found = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            found[conv].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [t[2:] for t in sorted(ts)] for c, ts in found.items()}


def regrafted(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        out[c] = convs.get(base, [])[:h] + own[h:]
    return out


def by_recursion(convs):
    members, children = defaultdict(list), defaultdict(set)
    for c, turns in sorted(convs.items()):
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
            if d:
                children[tuple(turns[:d - 1])].add(tuple(turns[:d]))
    out, sums = [], {}
    for node in sorted(members, key=len, reverse=True):
        below = [sums[k] for k in children[node]]
        own = (len(members[node]) - 1) * len(node[-1][1]) if node else 0
        sums[node] = (sum(x for x, _ in below) or 1, own + sum(y for _, y in below))
        ends = ",".join(str(c) for c in sorted(members[node]) if len(convs[c]) == len(node))
        out.append((min(members[node]), len(node), min(members[node[:-1]]) if node else None, len(members[node]), len(children[node]),
                    *sums[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def told(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


def some_rows():
    random.seed(5)
    rows = [(c, i, random.choice(["user", "assistant", None]), random.choice(["a", "bb", "ccc", None, "é日"]), "x", 1)
            for c in range(60) for i in range(random.choice([1, 2, 3, 6, 9]))]
    rows += [(c, i, "user", f"copy {i}", "x", 1) for c in range(300, 340) for i in range(4)]  # a group of copies
    rows += [(c, 0, "user", "hi", "x", 1) for c in (501, 502)] + [(None, 1, "user", "lost", "x", 1), (-205, 1, "user", "minus", "x", 1)]
    return rows + [(700, None, "user", "b", "x", 1), (700, None, "user", "a", "x", 1), (700, 1, "u" * 9, "long " * 30_000, "x", 1), (700, 1, "user", "", "x", 1)] * 2


@pytest.mark.parametrize("residual", [2, 40, 1 << 14])
def test_odd_conversations(spark, residual):
    rows = some_rows()
    turns = trie.placed(spark.createDataFrame(rows, SCHEMA).repartition(6))
    got = trie.trie(*trie.regrafted(turns), residual=residual)
    assert got.columns == COLUMNS and told(got) == by_recursion(regrafted(grouped(rows)))


def test_long_conversations_go_slice_by_slice(spark, monkeypatch):
    monkeypatch.setattr(trie, "SLICE", 7)
    monkeypatch.setattr(trie, "BLOCK", 16)
    rows = [(c, i, "user", f"t{i if i < 40 + c else (i, c)}", "x", 1) for c in range(1, 6) for i in range(60)] + [(9, i, "user", "same", "x", 1) for i in range(300)]
    assert told(trie.trie(*trie.plain(trie.placed(spark.createDataFrame(rows, SCHEMA))), residual=10)) == by_recursion(grouped(rows))


def test_a_parent_of_very_many(spark):
    turns = spark.range(6000).selectExpr("id as conv_id", "0L as turn", "'user' as role", "cast(id div 2 as string) as text")
    rows = told(trie.trie(*trie.plain(trie.placed(turns)), residual=500))
    top = next(r for r in rows if r[1] == 0)
    assert len(rows) == 3001 and top[3:7] == (6000, 3000, 3000, sum(len(str(i)) for i in range(3000)))
    assert all(r[0] % 2 == 0 and r[3] == 2 and r[5] == 1 for r in rows if r[1] == 1)


def test_ranks_of_a_long_list(spark):
    n = 5000
    at = [(i * 2347) % n for i in range(n)]
    rows = [(at[i], at[i - 1] if i else None, at[i + 1] if i + 1 < n else None, 1) for i in range(n)]
    arcs = spark.createDataFrame(rows, "arc long, before long, after long, back long")
    got = {r.arc: r["rank"] for r in trie.ranked(arcs, residual=300).collect()}
    assert got == {a: i for i, a in enumerate(at)}


def test_no_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert trie.trie(*trie.regrafted(trie.placed(none))).collect() == []


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_op13_equals_its_sql(spark, size):
    folder = f"/root/testdata/{size}"
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{folder}/conversations.parquet'")
    answer = con.execute(ORACLES["op13_prefix_trie"])
    names = [c[0] for c in answer.description]
    got = op13_prefix_trie(spark, folder)
    assert sorted(names) == sorted(got.columns)
    assert told(got) == sorted((tuple(r[names.index(c)] for c in COLUMNS) for r in answer.fetchall()), key=str)
