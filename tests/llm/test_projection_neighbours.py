"""Embedding links against brute force."""

import numpy as np
import pytest

from unitlens.llm import projection_neighbours as near
from unitlens.llm.queries import op3_projection_neighbours


def brute(rows):
    """(n_links, component) by row number for (vec_id, embedding, label) rows."""
    ok, units = [], []
    for _, e, label in rows:
        good = (label is not None and e is not None and len(e) > 0 and all(x is not None for x in e)
                and np.isfinite(np.array(e, "f8")).all() and np.any(np.array(e, "f8") != 0))
        ok.append(bool(good))
        v = np.array(e, "f8") / np.abs(np.array(e, "f8")).max() if good else None
        units.append(v / np.sqrt((v * v).sum()) if good else None)
    n = len(rows)
    links = [[] for _ in rows]
    for i in range(n):
        for j in range(i + 1, n):
            if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(units[i]) == len(units[j]) and units[i] @ units[j] >= 0.98:
                links[i].append(j)
                links[j].append(i)
    component = {}
    for i in range(n):
        if i in component:
            continue
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [rows[k][0] for k in seen if rows[k][0] is not None]
        for k in seen:
            component[k] = min(ids, default=None)
    return [(rows[i][0], len(links[i]), component[i]) for i in range(n)]


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_op3_against_brute_force(spark, size):
    folder = f"/root/testdata/{size}"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    got = op3_projection_neighbours(spark, folder).collect()
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == sorted(brute(rows))


def test_a_group_larger_than_windows_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(near, "BLOCK", 16)
    rng = np.random.default_rng(1)
    rows, base = [], rng.standard_normal((3, 24))
    for i in range(240):
        v = base[i % 3 if i < 30 else 0] + 0.04 * rng.standard_normal(24) * (i % 7)
        rows.append((1000 - i, [float(x) for x in v.astype("f4")], i % 2))
    got = near.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), window=8).collect()
    want = brute(rows)
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == sorted(want)
    assert max(n for _, n, _ in want) > 60


def test_edges(spark):
    v, w = [1.0, 2.0, 3.0], [1.0, 2.0, 3.01]
    rows = [(9, v, 1), (8, v, 1), (8, v, 1), (7, w, 1), (6, [2.0, 4.0, 6.0], 1), (5, v, 2), (4, v, None), (3, None, 1), (2, [], 1),
            (1, [0.0, 0.0, 0.0], 1), (0, [1.0, None, 3.0], 1), (-1, [1.0, float("nan"), 3.0], 1), (-2, [1.0, float("inf"), 3.0], 1),
            (-3, [1.0, 2.0], 1), (None, [3.0, 1.0, -1.0], 1), (None, v, 3), (11, v, 3), (12, [1e300, 2e300, 3e300], 1),
            (13, [-0.0, 1.0, 0.0], 4), (14, [0.0, 1.0, 0.0], 4)]
    docs = spark.createDataFrame([(*r, "x", 5) for r in rows], "vec_id long, embedding array<double>, label int, node string, root int")
    got = near.near_duplicates(docs).collect()
    key = lambda t: tuple((x is None, x) for x in t)
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=key) == sorted(brute(rows), key=key)
    assert near.near_duplicates(docs.where("false")).collect() == []
    alone = near.near_duplicates(docs.where("vec_id = 4")).first()
    assert (alone.n_links, alone.component_id, alone.kept) == (0, 4, True)


def test_pairs_in_a_cone(spark):
    """Vectors about one direction share most signs: what tells them apart has to be measured."""
    rng = np.random.default_rng(2)
    centre = np.zeros(64)
    centre[0] = 1.0

    def some(n):
        v = rng.standard_normal((n, 64))
        v[:, 0] = 0
        return v / np.linalg.norm(v, axis=1, keepdims=True)

    base = np.sqrt(0.9) * centre + np.sqrt(0.1) * some(700)
    aside = some(200)
    aside -= (aside * base[:200]).sum(axis=1, keepdims=True) * base[:200]
    aside /= np.linalg.norm(aside, axis=1, keepdims=True)
    twins = 0.9805 * base[:200] + np.sqrt(1 - 0.9805**2) * aside
    rows = [(i, v.tolist(), 1) for i, v in enumerate(np.concatenate([base, twins]))]
    got = near.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), window=4).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == sorted(brute(rows))
