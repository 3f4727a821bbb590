"""SimHash groups against brute force over all pairs."""

import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from unitlens.llm import golay_simhash as simhash
from unitlens.llm.queries import op10_golay_simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, root string, least string, key string"


def brute_fingerprint(text):
    import re

    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = re.findall("[^\x20\x09-\x0d]+", low)
    if not words:
        return 0
    grams = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(fps):
    """smallest key reachable, by key."""
    keys = sorted(fps)
    root = {k: k for k in keys}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, a in enumerate(keys):
        for b in keys[i + 1:]:
            if (fps[a] ^ fps[b]).bit_count() <= 3:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: find(k) for k in keys}


def signed(fp):
    return fp - (1 << 64) if fp >> 63 else fp


def test_code_is_perfect():
    table = simhash.indices()
    assert np.bincount(table, minlength=4096).tolist() == [2048] * 4096


def test_all_pairs_within_three_bits_meet(spark):
    rng = random.Random(5)
    fps = set()
    for _ in range(60):
        base = rng.getrandbits(64)
        fps.add(base)
        for flips in (1, 2, 3, 3, 3, 4):
            fps.add(base ^ sum(1 << b for b in rng.sample(range(64), flips)))
        fps.add(base ^ (1 << rng.randrange(23)) ^ (1 << rng.randrange(23, 46)) ^ (1 << rng.randrange(46, 64)))
    fps |= {0, 1, 7, 15, (1 << 64) - 1, (1 << 63) - 1}
    got = {(r.a, r.b) for r in simhash.links(spark.createDataFrame([(signed(f),) for f in fps], "fp long")).collect()}
    fps = sorted(fps)
    want = {tuple(sorted((signed(a), signed(b)))) for i, a in enumerate(fps) for b in fps[i + 1:]
            if (a ^ b).bit_count() <= 3}
    assert got == want


def test_a_ball_of_fingerprints_gives_few_rows(spark, monkeypatch):
    rng = random.Random(6)
    center = rng.getrandbits(64)
    ball = {center ^ 1 << i ^ 1 << j for i in range(64) for j in range(64)}  # the center and all two bits away
    while len(ball) < 3000:
        ball.add(center ^ sum(1 << b for b in rng.sample(range(64), 3)))
    far = {rng.getrandbits(64) for _ in range(50)}
    fps = spark.createDataFrame([(signed(f),) for f in ball | far], "fp long").repartition(4)
    monkeypatch.setattr(simhash, "BLOCK", 40)  # so that a key has several blocks
    links = simhash.spanning_links(fps)
    rows = links.collect()
    assert len(rows) < 300 * len(ball)
    assert all(r.a != r.b for r in rows)
    got = {r.node: r.root for r in simhash.connected_components(links).collect()}
    want = brute_groups({signed(f): f for f in ball | far})
    assert {f: got.get(f, f) for f in want} == want


def test_trees_of_a_block_have_its_components():
    rng = random.Random(7)
    for _ in range(30):
        base = [rng.getrandbits(64) for _ in range(4)]
        fps = [rng.choice(base) ^ sum(1 << b for b in rng.sample(range(12), rng.randint(0, 3))) for _ in range(60)]
        x, y = fps[:30], fps[30:]
        a, b = simhash._block_trees(np.array([signed(f) for f in x], "i8"), np.array([signed(f) for f in y], "i8"))
        tree, full = {signed(f): signed(f) for f in fps}, {signed(f): signed(f) for f in fps}

        def find(root, k):
            while root[k] != k:
                k = root[k]
            return k

        for root, pairs in ((tree, zip(a.tolist(), b.tolist(), strict=True)),
                            (full, [(signed(f), signed(g)) for f in x for g in y if (f ^ g).bit_count() <= 3])):
            for f, g in pairs:
                u, w = sorted((find(root, f), find(root, g)))
                root[w] = u
        assert {k: find(tree, k) for k in tree} == {k: find(full, k) for k in full}


def test_op10_against_brute_force(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    fps = {r.doc_id: brute_fingerprint(r.text) for r in rows}
    groups = brute_groups(fps)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in op10_golay_simhash(spark, sf_dir).collect()}
    assert got == {d: (f"{fps[d]:016x}", groups[d]) for d in fps}


def test_edges(spark):
    long = " ".join(f"w{i % 977}" for i in range(100_000))
    texts = [None, "", " \t", "A", "a", "b c", "B  C\n", long, long + " end", "tie one two three", "tie one two three"]
    rows = [(i, t, None, "s", 1, "f", "r", "l", "k") for i, t in enumerate(texts)]
    fps = {i: brute_fingerprint(t) for i, t in enumerate(texts)}
    got = {r.doc_id: (r.fp, r.component_id) for r in simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    groups = brute_groups(fps)
    assert got == {d: (signed(fps[d]), groups[d]) for d in fps}
    assert groups[1] == groups[2] == 0 and groups[4] == 3 and groups[8] == 7
    empty = simhash.near_duplicates(spark.createDataFrame([], SCHEMA))
    assert empty.collect() == []
    again = [(1, "x y z", *[None] * 7), (1, "x y z", *[None] * 7), (None, "x y z", *[None] * 7), (None, "q", *[None] * 7)]
    got = simhash.near_duplicates(spark.createDataFrame(again, SCHEMA)).orderBy(F.col("doc_id").desc_nulls_last()).collect()
    assert [(r.doc_id, r.component_id) for r in got][:2] == [(1, 1), (1, 1)]
    assert {(r.doc_id, r.component_id) for r in got[2:]} == {(None, 1), (None, None)}
