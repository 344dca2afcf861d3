"""Components without pairs, and components that grow."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from cairnworks.functions.simhash import _signatures, md5_halves, simhash_md5
from cairnworks.operators import near
from cairnworks.operators.components import connected_components, grow_components


def union_find(links, nodes=()):
    parent = {n: n for n in nodes}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


def signatures(r, n):
    """Chains of signatures a few bits apart, repeats, and the sign bit."""
    out = []
    for _ in range(n):
        sig = r.getrandbits(64) if not out or r.random() < 0.5 else r.choice(out) ^ (1 << r.randrange(64)) ^ (r.random() < 0.5)
        out.append(sig & (2**64 - 1))
    return [s - 2**64 if s >= 2**63 else s for s in out]


def test_forests_have_the_components_of_all_pairs():
    r = random.Random(2)
    for n, radius in ((1, 3), (2, 64), (60, 3), (60, 26), (300, 2)):
        sigs = signatures(r, n)
        a, b = near.spanning_forest(np.arange(n) * 3, np.array(sigs, np.int64), radius)
        pairs = [(3 * i, 3 * j) for i in range(n) for j in range(i) if bin((sigs[i] ^ sigs[j]) & (2**64 - 1)).count("1") <= radius]
        want = union_find(pairs)
        assert union_find(zip(a.tolist(), b.tolist(), strict=True)) == want
        assert len(a) == len(want) - len(set(want.values()))


def test_cross_links_are_as_few_as_the_components_they_join():
    r = random.Random(4)
    for n, radius in ((1, 64), (40, 3), (150, 4), (60, 40)):
        sigs = np.array(signatures(r, 2 * n), np.int64)
        left, right = np.arange(n), np.arange(n, 2 * n)
        inside = [e for t in (left, right) for e in zip(*(z.tolist() for z in near.spanning_forest(t, sigs[t], radius)), strict=True)]
        a, b = (z.tolist() for z in near.cross_links(left, sigs[left], right, sigs[right], radius))
        both = union_find([*inside, *zip(a, b, strict=True)], range(2 * n))
        whole = union_find(zip(*(z.tolist() for z in near.spanning_forest(np.arange(2 * n), sigs, radius)), strict=True), range(2 * n))
        assert both == whole and set(a) <= set(left) and set(b) <= set(right)
        assert len(a) == len(set(union_find(inside, range(2 * n)).values())) - len(set(whole.values()))


def test_block_links_join_what_block_pairs_join(spark):
    r = random.Random(3)
    sigs = signatures(r, 240)
    rows = [(f"b{r.randrange(2)}", f"h{i:03d}", i, s) for i, s in enumerate(sigs)] + [("b0", f"h{i:03d}", i, s) for i, s in enumerate(sigs[:40])]
    rows += [("b1", f"h{i:03d}", i, sigs[5]) for i in range(300, 420)]  # a third in one signature
    keyed = spark.createDataFrame(rows, "block string, hash string, node long, sig long")
    want = {r["node"]: r["component"] for r in connected_components(near.block_pairs(keyed.select("block", "hash", "sig"), 6).select(F.substring("a", 2, 3).cast("long").alias("src"), F.substring("b", 2, 3).cast("long").alias("dst"))).collect()}
    for tile in (7, 50, 4096):
        links = [tuple(x) for x in near.block_links(keyed.select("block", "node", "sig"), 6, tile).collect()]
        assert union_find(links) == want
        tiles = -(-320 // tile)
        assert len(links) <= 3 * len(rows) * (tiles + 1)
    assert near.block_links(keyed.select("block", "node", "sig").limit(0), 6).count() == 0


def test_only_tiles_with_fresh_members_are_compared(spark):
    r = random.Random(5)
    rows = [("b", i, s, i >= 90) for i, s in enumerate(signatures(r, 100))]
    keyed = spark.createDataFrame(rows, "block string, node long, sig long, fresh boolean")
    old = near.block_links(keyed.where("not fresh").drop("fresh"), 5, 10).collect()
    new = near.block_links(keyed, 5, 10).collect()
    every = near.block_links(keyed.drop("fresh"), 5, 10).collect()
    assert union_find([*map(tuple, old), *map(tuple, new)]) == union_find(map(tuple, every))
    assert near.block_links(keyed.withColumn("fresh", F.lit(False)).withColumn("sig", F.col("node")), 64, 10).count() == 0


def test_ten_batches_grow_to_the_rebuilt_components(spark):
    r = random.Random(7)
    edges = [(r.randrange(-60, 60), r.randrange(300)) for _ in range(170)] + [(5, 5), (None, 3)]
    known, merged = spark.createDataFrame([], "node long, component long"), 0
    for k in range(10):
        batch = spark.createDataFrame(edges[k::10] + edges[k::20], "src long, dst long")
        changed, merges = grow_components(known, batch)
        rows = {x["node"]: x["component"] for x in changed.collect()}
        into = {x["component"]: x["into"] for x in merges.collect()}
        before = {x["node"]: x["component"] for x in known.collect()}
        after = before | rows
        assert after == union_find([e for e in sum((edges[j::10] for j in range(k + 1)), []) if None not in e])
        assert all(into[before[n]] == c for n, c in rows.items() if n in before) and all(c in set(before.values()) for c in into)
        assert {n for n in rows if n in before} == {n for n, c in before.items() if c in into}  # nothing else is touched
        merged += len(into)
        known = spark.createDataFrame(sorted(after.items()), "node long, component long")
    assert merged > 10
    same, none = grow_components(known, known.limit(0).toDF("src", "dst"))
    assert same.count() == 0 and none.count() == 0


def test_fresh_documents_grow_the_versions_known_before(spark):
    r = random.Random(9)
    sigs = signatures(r, 80)
    paths = spark.createDataFrame([(f"h{i}", f"d{i % 3}/f{i}.txt", "active" if i % 9 else "purgatory") for i in range(80)], "hash string, path string, status string")
    rows = spark.createDataFrame([(f"h{i}", s, i % 4 == 0) for i, s in enumerate(sigs)], "hash string, sig long, fresh boolean")
    known = connected_components(near.document_links(paths, rows.where("not fresh").drop("fresh")), "a", "b")
    changed, _ = near.grown_documents(paths, rows, known)
    grown = near.named(known.join(changed, "node", "left_anti").union(changed), rows.select("hash"))
    whole = near.components_of(near.document_pairs(paths, rows))
    assert sorted(map(tuple, grown.collect())) == sorted(map(tuple, whole.collect())) and whole.count() > 20


def test_signatures_shuffle_no_texts_and_no_shingles(spark):
    rows = spark.createDataFrame([(1, "a b"), (2, None)], "k long, t string")
    plan = simhash_md5(rows, "k", "t")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan


def test_md5_side_by_side_and_signatures_in_pieces():
    r = random.Random(6)
    data = r.randbytes(9_000)
    lengths = [*range(200), *(r.randrange(60) for _ in range(300)), 4_000]
    starts = [r.randrange(len(data) - n + 1) for n in lengths]
    got = md5_halves(np.frombuffer(data, np.uint8), np.array(starts), np.array(lengths)).tolist()
    assert got == [int.from_bytes(hashlib.md5(data[s : s + n]).digest()[:8], "big") for s, n in zip(starts, lengths, strict=True)]

    texts = [" ".join("xyü"[r.randrange(3)] * r.randrange(1, 90) for _ in range(n)) for n in (0, 1, 3, 4, 5, 400, 0, 700)]
    whole = _signatures(pa.array(texts), 4, 1 << 20).tolist()
    assert _signatures(pa.array(["", *texts])[1:], 4, 10).tolist() == whole and whole[0] == whole[6] == 0 and len(set(whole)) == 7


def test_pairs_come_from_tiles_with_every_distance(spark):
    """Rows of a block aren't joined to each other; the least and greatest signatures and repeated hashes are held."""
    r = random.Random(8)
    sigs = [*signatures(r, 120), 0, -1, -(2**63), 2**63 - 1, 0, 0]
    rows = [(f"b{i % 2}", f"h{i:03d}", s) for i, s in enumerate(sigs)] + [("b0", "h000", sigs[1]), ("b1", "h000", sigs[0]), (None, "h001", 0), (None, "h002", 0)]
    want = set()
    for x in rows:
        for y in rows:
            d = bin((x[2] ^ y[2]) & (2**64 - 1)).count("1")
            if x[0] and x[0] == y[0] and x[1] < y[1] and d <= 26:
                want.add((x[1], y[1], d))
    for tile in (9, 4096):
        found = near.block_pairs(spark.createDataFrame(rows, "block string, hash string, sig long"), 26, tile)
        assert sorted(map(tuple, found.collect())) == sorted(want)
        assert "bit_count" not in found._jdf.queryExecution().executedPlan().toString()


def test_a_tile_finds_its_components_once(spark, monkeypatch):
    """Two tiles that meet are told their components, they don't look for them again."""
    r = random.Random(9)
    sigs = np.array(signatures(r, 80), np.int64)
    left, right = np.arange(40), np.arange(40, 80)
    roots = [near._roots(sigs[t], 5) for t in (left, right)]
    want = [x.tolist() for x in near.cross_links(left, sigs[left], right, sigs[right], 5)]
    monkeypatch.setattr(near, "_roots", None)
    assert [x.tolist() for x in near.cross_links(left, sigs[left], right, sigs[right], 5, *roots)] == want
