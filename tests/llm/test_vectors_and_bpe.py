"""Clustering, vector codes and byte-pair encoding against plain versions."""

from __future__ import annotations

import hashlib
import math
import random
from collections import defaultdict
from functools import lru_cache

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cairnworks.llm import bpe, centroids, vector_codes
from cairnworks.llm.centroids import Annuli

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "vec_id long, embedding array<float>, label int, v string, cluster int, slot string, distance string, x string, key string"


@lru_cache
def held(make):
    return make(PATH)


@pytest.fixture(scope="module")
def library():
    return held(Tokenizer.from_file)


@pytest.fixture(scope="module")
def odd_vectors(spark):
    """Few distinct vectors, so that distances tie; repeats, nulls, other lengths, and columns whose names the operators use."""
    r = random.Random(3)
    some = lambda: [r.choice([-0.5, -0.001, 0.0, 0.25]) if i < 3 else 0.125 * (i % 3) for i in range(64)]
    rows = [(i, some(), i % 4 if i % 5 else None) for i in range(300)]
    rows += [(i, rows[0][1], 1) for i in range(300, 420)]  # a third of all rows is one vector
    rows += [(7, rows[1][1], 2), (7, rows[2][1], 2), (None, some(), None), (None, some(), 3)]
    rows += [(900, None, 1), (901, [], 1), (902, [0.1] * 63, 1), (903, [0.1] * 63 + [None], 1), (904, [0.1] * 63 + [math.inf], 1), (905, [0.1] * 63 + [math.nan], 1), (906, [0.1] * 65, None)]
    return spark.createDataFrame([(*row, *"a1bcde"[:1], 5, *"fghi") for row in rows], SCHEMA).repartition(6)


def plain_vectors(df, scale):
    rows = [(r["vec_id"], r["label"], r["embedding"]) for r in df.select("vec_id", "label", "embedding").collect()]
    rows = [(i, label, e) for i, label, e in rows if e is not None and len(e) == 64 and all(x is not None and math.isfinite(x) for x in e)]
    return [(i, label, [math.floor(scale * x) for x in e]) for i, label, e in rows]


def apart(a, b):
    return sum((x - y) ** 2 for x, y in zip(a, b, strict=True))


def nearest(v, among):
    return min((apart(v, c), k) for k, c in enumerate(among))


def means(groups, among):
    return [[sum(col) // len(groups[k]) for col in zip(*groups[k], strict=True)] if groups[k] else c for k, c in enumerate(among)]


def plain_clusters(rows, k=8, rounds=10):
    drawn = sorted(rows, key=lambda r: (r[0] is None, "" if r[0] is None else hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[2]))
    among = [r[2] for r in drawn[:k]]
    for _ in range(rounds):
        groups = defaultdict(list)
        for _, _, v in rows:
            groups[nearest(v, among)[1]].append(v)
        among = means(groups, among)
    found = [(i, *nearest(v, among)) for i, _, v in rows]
    total = defaultdict(int)
    for _, d, c in found:
        total[c] += d
    told = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in among]
    return sorted(((i, c, d, total[c], sum(total.values()), told[c]) for i, d, c in found), key=repr)


def test_clusters_equal_plain_ones(spark, odd_vectors):
    got = centroids.with_inertia(*centroids.cluster_vectors(odd_vectors))
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    want = plain_clusters(plain_vectors(odd_vectors, 1024))
    assert sorted(map(tuple, got.collect()), key=repr) == want and len(want) == 424


def test_few_and_no_vectors(spark, odd_vectors):
    few = odd_vectors.where("vec_id < 5")
    got = centroids.with_inertia(*centroids.cluster_vectors(few))
    assert sorted(map(tuple, got.collect()), key=repr) == plain_clusters(plain_vectors(few, 1024))
    for none in (odd_vectors.limit(0), odd_vectors.where("vec_id between 900 and 906")):
        assert centroids.with_inertia(*centroids.cluster_vectors(none)).count() == 0
        assert vector_codes.with_label_error(vector_codes.encode_vectors(none)[0]).count() == 0
    rows, books = vector_codes.encode_vectors(few)
    assert rows.count() == 5 and books.shape == (8, 5, 8) and rows.agg(F.sum("error")).first()[0] == 0
    huge = few.withColumn("embedding", F.transform("embedding", lambda c: c * 1e30))
    with pytest.raises(Exception, match="too large"):
        centroids.cluster_vectors(huge)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(-3, 3), min_size=3, max_size=3), min_size=1, max_size=12), st.lists(st.lists(st.integers(-40, 40), min_size=3, max_size=3), min_size=1, max_size=30))
def test_annuli_find_the_nearest(among, vectors):
    """With centroids that repeat and lie on the edges of annuli."""
    number, distance = Annuli(np.array(among, np.int64)).nearest(np.array(vectors, np.int64))
    assert list(zip(distance.tolist(), number.tolist(), strict=True)) == [nearest(v, among) for v in vectors]


def test_annuli_leave_centroids_out():
    r = np.random.default_rng(1)
    among = r.integers(-1000, 1000, (200, 8))
    vectors = among[:50] + r.integers(-3, 3, (50, 8))
    first, end = Annuli(among).candidates(vectors)
    assert (end - first).min() >= 1 and (end - first).mean() < 190


def test_codes_equal_plain_ones(spark, odd_vectors):
    table, books = vector_codes.encode_vectors(odd_vectors)
    rows = plain_vectors(odd_vectors, 4096)
    first = [v for _, _, v in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[2]))[:16]]
    plain = []
    for p in range(8):
        among, cut = [v[8 * p : 8 * p + 8] for v in first], [v[8 * p : 8 * p + 8] for _, _, v in rows]
        for _ in range(6):
            groups = defaultdict(list)
            for v in cut:
                groups[nearest(v, among)[1]].append(v)
            among = means(groups, among)
        plain.append(among)
    assert books.tolist() == plain
    coded = [(i, label, [nearest(v[8 * p : 8 * p + 8], plain[p]) for p in range(8)]) for i, label, v in rows]
    error = defaultdict(int)
    for _, label, parts in coded:
        error[label] += sum(d for d, _ in parts)
    want = [(i, "".join(f"{e:02x}" for _, e in parts), sum(d for d, _ in parts), error[label]) for i, label, parts in coded]
    got = vector_codes.with_label_error(table).select("vec_id", "code", "error", "label_error").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr) and len(want) == 424
    assert vector_codes.books_digest(books) == hashlib.sha256(",".join(str(x) for part in plain for e in part for x in e).encode()).hexdigest()


def test_more_blocks_than_one_a_task(spark, odd_vectors, monkeypatch):
    monkeypatch.setattr(vector_codes, "BLOCK", 7)
    blocks = vector_codes.to_blocks(vector_codes.integer_vectors(odd_vectors, 4096, 64, "vec_id", "label"), 64)
    sizes = [len(r["ids"]) for r in blocks.collect()]
    assert sum(sizes) == 424 and max(sizes) <= 7


def test_ids_and_texts_equal_the_library(spark, odd_docs, no_docs, library):
    r = random.Random(8)
    told = ["It's <|endoftext|> or <|STARTOFTEXT|>", "<|<|startoftext|><|endoftext|>", "ΑΣ Σ ǅ İ é é", "a\x85b c", "-" * 5000, "".join(r.choice("thein") for _ in range(9000)), "word " * 70_000 + "日本" * 9]
    docs = odd_docs.select("doc_id", "text", F.col("t").alias("ids"), F.lit(1).alias("decoded")).unionByName(spark.createDataFrame([(500 + i, t, None, 1) for i, t in enumerate(told)], "doc_id long, text string, ids string, decoded int"))
    got = bpe.decode(bpe.encode(docs, PATH), PATH)
    want = []
    for row in docs.collect():
        ids = library.encode(row["text"] or "", add_special_tokens=False).ids
        want.append((row["doc_id"], ids, library.decode(ids, skip_special_tokens=False)))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert bpe.decode(bpe.encode(no_docs, PATH), PATH).count() == 0
    none = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert [r["decoded"] for r in bpe.decode(none, PATH).orderBy("doc_id").collect()] == ["", ""]


@settings(max_examples=150, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=200))
def test_any_text_is_encoded_as_the_library_does(text):
    assert held(bpe.RankEncoder).encode([text])[0].tolist() == held(Tokenizer.from_file).encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("n", [1, 2, bpe.SHORT - 1, bpe.SHORT, bpe.SHORT + 1, 400])
def test_scan_and_heap_merge_alike(n):
    table, r = bpe.rank_table(PATH), random.Random(n)
    for alphabet in (b"ab", b"w", b"thein", bytes(range(97, 123)), bytes(range(256))):
        word = bytes(r.choice(alphabet) for _ in range(n))
        parts = [table.inner[b] for b in word[:-1]] + [table.last[word[-1]]]
        assert table._scan(list(parts)) == table._heap(list(parts))


def test_byte_level_files_with_a_decoder_round_trip(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    told = ["Some  text,\n\twith Ünïcode 日本 and 42's", "", "x" * 300]
    docs = spark.createDataFrame(list(enumerate(told)), "doc_id long, text string")
    model = Tokenizer.from_file(path)
    rows = bpe.decode(bpe.encode(docs, path), path).orderBy("doc_id").collect()
    assert [r["decoded"] for r in rows] == told and [r["ids"] for r in rows] == [model.encode(t, add_special_tokens=False).ids for t in told]


def test_other_models_are_refused(tmp_path):
    (tmp_path / "w.json").write_text('{"model": {"type": "WordLevel", "vocab": {}}, "added_tokens": []}')
    with pytest.raises(ValueError):
        bpe.RankTable(str(tmp_path / "w.json"))
